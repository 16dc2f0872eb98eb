"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

1. Each whole text becomes its set of distinct word shingles (64-bit hashes). Texts of equal sets are one class, so
   exact copies cost one row each and never form pairs.
2. One hash of each shingle gives both its bin (top bits) and its rank in the bin; empty bins borrow from full ones by
   optimal densification. Bands of the signature are bucket keys.
3. In each bucket only a star is compared: its centre, the member with most company over all its buckets, against
   every other member. Pairs pass a length bound and a signature estimate, then the exact sets decide.
4. What the stars leave open is settled exactly without all pairs. Under a centre with at most ``FEW`` members outside
   its component, each of those is compared with all of the centre's members. Other centres form families by shared
   members. Two sets of a family that reach the limit share a shingle that few of the family have and its middle lacks,
   or else both lie almost whole in the other shingles, which their sizes show: only such pairs are compared. So a
   large group of copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Saved, map_batches, small_side, text_steps
from .words import hashes_of, lowered, mixed, shingles_of, texts_of, words_of

BINS = 512
ROWS_PER_BAND = 9
BANDS = 56
SHINGLE_WORDS = 5
#: Up to so many open members of a centre are compared with all of its members; a shingle is rare up to so many members.
FEW, RARE = 16, 16
#: Pairs whose signatures agree in a share of bins so far below the limit are not compared: five standard errors.
MARGIN = 0.08

_TRIES = np.random.Generator(np.random.PCG64(77)).integers(0, BINS, (4096, BINS))
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_SIGNED = "doc_id long, n_shingles int, fp1 long, fp2 long, bands array<long>, sig array<byte>"


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each row's ascending shingles; rows without shingles stay all ones.

    As shingles are ascending, the first of each bin is the bin's minimum. An empty bin j tries the bins of column j
    of a fixed random table until one is full; the table is the same for all rows, so equal sets agree and the chance
    that two rows agree in a bin stays their Jaccard similarity.
    """
    rows = len(bounds) - 1
    sig, full = np.full((rows, BINS), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((rows, BINS), bool)
    if len(shingles):
        row, bin_ = np.repeat(np.arange(rows), np.diff(bounds)), (shingles >> _SHIFT).astype(np.int64)
        cell = row * BINS + bin_
        first = np.concatenate(([True], cell[1:] != cell[:-1]))
        sig.ravel()[cell[first]] = shingles[first]
        full.ravel()[cell[first]] = True
    row, bin_ = np.nonzero(~full & full.any(1)[:, None])
    for tries in _TRIES:
        if not len(row):
            break
        got = full[row, tries[bin_]]
        sig[row[got], bin_[got]] = sig[row[got], tries[bin_[got]]]
        row, bin_ = row[~got], bin_[~got]
    for r, b in zip(row.tolist(), bin_.tolist(), strict=True):
        sig[r, b] = sig[r, np.flatnonzero(full[r])[0]]
    return sig


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in text_steps(batch):
            texts = lowered(texts_of(step.column("text")))
            words = words_of(texts)
            shingles, bounds = shingles_of(hashes_of(texts.data, words), words.firsts, SHINGLE_WORDS)
            n, sums = np.diff(bounds), np.zeros((2, len(bounds)), np.uint64)
            for k in range(2):
                whole = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(shingles + np.uint64(k)), dtype=np.uint64)))
                sums[k, :-1] = whole[bounds[1:]] - whole[bounds[:-1]]
            sig = signatures(shingles, bounds)
            bands = np.zeros((len(n), BANDS), np.uint64)
            for k in range(BANDS):
                key = np.full(len(n), np.uint64(k))
                for j in range(ROWS_PER_BAND):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * ROWS_PER_BAND + j])
                bands[:, k] = key
            yield pa.record_batch(
                [
                    step.column("doc_id").cast(pa.int64()),
                    pa.array(n.astype(np.int32)),
                    pa.array(sums[0, :-1].view(np.int64)),
                    pa.array(sums[1, :-1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BINS), pa.array(sig.astype(np.uint8).ravel().view(np.int8))),
                ],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in text_steps(batch):
            texts = lowered(texts_of(step.column("text")))
            words = words_of(texts)
            shingles, bounds = shingles_of(hashes_of(texts.data, words), words.firsts, SHINGLE_WORDS)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.record_batch([step.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "shingles"])


def _agreement(a: str, b: str) -> Column:
    equal = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(equal, F.lit(0), lambda n, x: n + x)


def _alike(na: str, nb: str, sa: str, sb: str, percent: int) -> Column:
    """Whether sizes and signatures leave it possible that two sets reach the limit."""
    sizes = 100 * F.least(na, nb).cast("long") >= percent * F.greatest(na, nb).cast("long")
    return sizes & (_agreement(sa, sb) >= int((percent / 100 - MARGIN) * BINS))


def _confirmed(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose exact sets have 100 * intersection >= percent * union."""
    side = lambda c: signed.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(_alike("na", "nb", "sa", "sb", percent)).select("a", "b", "na", "nb")
    near = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a")
    near = near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    return near.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _open_pairs(stars: DataFrame, grouped: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, among the members (x) of each centre (c)."""
    own = lambda c: grouped.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"k{c}"))
    rows = stars.join(own("x"), "x", "left").join(own("c"), "c", "left")
    rows = rows.select("c", "x", F.coalesce("kx", "x").alias("k"), (F.coalesce("kx", "x") != F.coalesce("kc", "c")).alias("open"))
    sizes = rows.groupBy("c").agg(F.count_if("open").alias("n_open"), F.count("*").alias("n"))
    rows = Saved(rows.join(sizes.where("n_open > 0 AND n > 2"), "c"), "open").df
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    other = lambda df: df.select("c", F.col("x").alias("y"), F.col("k").alias("ky"))

    few = rows.where(F.col("n_open") <= FEW)
    by_few = few.where("open AND x <> c").select("c", "x", "k").join(other(few.where("x <> c")), "c").where("k <> ky")

    # centres that share members make one family, so that each member's shingles are looked at once
    many = rows.where(F.col("n_open") > FEW)
    family = connected_components(many.where("c <> x"), "c", "x")
    own_family = lambda c: family.df.select(F.col("doc_id").alias(c), F.col("component_id").alias("f"))
    middle = many.select("c", "n").distinct().join(own_family("c"), "c").groupBy("f").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("m"))
    members = many.select("x", "k").distinct().join(own_family("x"), "x")
    settled = middle.join(members.select(F.col("x").alias("m"), F.col("k").alias("km")), "m").join(sets.select(F.col("doc_id").alias("m"), F.col("shingles").alias("usual")), "m").select("f", "km", "usual")
    members = members.join(settled, "f").join(sets.select(F.col("doc_id").alias("x"), "shingles"), "x")
    members = members.select("f", "x", "k", (F.col("k") != F.col("km")).alias("open"), F.size("shingles").alias("n"), F.array_except("shingles", "usual").alias("unusual"))
    members = Saved(members, "members").df
    each = members.select("f", "x", "k", "open", F.explode("unusual").alias("h"))
    each = Saved(each.join(each.groupBy("f", "h").agg(F.count("*").alias("df"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.bit_xor(F.xxhash64("x")).alias("who")), ["f", "h"]), "shingles").df
    rare = each.where((F.col("df") <= RARE) & (F.col("lo") < F.col("hi")))
    # shingles of the same members give the same pairs, so one of them stands for all
    rare = rare.join(rare.groupBy("f", "who", "df").agg(F.min("h").alias("h")).select("f", "h"), ["f", "h"]).select("f", "h", "x", "k", "open")
    rare = Saved(rare.join(signed.select(F.col("doc_id").alias("x"), "n_shingles", "sig"), "x"), "rare").df
    theirs = rare.select("f", "h", F.col("x").alias("y"), F.col("k").alias("ky"), F.col("n_shingles").alias("ny"), F.col("sig").alias("sy"))
    by_rare = rare.where("open").join(theirs, ["f", "h"]).where("k <> ky").where(_alike("n_shingles", "ny", "sig", "sy", percent))
    # without a rare shingle in common, both must have percent / (100 + percent) of the two sizes in other shingles
    scarce = each.where(F.col("df") <= RARE).groupBy("f", "x").agg(F.count("*").alias("r"))
    held = members.select("f", "x", "k", "open", "n").join(scarce, ["f", "x"], "left").withColumn("i", F.col("n") - F.coalesce("r", F.lit(0)))
    held = Saved(held.withColumn("reach", F.floor(F.col("i") * (100 + percent) / F.lit(percent)) - F.col("n")), "held").df
    others = held.select("f", F.col("x").alias("y"), F.col("k").alias("ky"), F.col("n").alias("ny"), F.col("reach").alias("to_y"))
    least = held.groupBy("f").agg(F.min("n").alias("shortest"))
    by_size = held.where("open").join(least, "f").where("reach >= shortest").join(others, "f").where("k <> ky AND ny <= reach AND n <= to_y")
    return pair(by_few).unionByName(pair(by_rare)).unionByName(pair(by_size)).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text; further columns are ignored).

    component_id is the least doc_id reachable over links; kept means doc_id = component_id. Null, empty and blank
    texts have no shingles and stay alone. Rows that repeat a doc_id must repeat its text too; each gives a row. Rows
    with a null doc_id are linked with nothing and keep a null component_id and kept = true. An empty table gives an
    empty result. Word shingles take five words and links a similarity of 0.8 or more, 0.85 unless asked otherwise.
    """
    if percent < 80:
        raise ValueError("links need a similarity of 0.8 or more")
    every = Saved(map_batches(docs.select("doc_id", "text"), _sign, _SIGNED), "signed")
    classes = every.df.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    reps = Saved(every.df.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "sig"), "classes")
    buckets = reps.df.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = Saved(buckets.join(shared, ["band", "bucket"]), "members")
    company = Saved(members.df.groupBy("doc_id").agg(F.sum("size").alias("company")), "company")
    texts = docs.select("doc_id", "text").join(small_side(company.df.select("doc_id")), "doc_id", "left_semi")
    sets = Saved(map_batches(texts, _sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")

    ranked = members.df.join(company.df, "doc_id")
    centres = ranked.groupBy("band", "bucket").agg(F.max(F.struct("company", -F.col("doc_id"))).alias("top"))
    stars = members.df.join(centres.select("band", "bucket", (-F.col("top.col2")).alias("c")), ["band", "bucket"])
    stars = Saved(stars.select("c", F.col("doc_id").alias("x")).distinct(), "stars")
    pairs = stars.df.where("c <> x").select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct()
    links = Saved(_confirmed(pairs, reps.df, sets.df, percent), "links")
    grouped = connected_components(links.df)
    more = Saved(_confirmed(_open_pairs(stars.df, grouped.df, reps.df, sets.df, percent), reps.df, sets.df, percent), "links")
    if not more.df.isEmpty():
        again = connected_components(links.df.unionByName(more.df))
        grouped.drop()
        grouped = again

    merged = classes.withColumnRenamed("doc_id", "rep").join(grouped.df.withColumnRenamed("doc_id", "rep"), "rep", "left")
    merged = merged.select("fp1", "fp2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = every.df.select("doc_id", "n_shingles", "fp1", "fp2").join(merged, ["fp1", "fp2", "n_shingles"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull() | F.col("component_id").isNull()
    out = out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    for table in (members, company, sets, stars, links, more, reps):
        table.drop()
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
