"""Mixing to target weights: soft domain membership, and document rates by distributed projected-gradient least squares.

1. A softmax classifier, fitted on a bounded sample of labelled documents (SAMPLE), gives every document a posterior over
   the domains, in whole GRID parts. One pass stores a small row a document: identifier, tokens, parts.
2. With tokens t, posteriors p and rates r, the expected tokens of domain d are sum t*p[d]*r. Rates minimise the squared
   gaps to the targets, each gap against the tokens that its domain has at rates of 1, plus RIDGE times the token-weighted
   squared distance of r from 1, subject to r >= 0. So a domain with few tokens is held to its target as the others are.
3. Documents of equal posteriors share a rate, so their tokens are summed once, into at most one row for each posterior.
   A rate after k accelerated projected-gradient steps depends on its posterior and the k gap vectors so far, so each step
   is one sum of a domain-sized vector over those rows; tasks replay the steps and keep no state. Lost executors cost a
   recomputation of their part only, and what reaches the driver is a number a domain and partition sum.
4. Steps go on until the rates no longer move: the token-weighted mean move of a projected-gradient step, which is zero
   at the optimum and nowhere else, falls under MOVED. The result says how far it came (``Mixture.moved``).

A token is a word, or with ``tokenizer`` a token of that public tokenizer, which costs an encoding of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Saved, map_batches, remove, small_side, text_steps
from .tokens import id_cache, public_path
from .toxicity import features_of
from .words import mixed, texts_of, words_of

#: Labelled documents that the classifier is fitted on, at most, by domain; features that it keeps.
SAMPLE, FEATURES = 2_500, 768
#: Parts of a posterior, weight of the distance from 1, mean move at which steps end, and steps after which they fail.
GRID, RIDGE, MOVED, MOST_STEPS = 1024, 1e-3, 5e-5, 2_000
#: Domains of the given labels, and the share of all tokens that each shall have.
TARGETS = {"good": 0.92, "poor": 0.08, "toxic": 0.0}
_MASK = (1 << 20) - 1


def label_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "poor").when(F.col(quality) == 1, "good")


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, domain) of those ``docs`` whose doc_id ``labels`` (doc_id, quality, toxic) gives a domain."""
    domains = labels.select("doc_id", label_domain().alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    return docs.select("doc_id", "text").join(small_side(domains), "doc_id")


def domain_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of words and their beginnings in lower case, and of word endings as written."""
    kinds, _ = features_of(column)
    texts = texts_of(column)
    words = words_of(texts)
    rows, size = np.repeat(np.arange(len(column)), np.diff(words.firsts)), words.ends - words.starts
    value = np.full(len(rows), np.uint64(977))
    for k in range(1, 4):
        long_enough = size >= k
        rows, size, value, ends = rows[long_enough], size[long_enough], value[long_enough], (words.ends if k == 1 else ends)[long_enough]
        value = mixed(value * np.uint64(0x100000001B3) + texts.data[ends - k])
        kinds.append((rows, value))
    return kinds


def present(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    maybe = np.zeros(_MASK + 1, bool)
    maybe[(keys & np.uint64(_MASK)).astype(np.int64)] = True
    cells = [np.zeros(0, np.int64)]
    for rows, hashes in domain_features(column) if len(keys) else ():
        hit = np.flatnonzero(maybe[(hashes & np.uint64(_MASK)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, hashes[hit]), len(keys) - 1)
        same = keys[at] == hashes[hit]
        cells.append(np.unique(rows[hit[same]] * len(keys) + at[same]))
    cell = np.unique(np.concatenate(cells))
    return cell // max(1, len(keys)), cell % max(1, len(keys))


class DomainModel(NamedTuple):
    domains: tuple[str, ...]
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, column: pa.Array) -> np.ndarray:
        rows, at = present(column, self.keys)
        z = np.stack([np.bincount(rows, self.weights[at, d], len(column)) for d in range(len(self.domains))], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _domain_frequency(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                domain = step.column("domain").to_numpy(zero_copy_only=False)
                for rows, hashes in domain_features(step.column("text")):
                    order = np.lexsort((hashes, rows))
                    rows, hashes = rows[order], hashes[order]
                    first = np.ones(len(rows), bool)
                    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                    for d in range(n):
                        found, count = np.unique(hashes[first & (domain[rows] == d)], return_counts=True)
                        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.full(len(found), d, np.int32)), pa.array(count)], names=["feature", "domain", "n"])

    return run


def fit_domains(labelled: DataFrame, domains: tuple[str, ...]) -> DomainModel:
    """A classifier from ``labelled`` (doc_id, text, domain): at most SAMPLE documents a domain, first by a hash of doc_id.

    Domains without documents get no posterior; without any labelled document all of it goes to the first domain.
    """
    number = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    known = labelled.select("doc_id", number[F.col("domain")].alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL").distinct()
    # a top-k by domain: no domain's labels gather in one task
    ids = reduce(DataFrame.unionByName, [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for d in range(len(domains))])
    sample = Saved(labelled.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "domain"), "labelled")  # SAMPLE rows a domain at most
    sizes = np.zeros(len(domains))
    for d, n in sample.df.groupBy("domain").count().collect():
        sizes[d] = n
    absent = np.where(sizes > 0, 0.0, -1e9)
    if not sizes.any():
        sample.drop()
        return DomainModel(domains, np.zeros(0, np.uint64), np.zeros((0, len(domains))), np.where(np.arange(len(domains)) == 0, 0.0, -1e9))
    counts = map_batches(sample.df, _domain_frequency(len(domains)), "feature long, domain int, n long")
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in range(len(domains))])
    share = [F.col(f"n{d}") / float(max(1, sizes[d])) for d in range(len(domains))]
    spread = (F.greatest(*share) - F.least(*share)) if len(domains) > 1 else share[0]
    top = wide.withColumn("spread", spread).where("spread > 0.02").orderBy(F.desc("spread"), "feature").limit(FEATURES).select("feature").toPandas()
    keys = np.sort(top["feature"].to_numpy(np.int64).view(np.uint64))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                rows, at = present(step.column("text"), keys)
                bounds = np.searchsorted(rows, np.arange(step.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([step.column("domain"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32)))], names=["domain", "features"])

    rows = map_batches(sample.df, rows_of, "domain int, features array<int>").toPandas()
    sample.drop()
    x, y = np.zeros((len(rows), len(keys)), np.float32), rows["domain"].to_numpy(np.int64)
    for i, found in enumerate(rows["features"]):
        x[i, np.asarray(found, np.int64)] = 1
    order = np.lexsort((*np.packbits(x > 0, axis=1).T, y))  # sums must not depend on the order in which rows came
    x, y = x[order], y[order]
    weights, bias = _softmax(x, y, sizes, absent)
    return DomainModel(domains, keys, weights, bias)


def _softmax(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, absent: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adam on the whole sample."""
    n, d = x.shape
    theta = np.zeros((d + 1, len(sizes)))
    m, v, truth = np.zeros_like(theta), np.zeros_like(theta), np.eye(len(sizes))[y]
    for step in range(1, steps + 1):
        z = x @ theta[:-1].astype(np.float32) + theta[-1] + absent
        p = np.exp(z - z.max(1, keepdims=True))
        slope = (p / p.sum(1, keepdims=True) - truth) / n
        grad = np.concatenate((x.T @ slope.astype(np.float32) + decay * theta[:-1], slope.sum(0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], theta[-1] + absent


def replay(posterior: np.ndarray, gaps: list[np.ndarray], ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After a step for each gap vector, from rates of 1: the rates, the point where the next gap is wanted, and how far the last step moved."""
    rate = look = np.ones(len(posterior))
    moved, pace = np.zeros(len(posterior)), 1.0
    for gap in gaps:
        step = np.maximum(0, look - (posterior @ gap + ridge * (look - 1)) / (1 + ridge))
        moved, faster = np.abs(step - look), (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look, rate, pace = step + (pace - 1) / faster * (step - rate), step, faster
    return rate, look, moved


def grid_parts(posterior: np.ndarray) -> np.ndarray:
    """Posteriors in whole parts of GRID: rounded down, what is left to the likeliest domain, so that each row sums to GRID."""
    parts = np.floor(posterior * GRID).astype(np.int32)
    parts[np.arange(len(parts)), posterior.argmax(1)] += GRID - parts.sum(1, dtype=np.int32)
    return parts


def _rows_of(model: DomainModel, tokenizer: str | None):
    path = public_path(tokenizer) if tokenizer else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                parts = grid_parts(model.posteriors(step.column("text")))
                if path:
                    tokens = np.array([len(ids) // 4 for ids in id_cache(path).encode(pc.fill_null(step.column("text"), "").to_pylist())], np.int64)
                else:
                    tokens = np.diff(words_of(texts_of(step.column("text"))).firsts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
                yield pa.record_batch([step.column("doc_id").cast(pa.int64()), pa.array(tokens.astype(np.int64)), lists], names=["doc_id", "n_tokens", "parts"])

    return run


def _posteriors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) / GRID


def _totals(gaps: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, width))
        for batch in batches:
            p, t = _posteriors(batch.column("parts"), width), batch.column("n_tokens").to_numpy()
            rate, look, moved = replay(p, gaps)
            sums += np.stack([(t * x) @ p for x in (rate, look, moved)])
        yield pa.record_batch([pa.array(range(width), pa.int32()), *map(pa.array, sums)], names=["domain", "held", "ahead", "moved"])

    return run


class Mixture(NamedTuple):
    """A fitted mixture. ``moved`` is the token-weighted mean move of a last step, 0 at the exact optimum."""

    model: DomainModel
    gaps: list[np.ndarray]
    rows: Saved
    reached: dict[str, float]
    wanted: dict[str, float]
    moved: float


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None) -> Mixture:
    """The rates that bring ``docs`` (doc_id, text) to ``targets``: domain to share of all tokens.

    ``labelled`` has doc_id, text and domain; rows without a domain that ``targets`` has are left out. ``reached`` and
    ``wanted`` are the domains' expected and target tokens; they differ where posteriors leave no better rates. Null,
    empty and blank texts have no tokens and move nothing. Repeated rows count each. Without tokens all rates are 1.
    """
    targets = TARGETS if targets is None else targets
    domains, width = tuple(targets), len(targets)
    model = fit_domains(labelled, domains)
    rows = Saved(map_batches(docs.select("doc_id", "text"), _rows_of(model, tokenizer), "doc_id long, n_tokens long, parts array<int>"), "memberships")
    cells = Saved(rows.df.groupBy("parts").agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0"), "cells")
    total = float(cells.df.agg(F.sum("n_tokens")).first()[0] or 0)
    wanted = np.array([targets[d] for d in domains]) * total
    gaps: list[np.ndarray] = []
    held, start, moved = np.zeros(width), np.ones(width), 0.0
    while total:
        sums = map_batches(cells.df, _totals(gaps, width), "domain int, held double, ahead double, moved double").groupBy("domain").agg(F.sum("held"), F.sum("ahead"), F.sum("moved")).collect()
        ahead, moves = np.zeros(width), np.zeros(width)
        for d, *found in sums:
            held[d], ahead[d], moves[d] = found
        if not gaps:
            start = np.maximum(held, 1.0)
        moved = float(moves.sum()) / total
        if gaps and moved <= MOVED:
            break
        if len(gaps) == MOST_STEPS:
            raise RuntimeError(f"rates still move by {moved:.2g} after {MOST_STEPS} steps")
        # sums of doubles differ in their last bits with the order of partitions; rates must not
        gaps.append(np.round((ahead - wanted) / start, 9))
    cells.drop()
    return Mixture(model, gaps, rows, dict(zip(domains, held.tolist(), strict=True)), dict(zip(domains, wanted.tolist(), strict=True)), moved)


def copies_of(doc_id: pa.Array, rate: np.ndarray) -> np.ndarray:
    """Whole copies of documents: rates rounded up or down by a hash of doc_id (null: as 0), so the mean is the rate."""
    keys = np.asarray(pc.fill_null(doc_id.cast(pa.int64()), 0), np.int64).view(np.uint64)
    draw = (mixed(mixed(keys + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(12)) / float(1 << 52)
    return (np.floor(rate) + (draw < rate - np.floor(rate))).astype(np.int64)


def mixing_rates(mixture: Mixture) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of each document of a mixture, posteriors in the order of its targets.

    Texts that are null, empty or blank have no tokens and a posterior from the bias alone. Rows that repeat a doc_id
    each get the rate of their own text. An empty table gives an empty result.
    """
    gaps, width = mixture.gaps, len(mixture.model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _posteriors(batch.column("parts"), width)
            rate = replay(p, gaps)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(p.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"), lists, pa.array(rate), pa.array(copies_of(batch.column("doc_id"), rate))], names=["doc_id", "n_tokens", "posterior", "rate", "copies"])

    return map_batches(mixture.rows.df, run, "doc_id long, n_tokens long, posterior array<double>, rate double, copies long")


def with_totals(rates: DataFrame, mixture: Mixture) -> DataFrame:
    """Each row with the expected tokens that the domains reach, those wanted, and the last move."""
    each = lambda totals: F.array(*(F.lit(float(x)) for x in totals.values()))
    return rates.select("*", each(mixture.reached).alias("reached"), each(mixture.wanted).alias("wanted"), F.lit(mixture.moved).alias("moved"))


def mixed_documents(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs`` with each row as often as its copies say, in one pass, with its columns as they are, whatever their names.

    Rows that repeat a doc_id get the copies of their own text; a null doc_id counts as 0 in the draw; null, empty and
    blank texts get the rate of a text without features. An empty table gives an empty result.
    """
    gaps, model = mixture.gaps, mixture.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                rate = replay(grid_parts(model.posteriors(step.column("text"))) / GRID, gaps)[0]
                rows = np.repeat(np.arange(step.num_rows), copies_of(step.column("doc_id"), rate))
                for at in range(0, len(rows), step.num_rows):
                    yield step.take(pa.array(rows[at : at + step.num_rows]))

    return map_batches(docs, run, docs.schema)


def forget(mixture: Mixture) -> None:
    """Removes the stored memberships of a mixture whose rates are no longer wanted."""
    remove(mixture.rows.spark, mixture.rows.path)
