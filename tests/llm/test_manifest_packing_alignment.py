"""Merkle manifests, packing and alignment of tokenizers against plain loops, on documents and on hard rows."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from boxwright.llm import alignment, encoders, merkle, packing
from boxwright.llm.queries import ORACLE_SQL, QUERIES
from boxwright.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
WORDS = "the river runs past Old mills, und wieder 1234 é漢字 ... end".split()
ROWS = [
    (1, "a", "one two three"), (2, "a", None), (3, "a", ""), (4, None, "Null source"), (5, None, "x"), (None, "a", "no id ABC"), (None, "b", "no id"), (7, "b", "twice"), (7, "b", "twice"), (7, "b", "Twice"),
    (8, "é", " \n\t  "), (9, "é", " ".join(WORDS * 900)), (10, "lone", "▁ odd  <|endoftext|> <s>\x1c \x00"), *((100 + k, "long", f"Text {k} of many " + " ".join(WORDS[: k % 11]) * (k % 7)) for k in range(700)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, t, None if t is None else len(t), None if k % 3 else "en", k, "p") for k, (i, s, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int, lang string, pos long, tree string")


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps_of(levels, at):
    out = []
    for level in levels[:-1]:
        low = at // 16 * 16
        out.append((level[low:at], level[at + 1 : low + 16]))
        at //= 16
    return out


def expected_proofs(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    trees = {s: levels_of([leaf for *_, leaf, _ in sorted(found, key=lambda x: x[:3])]) for s, found in by_source.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in order])
    for place, source in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[source], key=lambda x: x[:3])):
            steps = steps_of(trees[source], at) + steps_of(top, place)
            folded = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                folded = leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            for left, right in steps:
                folded = digest([*left, folded, *right])
            yield r.doc_id, leaf, trees[source][-1][0], top[-1][0], digest(x for left, right in steps for x in left + right), folded, folded == top[-1][0]


def same(got, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def test_proofs(spark, docs):
    rows = docs.collect()
    got = merkle.merkle_proofs(docs.repartition(7), merkle.lowered_every_fifth()).collect()
    same(got, expected_proofs(rows))
    assert {r.verified for r in got} == {True, False}
    one = docs.where("doc_id = 10")
    only = merkle.merkle_proofs(one).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == digest([]) and only.verified
    assert merkle.merkle_proofs(docs.where("false")).count() == 0


def test_proofs_of_many_levels_and_sources(spark):
    """Trees of one to four levels, and more sources than a node of the top has."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit("de").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("text"))
    same(merkle.merkle_proofs(rows, merkle.lowered_every_fifth()).collect(), expected_proofs(rows.collect()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name])


def test_registered_proofs(spark):
    same(QUERIES["op11_merkle_manifest"](spark, SF).collect(), expected_proofs(spark.read.parquet(f"{SF}/documents.parquet").collect()))


def odd_texts():
    rng = np.random.default_rng(3)
    marks = ["a", "b", "'s", " ", "  ", "\n", "1", "é", "漢", "▁", "\x1d", "\xa0", ".", "<|endoftext|>", "<s>", "\t", "<0x0A>", "\0", "२", "😀", "ſ", "'S", "Ġ"]
    return ["", " ", "a  b", " a", "a ", "\x85 a", *("".join(rng.choice(marks, 20)) for _ in range(1500))]


def test_encoders_give_the_ids_of_the_libraries():
    from tokenizers import Tokenizer

    model, texts = Tokenizer.from_file(public_path("byte_bpe_50k.json")), [*odd_texts(), " " * 400_000 + "x"]
    for plain in (False, True):
        model.encode_special_tokens = plain
        mine = encoders.ByteLevel(plain)
        assert all(mine.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids for t in texts)
        vocabulary = {i: token for token, i in model.get_vocab().items()}
        assert b"".join(mine.token_bytes[i] for i in mine.ids("é 漢 Ġ")) == "é 漢 Ġ".encode() and len(vocabulary) == len(mine.token_bytes)


def packed_pieces(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [*range(len(ids), 0, -1024)][::-1]
        for piece, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            yield r.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())


def check_sequences(got):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 1024
    return len(by)


def test_packing(spark, docs):
    for table in (docs.repartition(5), spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.packed(table).collect()
        same([tuple(r)[:5] for r in got], packed_pieces(table))
        assert check_sequences(got) <= 1.02 * sum(r.length for r in got) / 1024 + 1
    assert packing.packed(docs.where("false")).count() == 0


def test_plans_against_every_partition():
    """Small cases against the fewest sequences that there are; large ones against their tokens."""
    rng = np.random.default_rng(7)

    def fewest(sizes, capacity):
        best = len(sizes)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] >= sizes[k]:
                    bins[i] -= sizes[k]
                    go(k + 1, bins)
                    bins[i] += sizes[k]
            go(k + 1, [*bins, capacity - sizes[k]])

        go(0, [])
        return best

    over = 0
    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
        plan = packing.plan_sequences(np.bincount(sizes, minlength=21), 20)
        assert plan.sequences >= fewest(sizes, 20)
        over += plan.sequences - fewest(sizes, 20)
    assert over <= 3
    sizes = rng.integers(1, 1025, 30_000)
    plan = packing.plan_sequences(np.bincount(sizes, minlength=1025), 1024)
    filled = np.zeros(plan.sequences, np.int64)
    for n, k in Counter(sizes.tolist()).items():
        sequence, offset = plan.places(n, np.arange(k))
        assert offset.max() + n <= 1024
        np.add.at(filled, sequence, n)
    assert filled.max() <= 1024 and filled.sum() == sizes.sum() and plan.sequences <= 1.006 * sizes.sum() / 1024


def expected_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(public_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    names = {i: token for token, i in a_model.get_vocab().items()}
    visible = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte_of = {c: b for b, c in visible.items()} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    found = []
    for r in rows:
        text = r.text or ""
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in a_model.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
        groups = []
        if text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            ia = ib = at = bt = 0
            group = ([], [])
            while ia < len(a):
                if at <= bt:
                    group[0].append(a[ia][0])
                    at, ia = at + len(a[ia][1]), ia + 1
                while bt < at:
                    group[1].append(b[ib][0])
                    bt, ib = bt + len(b[ib][1]), ib + 1
                if at == bt:
                    groups.append(group)
                    group = ([], [])
        found.append((r.doc_id, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(pair for _, _, links in found for pair in links)
    best_a, best_b = Counter(), Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    for doc_id, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best_a[p[0]]),
               sum(n for p, n in links.items() if count[p] == best_b[p[1]]), sum(n * count[p] for p, n in links.items()), sha256(written.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("links", [None, 40])
def test_alignment(spark, docs, monkeypatch, links):
    """With few links at once every text takes the way of very long ones, in parts."""
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd_texts()[:400])], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd) if links is None else odd.limit(150).unionByName(docs.select("doc_id", "text").where("doc_id <= 9 OR doc_id IS NULL"))
    if links:
        monkeypatch.setattr(alignment, "LINKS", links)
        batch = next(iter(table.toArrow().combine_chunks().to_batches()))
        pairs = alignment.Merger()
        for text in batch.column("text").to_pylist():
            (a,), (b,) = pairs.tokens([text or ""])
            ga, gb, n = alignment.merged_ends(a, b, *pairs.sizes)
            brute = Counter((x, y) for x, p in zip(a.tolist(), ga.tolist(), strict=True) for y, q in zip(b.tolist(), gb.tolist(), strict=True) if p == q) if len(a) < 2000 else None
            parts = [dict(zip(p.tolist(), t.tolist(), strict=True)) for p, t in alignment.document_pairs(a, b, ga, gb, n, links)] if len(a) < 2000 else []
            merged = {k: v for part in parts for k, v in part.items()}
            assert brute is None or ({divmod(k, alignment.SHIFT): v for k, v in merged.items()} == brute and sum(map(len, parts)) == len(merged))
        return
    same(alignment.aligned(table).collect(), expected_alignment(table.collect()))
    assert alignment.aligned(table.where("false")).count() == 0


def test_registered_alignment(spark):
    same(QUERIES["op13_tokenizer_alignment"](spark, SF).collect(), expected_alignment(spark.read.parquet(f"{SF}/documents.parquet").collect()))
