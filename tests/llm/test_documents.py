"""Corpus operators on a small table of hard cases: nulls, empty, blank and long texts, ties, repeated rows, clashing columns."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from boxwright.llm import compaction, decontamination, mixing, neardup, pseudonyms, quality, sstable, tokens, toxicity

WORDS = [f"w{i}{'xyz'[i % 3]}" for i in range(900)]
BASE = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:60], "changed", *WORDS[61:120]])
ROWS = [
    (1, BASE), (2, NEAR), (3, BASE.upper()), (4, ""), (5, None), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, " ".join(WORDS * 40)), (9, "again"), (None, BASE),
    (10, " ".join(WORDS[300:420]) + " mail bob.7@host.example.com card 4111111111111111 not 4111111111111112"), (11, "ünï\x85cödé\xa0 text  with\n\nspaces <|endoftext|> 12٣ "), (12, "the same line\nthe same line\n" * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", k, f"s{k}") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket long, sig string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got[1, 116] == got[3, 116][:1] + (True,) and got[2, 116] == (1, False) and got[8, 1] == (7, False)
    assert got[4, 0] == (4, True) and got[5, 0] == (5, True) and got[6, 0] == (6, True) and got[None, 116] == (None, True)
    assert sum(1 for _ in got) == len(ROWS) and neardup.near_duplicates(empty).count() == 0


def test_near_duplicate_families(spark):
    """A family with many members on both sides of the limit, against all pairs."""
    rng = np.random.default_rng(4)
    base, texts = [f"b{i}" for i in range(90)], []
    for k in range(160):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, 90))] = f"e{int(rng.integers(0, 60))}"
        texts.append(" ".join(w[: int(rng.integers(60, 91))] if k % 5 == 0 else w))
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_token_counts(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path(tokens.COUNT_MODEL))
    rows = tokens.prefix_counts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in rows) == sorted((i or 0, len(model.encode(t or "")), len((t or "").encode())) for i, t in ROWS)
    text = dict(ROWS)[11]
    table = tokens.piece_table(tokens.public_path(tokens.COUNT_MODEL))
    assert [table.at(text, n) for n in range(len(text) + 1)] == [len(model.encode(text[:n])) for n in range(len(text) + 1)]
    cut = table.fitting(BASE, 50)
    assert len(model.encode(BASE[:cut])) <= 50 and tokens.prefix_counts(empty).count() == 0
    within = tokens.prefix_counts(docs).where("doc_id = 1").select(tokens.tokens_within("counts", "ends", F.lit(cut))).first()[0]
    assert within == len(model.encode(BASE[:cut]))


def test_token_counts_inside_pieces(spark):
    """Every length of texts whose pieces are long, against the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path(tokens.COUNT_MODEL))
    rng = np.random.default_rng(8)
    texts = ["这是一个没有空格的句子" * 9, "aGVsbG8gd29ybGQ" * 5 + " and  more ", "if(x){return'y'}" * 6, "", " a", "  ", "the\nend \n", *("".join(rng.choice(list("abething é漢\n "), 30)) for _ in range(40)), "b▁ ", "▁▁ ▁", *("".join(rng.choice(list("ab ▁"), 9)) for _ in range(40))]
    table = tokens.piece_table(tokens.public_path(tokens.COUNT_MODEL))
    rows = tokens.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    packed = tokens.unpacked(tokens.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packed=True))
    assert sorted(packed.collect()) == sorted(rows.collect())
    within = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(140)), lambda n: tokens.tokens_within("counts", "ends", n)))).collect()
    for i, text in enumerate(texts):
        brute = [len(model.encode(text[:n])) for n in range(len(text) + 1)]
        assert [r.col for r in within if r.doc_id == i][: len(text) + 1] == brute == [table.at(text, n) for n in range(len(text) + 1)]
        for budget in (0, 1, 5, 20, 999):
            assert table.fitting(text, budget) == max(n for n, c in enumerate(brute) if c <= budget)


def test_shards(spark, docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.public_path(tokens.IDS_MODEL))
    manifest = sstable.write_shards(docs)
    rows = sorted(sstable.read_shards(manifest.df).collect(), key=lambda r: r.start)
    expect, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expect.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == expect
    wanted = spark.createDataFrame([(7,), (9,), (77,)], "doc_id long")
    found = Counter(r.doc_id for r in sstable.look_up(spark, manifest.df, wanted).collect())
    assert found == {7: 1, 9: 2}
    assert sstable.read_shards(sstable.write_shards(empty).df).count() == 0


def test_shard_blocks(tmp_path):
    with open(tmp_path / "s.sst", "wb") as sink:
        writer = sstable.Writer(sink, 2, 1)
        keys = [None, -5, -5, *range(0, 60000, 7)]
        for k in keys:
            writer.add(sstable.key_of(k), np.arange((k or 3) % 50, dtype="<u2").tobytes())
        writer.close()
    shard = sstable.Shard(str(tmp_path / "s.sst"))
    assert len(shard.blocks) > 2 and [k for k, _ in shard.entries()] == keys and len(shard.get(-5)) == 2 and len(shard.get(700)[0]) == 700 % 50 and shard.get(701) == []


def test_quality(docs, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality.quality_verdicts(docs, docs.select("doc_id").limit(3)).collect()}

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)

    assert len(rows) == len(ROWS)
    for i, t in ROWS:
        n, chars, symbols, lines, repeats = brute(t)
        r = rows[i, n]
        failed = n < 50 or 100 * repeats > 50 * n
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (chars, symbols, lines, repeats, failed) and not (failed and r.kept)
    assert quality.quality_verdicts(empty, empty).count() == 0


def test_units_without_the_pattern():
    """Words of letters, alone or with one mark after them, skip the pattern; units and ids stay those of the tokenizer."""
    words = ["Word", "word,", "A.", "b,,", "don't", "it's", "s'.", "x1?", "?", "a.b.", "\u00e9,", "\u017f", "\u0130.", "<s>", "'s."]
    assert [tokens._units(w) for w in words[:3]] == [["word"], ["word", ","], ["a", "."]] and tokens._units("<s>") is None
    cache = tokens.IdCache(tokens.public_path(tokens.IDS_MODEL))
    assert cache.encode(words) == [cache.whole(w) for w in words]


def test_ids_by_distinct_units():
    """a worker remembers units, not words, so that words which differ in case and marks are encoded once; ids stay those of the tokenizer."""
    cache = tokens.IdCache(tokens.public_path(tokens.IDS_MODEL))
    marked = [f"{w}{m}" for w in ("plain", "Plain", "PLAIN") for m in ("", ",", "...", "12")]
    assert cache.encode([" ".join(marked)]) == [cache.whole(" ".join(marked))]
    assert set(cache.units) == {"plain", ",", "...", "1", "2"}
    rng = np.random.default_rng(6)
    signs = [*"aAbz' \n\t.,<>|?-09", "'s", "'re", "\u2019", "\u00e9", "\u00c9", "\u0130", "\u0131", "\u017f", "\u01c5", "\u023a", "\u03a9", "\u03c2", "\u4e2d", "\u3000", "\u2003", "\xa0", "\x85", "\x1c", "\x00", "\xb2", "\xbd", "\xad", "\U0001f600", "\u0301", "<|endoftext|>"]
    texts = ["", " ", *("".join(rng.choice(signs, n)) for n in rng.integers(0, 30, 3000))]
    assert cache.encode(texts) == [cache.whole(t) for t in texts]
    long = "word Caf\u00e9, " * (tokens.PART_CHARS // 6)
    assert cache.encode([long]) == [cache.whole("word Caf\u00e9, ") * (tokens.PART_CHARS // 6)]


def test_workers_let_tables_go(spark):
    """a worker keeps a table for the tasks of a stage, and no table of an earlier stage; no rows need no other kind of worker."""

    def run(batches):
        from boxwright.llm import shared

        for batch in batches:
            names = sorted({k[0] for k in shared._HELD})
            shared.held(("first",), lambda: [0])
            yield pa.RecordBatch.from_pylist([{"names": ",".join(names)}] * batch.num_rows)

    rows = spark.range(0, 6, 1, 1)
    for _ in range(3):
        assert {r.names for r in tokens.map_batches(rows, run, "names string").collect()} == {""}
    no_items = spark.range(0).selectExpr("id AS item_id", "CAST(id AS STRING) AS text")
    leaks = decontamination.benchmark_leaks(spark.range(3).selectExpr("id AS doc_id", "'a b c' AS text"), no_items)
    assert leaks.count() == 0 and "RDD" not in leaks._jdf.queryExecution().analyzed().toString()


def test_quality_hashes_grams_as_rows(spark, docs):
    """Grams come without functions over array elements, which Spark does not compile, and are those of the words and neighbours."""
    grams = quality.ngram_buckets(docs.select("doc_id", F.lit(True).alias("target"), "text"), quality.BUCKETS)
    assert "lambda" not in grams._jdf.queryExecution().optimizedPlan().toString()
    expected = 0
    for r in docs.select("text").collect():
        n = len([w for w in re.split("[\x20\x09-\x0d]+", r.text or "") if w])
        expected += max(0, 2 * n - 1)
    assert grams.count() == expected


def test_quality_separates(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(WORDS[:300], 80))) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}***" for w in rng.choice(WORDS[:300], 80))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    rows = quality.quality_verdicts(docs, docs.where("doc_id < 30")).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(30)) <= kept and not kept & {i for i, _ in bad}
    weights = {r.bucket: r.weight for r in quality.bucket_weights(docs.withColumn("target", F.col("doc_id") < 30)).collect()}
    import xxhash

    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in good[0][1].split()]
    grams = [h - (1 << 64) if h >> 63 else h for h in hashes]
    pairs = [xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), seed=42)) for a, b in zip(grams, grams[1:], strict=False)]
    pairs = [h - (1 << 64) if h >> 63 else h for h in pairs]
    mean = np.mean([weights[g % quality.BUCKETS] for g in grams + pairs]) * quality.STEP
    assert next(r.llr for r in rows if r.doc_id == 0) == pytest.approx(mean)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    insult = ["scumword", "vilething", "nastyone"]
    rows, labels = [], []
    for i in range(500):
        w, toxic = list(rng.choice(WORDS, 60)), i % 6 == 0
        if toxic:
            w[5], w[30] = rng.choice(insult), rng.choice(insult)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.toxicity_model(train, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.toxicity(train, model).collect()
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([a == b for a, b in held]) > 0.97
    hard = toxicity.toxicity(docs, model).collect()
    assert len(hard) == len(ROWS) and all(0 <= r.score <= 1 for r in hard) and toxicity.toxicity(empty, model).count() == 0
    assert toxicity.accepted(docs, model).columns == docs.columns
    none = toxicity.toxicity_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(3)
    items = [" ".join(rng.choice(WORDS[500:], 30)) for _ in range(6)]
    table = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "word")], "item_id long, text string")
    edited = items[1].replace("w5", "v5", 4)[:-3]
    rows = [(1, "before it " + items[0].upper() + " after it"), (2, "x " + edited), (3, " ".join(WORDS[:200])), (4, None), (5, ""), (6, items[2] + "\n" + items[3])]
    leaks = decontamination.benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in leaks) == [(1, 0), (2, 1), (6, 2), (6, 3)]
    first = next(r for r in leaks if r.doc_id == 1)
    assert (first.distance, rows[0][1][first.start : first.end].lower()) == (0, items[0])
    assert decontamination.benchmark_leaks(empty, table).count() == 0 and decontamination.benchmark_leaks(docs, table.where("false")).count() == 0


def test_decontamination_without_spaces(spark):
    """Unspaced items, exact and edited evenly, and one whose few long words are all edited."""
    rng = np.random.default_rng(9)
    han = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 60))
    code = "".join(rng.choice(list("abcdefgh(){};=."), 120))
    long = " ".join("".join(rng.choice(list("abcdefgh"), 50)) for _ in range(4))
    near = lambda t, every: "".join("X" if k % every == every - 1 else c for k, c in enumerate(t))
    items = spark.createDataFrame([(0, han), (1, code), (2, long), (3, "internationalization")], "item_id long, text string")
    rows = [(1, "前" + han + "后"), (2, "x" + near(han, 12) + "y"), (3, "say:" + code), (4, near(code, 9)), (5, near(long, 12)), (6, "internationalization"), (7, han[:30]), (8, None)]
    leaks = decontamination.benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted({(r.doc_id, r.item_id) for r in leaks}) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
    assert next((r.distance, r.start, r.end) for r in leaks if r.doc_id == 1) == (0, 1, 61)


@pytest.mark.parametrize("edit", ["substitutions", "any", "third words", "fourth words", "blanks _", "blanks -", "blanks gone", "blanks doubled", "blanks and letters"])
def test_decontamination_recall(edit):
    """Edited items inside other text: at least nine of ten of those that a brute force over all alignments finds."""
    rng = np.random.default_rng(12)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(list(letters), int(rng.integers(*((5, 12) if edit[:6] == "blanks" else (2, 10))))))
    vocabulary = [word() for _ in range(1500)]
    items = [" ".join(rng.choice(vocabulary, int(rng.integers(20, 45)))) for _ in range(50)]

    def edited(text):
        c, n = list(text), int(0.14 * len(text))
        if edit[:6] == "blanks":
            other = text.replace(" ", {"_": "_", "-": "-", "gone": "", "doubled": "  "}.get(edit[7:], "_"))
            return other if edit != "blanks and letters" else "".join("q" if rng.random() < 0.03 else x for x in other)
        if edit == "substitutions":
            for p in rng.choice(len(c), n, replace=False):
                c[p] = "q"
        elif edit == "any":
            for _ in range(n):
                p, kind = int(rng.integers(0, len(c))), int(rng.integers(0, 3))
                c[p : p + (kind > 0)] = ["z"] * (kind < 2)
        else:
            w = text.split(" ")
            for i in range(len(w)):
                if i % (3 if edit == "third words" else 4):
                    at = int(rng.integers(0, len(w[i])))
                    w[i] = w[i][:at] + "x" + w[i][at + 1 :]
            return " ".join(w)
        return "".join(c)

    index = decontamination.Index(list(range(len(items))), items, decontamination.MAX_DISTANCE)
    texts = [" ".join(rng.choice(vocabulary, 60)) + " " + edited(t) + " " + " ".join(rng.choice(vocabulary, 60)) for t in items]
    near = {i for i, t in enumerate(texts) if decontamination.edit_distance(items[i].encode(), t.encode(), index.most[i])}
    leaks = decontamination.leaks_of(pa.array(texts), index)
    assert len(near) > 25 and len({r for r, i, *_ in leaks if r == i} & near) >= 0.9 * len(near)
    assert all(decontamination.edit_distance(items[i].encode(), texts[r].encode(), index.most[i])[0] == d for r, i, d, *_ in leaks)


def test_decontamination_long_items():
    """Items of 5,600 bytes, and one item among texts of any length."""
    rng = np.random.default_rng(13)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(700))
    index = decontamination.Index([0, 1], [long, "an item of only a few words"], 0.15)
    texts = pa.array(["x " + long.replace("abc", "abd"), "here is an item of only a few words again", long[:2500], None, ""])
    assert {(r, i) for r, i, *_ in decontamination.leaks_of(texts, index)} == {(0, 0), (1, 1)}


def test_edit_distance():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (bytes(rng.integers(97, 100, int(rng.integers(1, 14))).astype(np.uint8)) for _ in range(2))
        assert decontamination.edit_distance(a, b, 99)[0] == brute(a, b)


def test_cgk_recall():
    """Windows within the distance share a hash with their item."""
    rng, caught = np.random.default_rng(6), 0
    walk = decontamination.walks()
    for _ in range(100):
        item = bytearray(rng.integers(97, 122, 180).astype(np.uint8))
        other = bytearray(item)
        for p in rng.integers(0, 170, 12):
            kind = int(rng.integers(0, 3))
            if kind == 0:
                other[p] = 122
            elif kind == 1:
                del other[p]
            else:
                other.insert(p, 122)
        a, b = decontamination.embed([bytes(item), bytes(other)], [180, 180], walk)
        caught += bool((a == b).any())
    assert caught >= 95


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(5)
    kinds = {"good": WORDS[:300], "poor": WORDS[300:600]}
    rows = [(i, " ".join(rng.choice(kinds["good" if i % 3 else "poor"], int(rng.integers(30, 90)))), "good" if i % 3 else "poor") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.fit_mixture(table, table.where("doc_id < 150"), {"good": 0.9, "poor": 0.1})
    assert got.moved <= mixing.MOVED and all(abs(got.reached[d] - got.wanted[d]) <= 0.01 * got.wanted[d] for d in got.wanted)
    rates = mixing.mixing_rates(got).collect()
    assert len(rates) == 300 and all(r.rate >= 0 for r in rates) and abs(sum(r.copies for r in rates) - sum(r.rate for r in rates)) < 30
    # every column stays as it is, whatever its name
    clashing = table.withColumn("mixing_rate", F.col("doc_id") * 2).withColumn("copies", F.lit("x"))
    mixed = mixing.mixed_documents(clashing, got)
    assert mixed.columns == clashing.columns and Counter(r.doc_id for r in mixed.collect()) == {r.doc_id: r.copies for r in rates if r.copies}
    assert len(mixing.mixing_rates(mixing.fit_mixture(docs, docs.select("doc_id", "text", F.lit("good").alias("domain")), {"good": 1.0})).collect()) == len(ROWS)
    none = mixing.fit_mixture(empty, empty.withColumn("domain", F.lit("good")), {"good": 1.0})
    assert mixing.mixing_rates(none).count() == 0 and mixing.mixed_documents(empty, none).count() == 0
    tokens_ = mixing.fit_mixture(table, table, {"good": 0.5, "poor": 0.5}, tokenizer=tokens.IDS_MODEL)
    assert sum(tokens_.wanted.values()) > sum(got.wanted.values())


def test_mixing_optimum(spark):
    """Rates against non-negative least squares by coordinate descent over all documents."""
    rng = np.random.default_rng(11)
    t = rng.integers(20, 200, 120).astype(float)
    parts = mixing.grid_parts(rng.dirichlet([0.4, 0.3, 0.2], 120))
    p, targets = parts / mixing.GRID, np.array([0.8, 0.2, 0.0])
    wanted, start = targets * t.sum(), t @ p
    # least squares of (sum of t*p*r - wanted) / sqrt(start) and sqrt(ridge*t) * (r - 1)
    a = np.concatenate(((t[:, None] * p / np.sqrt(start)).T, np.diag(np.sqrt(mixing.RIDGE * t))))
    y, r = np.concatenate((wanted / np.sqrt(start), np.sqrt(mixing.RIDGE * t))), np.ones(120)
    rest = y - a @ r
    for _ in range(4000):
        for j in range(120):
            new = max(0.0, r[j] + a[:, j] @ rest / (a[:, j] @ a[:, j]))
            rest, r[j] = rest + a[:, j] * (r[j] - new), new
    gaps: list[np.ndarray] = []
    while True:
        rate, look, moved = mixing.replay(p, gaps)
        if gaps and t @ moved / t.sum() <= mixing.MOVED:
            break
        gaps.append(np.round(((t * look) @ p - wanted) / start, 9))
    assert len(gaps) < mixing.MOST_STEPS and np.abs((t * rate) @ p - (t * r) @ p).max() < 0.002 * t.sum() and t @ np.abs(rate - r) / t.sum() < 0.02
    objective = lambda x: ((y - a @ x) ** 2).sum()
    assert objective(rate) <= objective(r) * 1.02 + 1e-6


def test_pseudonyms(docs, empty):
    f = pseudonyms.Feistel(b"k")
    assert len({f.number(i, 1000, b"t") for i in range(1000)}) == 1000 and len({f.symbols(f"{i:03d}", "0123456789", b"t") for i in range(1000)}) == 1000
    text = "card 4111 1111 1111 1111, born 1985-03-12 and 12/03/1985, ip 10.1.2.3, id 123-45-6789, GB82 WEST 1234 5698 7654 32, +1 (017) 555-7713, x.9@mail7.example.com"
    new, spans = pseudonyms.pseudonymised(f, text)
    assert [s[0] for s in spans] == ["card", "date", "date", "ip", "ssn", "iban", "phone", "email"] and len(new.split()) == len(text.split())
    card = re.search(r"card ([\d ]+),", new)[1].replace(" ", "")
    assert pseudonyms.luhn_valid(card) and card != "4111111111111111" and pseudonyms.iban_valid(re.search(r"GB\d\d \w{4} .{17}", new)[0].replace(" ", "")[:22])
    assert re.search(r"born (\S+)-(\S+)-(\S+) and (\S+)/(\S+)/(\S+),", new).groups()[:3] == re.search(r"and (\S+)/(\S+)/(\S+),", new).groups()[::-1]
    for clean in ("4111 1111 1111 1112", "999.1.1.1", "31.02.2001", "000-12-3456", "version 1.2.3 of 2020"):
        assert pseudonyms.pseudonymised(f, clean) == (clean, [])
    rows = {r.bucket: r for r in pseudonyms.pseudonymise(docs, b"k").withColumn("bucket", F.col("n_replaced")).collect()}
    assert rows[2].doc_id == 10 and "4111111111111112" in rows[2].text
    assert pseudonyms.pseudonymise(docs, b"k").count() == len(ROWS) and pseudonyms.pseudonymise(empty, b"k").count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"),
        ("4111111111111111 123", "card", "4111111111111111"),
        ("4111-1111-1111-1111-1234", "card", "4111-1111-1111-1111"),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB29NWBK60161331926819 OR", "iban", "GB29NWBK60161331926819"),
    ],
)
def test_pseudonyms_before_more(text, kind, value):
    """A value followed by more digits or capitals."""
    new, spans = pseudonyms.pseudonymised(pseudonyms.Feistel(b"k"), "pay " + text)
    assert spans == [(kind, 4, 4 + len(value))] and value not in new and new.endswith(text[len(value) :]) and len(new) == 4 + len(text)


def random_cards(rng, n):
    for _ in range(n):
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        yield body + pseudonyms.luhn_digit(body)


def test_cards_beside_other_numbers():
    """A card has one pseudonym wherever it stands, and it can be turned back there."""
    rng = np.random.default_rng(3)
    f, back = pseudonyms.Feistel(b"k"), pseudonyms.Feistel(b"k", back=True)
    for card in random_cards(rng, 1000):
        grouped = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        code, alone = f"{int(rng.integers(1000)):03d}", pseudonyms.pseudonymised(f, grouped + ", x")[0][:19]
        run = alone.replace(" ", "")
        for text, new in ((f"{grouped} {code}", f"{alone} {code}"), (f"{card} {code}", f"{run} {code}"), (f"no 12 {grouped} 27", f"no 12 {alone} 27"), (f"{grouped} 12 2027", f"{alone} 12 2027"), (f"{code} {card} {card}", f"{code} {run} {run}"), (f"{grouped} {grouped}", f"{alone} {alone}"), (f"a_{card}", f"a_{run}")):
            assert pseudonyms.pseudonymised(f, text)[0] == new and pseudonyms.pseudonymised(back, new)[0] == text
    for card in ("378282246310005", "3782 822463 10005", "3056 930902 5904", "5555 5555 5555 4444", "6011111111111117", "3530111333300000"):
        new, spans = pseudonyms.pseudonymised(f, card)
        assert len(spans) == 1 and new != card and pseudonyms.pseudonymised(back, new)[0] == card


def test_tables_of_numbers_stay():
    """Lists of numbers, prices and years, and long runs of digits, in little time."""
    rng = np.random.default_rng(4)
    f = pseudonyms.Feistel(b"k")
    texts = [" ".join(str(int(rng.integers(0, 10 ** int(rng.integers(1, 9))))) for _ in range(10_000)), " ".join(str(int(x)) for x in rng.integers(1000, 99_999, 10_000)), " ".join(str(int(x)) for x in rng.integers(1900, 2100, 10_000)), "-".join(str(int(x)) for x in rng.integers(1000, 9999, 10_000)), "\n".join(" ".join(str(int(x)) for x in rng.integers(10, 9999, 7)) for _ in range(2000))]
    for text, most in zip(texts, (0.001, 0.001, 0.001, 0.001, 0.005), strict=True):  # the last are rows of seven, which may look like a card and its code
        new, _ = pseudonyms.pseudonymised(f, text)
        assert sum(x != y for x, y in zip(new, text, strict=True)) < most * len(text)
    began = time.process_time()
    for text in ("1 " * 200_000, "4" * 400_000, "4111 " * 80_000, "12-" * 130_000):
        pseudonyms.pseudonymised(f, text)
    assert time.process_time() - began < 20


def test_other_forms_of_values():
    """Time stamps, months first, lower-case account numbers, dots in phone numbers, accented names: replaced, and turned back."""
    f, back = pseudonyms.Feistel(b"k"), pseudonyms.Feistel(b"k", back=True)
    for text, kind in (("at 2024-01-02T10:00:00Z", "date"), ("on 12/31/2024 or", "date"), ("on 31/12/2024 or", "date"), ("to de89370400440532013000 now", "iban"), ("call 415.555.2671 now", "phone"), ("mail garcía.ñ@ex.com", "email"), ("mail é@ex.com", "email")):
        new, spans = pseudonyms.pseudonymised(f, text)
        assert [k for k, _, _ in spans] == [kind] and new != text and len(new) == len(text) and pseudonyms.pseudonymised(back, new)[0] == text
    assert "í" not in pseudonyms.pseudonymised(f, "garcía@ex.com")[0][:6] and pseudonyms.pseudonymised(f, "2024-01-02Tx and 13/31/2024") == ("2024-01-02Tx and 13/31/2024", [])
    for n in range(2000):
        text = f"{n % 12 + 1:02d}/{n % 28 + 1:02d}/{1950 + n % 100}"
        assert pseudonyms.pseudonymised(back, pseudonyms.pseudonymised(f, text)[0])[0] == text


def test_pseudonyms_of_any_length():
    """Nothing of a long value stays, nothing crashes, and the key owner gets it back."""
    rng = np.random.default_rng(21)
    f, back = pseudonyms.Feistel(b"k"), pseudonyms.Feistel(b"k", back=True)
    for n in (40, 128, 257, 10_000):
        secret = "".join(rng.choice(list("0123456789abcdef"), n))
        new, spans = pseudonyms.pseudonymised(f, f'key "{secret}" end')
        assert len(spans) == 1 and sum(x == y for x, y in zip(new[5 : 5 + n], secret, strict=True)) < n / 8 + 8
        assert pseudonyms.pseudonymised(back, new)[0] == f'key "{secret}" end'
    text = "mail " + "ab7" * 200 + "@ex.com, no.4111111111111111, card 4111 1111 1111 1111 12/27, 2011-03-12, 10.1.2.3, 123-45-6789, GB82 WEST 1234 5698 7654 32 NOW"
    new, spans = pseudonyms.pseudonymised(f, text)
    assert [k for k, _, _ in spans] == ["email", "card", "card", "date", "ip", "ssn", "iban"] and "4111" not in new and "ab7ab7" not in new
    assert pseudonyms.pseudonymised(back, new)[0] == text


def test_compaction(spark, docs, empty):
    table = compaction.compacted(docs)
    assert Counter(map(tuple, table.read().select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    for _ in range(5):
        table.append(docs)
    before = table.manifest().count()
    table.compact()
    assert table.manifest().count() < before and table.located().count() == 6 * len(ROWS)
    with pytest.raises(Exception, match="[Ee]xists"):
        table.commit(table.manifest(), table.versions()[-2])
    assert len(table.versions()) == compaction.LIVE and table.read(table.versions()[0]).count() == 6 * len(ROWS)
    nothing = compaction.compacted(empty)
    assert nothing.located().count() == 0 and nothing.read().count() == 0 and nothing.read().columns == docs.columns
    several = compaction.compacted(docs, arrivals=3)
    assert Counter(map(tuple, several.read().select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


def test_compaction_beside_readers_and_writers(spark, docs):
    """A version that is open when several rounds of merges begin stays whole; an arrival that another one overtook is committed after it; places are those in the files."""
    table = compaction.ShardTable(spark, compaction.fresh_path(spark, "rounds"))
    for _ in range(9):
        table.append(docs, small=200)
    opened = table.read(table.versions()[-1])
    table.compact(target=60_000, small=200, fan_in=3)
    assert Counter(map(tuple, opened.select(*docs.columns).collect())) == Counter(r for row in map(tuple, docs.collect()) for r in [row] * 9)
    first = table._last

    def overtaken():
        table._last = first
        table.append(docs)
        return table.versions()[-2]

    table._last = overtaken
    table.append(docs)
    assert table.read().count() == 11 * len(ROWS)
    expected = []
    for shard, row in enumerate(sorted(table.manifest().collect(), key=lambda r: (r.arrival, r.seq, r.uri))):
        files, path = pa.fs.FileSystem.from_uri(row.uri)
        for k, one in enumerate(pa.parquet.read_table(path, filesystem=files).to_pylist()):
            expected.append((one["doc_id"], shard, k, None if one["text"] is None else zlib.crc32(one["text"].encode())))
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, table.located().collect()), key=key) == sorted(expected, key=key)


def test_vacuum_spares_uncommitted_arrivals(spark, docs):
    """A vacuum between the writing of an arrival and its commit loses nothing; a sweep removes what stays uncommitted."""
    table = compaction.compacted(docs)
    table.append(docs)
    base = table.versions()[-1]
    rows = docs.mapInArrow(compaction._appending(f"{table.folder}/data", "zz", compaction.SMALL_BYTES), compaction._ROWS).cache()
    written = rows.count()
    table.vacuum(live=1)
    assert table.sweep() == 0
    table.commit(table.manifest().unionByName(rows), base)
    assert table.read().count() == 3 * len(ROWS) and written > 0
    docs.mapInArrow(compaction._appending(f"{table.folder}/data", "yy", compaction.SMALL_BYTES), compaction._ROWS).count()
    assert table.sweep(grace=-60) > 0 and table.read().count() == 3 * len(ROWS)


def test_shards_roll(spark, docs):
    """Many shards of bounded size hold what one holds."""
    one, many = sstable.write_shards(docs.coalesce(1)), sstable.write_shards(docs, shard_bytes=400)
    assert many.df.count() > 4 and sorted(map(str, sstable.read_shards(many.df).collect())) == sorted(map(str, sstable.read_shards(one.df).collect()))
    wanted = spark.createDataFrame([(1,), (9,), (12,), (-3,), (10**15,), (None,)], "doc_id long")
    assert Counter(r.doc_id for r in sstable.look_up(spark, many.df, wanted).collect()) == {1: 1, 9: 2, 12: 1}


def test_steps_cover_batches():
    from boxwright.llm.shared import text_steps

    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 90, 3, 3)])], names=["text"])
    assert [s.num_rows for s in text_steps(batch, most=10)] == [2, 1, 2] and not list(text_steps(batch.slice(0, 0)))
