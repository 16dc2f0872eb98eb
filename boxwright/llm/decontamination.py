"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk copies a string along random steps: at each step it writes the current character and moves on or stays,
as a fixed random bit of that step and character says. Strings at a small edit distance then agree in most places, so
edit distance becomes Hamming distance and sampling places of the embedding is a locality-sensitive hash.

Benchmark items are few and fixed, so their tables travel with the tasks and each document is searched where it lies,
without a shuffle of text. A walk over an item-sized window at every word of a corpus costs hundreds of steps a byte, so
windows are chosen by samples of short walks first, which neighbouring windows share: ``SEEDS`` walks of ``SEED_STEPS``
steps start at every word of SEED_WORD bytes and more, in the items and in the text. Where the sampled characters of one
agree, the place in the item puts an item-sized window in the text. An edit that the samples miss, or that the walk has
caught up with, does no harm, so no word has to be unedited. Where blanks were changed or left out there are no such words:
CLOSE_SEEDS more walks go over the letters and digits alone, from places that the letters there choose. Windows that VOTES places of the text vote for (fewer, where
an item has few) are embedded whole, ``REPEATS`` times, but for those that cannot hold the item by a count of its runs of
RUN bytes; those that share a sampled hash with their item are aligned exactly,
ends free in the document, and reported within the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Saved, held, map_batches, text_steps
from .words import lowered, mixed, texts_of, words_of

#: Share of an item's length that may be edited.
MAX_DISTANCE = 0.15
#: Independent walks over a window, and sampled places of each walk's hash.
REPEATS, SAMPLES = 48, 2
#: Short walks from a word, their steps and sampled places, and bytes of the words that they start from.
SEEDS, SEED_STEPS, SEED_SAMPLES, SEED_WORD = 3, 32, 10, 4
#: Walks over letters and digits alone, and how many places of such a text, chosen by a hash of CLOSE_BYTES bytes, one starts from.
CLOSE_SEEDS, CLOSE_BYTES, CLOSE_ONE_IN = 2, 3, 8
#: Places of the text that must vote for a window: VOTES, fewer for items with up to FEW_SEEDS times as many seeds, and one
#: in MANY_SEEDS seeds of a long item, whose windows may drift so far that chance puts some votes anywhere.
VOTES, FEW_SEEDS, MANY_SEEDS = 3, 6, 25
#: Most items that are sent to the tasks; larger benchmarks are searched in so many blocks of items.
ITEMS = 20_000
#: A start within so many characters of another belongs to its window.
NEAR = 12
#: Seeds that more than this share of the items have (and more than three) say nothing.
COMMON = 0.015
#: Bytes a word beyond which an item is placed by runs of GRAM bytes, and the least bytes of such an item: less is no evidence.
SPARSE, GRAM, LEAST = 12, 5, 24
#: Bytes of the runs that are counted before an alignment.
RUN = 3
#: Steps after which the random bits of a walk begin again.
PERIOD = 1024
_BITS = 22
_FAR = np.uint64(0x9E3779B97F4A7C15)


class Walks(NamedTuple):
    """Random bits by step, walk and character; a table that no item's length changes."""

    bits: np.ndarray
    seed: int

    def places(self, length: int) -> np.ndarray:
        """Sampled steps (walk, sample) for strings of ``length`` characters: where such a string still has characters."""
        rng = np.random.Generator(np.random.PCG64([self.seed, length]))
        return rng.integers(0, max(1, int(1.6 * length)), (REPEATS, SAMPLES))


def walks(seed: int = 5) -> Walks:
    rng = np.random.Generator(np.random.PCG64(seed))
    return Walks(rng.integers(0, 2, (PERIOD, REPEATS, 256), dtype=np.uint8), seed)


def _seed_walks(seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Random bits by walk, step and character, and whether a walk samples a step."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = rng.integers(0, 2, (SEEDS, SEED_STEPS, 256), dtype=np.int64)
    sampled = np.zeros((SEEDS, SEED_STEPS), bool)
    for k in range(SEEDS):
        sampled[k, rng.choice(SEED_STEPS, SEED_SAMPLES, replace=False)] = True
    return bits, sampled


_SEED_BITS, _SEED_SAMPLED = _seed_walks()


def embed(strings: list[bytes], lengths: list[int], walk: Walks) -> np.ndarray:
    """Hashes (string, walk) of the sampled places of each walk over each string, of which so many bytes count."""
    out = np.zeros((len(strings), REPEATS), np.uint64)
    first = 0
    while first < len(strings):
        count = max(1, min(200, 50_000 // max(1, max(lengths[first : first + 200]))))
        part, sizes = strings[first : first + count], np.array(lengths[first : first + count])
        n, longest = len(part), int(sizes.max())
        padded = np.zeros((n, longest + 1), np.uint8)
        for k, s in enumerate(part):
            padded[k, : min(len(s), sizes[k])] = np.frombuffer(s, np.uint8, min(len(s), int(sizes[k])))
        flat, base = padded.ravel(), (np.arange(n) * (longest + 1))[:, None]
        at, stop, walker = np.zeros((n, REPEATS), np.int64), sizes[:, None], np.arange(REPEATS)[None]
        seen = np.zeros((int(1.6 * longest) + 1, n, REPEATS), np.uint8)
        for step in range(len(seen)):
            c = seen[step] = flat[base + at]
            at = np.minimum(at + walk.bits[step % PERIOD][walker, c], stop)
        places = {size: walk.places(size) for size in set(sizes.tolist())}
        where = np.stack([places[size] for size in sizes.tolist()])
        key = np.broadcast_to(np.arange(REPEATS, dtype=np.uint64) + np.uint64(1), (n, REPEATS))
        for k in range(SAMPLES):
            key = mixed(key * _FAR + seen[where[:, :, k], np.arange(n)[:, None], walker] + np.uint64(1))
        out[first : first + n] = key
        first += n
    return out


def seed_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, walk: int) -> np.ndarray:
    """The sampled characters of a short walk from each start; there are no characters from its stop on."""
    keys = np.full(len(starts), np.uint64(walk + 1))
    open_end = stops - starts < SEED_STEPS
    for rows in (np.flatnonzero(~open_end), np.flatnonzero(open_end)):
        if not len(rows):
            continue
        at, stop, key = starts[rows], stops[rows], keys[rows]
        near, moves = bool(open_end[rows[0]]), np.empty(len(rows), np.int64)
        c = np.empty(len(rows), np.uint8)
        for step in range(SEED_STEPS):
            np.take(data, at, out=c, mode="clip")
            if near:
                c[at >= stop] = 0
            if _SEED_SAMPLED[walk, step]:
                key = key * _FAR + c
            np.take(_SEED_BITS[walk, step], c, out=moves, mode="clip")
            at += moves
        keys[rows] = key
    return mixed(keys)


def seed_starts(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words short walks start from."""
    return np.flatnonzero(ends - starts >= SEED_WORD)


_LETTERS = np.zeros(256, bool)
_LETTERS[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def close_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters and digits of lower-cased bytes, where they stand, and which of them short walks start from."""
    place = np.flatnonzero(_LETTERS[data])
    letters = data[place]
    code = np.zeros(max(0, len(letters) - CLOSE_BYTES + 1), np.uint32)
    for k in range(CLOSE_BYTES):
        code = code * np.uint32(0x01000193) + letters[k : k + len(code)]
    return letters, place, np.flatnonzero((code * np.uint32(0x9E3779B1)) >> np.uint32(8) & np.uint32(CLOSE_ONE_IN - 1) == 0)


def edit_distance(item: bytes, window: bytes, most: int) -> tuple[int, int, int] | None:
    """Least edits that turn ``item`` into a stretch of ``window``, and its start and end; None beyond ``most``."""
    n = len(window)
    text = np.frombuffer(window, np.uint8)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, c in enumerate(item, 1):
        swap = cost[:-1] + (text != c)
        drop = cost + 1
        best, origin = drop.copy(), start.copy()
        better = swap < best[1:]
        best[1:][better], origin[1:][better] = swap[better], start[:-1][better]
        # insertions run along the row: the least of best[j] - j up to each place
        lead = np.minimum.accumulate((best - steps) * (n + 1) + steps)
        source = lead % (n + 1)
        cost, start = best[source] + steps - source, origin[source]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


def run_codes(data: np.ndarray) -> np.ndarray:
    """A 16-bit code of the RUN bytes from each byte on."""
    n = max(0, len(data) - RUN + 1)
    code = np.zeros(n, np.uint32)
    for k in range(RUN):
        code = code * np.uint32(0x9E3779B1) + data[k : k + n]
    return (code * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def may_hold(codes: np.ndarray, stretch: np.ndarray, edits: int) -> bool:
    """False only if the item of these run codes cannot be in the stretch within so many edits: one edit changes RUN runs at most."""
    there = np.zeros(1 << 16, bool)
    there[run_codes(stretch)] = True
    return int(there[codes].sum()) >= len(codes) - RUN * edits


def sparse(n_bytes: int, n_words: int) -> bool:
    return n_bytes >= LEAST and n_words * SPARSE < n_bytes


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    n = max(0, len(data) - GRAM + 1)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(8) | data[k : k + n]
    return mixed(key)


class Places:
    """Keys of items by place: which item has a key, and where."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray, int]]):
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _, _ in found)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.items = np.concatenate([np.zeros(0, np.int64), *(np.full(len(k), i) for k, _, i in found)])[order]
        self.offsets = np.concatenate([np.zeros(0, np.int64), *(at for _, at, _ in found)])[order]
        self.maybe = np.zeros(1 << _BITS if found else 0, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key that items have with each of its entries."""
        hit = np.flatnonzero(self.maybe.take((keys >> np.uint64(64 - _BITS)).view(np.int64)))
        low, high = np.searchsorted(self.keys, keys[hit], "left"), np.searchsorted(self.keys, keys[hit], "right")
        n = high - low
        return np.repeat(hit, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """Seeds and walk hashes of the items."""

    def __init__(self, ids: list[int], texts: list[str], max_distance: float):
        self.ids, self.texts = ids, [lowered(texts_of(pa.array([t]))).data.tobytes() for t in texts]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(max_distance * len(t)) for t in self.texts], np.int64)
        self.needs = np.ones(len(ids), np.int64)
        seeds: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[] for _ in range(SEEDS)]
        close: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[] for _ in range(CLOSE_SEEDS)]
        grams = []
        for i, t in enumerate(self.texts):
            data = np.frombuffer(t, np.uint8)
            words = words_of(texts_of(pa.array([t.decode("utf-8", "replace")])))
            if sparse(len(t), len(words.starts)):
                keys = gram_keys(data)
                grams.append((keys, np.arange(len(keys)), i))
                self.needs[i] = max(1, len(keys) - GRAM * self.most[i])  # an edit changes GRAM runs at most
                continue
            chosen = seed_starts(words.starts, words.ends)
            starts = words.starts[chosen if len(chosen) else slice(None)]
            self.needs[i] = max(min(VOTES, 1 + len(starts) // (FEW_SEEDS + 1)), len(starts) // MANY_SEEDS)
            for walk in range(SEEDS):
                seeds[walk].append((seed_keys(data, starts, np.full(len(starts), len(t)), walk), starts, i))
            letters, place, begins = close_text(data)
            for walk in range(CLOSE_SEEDS):
                close[walk].append((seed_keys(letters, begins, np.full(len(begins), len(letters)), walk), place[begins], i))
        self.seeds, self.close = ([Places(_telling(found, len(ids))) for found in kind] for kind in (seeds, close))
        self.grams = Places(grams)
        self.every_word = any(len(seed_starts(*_word_bounds(t))) == 0 for t in self.texts)
        self.codes = [run_codes(np.frombuffer(t, np.uint8)) for t in self.texts]
        self.walks = walks()
        self.hashes = embed(self.texts, self.lengths.tolist(), self.walks)


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(texts_of(pa.array([text.decode("utf-8", "replace")])))
    return words.starts, words.ends


def _telling(found: list[tuple[np.ndarray, np.ndarray, int]], n_items: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Seeds without those that many items have, but for items that have hardly others."""
    if not found:
        return found
    known, n = np.unique(np.concatenate([np.unique(k) for k, _, _ in found]), return_counts=True)
    common = known[n > max(3, COMMON * n_items)]
    out = []
    for keys, at, item in found:
        plain = np.isin(keys, common)
        rare = ~plain if (~plain).sum() >= FEW_SEEDS else np.ones(len(keys), bool)
        out.append((keys[rare], at[rare], item))
    return out


def leaks_of(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end) in bytes of the lower-cased texts: the best of each stretch of nearby windows."""
    texts = lowered(texts_of(column))
    bounds, words = np.asarray(texts.bounds), words_of(texts)
    found: list[tuple[int, int, int, int, int]] = []
    chosen = slice(None) if index.every_word else seed_starts(words.starts, words.ends)
    begins = words.starts[chosen]
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(words.firsts))[chosen]
    stops = bounds[row_of + 1]
    rows, items, places, starts = ([np.zeros(0, np.int64)] for _ in range(4))
    for walk, seeds in enumerate(index.seeds):
        if not len(seeds.keys):
            continue
        at, entry = seeds.hits(seed_keys(texts.data, begins, stops, walk))
        rows.append(row_of[at])
        items.append(seeds.items[entry])
        places.append(begins[at])
        starts.append(begins[at] - seeds.offsets[entry])
    if any(len(seeds.keys) for seeds in index.close):
        letters, where, begins = close_text(texts.data)
        edges = np.searchsorted(where, bounds)
        owner = np.searchsorted(edges, begins, "right") - 1
        for walk, seeds in enumerate(index.close):
            at, entry = seeds.hits(seed_keys(letters, begins, edges[owner + 1], walk))
            rows.append(owner[at])
            items.append(seeds.items[entry])
            places.append(where[begins[at]])
            starts.append(where[begins[at]] - seeds.offsets[entry])
    if len(index.grams.keys):
        at, entry = index.grams.hits(gram_keys(texts.data))
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + GRAM <= bounds[row + 1]
        at, entry, row = at[inside], entry[inside], row[inside]
        rows.append(row)
        items.append(index.grams.items[entry])
        places.append(at)
        starts.append(at - index.grams.offsets[entry])
    row, item, place, start = map(np.concatenate, (rows, items, places, starts))
    if not len(row):
        return found
    # a place votes once for a start of an item, whichever walks agree there
    votes = np.unique(np.stack((row * len(index.ids) + item, start, place), 1), axis=0)
    pair, start = votes[:, 0], votes[:, 1]
    most = index.most[pair % len(index.ids)]
    # starts drift by insertions and deletions: votes up to the allowed distance apart support each other
    span = int(len(texts.data) + index.lengths.max() + index.most.max() + 1) * 2
    line = np.unique(pair, return_inverse=True)[1] * span + start + int(index.lengths.max())
    support = np.searchsorted(line, line + most, "right") - np.searchsorted(line, line - most, "left")
    strong = support >= index.needs[pair % len(index.ids)]
    pair, start, line, most = pair[strong], start[strong], line[strong], most[strong]
    if not len(pair):
        return found
    new = np.ones(len(pair), bool)
    new[1:] = line[1:] - line[:-1] > np.minimum(NEAR, most[1:] + 1)
    firsts = np.flatnonzero(new)
    # of groups within the allowed distance of each other those with most votes place the window
    size = np.diff(np.append(firsts, len(pair)))
    cluster = np.cumsum(np.concatenate(([True], np.diff(line) > most[1:])))[firsts] - 1
    largest = np.zeros(cluster[-1] + 1, np.int64)
    np.maximum.at(largest, cluster, size)
    placing = 2 * size >= largest[cluster]
    lasts = (np.append(firsts[1:], len(pair)) - 1)[placing]
    firsts = firsts[placing]
    low, high, middle = start[firsts], start[lasts], start[(firsts + lasts) // 2]
    group_row, group_item = pair[firsts] // len(index.ids), pair[firsts] % len(index.ids)
    windows, sizes, owner, spans = [], [], [], {}
    for g, (r, i) in enumerate(zip(group_row.tolist(), group_item.tolist(), strict=True)):
        begin, stop, length, edits = int(bounds[r]), int(bounds[r + 1]), int(index.lengths[i]), int(index.most[i])
        a, b = max(begin, int(low[g]) - edits), min(stop, int(high[g]) + length + edits)
        if not may_hold(index.codes[i], texts.data[a:b], edits):
            continue
        spans[g] = (a, b)
        for p in {int(middle[g]), int(low[g])}:
            windows.append(bytes(max(0, begin - p)) + texts.data[max(begin, p) : min(stop, p + length)].tobytes())
            sizes.append(length)
            owner.append(g)
    if not windows:
        return found
    alike = (embed(windows, sizes, index.walks) == index.hashes[group_item[owner]]).any(1)
    for g in sorted({g for g, same in zip(owner, alike.tolist(), strict=True) if same}):
        r, i, (a, b) = int(group_row[g]), int(group_item[g]), spans[g]
        begin, edits = int(bounds[r]), int(index.most[i])
        if (got := edit_distance(index.texts[i], texts.data[a:b].tobytes(), edits)) is not None:
            found.append((r, i, got[0], a + got[1] - begin, a + got[2] - begin))
    best: dict[tuple[int, int, int], tuple[int, int, int, int, int]] = {}
    for leak in found:
        key = (leak[0], leak[1], leak[4])
        best[key] = min(best.get(key, leak), leak)
    return sorted(best.values())


def _index(ids: list[int], texts: list[str], max_distance: float) -> Index:
    """Built once a worker for a block of items, whatever the number of its tasks in a stage."""
    return held(("items", max_distance, hash((tuple(ids), tuple(texts)))), lambda: Index(ids, texts, max_distance))


def _searching(ids: list[int], texts: list[str], max_distance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(ids, texts, max_distance)
        for batch in batches:
            for step in text_steps(batch):
                leaks = leaks_of(step.column("text"), index)
                if not leaks:
                    continue
                raw = [t.encode() if t else b"" for t in step.column("text").take(pa.array([k[0] for k in leaks])).to_pylist()]
                chars = [(len(t[: k[3]].decode("utf-8", "ignore")), len(t[: k[4]].decode("utf-8", "ignore"))) for t, k in zip(raw, leaks, strict=True)]
                yield pa.record_batch(
                    [step.column("doc_id").cast(pa.int64()).take(pa.array([k[0] for k in leaks])), pa.array([index.ids[k[1]] for k in leaks], pa.int64()), pa.array([k[2] for k in leaks], pa.int64()), pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64())],
                    names=["doc_id", "item_id", "distance", "start", "end"],
                )

    return run


def benchmark_leaks(docs: DataFrame, items: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of each benchmark passage in ``docs`` (doc_id, text).

    ``items`` has item_id and text. A passage is a stretch of a text, A-Z lower-cased, within ``max_distance`` of an
    item's length in bytes; start and end are code points of the text. Null texts hold nothing; null, empty and
    items of one word below LEAST bytes are found nowhere, as a single word is no evidence. Rows that repeat a doc_id or
    item_id each count; of items that end at one place the nearest counts, of equally near ones the first. Items and texts
    may have any length: tables are as large as the items, whatever the longest is. An empty table on either side gives
    an empty result. Items are sent to the tasks in blocks of ``ITEMS``.
    """
    spark, kind = docs.sparkSession, "doc_id long, item_id long, distance long, start long, end long"
    usable = Saved(items.where("text IS NOT NULL AND text RLIKE '[^ \\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]' OR " f"octet_length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '')) >= {LEAST}").select(F.col("item_id").cast("long").alias("item_id"), "text", (F.row_number().over(_by_item()) - 1).alias("place")), "items")
    # no rows by range(0): createDataFrame would start a second kind of Python workers, which stay in the executors' memory
    found = spark.range(0).select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "item_id", "distance", "start", "end")))
    for block in range(-(-usable.df.count() // ITEMS)):
        rows = usable.df.where((F.col("place") >= block * ITEMS) & (F.col("place") < (block + 1) * ITEMS)).orderBy("place").collect()
        found = found.unionByName(map_batches(docs.select("doc_id", "text"), _searching([r.item_id for r in rows], [r.text for r in rows], max_distance), kind))
    usable.drop()
    return found


def _by_item():
    from pyspark.sql import Window

    return Window.orderBy("item_id", "text")


def contaminated(docs: DataFrame, items: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(doc_id, n_leaks, items) of the documents with a benchmark passage, ``items`` ascending and distinct."""
    leaks = benchmark_leaks(docs, items, max_distance)
    return leaks.groupBy("doc_id").agg(F.count("*").alias("n_leaks"), F.array_sort(F.collect_set("item_id")).alias("items"))
