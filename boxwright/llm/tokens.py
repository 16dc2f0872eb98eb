"""Token counts by prefix dynamic programming, and cached whole-text encoding, with public tokenizers.

A text is cut where no token can cross, so that the tokens of a text are those of its pieces and each distinct piece
is encoded once in a batch, with each of its own prefixes. ``prefix_counts`` keeps the exact number of tokens of every
prefix of a text, as the lengths at which it changes. Truncation and budget questions are then look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held, map_batches, text_steps

COUNT_MODEL = "piece_bpe_32k.model"
IDS_MODEL = "word_bpe_49k.json"
LIMIT = 4096
#: Distinct pieces that a worker remembers before it starts afresh, and units in each of the two generations that it keeps.
CACHE, GENERATION = 1_000_000, 300_000
#: Characters of the remembered pieces, at most; length beyond which a piece's prefixes are counted by one pass over it;
#: how many pairs of tokens are remembered.
CACHE_CHARS, LONG, MEMORY = 12_000_000, 48, 200_000
#: Characters of a text that are cut into units at once, at least.
PART_CHARS = 1 << 20
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only are cut by _UNIT as the tokenizer cuts them: composed, cased one to one, no spaces.
_PLAIN = re.compile("[!-;=-~¡-įı-ɏ]+")
_MARKS = frozenset(".,;:!?")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(" *[^ ]+| +$")
_BLANK = re.compile(r"\s")
#: Kinds of characters, as ``_UNIT`` tells them apart in words of _PLAIN without apostrophes: runs of letters, single
#: numbers, runs of others. A word with an odd one is a key of its own. No white space lies beyond _TOP.
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_TOP = 0x3001


def _kind(c: str) -> int:
    if c.isspace():
        return _SPACE
    if c == "'" or not _PLAIN.fullmatch(c):
        return _ODD
    return _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER


_KINDS = np.array([*map(_kind, map(chr, range(_TOP))), _ODD], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _KINDS[c] < _ODD else c for c in range(_TOP + 1)], "<u4")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Token counts of a sentencepiece BPE model without begin and end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._forget()
        self.vocabulary = {self.model.id_to_piece(i): i for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}
        self.longest = max(map(len, self.vocabulary))
        self.pairs: dict[tuple[str, str], bool] = {}

    def pieces(self, text: str) -> list[str]:
        """Runs of spaces with what follows, each without one space, which the model itself puts before a piece.

        No token holds a space after another character, so none crosses a cut. A lone space at the end is ''. The
        character U+2581 counts as a space: the model has one symbol for both.
        """
        text = text.replace("▁", " ")
        if text == "":
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [run[1:] for run in _RUNS.findall(" " + text)]
        return text.split(" ")

    def _forget(self) -> None:
        """Known pieces: place, and by place the characters, first entry and entries (characters and tokens where the tokens change)."""
        self.place: dict[str, int] = {}
        self.chars, self.first, self.offset, self.count = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, pieces: set[str]) -> None:
        if len(self.place) > CACHE or self.chars.sum() > CACHE_CHARS:
            self._forget()
        fresh = [p for p in pieces if p not in self.place]
        for at in range(0, len(fresh), 20_000):
            self._add(fresh[at : at + 20_000])

    def _add(self, fresh: list[str]) -> None:
        """Counts of all prefixes of new pieces. In sorted order a piece shares its first prefixes with the one before it, so each is encoded once."""
        fresh.sort()
        chars = np.fromiter(map(len, fresh), np.int64, len(fresh))
        brief = np.flatnonzero(chars <= LONG)
        pieces, sizes = [fresh[k] for k in brief.tolist()], chars[brief]
        letters = np.array([p.encode("utf-32-le").ljust(4 * LONG, b"\0") for p in pieces], f"S{4 * LONG}").view(np.uint32).reshape(len(pieces), LONG)
        shared = np.zeros(len(pieces), np.int64)
        if len(pieces):
            differs = np.concatenate((letters[1:] != letters[:-1], np.ones((len(pieces) - 1, 1), bool)), 1)
            shared[1:] = np.minimum(differs.argmax(1), sizes[:-1])
        plan = list(zip(pieces, shared.tolist(), sizes.tolist(), strict=True))
        wanted = [p[:k] for p, low, n in plan for k in range(low + 1, n + 1)]
        # every piece has 1 token at length 0, its space mark
        found = np.fromiter(chain((1,), map(len, self.model.encode(wanted, num_threads=1)) if wanted else ()), np.int32, len(wanted) + 1)
        places, row, after = [], [0], 1
        for _, low, n in plan:
            row = [*row[: low + 1], *range(after, after + n - low)]
            after += n - low
            places += row
        stops = np.cumsum(chars + 1)
        starts = stops - chars - 1
        counts = np.empty(int(stops[-1]), np.int32)
        known = np.ones(len(counts), bool)
        for k in np.flatnonzero(chars > LONG).tolist():
            counts[starts[k] : stops[k]], known[starts[k] : stops[k]] = self.inside(fresh[k]), False
        counts[known] = found[places]
        change = np.ones(len(counts), bool)
        change[1:] = counts[1:] != counts[:-1]
        change[starts] = True
        at = np.flatnonzero(change)
        owner = np.searchsorted(stops, at, "right")
        self.place.update(zip(fresh, range(len(self.chars), len(self.chars) + len(fresh)), strict=True))
        self.chars = np.concatenate((self.chars, chars))
        self.first = np.concatenate((self.first, self.first[-1] + np.searchsorted(at, stops)))
        self.offset = np.concatenate((self.offset, (at - starts[owner]).astype(np.int32)))
        self.count = np.concatenate((self.count, counts[at]))

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds by text, and within them, ascending, the lengths of prefixes at which the tokens change and the tokens from there on."""
        split = [self.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        size = np.fromiter(map(len, split), np.int64, len(split))
        piece = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        low, high = self.first[piece], self.first[piece + 1]
        n, chars, total = high - low, np.cumsum(self.chars[piece] + 1), np.cumsum(self.count[high - 1], dtype=np.int64)
        chars, total = np.concatenate(([0], chars)), np.concatenate(([0], total))
        head = np.cumsum(size) - size
        begin, base = chars[:-1] - np.repeat(chars[head], size), total[:-1] - np.repeat(total[head], size)
        entry = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(low - entry[:-1], n) + np.arange(entry[-1])
        ends, counts = np.repeat(begin, n) + self.offset[source], np.repeat(base, n) + self.count[source]
        # a text has no token at length 0: its first piece's mark comes with its first character
        mark = entry[head[size > 0]]
        double = mark[(n[head[size > 0]] > 1) & (np.append(ends, 0)[mark + 1] == 1)]
        ends[mark] = 1
        bounds = np.concatenate((entry[head], entry[-1:]))
        kept = np.ones(len(ends), bool)
        kept[double] = False
        return bounds - np.searchsorted(double, bounds), ends[kept], counts[kept]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the prefixes of ``text`` at which their tokens change, ascending, and the tokens from there on."""
        return self.tables([text])[1:]

    def _together(self, a: str, b: str) -> bool:
        """Whether the tokens a and b stay two when they meet, b standing after a."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            self.pairs[a, b] = self._encoded(a + b) == [a, b]
        return self.pairs[a, b]

    def _encoded(self, symbols: str) -> list[str]:
        if symbols == "▁":
            return [symbols]
        if symbols[0] == "▁":
            return self.model.encode(symbols[1:].replace("▁", " "), out_type=str)
        # a leading newline is always a token of its own and takes the model's space mark away from the symbols
        return self.model.encode("\n" + symbols.replace("▁", " "), out_type=str)[2:]

    def inside(self, piece: str) -> np.ndarray:
        """Tokens of each prefix of a piece, the empty one (its space mark alone) first: one pass from left to right.

        The last token of a prefix is the only one that follows the last token of the prefix before it without
        merging with it, so each count is one more than an earlier one.
        """
        marked = "▁" + piece.replace(" ", "▁")
        last, count = [""] * (len(marked) + 1), np.zeros(len(marked) + 1, np.int64)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - self.longest), end):
                token = marked[start:end]
                known = token in self.vocabulary
                if known and (self._encoded(token) == [token] if not start else not last[start] or self._together(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
                    break
            else:
                last[end], count[end] = "", count[end - 1] + len(marked[end - 1].encode())
        return count[1:]

    def at(self, text: str, length: int) -> int:
        """Tokens of the first ``length`` characters of ``text``, from the stored counts of its prefixes."""
        ends, counts = self.counts(text)
        k = int(np.searchsorted(ends, length, "right"))
        return int(counts[k - 1]) if k else 0

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens; longer ones can have fewer than shorter ones."""
        ends, counts = self.counts(text)
        fits = np.flatnonzero(counts <= budget)
        after = int(fits[-1]) + 1 if len(fits) else 0
        return int(ends[after]) - 1 if after < len(ends) else len(text)


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def _differences(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each value less the one before it in its text; the first of a text stays."""
    out = np.diff(values, prepend=0)
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    out[first] = values[first]
    return out


def _counting(path: str, keep: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            for step in text_steps(batch):
                texts = pc.fill_null(step.column("text"), "").to_pylist()
                bounds, ends, counts = table.tables(texts)
                n_tokens = np.append(0, counts)[bounds[1:]] * (bounds[1:] > bounds[:-1])
                columns = [step.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64())]
                if packed:
                    ends, counts = (_differences(part, bounds) for part in (ends, counts))
                if keep:
                    columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(part, pa.int32())) for part in (ends, counts)]
                yield pa.record_batch([*columns, pc.cast(pc.binary_length(pc.fill_null(step.column("text"), "")), pa.int64())], names=["doc_id", "n_tokens", "ends", "counts", "n_bytes"] if keep else ["doc_id", "n_tokens", "n_bytes"])

    return run


def prefix_counts(docs: DataFrame, model: str = COUNT_MODEL, keep: bool = True, packed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ends, counts, n_bytes) of each row of ``docs`` (doc_id, text; further columns are ignored).

    ``ends`` and ``counts`` hold the exact token counts of all prefixes: the lengths in characters at which the count
    changes, and the count from each up to the next; ``n_tokens`` is the last count. With ``packed``
    each entry of both is its difference from the one before, for tables on disk; ``unpacked`` undoes that. Without ``keep`` the two arrays are left out. Null and empty texts have no
    prefix and 0 tokens; each row is counted on its own, whatever its doc_id; an empty table gives an empty result.
    """
    path = public_path(model)
    arrays = ", ends array<int>, counts array<int>" if keep else ""
    return map_batches(docs.select("doc_id", "text"), _counting(path, keep, packed), f"doc_id long, n_tokens long{arrays}, n_bytes long")


def unpacked(table: DataFrame) -> DataFrame:
    """A packed table with the lengths and counts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in ("ends", "counts"):
                at, lists = batch.schema.get_field_index(name), batch.column(name)
                bounds, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)
                total = np.cumsum(values, dtype=np.int64)
                before = np.repeat(np.append(0, total)[bounds[:-1]], np.diff(bounds))
                batch = batch.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(total - before, pa.int32())).cast(batch.schema.field(at).type))
            yield batch

    return map_batches(table, run, table.schema)


def tokens_within(counts: Column | str, ends: Column | str, length: Column | int) -> Column:
    """Tokens of the first ``length`` characters: a look-up in a kept table."""
    k = F.size(F.filter(F.col(ends) if isinstance(ends, str) else ends, lambda e: e <= length))
    return F.when(k > 0, F.element_at(counts, k)).otherwise(0)


def _units(word: str) -> list[str] | None:
    """The units of a word that ``_UNIT`` cuts as the tokenizer does; None for others. Letters alone, and with one mark after them, need no pattern."""
    if word.isascii():
        if word.isalpha():
            return [word.lower()]
        if word[-1] in _MARKS and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
    return _UNIT.findall(word.lower()) if _PLAIN.fullmatch(word) else None


def _parts(text: str) -> Iterator[str]:
    """A text in parts of PART_CHARS and up to the next white space."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PART_CHARS)
        stop = blank.start() if blank else len(text)
        yield text[at:stop]
        at = stop


class IdCache:
    """Little-endian unsigned 32-bit ids of whole texts with a lower-casing word BPE, without special tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.closes = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.chars = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_units(self, fresh: list[str]) -> None:
        """Each unit ends with its only token that closes a word, so many can be encoded as one text."""
        for at in range(0, len(fresh), 2_000):
            part = fresh[at : at + 2_000]
            ids = np.asarray(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(part):
                self.units.update((u, self.whole(u)) for u in part)
                continue
            data, stops = ids.tobytes(), (stops * 4).tolist()
            self.units.update(zip(part, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    @staticmethod
    def _recalled(keys: list[str], young: dict[str, bytes], old: dict[str, bytes]) -> list[str]:
        """Take what the generation before knows; the keys that it doesn't know."""
        if not old:
            return keys
        young.update((k, old[k]) for k in keys if k in old)
        return [k for k in keys if k not in old]

    def learn(self, units: list[str], words: list[str]) -> None:
        """Ids of new ``units`` and of new ``words``, which hold a character of which _KINDS says nothing."""
        if len(self.units) > GENERATION or self.chars > CACHE_CHARS:
            self.chars = 0
            self.old_units, self.units = self.units, {}
        odd = self._recalled([w for w in words if w not in self.units], self.units, self.old_units)
        cut = list(map(_units, odd))
        fresh = self._recalled([u for u in units if u not in self.units], self.units, self.old_units)
        if odd:
            inner = {u for us in cut if us is not None for u in us}.difference(fresh)
            fresh += self._recalled([u for u in inner if u not in self.units], self.units, self.old_units)
        self.chars += sum(map(len, odd)) + sum(map(len, fresh))
        self._learn_units(fresh)
        known = self.units
        known.update([(w, self.whole(w) if us is None else b"".join([known[u] for u in us])) for w, us in zip(odd, cut, strict=True)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; those of ASCII and others apart, as the first take a byte a character."""
        out, kinds = [b""] * len(texts), ([], [])
        for i, text in enumerate(texts):
            if _ODD_SPACE.search(text):
                out[i] = self.whole(text)
            elif len(text) > PART_CHARS:  # white space separates units, so a long text is cut there
                out[i] = b"".join(self._joined([part])[0] for part in _parts(text))
            else:
                kinds[text.isascii()].append(i)
        for kind in filter(None, kinds):
            for i, ids in zip(kind, self._joined([texts[i] for i in kind]), strict=True):
                out[i] = ids
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Looks up the distinct units of the texts once, and gathers the ids of all by their places."""
        text = "\n".join(texts)
        ascii = text.isascii()
        chars = np.frombuffer(text.encode("ascii" if ascii else "utf-32-le"), np.uint8 if ascii else "<u4")
        near = chars if ascii else np.minimum(chars, _TOP)
        kind = _KINDS[near]
        inside = kind != _SPACE
        begins = inside.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        lower, strange, whole = _LOWER[near].astype(chars.dtype), kind == _ODD, None
        if strange.any():
            head = inside.copy()
            head[1:] &= ~inside[:-1]
            word = np.cumsum(head, dtype=np.int32)
            hit = np.zeros(int(word[-1]) + 1, bool)
            hit[word[strange]] = True
            whole = hit[word] & inside
            begins = np.where(whole, head, begins)
            lower = np.where(whole, chars, lower)
        lower, at = lower[inside], np.flatnonzero(begins)
        bounds, data = np.append(np.flatnonzero(begins[inside]), len(lower)), lower.tobytes()
        if not ascii:
            size = (lower > 0x7F).astype(np.uint8) + (lower > 0x7FF) + (lower > 0xFFFF) + 1
            bounds, data = np.append(0, np.cumsum(size, dtype=np.int64))[bounds], data.decode("utf-32-le").encode()
        units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        words = set() if whole is None else set(np.unique(units.indices.to_numpy()[whole[at]]).tolist())
        self.learn([u for k, u in enumerate(names) if k not in words] if words else names, [names[k] for k in words])
        found = list(map(self.units.__getitem__, names))
        bounds = np.cumsum(np.fromiter(chain((0,), map(len, found)), np.int64, len(found) + 1))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(found))]).take(units.indices)
        # a text begins after those before it and the characters between them
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edges = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(at, starts)].tolist()
        data = ids.buffers()[2].to_pybytes() if edges[-1] else b""
        return [data[edges[i] : edges[i + 1]] for i in range(len(texts))]


def id_cache(path: str) -> IdCache:
    return held(("ids", path), lambda: IdCache(path))
