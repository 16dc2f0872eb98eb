"""Run-length masks to polygons: decoding of both forms of run lengths and border following, on numpy in Arrow batches.

The borders of all masks of a batch are followed at once. Where a border goes from a pixel depends on where it came from
and on the pixels around, so such states and their successors are arrays, and each cycle of successors is a border.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps around a pixel, clockwise from the right, as row and column.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def run_lengths(counts: list[int] | str) -> np.ndarray:
    """Lengths of runs, background first. Text has five bits a character, low ones first, and from the third run on the difference from the run two before."""
    if not isinstance(counts, str):
        return np.asarray(counts, np.int64)
    runs: list[int] = []
    value = shift = 0
    for character in counts:
        bits = ord(character) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return np.array(runs, np.int64)


def decoded(counts: list[int] | str, height: int) -> tuple[np.ndarray, int]:
    """The columns of the mask that have anything, and the first one's number. Runs go down one column after another."""
    runs = run_lengths(counts)
    ends = np.cumsum(runs)
    starts, ends = (ends - runs)[1::2], ends[1::2]
    starts, ends = starts[ends > starts], ends[ends > starts]
    if not len(starts) or height <= 0:
        return np.zeros((0, 0), np.int8), 0
    first, last = int(starts[0] // height), int((ends[-1] - 1) // height)
    change = np.zeros((last - first + 1) * height + 1, np.int8)
    np.add.at(change, starts - first * height, 1)
    np.add.at(change, ends - first * height, -1)
    return np.cumsum(change[:-1], dtype=np.int8).reshape(-1, height).T, first


def _followed(f: np.ndarray, i: int, j: int, back: int, label: int) -> list[tuple[int, int, int]]:
    """The border that begins at (i, j), coming from direction ``back``: places with the direction in which each is left. Marks it in ``f``."""
    for turn in range(8):
        first = (back + turn) % 8
        if f[i + _AROUND[first][0], j + _AROUND[first][1]]:
            break
    else:
        f[i, j] = -label
        return [(i, j, -1)]
    start, second = (i, j), (i + _AROUND[first][0], j + _AROUND[first][1])
    came, here, out = first, start, []  # came: the direction of the pixel before
    while True:
        right_empty = False
        for turn in range(1, 9):
            way = (came - turn) % 8
            there = (here[0] + _AROUND[way][0], here[1] + _AROUND[way][1])
            if f[there]:
                break
            right_empty |= way == 0
        if right_empty:
            f[here] = -label
        elif f[here] == 1:
            f[here] = label
        out.append((*here, way))
        if there == start and here == second:
            return out
        here, came = there, (way + 4) % 8


def contours(mask: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Borders of a mask's parts, as [x, y] of their corner pixels: those that lie in nothing, then holes and what is inside them.

    Pixels of a part touch at sides or corners. A row's changes between empty and full are looked at in order; each where no
    border runs yet begins one. What a part lies in is told by the border to its left in the row.
    """
    f = np.pad(mask.astype(np.int32), 1)
    left = (f[:, 1:] != 0) & (f[:, :-1] == 0)
    right = (f[:, :-1] != 0) & (f[:, 1:] == 0)
    begin, end = np.argwhere(left) + (0, 1), np.argwhere(right)
    places = sorted([(i, j, 0) for i, j in begin.tolist()] + [(i, j, 1) for i, j in end.tolist()])
    # by label: a hole, and whether the border lies in nothing
    hole, free, label = {1: True}, {1: True}, 1
    outer, inner = [], []
    row, beside = -1, 1
    for i, j, kind in places:
        if i != row:
            row, beside = i, 1
        if kind == 0 and f[i, j] == 1:
            label += 1
            hole[label] = False
            free[label] = beside == 1 or not hole[beside] and free[beside]
            border = _followed(f, i, j, 4, label)
        elif kind == 1 and f[i, j] > 0:
            label += 1
            hole[label], free[label] = True, False
            border = _followed(f, i, j, 0, label)
        else:
            border = None
        if border is not None:
            ways = [w for *_, w in border]
            corners = [(y - 1, x - 1) for k, (y, x, w) in enumerate(border) if w != ways[k - 1] or len(border) == 1]
            (outer if free[label] else inner).append(np.array([(x, y) for y, x in corners]))
        if abs(f[i, j]) > 1:
            beside = abs(int(f[i, j]))
    return outer, inner


def shoelace(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def mask_polygons(text: str | None, least: float = 0.0) -> list[list[list[float]]] | None:
    """Polygons of a run-length mask in JSON, outer ones first, without those of under 3 points or, if asked, under an area; null if it can't be read."""
    try:
        mask = json.loads(text or "")
        height, counts = int(mask["size"][0]), mask["counts"]
    except (ValueError, TypeError, KeyError, IndexError):
        return None
    pixels, first = decoded(counts, height)
    if not pixels.size:
        return []
    found = [p for part in contours(pixels) for p in part if len(p) >= 3]
    return [(p + (first, 0)).astype(float).tolist() for p in found if not least or shoelace(p) >= least]


#: Pixels of the masks that are followed together.
TOGETHER = 1 << 21
_SET = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: By the filled pixels around: the first one clockwise from a direction on, and the next one the other way round after it (-1: none).
_FIRST, _NEXT = (np.array([[next((d for d in ways(c) if around[d]), -1) for c in range(8)] for around in _SET.tolist()], np.int8) for ways in (lambda c: [(c + k) % 8 for k in range(8)], lambda c: [(c - k) % 8 for k in range(1, 9)]))
_NONE = np.iinfo(np.int64).max


def _cycles(follows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cycles of ``follows`` in order of their least keys, each from that key on: all places, the bounds of the cycles, and the cycle of each place."""
    least, ahead = key, follows
    while True:
        lower = np.minimum(least, least[ahead])
        if (lower == least).all():
            break
        least, ahead = lower, ahead[ahead]
    heads = np.flatnonzero(key == least)
    heads = heads[np.argsort(key[heads])]
    last = key[follows] == least
    left, ahead = np.where(last, 0, 1), np.where(last, np.arange(len(follows)), follows)
    while (further := left[ahead]).any():
        left, ahead = left + further, ahead[ahead]
    own = np.searchsorted(key[heads], least)
    bounds = np.concatenate(([0], np.cumsum(left[heads] + 1)))
    places = np.empty(len(follows), np.int64)
    places[bounds[own + 1] - 1 - left] = np.arange(len(follows))
    return places, bounds, own


def _borders(start: np.ndarray, end: np.ndarray, mask: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The masks, corner counts and corners of all borders of three corners and more, as ``contours`` orders them.

    ``start`` and ``end`` bound the filled runs of ``mask``, which ascends from 0 without gaps; ``height`` is a mask's.
    """
    high = height[mask]
    first, n = start // high, (end - 1) // high - start // high + 1
    piece = np.repeat(np.arange(len(start)), n)  # a run goes on in the next column
    column = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    mask, high = mask[piece], high[piece]
    top, low = np.maximum(start[piece] - column * high, 0), np.minimum(end[piece] - column * high, high)
    at = np.searchsorted(mask, np.arange(len(height)))
    x0, y0 = column[at], np.minimum.reduceat(top, at)
    wide, tall = np.maximum.reduceat(column, at) - x0 + 3, np.maximum.reduceat(low, at) - y0 + 2  # with a margin of a pixel
    base = np.cumsum(wide * tall) - wide * tall
    place = base[mask] + (column - x0[mask] + 1) * tall[mask] - y0[mask] + 1
    change = np.zeros(int((wide * tall).sum()), np.int8)
    change[place + top] = 1
    change[place + low] -= 1
    full = np.cumsum(change, dtype=np.int8).view(bool)

    pixel, mask = np.flatnonzero(full), np.repeat(mask, low - top)
    step = tall[mask]
    edge = ~(full[pixel - 1] & full[pixel + 1] & full[pixel - step] & full[pixel + step])
    pixel, mask, step = pixel[edge], mask[edge], step[edge]
    beside = [i + j * step for i, j in _AROUND]
    around = np.zeros(len(pixel), np.uint8)
    for d, by in enumerate(beside):
        around |= full[pixel + by].view(np.uint8) << np.uint8(d)
    rank = np.zeros(len(full), np.int32)
    rank[pixel] = np.arange(len(pixel))
    inside = pixel - base[mask]
    x, y = inside // step, inside % step
    line = base[mask] + y * wide[mask]  # by mask and row

    # a state is a pixel and where its border came from; each empty side of a pixel belongs to one
    state = lambda d, of: of * 8 + np.maximum(_FIRST[around[of], d], 0)
    sides = [np.flatnonzero((around >> d) & 1 == 0) for d in (0, 2, 4, 6)]
    states = np.zeros(len(pixel) * 8, bool)
    for d, of in zip((0, 2, 4, 6), sides, strict=True):
        states[state(d, of)] = True
    number = np.cumsum(states) - 1
    places = np.flatnonzero(states)
    of = places >> 3
    way = _NEXT[around[of], places & 7].astype(np.int64)
    moved = np.array([i for i, _ in _AROUND])[way] + np.array([j for _, j in _AROUND])[way] * step[of]
    follows = np.where(way < 0, np.arange(len(places)), number[rank[pixel[of] + moved] * 8 + (way + 4) % 8])
    # borders are found by their left or right sides, row by row
    right, left = sides[0], sides[2]
    key = np.full(len(places), _NONE)
    key[number[state(4, left)]] = (line + x)[left] * 2
    ends = number[state(0, right)]
    key[ends] = np.minimum(key[ends], (line + x)[right] * 2 + 1)
    places, bounds, own = _cycles(follows, key)

    # a border that begins at a left side lies in what the one that ends before it in its row lies in
    heads = places[bounds[:-1]]
    outer, root = key[heads] % 2 == 0, np.arange(len(heads))
    order = np.argsort((line + x)[right])
    before = np.searchsorted((line + x)[right][order], key[heads] // 2) - 1
    before = order[np.maximum(before, 0)]
    known = outer & (line[right][before] == line[of[heads]]) & (x[right][before] < x[of[heads]])
    root[known] = own[ends[before[known]]]
    while ((further := root[root]) != root).any():
        root = further
    free = outer[root]

    ways = way[places]
    turn = ways != np.concatenate((ways[:1], ways[:-1]))
    turn[bounds[:-1]] = ways[bounds[:-1]] != ways[bounds[1:] - 1]
    count = np.add.reduceat(turn, bounds[:-1], dtype=np.int64)
    corner = of[places[turn]]
    corners = np.stack((x[corner] - 1 + x0[mask[corner]], y[corner] - 1 + y0[mask[corner]]), 1)
    owner = mask[of[heads]]
    kept = np.lexsort((np.arange(len(heads)), ~free, owner))
    kept = kept[count[kept] >= 3]
    offset = (np.cumsum(count) - count)[kept]
    n = count[kept]
    return owner[kept], n, corners[np.repeat(offset - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _areas(n: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Shoelace areas of polygons of ``n`` corners each."""
    ends = np.cumsum(n)
    after = np.arange(len(corners)) + 1
    after[ends - 1] = ends - n
    c = corners.astype(float)
    return np.abs(np.add.reduceat(c[:, 0] * c[after, 1] - c[after, 0] * c[:, 1], ends - n)) / 2 if len(n) else np.zeros(0)


def batch_polygons(texts: list[str | None], least: float = 0.0) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """``mask_polygons`` of many texts at once: corner counts and corners of the polygons of each."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    nothing = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    rows, heights, counts = [], [], []
    for i, text in enumerate(texts):
        try:
            mask = json.loads(text or "")
            height, runs = int(mask["size"][0]), mask["counts"]
        except (ValueError, TypeError, KeyError, IndexError):
            continue
        out[i] = nothing
        if height > 0:
            rows.append(i)
            heights.append(height)
            counts.append(run_lengths(runs) if isinstance(runs, str) else runs)
    if not rows:
        return out
    n = np.fromiter(map(len, counts), np.int64, len(counts))
    run = np.fromiter(chain.from_iterable(counts), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    back = np.unique(owner[run < 0])  # runs that go back are no mask as others are
    for k in back.tolist():
        found = [np.array(p) for p in mask_polygons(texts[rows[k]], least) or []]
        out[rows[k]] = np.array(list(map(len, found)), np.int64), np.concatenate([nothing[1], *found])
    end = np.cumsum(run)
    bounds = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate(([0], end))
    end = end - total[bounds[:-1]][owner]
    kept = ((np.arange(len(run)) - bounds[:-1][owner]) % 2 == 1) & (run > 0) & ~np.isin(owner, back)
    start, end, owner = (end - run)[kept], end[kept], owner[kept]
    if not len(owner):
        return out
    height = np.array(heights, np.int64)
    masks, at = np.unique(owner, return_index=True)
    upto = np.concatenate((at[1:], [len(owner)]))
    size = ((end[upto - 1] - 1) // height[masks] - start[at] // height[masks] + 3) * (height[masks] + 2)
    low = 0
    sums = np.concatenate(([0], np.cumsum(size)))
    while low < len(masks):
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + TOGETHER, "right")) - 1)
        runs = slice(at[low], upto[high - 1])
        own, corners_of, corners = _borders(start[runs], end[runs], np.repeat(np.arange(high - low), (upto - at)[low:high]), height[masks[low:high]])
        if least:
            large = _areas(corners_of, corners) >= least
            corners = corners[np.repeat(large, corners_of)]
            own, corners_of = own[large], corners_of[large]
        polygons = np.searchsorted(own, np.arange(high - low + 1))
        points = np.concatenate(([0], np.cumsum(corners_of)))[polygons].tolist()
        polygons = polygons.tolist()
        for k, m in enumerate(masks[low:high].tolist()):
            out[rows[m]] = corners_of[polygons[k] : polygons[k + 1]], corners[points[k] : points[k + 1]]
        low = high
    return out


def polygons_of_masks(text: Column, least: float = 0.0) -> Column:
    """The polygons of run-length masks; null where the text is null."""
    kind = pa.list_(pa.list_(pa.list_(pa.float64())))

    @F.arrow_udf("array<array<array<double>>>")
    def polygons(texts: pa.Array) -> pa.Array:
        found = batch_polygons(texts.to_pylist(), least)
        there = [f for f in found if f is not None]
        counts = np.concatenate([n for n, _ in there] or [np.zeros(0, np.int64)])
        corners = np.concatenate([c for _, c in there] or [np.zeros((0, 2), np.int64)]).astype(float)
        bounds = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(corners) + 1) * 2, pa.int32()), pa.array(corners.ravel()))
        listed = pa.ListArray.from_arrays(bounds(counts), points)
        missing = np.array([f is None for f in found], bool)
        own = np.array([0 if f is None else len(f[0]) for f in found], np.int64)
        return pa.ListArray.from_arrays(bounds(own), listed, mask=pa.array(missing)).cast(kind)

    return polygons(text)
