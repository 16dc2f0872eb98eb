"""Merging of overlapping detections, window clusters and crops: order-dependent work, done per image in tasks.

Each image (and class) is a group that Spark shuffles; the kernels are numpy over the group's columns. Which boxes match is
found by a sweep over their left edges, so memory goes with the matches, not with the square of the boxes. Greedy merges of
all groups of a batch are found at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box
from .tiling import padded_crop

CORNERS = ("x1", "y1", "x2", "y2")
#: Candidate pairs that the sweep looks at together.
SWEPT = 1 << 20
#: Rounds in which all groups of a batch merge together; what chains of matches leave is done box by box.
ROUNDS = 30
Group = dict[str, np.ndarray]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[Group, np.ndarray]]:
    """The columns of many groups of neighbouring rows, and where each group begins; only the last group of a batch is carried over."""
    carried: list[Group] = []  # parts of the open group
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        change = np.zeros(batch.num_rows, bool)
        change[0] = bool(carried) and any(carried[0][k][0] != columns[k][0] for k in keys)
        for key in keys:
            change[1:] |= columns[key][1:] != columns[key][:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            last, before = int(starts[-1]), sum(len(part[keys[0]]) for part in carried)
            done = [*carried, {name: values[:last] for name, values in columns.items()}]
            yield _whole(done), np.concatenate(([0], starts[:-1] + before))
            carried, columns = [], {name: values[last:] for name, values in columns.items()}
        carried.append(columns)
    if carried:
        yield _whole(carried), np.zeros(1, np.int64)


def _target(df: DataFrame, schema: str) -> tuple[str, pa.Schema]:
    """``schema`` with the image before it, for Spark and for Arrow."""
    schema = f"image_id {dict(df.dtypes)['image_id']}, {schema}"
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return schema, pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def grouped_map(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[Group], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` over the columns of each group of neighbouring rows, many groups a batch.

    The kernel's rows begin with the image; ``schema`` has the columns after it.
    """
    schema, target = _target(df, schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)] if rows else [pa.array([], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_groups(batches, keys):
            ends = [*starts[1:].tolist(), len(columns[keys[0]])]
            yield made([row for a, b in zip(starts.tolist(), ends, strict=True) for row in kernel({name: values[a:b] for name, values in columns.items()})])

    return df.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _whole(parts: list[Group]) -> Group:
    return parts[0] if len(parts) == 1 else {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _score(a: np.ndarray, b: np.ndarray, mode: str) -> np.ndarray:
    """IoU, or common part over the smaller area, of boxes in rows, in single precision."""
    side = np.maximum(0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
    inter = side[..., 0] * side[..., 1]
    area_a, area_b = ((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return inter / (np.minimum(area_a, area_b) if mode == "ios" else area_a + area_b - inter)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in the order of numbers in single precision."""
    bits = (x + np.float32(0)).view(np.uint32).astype(np.int64)
    return np.where(bits >> 31 == 1, 0xFFFFFFFF - bits, bits | 0x80000000)


def _swept(b: np.ndarray, which: np.ndarray, group: np.ndarray, limit: np.float32, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes with an area that match within their group, each once."""
    order = which[np.lexsort((b[which, 0], group[which]))]
    # those after a box in the sweep that begin before it ends
    low_key, high_key = ((group[order] << 32) | _ordered(b[order, k]) for k in (0, 2))
    wide = np.maximum(0, np.searchsorted(low_key, high_key, "left") - np.arange(len(order)) - 1)
    total = np.concatenate(([0], np.cumsum(wide)))
    low = 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(total, total[low] + SWEPT, "right")) - 1)
        here = np.repeat(np.arange(low, high), wide[low:high])
        there = here + 1 + np.arange(len(here)) - np.repeat(total[low:high] - total[low], wide[low:high])
        i, j = order[here], order[there]
        meet = (b[i, 1] < b[j, 3]) & (b[j, 1] < b[i, 3])
        i, j = i[meet], j[meet]
        hit = ~(_score(b[i], b[j], mode) < limit)
        yield i[hit], j[hit]
        low = high


def matches(boxes: np.ndarray, threshold: float, mode: str = "ios") -> tuple[np.ndarray, np.ndarray]:
    """For each box the others that match it, ascending: bounds by box, and their indexes.

    Boxes match unless their score is under the threshold. A box with no area may have no score, which counts as a
    match, so such boxes are compared with all; so are all if the threshold is 0.
    """
    b, limit, n = boxes.astype(np.float32), np.float32(threshold), len(boxes)
    plain = (b[:, 2] > b[:, 0]) & (b[:, 3] > b[:, 1]) if limit > 0 else np.zeros(n, bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(~plain).tolist():
        met = np.flatnonzero(~(_score(b[i], b, mode) < limit))
        met = met[met != i]
        left += [np.full(len(met), i), met[plain[met]]]  # among themselves both rows are made
        right += [met, np.full(int(plain[met].sum()), i)]
    for i, j in _swept(b, np.flatnonzero(plain), np.zeros(n, np.int64), limit, mode):
        left += [i, j]
        right += [j, i]
    a, c = np.concatenate(left), np.concatenate(right)
    at = np.lexsort((c, a))
    return np.searchsorted(a[at], np.arange(n + 1)), c[at]


def greedy_groups(boxes: np.ndarray, conf: np.ndarray, threshold: float, mode: str = "ios", highest_first: bool = False) -> list[list[int]]:
    """Keeper and members of each merge. The first seed is the lowest score, unless asked; later ones the highest left."""
    bounds, others = matches(boxes, threshold, mode)
    order = np.lexsort((np.arange(len(conf)), conf)).tolist()
    left, groups = np.ones(len(conf), bool), []
    if order and not highest_first:
        order.append(order[0])
    while order:
        keeper = order.pop()
        if left[keeper]:
            left[keeper] = False
            near = others[bounds[keeper] : bounds[keeper + 1]]
            members = near[left[near]]
            left[members] = False
            groups.append([keeper, *members.tolist()])
    return groups


def greedy_owners(boxes: np.ndarray, conf: np.ndarray, starts: np.ndarray, threshold: float, mode: str = "ios", highest_first: bool = False) -> np.ndarray:
    """The keeper of each box, itself or another, by the merges of ``greedy_groups`` in each of the groups that begin at ``starts``.

    A box that comes before all its matches that are left keeps them. Boxes of all groups do so in the same round.
    """
    n, b, limit = len(conf), boxes.astype(np.float32), np.float32(threshold)
    ends = np.concatenate((starts[1:], [n]))
    group = np.repeat(np.arange(len(starts)), ends - starts)
    owner = np.arange(n)
    plain = (b[:, 2] > b[:, 0]) & (b[:, 3] > b[:, 1]) & bool(limit > 0)
    odd = np.unique(group[~plain])  # boxes with no area may match any
    for k in odd.tolist():
        a, z = int(starts[k]), int(ends[k])
        for members in greedy_groups(boxes[a:z], conf[a:z], threshold, mode, highest_first):
            owner[np.array(members) + a] = members[0] + a
    turn = np.empty(n, np.int64)
    order = np.lexsort((np.arange(n), conf, group))
    turn[order] = np.arange(n) * 2  # the highest is first
    if not highest_first:
        turn[order[starts]] = ends * 2 - 1
    pairs = list(_swept(b, np.flatnonzero(~np.isin(group, odd)), group, limit, mode))
    i, j = (np.concatenate([p[k] for p in pairs] or [owner[:0]]) for k in (0, 1))
    first = turn[i] > turn[j]
    early, late = np.where(first, i, j), np.where(first, j, i)
    open_, keeps, e, f = np.ones(n, bool), np.zeros(n, bool), early, late
    for _ in range(ROUNDS):
        waits = np.zeros(n, bool)
        waits[f] = True
        now = open_ & ~waits
        keeps |= now
        open_ &= waits
        open_[f[now[e]]] = False
        both = open_[e] & open_[f]
        e, f = e[both], f[both]
        if not len(e):
            break
    if len(e):
        at = np.argsort(e, kind="stable")
        e, f = e[at], f[at]
        left = np.flatnonzero(open_)
        for k in left[np.argsort(-turn[left])].tolist():
            if open_[k]:
                open_[k], keeps[k] = False, True
                open_[f[slice(*np.searchsorted(e, (k, k + 1)))]] = False
    keeps |= open_
    claimed = np.where(keeps, turn, -1)
    by = keeps[early] & ~keeps[late]
    np.maximum.at(claimed, late[by], turn[early[by]])
    of = np.zeros(2 * n + 1, np.int64)
    of[turn] = np.arange(n)
    even = ~np.isin(group, odd)
    owner[even] = of[claimed[even]]
    return owner


def one_hop_groups(boxes: np.ndarray, conf: np.ndarray, threshold: float, mode: str = "ios") -> list[list[int]]:
    """In index order: an unclaimed box keeps and claims its unclaimed overlaps; a claimed one passes its own to its keeper."""
    bounds, others = matches(boxes, threshold, mode)
    owner: dict[int, int] = {}
    groups: dict[int, list[int]] = {}
    for i in range(len(conf)):
        keeper = owner.get(i, i)
        if keeper == i:
            groups[i] = [i]
        for j in others[bounds[i] : bounds[i + 1]].tolist():
            if j not in owner and j not in groups:
                owner[j] = keeper
                groups[keeper].append(j)
    return list(groups.values())


MERGED = "code long, keep_idx long, n_merged long, x1 double, y1 double, x2 double, y2 double, conf double"


def merge_detections(detections: DataFrame, threshold: float = 0.5, mode: str = "ios", greedy: bool = True, highest_first: bool = False, apart: tuple[int, ...] = ()) -> DataFrame:
    """Union boxes of merged ``detections`` (image_id, pred_idx, code, x1, y1, x2, y2, conf), by image and code.

    ``keep_idx`` and ``conf`` are the keeper's; ``n_merged`` counts its members. Codes in ``apart`` pass as they are. If
    detections have a name, it is the keeper's; if they have a segment, a detection that stays alone keeps its own.
    """

    def merge(group: Group) -> list[tuple]:
        boxes, conf, index = np.stack([group[c] for c in CORNERS], 1), group["conf"], group["pred_idx"]
        image, code = group["image_id"][0], int(group["code"][0])
        groups = [[i] for i in range(len(index))] if code in apart else one_hop_groups(boxes, conf, threshold, mode)
        return [(image, code, int(index[g[0]]), len(g), *boxes[g, :2].min(0).tolist(), *boxes[g, 2:].max(0).tolist(), float(conf[g[0]])) for g in groups]

    keys = ["image_id", "code"]
    keyed = detections.select("image_id", "pred_idx", F.coalesce("code", F.lit(-1)).cast("long").alias("code"), *(F.col(c).cast("double").alias(c) for c in CORNERS), F.coalesce("conf", F.lit(0.4)).cast("double").alias("conf"))
    if greedy:
        schema, target = _target(keyed, MERGED)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns, starts in whole_groups(batches, keys):
                boxes, conf, code = np.stack([columns[c] for c in CORNERS], 1), columns["conf"], columns["code"]
                owner = greedy_owners(boxes, conf, starts, threshold, mode, highest_first)
                owner = np.where(np.isin(code, apart), np.arange(len(code)), owner)
                order = np.argsort(owner, kind="stable")
                first = np.flatnonzero(np.diff(owner[order], prepend=-1))
                keeper, boxes = owner[order[first]], boxes[order]
                low, high = np.minimum.reduceat(boxes[:, :2], first), np.maximum.reduceat(boxes[:, 2:], first)
                values = [columns["image_id"][keeper], code[keeper], columns["pred_idx"][keeper], np.diff(first, append=len(order)), *low.T, *high.T, conf[keeper]]
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

        merged = keyed.repartition("image_id").sortWithinPartitions(*keys, "pred_idx").mapInArrow(run, schema)
    else:
        merged = grouped_map(keyed, keys, ["pred_idx"], merge, MERGED)
    more = [c for c in ("name", "segment") if c in detections.columns]
    if not more:
        return merged
    kept = merged.join(detections.select("image_id", F.col("pred_idx").alias("keep_idx"), *more), ["image_id", "keep_idx"])
    return kept.withColumn("segment", F.when(F.col("n_merged") == 1, F.col("segment"))) if "segment" in more else kept


def kmeans(points: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Labels by Lloyd's method from spread-out first centres; deterministic."""
    centers = points[:1]
    while len(centers) < k:
        gap = ((points[:, None] - centers[None]) ** 2).sum(2).min(1)
        centers = np.concatenate((centers, points[[int(gap.argmax())]]))
    for _ in range(rounds):
        label = ((points[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([points[label == c].mean(0) if (label == c).any() else centers[c] for c in range(k)])
        if (moved == centers).all():
            break
        centers = moved
    return label


def agglomerative(points: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters by least growth of variance, numbered by their first points.

    Chains of nearest neighbours find all merges with a row of distances at a time; the cheapest are then carried out.
    """
    n = len(points)
    centre, size, alive = points.astype(float).copy(), np.ones(n), np.ones(n, bool)
    joins, chain = [], []
    for _ in range(n - 1):
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            top = chain[-1]
            cost = np.where(alive, size * size[top] / (size + size[top]) * ((centre - centre[top]) ** 2).sum(1), np.inf)
            cost[top] = np.inf
            near = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                break
            chain.append(near)
        a, b = chain.pop(), chain.pop()
        low, high = min(a, b), max(a, b)
        joins.append((float(cost[b]), len(joins), low, high))
        centre[low] = (centre[low] * size[low] + centre[high] * size[high]) / (size[low] + size[high])
        size[low] += size[high]
        alive[high] = False
    owner = np.arange(n)
    for _, _, low, high in sorted(joins)[: n - k]:
        owner[owner == owner[high]] = owner[low]
    return np.unique(owner, return_inverse=True)[1] if n else owner


def fuse_windows(windows: list[list[float]], width: float, height: float, slack: float = 1.2) -> list[list[float]]:
    """Each window in turn joins every later one with which it still fits ``slack`` times the window size, and goes."""
    out = [list(w) for w in windows]
    i = 0
    while i < len(out):
        joined = False
        for j in range(i + 1, len(out)):
            both = [min(out[i][0], out[j][0]), min(out[i][1], out[j][1]), max(out[i][2], out[j][2]), max(out[i][3], out[j][3])]
            if both[2] - both[0] <= slack * width and both[3] - both[1] <= slack * height:
                out[j], joined = both, True
        if joined:
            del out[i]
        else:
            i += 1
    return out


def cluster_windows(boxes: DataFrame, images: DataFrame, window: tuple[int, int] = (640, 640), count: int = 3, padding: float = 0.0, method: str = "kmeans", same_ratio: bool = False, keep_size: bool = False) -> DataFrame:
    """(image_id, place, x1, y1, x2, y2): up to ``count`` windows an image around clusters of box centres.

    A cluster's window is what its boxes cover, widened by ``padding`` (a share from 0 to 1) of its widest and highest
    box and cut to the image. Near windows are fused. Then each gets the size of ``window``, a longer side its own (both
    sides in proportion with ``same_ratio``), around its middle and cut to the image; ``keep_size`` leaves them as fused.
    """
    cluster = {"kmeans": kmeans, "agglomerative": agglomerative}[method]
    share, (base_w, base_h) = min(max(0.0, padding), 1.0), window

    def windows_of(group: Group) -> list[tuple]:
        b, w, h = np.stack([group[c] for c in CORNERS], 1), int(group["width"][0]), int(group["height"][0])
        centres = (b[:, :2] + b[:, 2:]) / 2
        k = min(count, len(np.unique(centres, axis=0)))
        label = cluster(centres, k) if k > 1 else np.zeros(len(b), int)
        found = []
        for c in np.unique(label):
            own = b[label == c]
            pad_w, pad_h = (int((own[:, i + 2] - own[:, i]).max() * share) for i in (0, 1))
            found.append([int(max(0, own[:, 0].min() - pad_w)), int(max(0, own[:, 1].min() - pad_h)), int(min(w, own[:, 2].max() + pad_w)), int(min(h, own[:, 3].max() + pad_h))])
        rows = []
        for x1, y1, x2, y2 in fuse_windows(found, base_w, base_h):
            if not keep_size:
                grow_w, grow_h = max(1.0, (x2 - x1) / base_w), max(1.0, (y2 - y1) / base_h)
                both = max(grow_w, grow_h)
                new_w, new_h = (int(base_w * both), int(base_h * both)) if same_ratio else (int(base_w * grow_w), int(base_h * grow_h))
                x1, y1 = max(0, int(x1 + (x2 - x1) / 2) - new_w // 2), max(0, int(y1 + (y2 - y1) / 2) - new_h // 2)
                x2, y2 = min(w, x1 + new_w), min(h, y1 + new_h)
            rows.append((group["image_id"][0], len(rows), x1, y1, x2, y2))
        return rows

    sized = boxes.select("image_id", *(F.col(c).cast("double").alias(c) for c in CORNERS)).join(images.select("image_id", "width", "height"), "image_id")
    return grouped_map(sized, ["image_id"], list(CORNERS), windows_of, "place long, x1 long, y1 long, x2 long, y2 long")


CROPS = "gt_idx long, x1 long, y1 long, x2 long, y2 long, held array<long>, masked array<long>"


def cover(boxes: np.ndarray, crops: np.ndarray, threshold: float = 0.7, mask: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Labels whose crop is made, with the labels that it holds and those that are blacked out in it.

    Each label in turn makes its crop unless one before holds it. A crop holds the labels of which more than
    ``threshold`` lies in it; with ``mask`` those of which 0.95 and more does, the others that it cuts being blacked out.
    """
    taken, out = np.zeros(len(boxes), bool), []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i in range(len(boxes)):
        if not taken[i]:
            side = np.maximum(0, np.minimum(boxes[:, 2:], crops[i, 2:]) - np.maximum(boxes[:, :2], crops[i, :2]))
            part = side[:, 0] * side[:, 1] / area
            held = part >= 0.95 if mask else part > threshold
            taken |= held
            out.append((i, np.flatnonzero(held), np.flatnonzero((part > 0) & ~held) if mask else np.zeros(0, int)))
    return out


def crop_plan(labels: DataFrame, images: DataFrame, target: int = 640, ratio_pct: int = 85, threshold: float = 0.7, mask: bool = False) -> DataFrame:
    """(image_id, gt_idx, x1, y1, x2, y2, held, masked): the crops that cover all labels of each image (see ``cover``).

    gt_idx is the label that makes the crop; held and masked list labels. Labels without an area make none and are in none.
    """

    def plan(group: Group) -> list[tuple]:
        index = group["gt_idx"]
        boxes, crops = (np.stack([group[p + c] for c in CORNERS], 1) for p in ("", "c_"))
        return [(group["image_id"][0], int(index[i]), *map(int, crops[i]), index[held].tolist(), index[masked].tolist()) for i, held, masked in cover(boxes, crops, threshold, mask)]

    sized = labels.select("image_id", "gt_idx", *CORNERS).where("x1 < x2 AND y1 < y2").join(images.select("image_id", "width", "height"), "image_id")
    crop = padded_crop(box(), F.col("width"), F.col("height"), target, ratio_pct)
    sized = sized.select("image_id", "gt_idx", *(F.col(c).cast("double").alias(c) for c in CORNERS), *(c.cast("double").alias(f"c_{n}") for n, c in zip(CORNERS, crop, strict=True)))
    return grouped_map(sized, ["image_id"], ["gt_idx"], plan, CROPS)


def crop_labels(plan: DataFrame, labels: DataFrame, listed: str = "held") -> DataFrame:
    """Labels of each crop in its own coordinates, cut to it: image_id, crop, the labels' columns; ``listed``: held or masked."""
    inside = lambda c, low, size: F.least(F.greatest(F.col(c) - F.col(low), F.lit(0)), size).alias(c)
    rows = plan.select("image_id", F.col("gt_idx").alias("crop"), *(F.col(c).alias(f"w_{c}") for c in CORNERS), F.explode(listed).alias("gt_idx"))
    rest = [c for c in labels.columns if c not in ("image_id", "gt_idx", *CORNERS)]
    wide, high = F.col("w_x2") - F.col("w_x1"), F.col("w_y2") - F.col("w_y1")
    corners: list[Column] = [inside("x1", "w_x1", wide), inside("y1", "w_y1", high), inside("x2", "w_x1", wide), inside("y2", "w_y1", high)]
    return rows.join(labels, ["image_id", "gt_idx"]).select("image_id", "crop", "gt_idx", *corners, wide.alias("width"), high.alias("height"), *rest)
