"""Every registered query of the library's own against its SQL on the smallest tables."""

import numpy as np
import oracle
import pytest

from boxwright.queries import ORACLE_SQL, QUERIES
from boxwright.sources.derived import boxes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        oracle.compare(df, db, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def overlap(a, b, smaller):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (min(area(a), area(b)) if smaller else area(a))


def by_image(df, key, *columns):
    found = {}
    for r in df.orderBy(key).collect():
        found.setdefault(r["image_id"], []).append(tuple(r[c] for c in columns))
    return found


def test_fp_antijoin_against_a_loop(spark):
    """Every prediction without a hit is a row of its own, and with the hits they are all predictions."""
    gt, pr = boxes(spark, SF)
    truth, expected, every = by_image(gt, "gt_idx", "cls", "x1", "y1", "x2", "y2"), set(), set()
    for image, rows in by_image(pr, "pred_idx", "pred_idx", "cls", "x1", "y1", "x2", "y2").items():
        for idx, cls, *box in rows:
            every.add((image, idx))
            area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
            cut = [(max(0, min(box[2], g[3]) - max(box[0], g[1])) * max(0, min(box[3], g[4]) - max(box[1], g[2])), area(g[1:])) for g in truth.get(image, []) if g[0] == cls]
            if not any(np.float32(inter / (own + area(box) - inter)) > np.float32(0.5) for inter, own in cut):
                expected.add((image, idx))
    got = [(r.image_id, r.pred_idx) for r in QUERIES["fp_antijoin"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert expected | {(r.image_id, r.pred_idx) for r in QUERIES["tp_semijoin"](spark, SF).collect()} == every


def test_nmm_greedy_against_a_loop(spark):
    """Merges of every image, one candidate at a time."""
    expected = set()
    for image, rows in by_image(boxes(spark, SF)[1], "pred_idx", "pred_idx", "cls", "conf", "x1", "y1", "x2", "y2").items():
        for cls in {r[1] for r in rows}:
            left = sorted((r for r in rows if r[1] == cls), key=lambda r: (r[2], r[0]))
            first = True
            while left:
                seed = left.pop(0 if first else -1)
                first = False
                near = [r for r in left if np.float32(overlap(seed[3:], r[3:], True)) >= np.float32(0.5)]
                left = [r for r in left if r not in near]
                group = [seed, *near]
                expected.add((image, cls, seed[0], len(group), min(r[3] for r in group), min(r[4] for r in group), max(r[5] for r in group), max(r[6] for r in group), round(seed[2], 6)))
    got = {(r.image_id, r.code, r.keep_idx, r.n_merged, r.x1, r.y1, r.x2, r.y2, round(r.conf, 6)) for r in QUERIES["nmm_greedy"](spark, SF).collect()}
    assert got == expected


def test_nmm_onehop_against_a_loop(spark):
    """Every box in turn, whether claimed or not, looks at all others."""
    expected = set()
    for image, rows in by_image(boxes(spark, SF)[1], "pred_idx", "pred_idx", "cls", "conf", "x1", "y1", "x2", "y2").items():
        for cls in {r[1] for r in rows}:
            own, keeper = [r for r in rows if r[1] == cls], {}
            for k, r in enumerate(own):
                mine = keeper.setdefault(k, k)
                for j, o in enumerate(own):
                    if j != k and j not in keeper and np.float32(overlap(r[3:], o[3:], True)) >= np.float32(0.5):
                        keeper[j] = mine
            for k in {*keeper.values()}:
                group = [own[j] for j, m in keeper.items() if m == k]
                expected.add((image, cls, own[k][0], len(group), min(r[3] for r in group), min(r[4] for r in group), max(r[5] for r in group), max(r[6] for r in group), round(own[k][2], 6)))
    got = {(r.image_id, r.code, r.keep_idx, r.n_merged, r.x1, r.y1, r.x2, r.y2, round(r.conf, 6)) for r in QUERIES["nmm_onehop"](spark, SF).collect()}
    assert got == expected


@pytest.mark.parametrize("mode", ["ios", "iou"])
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 1.0])
def test_matches_by_sweep_against_all_pairs(monkeypatch, mode, threshold):
    """Boxes of no area, reversed ones and repeated ones too, in short sweeps."""
    from boxwright.operators import merging

    rng = np.random.default_rng(2)
    b = rng.integers(0, 60, (150, 4)).astype(float)
    b[:120, 2:] = b[:120, :2] + rng.integers(0, 30, (120, 2))
    b[20:25] = b[30:35]
    f = b.astype(np.float32)
    side = np.maximum(0, np.minimum(f[:, None, 2:], f[None, :, 2:]) - np.maximum(f[:, None, :2], f[None, :, :2]))
    inter, area = side[..., 0] * side[..., 1], (f[:, 2] - f[:, 0]) * (f[:, 3] - f[:, 1])
    with np.errstate(invalid="ignore", divide="ignore"):
        score = inter / (np.minimum(area[:, None], area[None]) if mode == "ios" else area[:, None] + area[None] - inter)
    expected = ~(score < np.float32(threshold)) & ~np.eye(150, dtype=bool)
    for swept in (1 << 20, 37):
        monkeypatch.setattr(merging, "SWEPT", swept)
        bounds, others = merging.matches(b, threshold, mode)
        assert [others[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [np.flatnonzero(row).tolist() for row in expected]


def test_merging_of_many_boxes_in_one_image():
    from boxwright.operators import merging

    rng = np.random.default_rng(1)
    b = rng.uniform(0, 30_000, (50_000, 2))
    b = np.concatenate((b, b + rng.uniform(20, 120, (50_000, 2))), 1)
    bounds, others = merging.matches(b, 0.5)
    assert bounds[-1] == len(others) < 400_000
    groups = merging.greedy_groups(b, rng.random(50_000), 0.5)
    assert sorted(i for g in groups for i in g) == list(range(50_000))


def test_merged_segments(spark):
    """A lone detection keeps its segment and name, a merged one the keeper's name alone; codes apart stay."""
    from boxwright.operators import merging

    rows = [(1, 0, 0, 0, 0, 10, 10, 0.9, "a", [1.0]), (1, 1, 0, 1, 0, 10, 10, 0.8, "b", [2.0]), (1, 2, 0, 50, 50, 60, 60, 0.7, "c", [3.0]), (1, 3, 7, 0, 0, 10, 10, 0.5, "d", [4.0]), (1, 4, 7, 0, 0, 10, 10, 0.4, "e", [5.0]), (1, 5, None, 0, 0, 1, 1, None, "f", None)]
    df = spark.createDataFrame(rows, "image_id long, pred_idx long, code long, x1 int, y1 int, x2 int, y2 int, conf double, name string, segment array<double>")
    got = {(r.code, r.keep_idx, r.n_merged, r.name, tuple(r.segment or ())) for r in merging.merge_detections(df, apart=(7,), highest_first=True).collect()}
    assert got == {(0, 0, 2, "a", ()), (0, 2, 1, "c", (3.0,)), (7, 3, 1, "d", (4.0,)), (7, 4, 1, "e", (5.0,)), (-1, 5, 1, "f", ())}


def ward_by_hand(points, k):
    """Merges the two clusters whose union adds least to the sum of squares, again and again."""
    groups = [[i] for i in range(len(points))]
    spread = lambda g: ((points[g] - points[g].mean(0)) ** 2).sum()
    while len(groups) > k:
        _, a, b = min((spread(groups[a] + groups[b]) - spread(groups[a]) - spread(groups[b]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_agglomerative_clusters_against_a_loop():
    from boxwright.operators import merging

    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 23):
        points = rng.normal(0, 100, (n, 2))
        for k in range(1, min(n, 6) + 1):
            label = merging.agglomerative(points, k)
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label)} == ward_by_hand(points, k)


@pytest.mark.parametrize("method", ["kmeans", "agglomerative"])
def test_cluster_windows_against_a_loop(spark, method):
    """Windows of every image from its clusters: padded by a share, cut, fused, set to size."""
    from boxwright.operators import merging

    size, count, share = ((640, 640), 3, 0.25) if method == "kmeans" else ((320, 320), 5, 0.25)
    expected = set()
    for image, rows in by_image(boxes(spark, SF)[0], "gt_idx", "x1", "y1", "x2", "y2").items():
        b = np.array(sorted(rows), float)
        centres = (b[:, :2] + b[:, 2:]) / 2
        k = min(count, len({tuple(c) for c in centres.tolist()}))
        label = getattr(merging, method)(centres, k)
        windows = []
        for c in sorted(set(label.tolist())):
            own = b[label == c].tolist()
            pw, ph = int(max(r[2] - r[0] for r in own) * share), int(max(r[3] - r[1] for r in own) * share)
            windows.append((max(0, min(r[0] for r in own) - pw), max(0, min(r[1] for r in own) - ph), min(1300, max(r[2] for r in own) + pw), min(700, max(r[3] for r in own) + ph)))
        gone = set()
        for i in range(len(windows)):
            for j in range(i + 1, len(windows)):
                both = (min(windows[i][0], windows[j][0]), min(windows[i][1], windows[j][1]), max(windows[i][2], windows[j][2]), max(windows[i][3], windows[j][3]))
                if both[2] - both[0] <= size[0] * 1.2 and both[3] - both[1] <= size[1] * 1.2:
                    windows[j] = both
                    gone.add(i)
        place = 0
        for x1, y1, x2, y2 in (w for i, w in enumerate(windows) if i not in gone):
            scale = [max(1.0, (x2 - x1) / size[0]), max(1.0, (y2 - y1) / size[1])]
            scale = [max(scale)] * 2 if method == "agglomerative" else scale
            w, h = int(size[0] * scale[0]), int(size[1] * scale[1])
            a, c = max(0, int(x1 + (x2 - x1) / 2) - w // 2), max(0, int(y1 + (y2 - y1) / 2) - h // 2)
            expected.add((image, place, a, c, min(1300, a + w), min(700, c + h)))
            place += 1
    assert {tuple(r) for r in QUERIES["cluster_windows" if method == "kmeans" else "cluster_windows_agglomerative"](spark, SF).collect()} == expected


def crop_by_hand(b, target, width=1300, height=700):
    sides = [target if s < target - 30 else int(s * 1.2) for s in (b[2] - b[0], b[3] - b[1])]
    sides = [max(s, int(max(sides) * 85 / 100)) for s in sides]
    out = []
    for low, high, side, most in ((b[0], b[2], sides[0], width), (b[1], b[3], sides[1], height)):
        half, middle = side // 2, (low + high) // 2
        middle = half if middle < half else most - half if middle > most - half else middle
        start = max(0, middle - half)
        out.append((start, min(most, start + side)))
    return out[0][0], out[1][0], out[0][1], out[1][1]


@pytest.mark.parametrize("mask", [False, True])
def test_crop_plan_against_a_loop(spark, mask):
    """Each label that no crop holds yet makes one; labels move with the crop and are cut to it."""
    plans, parts = set(), set()
    for image, rows in by_image(boxes(spark, SF)[0], "gt_idx", "gt_idx", "x1", "y1", "x2", "y2").items():
        taken = set()
        for idx, *b in rows:
            if idx in taken:
                continue
            crop = crop_by_hand(b, 160)
            share = {k: overlap(o, crop, False) for k, *o in rows}
            held = [k for k, v in share.items() if (v >= 0.95 if mask else v > 0.7)]
            taken.update(held)
            masked = [k for k, v in share.items() if 0 < v < 0.95] if mask else []
            plans.add((image, idx, *crop, tuple(held), tuple(masked)))
            w, h = crop[2] - crop[0], crop[3] - crop[1]
            for k, *o in rows:
                if k in held or k in masked:
                    x1, y1, x2, y2 = (min(max(v - crop[i % 2], 0), (w, h)[i % 2]) for i, v in enumerate(o))
                    parts.add((image, idx, k, x1, y1, x2, y2, w, h, k in masked))
    if mask:
        assert {tuple(r) for r in QUERIES["crop_plan_masked"](spark, SF).collect()} == parts
    else:
        assert {(*r[:6], tuple(r.held), tuple(r.masked)) for r in QUERIES["crop_plan"](spark, SF).collect()} == plans


def curve_by_hand(hits, n):
    """Points, envelope, average precision by np.interp, and both curves, of one class's hits in order."""
    tp = np.cumsum([h for _, h in hits])
    rec, prec = tp / n, tp / np.arange(1, len(tp) + 1)
    mrec, mpre = np.concatenate(([0.0], rec, [1.0])), np.concatenate(([1.0], prec, [0.0]))
    env = np.flip(np.maximum.accumulate(np.flip(mpre)))
    x = np.linspace(0, 1, 101)
    y = np.interp(x, mrec, env)
    conf, grid = -np.array([c for c, _ in hits]), -np.linspace(0, 1, 1000)
    return rec, prec, env, float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()), np.interp(grid, conf, rec, left=0), np.interp(grid, conf, prec, left=1)


@pytest.mark.parametrize("same", [0.0, 0.9])
def test_curves_over_many_ranges(spark, same):
    """Range ends inside a curve and at ties; ``same``: the share of rows with one confidence."""
    from boxwright.operators import precision

    rng = np.random.default_rng(5)
    rows = [(k // 7, k % 7, int(rng.random() < 0.8), 0.5 if rng.random() < same else float(rng.integers(0, 40)) / 40 * 0.999, int(rng.integers(0, 1024))) for k in range(900)]
    gt = spark.createDataFrame([(k, k % 2) for k in range(1300)], "image_id long, cls long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        points = precision.ranked(spark.createDataFrame(rows, "image_id long, pred_idx long, cls long, conf double, levels int"), gt)
        assert points.select("run", "cls").distinct().count() > 4
        assert same == 0 or points.groupBy("run").count().agg({"count": "max"}).first()[0] < 500
        long, env = precision.pr_points(points).collect(), precision.envelope(points).collect()
        ap, curve = precision.average_precision(points, gt).collect(), precision.curves(points, gt).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for cls in (0, 1):
        own = sorted((-c, i, p, m) for i, p, x, c, m in rows if x == cls)
        for k in range(10):
            rec, prec, envelope, area, r, p = curve_by_hand([(-c, m >> k & 1) for c, _, _, m in own], 650)
            mine = sorted((x.i, x.rec, x.prec) for x in long if x.cls == cls and x.k == k)
            assert [x[0] for x in mine] == list(range(1, len(own) + 1)) and np.allclose([x[1:] for x in mine], np.stack((rec, prec), 1))
            assert np.allclose([x[1] for x in sorted((x.i, x.env) for x in env if x.cls == cls and x.k == k)], envelope)
            assert abs(next(x.ap for x in ap if x.cls == cls and x.k == k) - area) < 1e-9
            if k == 0:
                found = sorted((x.g, x.r, x.p) for x in curve if x.cls == cls)
                assert len(found) == 1000 and np.allclose([x[1:] for x in found], np.stack((r, p), 1))


def test_pairs_of_a_crowded_image(spark):
    """Few candidates in an image of 20,000 boxes; on smaller ones the same pairs as all pairs, at any threshold and box size."""
    from boxwright.operators import matching

    rng = np.random.default_rng(6)

    def frames(n, span, widest):
        side = lambda: np.exp(rng.uniform(1, np.log(widest), n))
        x, y, w, h = rng.uniform(0, span, n), rng.uniform(0, span, n), side(), side()
        both = []
        for name, shift in (("gt_idx", 0.0), ("pred_idx", 0.1)):
            dx, dy = rng.normal(0, 1, n) * w * shift, rng.normal(0, 1, n) * h * shift
            extra = ("difficult", False) if name == "gt_idx" else ("conf", 0.5)
            rows = [(1, k, k % 3, *map(float, (x[k] + dx[k], y[k] + dy[k], x[k] + dx[k] + w[k], y[k] + dy[k] + h[k])), extra[1]) for k in range(n)]
            both.append(spark.createDataFrame(rows, f"image_id long, {name} long, cls long, x1 double, y1 double, x2 double, y2 double, {extra[0]} {'boolean' if extra[0] == 'difficult' else 'double'}"))
        return both

    gt, pr = frames(20_000, 20_000, 120)
    left, right, g, p = matching._sides(gt, pr)
    assert matching.near_pairs(left, right, g, p, 0.5, False).count() < 40 * 20_000
    assert matching.near_pairs(left, right, g, p, 0.5, True).count() < 40 * 20_000
    gt, pr = frames(500, 3_000, 30_000)
    a, b = ([tuple(r)[3:7] for r in df.orderBy(key).collect()] for df, key in ((gt, "gt_idx"), (pr, "pred_idx")))
    a, b = np.array(a)[:, None], np.array(b)[None]
    inter = np.maximum(0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])) * np.maximum(0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    areas = [(z[..., 2] - z[..., 0]) * (z[..., 3] - z[..., 1]) for z in (a, b)]
    for ios, score in ((False, inter / (areas[0] + areas[1] - inter)), (True, inter / areas[0])):
        for threshold in (0.5, 0.75, 0.3, 0.05):
            got = [(r.gt_idx, r.pred_idx) for r in matching.overlaps(gt, pr, threshold, ios).collect()]
            assert sorted(got) == sorted(map(tuple, np.argwhere(score.astype(np.float32) > np.float32(threshold)).tolist())), (ios, threshold)


@pytest.mark.parametrize("name", ["match_status_iou", "match_status_ios", "error_shapes", "ap_tp_assignment", "class_results"])
def test_images_of_few_and_many_boxes(spark, db, name, monkeypatch):
    """Images joined as a whole, by cells, and some of both; the rows are those of SQL each time."""
    from boxwright.operators import matching

    for many in (0, 38):
        monkeypatch.setattr(matching, "MANY", many)
        oracle.compare(QUERIES[name](spark, SF), db, ORACLE_SQL[name])


@pytest.mark.parametrize("name, most", [("match_status_ios", 4), ("ap_tp_assignment", 2), ("error_shapes", 4)])
def test_boxes_are_shuffled_by_image_alone(spark, name, most):
    """Of small images neither the boxes in their cells nor the pairs are shuffled."""
    shuffled_by_image(spark, lambda: QUERIES[name](spark, SF), most)


def test_levels_of_predictions_are_shuffled_by_image_alone(spark):
    """What results_table and the curves put in order: both sides once."""
    from boxwright.operators import matching

    shuffled_by_image(spark, lambda: matching.prediction_levels(*boxes(spark, SF)), 2)


def shuffled_by_image(spark, made, most):
    import re

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\)", plan)
    assert len(found) == plan.count("Exchange ") <= most


@pytest.mark.parametrize("rounds", [30, 1])
def test_greedy_merges_of_a_batch_as_each_group_by_itself(monkeypatch, rounds):
    """Boxes of no area too, with few rounds before boxes are taken one by one."""
    from boxwright.operators import merging

    rng = np.random.default_rng(3)
    monkeypatch.setattr(merging, "ROUNDS", rounds)
    for k in range(40):
        n = int(rng.integers(1, 150))
        low = rng.uniform(-50, [30, 100, 400][k % 3], (n, 2)).round(1)
        b = np.concatenate((low, low + rng.uniform(1, 60, (n, 2)).round()), 1)
        if k % 5 == 0:
            b[::7, 2:] = b[::7, :2]
        conf = rng.integers(0, 20, n) / 20
        starts = np.unique(np.concatenate(([0], rng.integers(0, n, 8))))
        for threshold, mode, highest_first in ((0.0, "iou", True), (0.1, "ios", False), (0.5, "iou", False), (1.0, "iou", True)):
            expected = np.empty(n, int)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                for group in merging.greedy_groups(b[a:z], conf[a:z], threshold, mode, highest_first):
                    expected[np.array(group) + a] = group[0] + a
            assert (merging.greedy_owners(b, conf, starts, threshold, mode, highest_first) == expected).all()
