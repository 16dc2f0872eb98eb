"""Confusion counts over streams: predictions and truth arrive in any order, and the counts follow.

State is kept per image: its boxes and the counts that were given out for it. When boxes arrive, the image is counted again
and what changed is given out, so the sum of all changes is what a batch over the same rows counts. Rows that come again
change nothing. An image's state goes once the watermark has passed its last row by ``keep``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIRED = "image_id long, side string, idx long, cls long, x1 long, y1 long, x2 long, y2 long, difficult boolean, conf double"
CHANGES = "image_id long, kind string, pred long, gt long, n long"
_BOX = "code long, x1 long, y1 long, x2 long, y2 long, difficult boolean"


def split_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ground truth, predictions) of rows (PAIRED) whose side is gt or pred."""
    common = ("image_id", "cls", "x1", "y1", "x2", "y2")
    return rows.where("side = 'gt'").select(*common, F.col("idx").alias("gt_idx"), "difficult"), rows.where("side = 'pred'").select(*common, F.col("idx").alias("pred_idx"), "conf")


def image_counts(gt: list[tuple], pr: list[tuple], background: int, threshold: float = 0.5) -> Counter:
    """(kind, pred, gt) counts of one image's boxes (cls, x1, y1, x2, y2, difficult), each side in order of its index: what ``confusion_pairs`` counts for it."""
    found: Counter = Counter()
    a, b = (np.array([r[1:5] for r in rows], float).reshape(-1, 4) for rows in (gt, pr))
    side = np.maximum(0, np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]))
    inter, areas = side[..., 0] * side[..., 1], [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
    with np.errstate(invalid="ignore", divide="ignore"):
        near = (inter > 0) & ((inter / (areas[0][:, None] + areas[1][None] - inter)).astype(np.float32) > np.float32(threshold))
    classes = np.array([r[0] for r in gt], np.int64), np.array([r[0] for r in pr], np.int64)
    hit = near & (classes[0][:, None] == classes[1][None])
    counted = hit.any(1) | ~np.array([bool(r[5]) for r in gt], bool)
    for i in np.flatnonzero(counted).tolist():
        partner = classes[0][i] if hit[i].any() else classes[1][near[i].argmax()] if near[i].any() else background
        found["R", int(partner), int(classes[0][i])] += 1
    near &= counted[:, None]
    for j in range(len(pr)):
        partner = classes[1][j] if hit[:, j].any() else classes[0][near[:, j].argmax()] if near[:, j].any() else background
        found["P", int(classes[1][j]), int(partner)] += 1
    return found


class ImageCounts(StatefulProcessor):
    """Keeps the boxes of an image by side and index, and gives out how its counts change."""

    def __init__(self, background: int, threshold: float, keep_ms: int):
        self.background, self.threshold, self.keep = background, threshold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.boxes = handle.getMapState("boxes", "side string, idx long", _BOX)
        self.given = handle.getMapState("given", "kind string, pred long, gt long", "n long")
        self.heard = handle.getValueState("heard", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        heard = self.heard.get()[0] if self.heard.exists() else 0
        for batch in rows:
            heard = max(heard, int(batch["ms"].max()))
            for r in batch.itertuples(index=False):
                self.boxes.updateValue((r.side, int(r.idx)), (int(r.cls), int(r.x1), int(r.y1), int(r.x2), int(r.y2), bool(r.difficult == True)))  # noqa: E712 (predictions have null)
        held = sorted((tuple(k), tuple(v)) for k, v in self.boxes.iterator())
        now = image_counts(*([v for (side, _), v in held if side == wanted] for wanted in ("gt", "pred")), self.background, self.threshold)
        before = {tuple(k): v[0] for k, v in self.given.iterator()}
        changes = [(int(key[0]), *cell, now[cell] - before.get(cell, 0)) for cell in sorted({*now, *before}) if now[cell] != before.get(cell, 0)]
        for _, *cell, _ in changes:
            self.given.updateValue(tuple(cell), (now[tuple(cell)],))
        if self.keep:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(heard + self.keep)
            self.heard.update((heard,))
        if changes:
            yield pd.DataFrame(changes, columns=["image_id", "kind", "pred", "gt", "n"]).astype({"kind": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.boxes, self.given, self.heard):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def confusion_changes(rows: DataFrame, background: int, threshold: float = 0.5, time: str | None = None, delay: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """(image_id, kind, pred, gt, n): how the counts change as ``rows`` (PAIRED) of a stream arrive, to be appended and summed.

    With ``time``, a timestamp column, rows later than the watermark (``delay``) are left out, and an image is forgotten
    ``keep_ms`` after it was last heard of; rows that come for it then would count as a new image. Without it state stays.
    The session must keep state in RocksDB.
    """
    names = [part.split()[0] for part in PAIRED.split(", ")]
    known = rows.withWatermark(time, delay) if time else rows
    ms = F.unix_millis(time) if time else F.lit(0).cast("long")
    grouped = known.select(*names, ms.alias("ms"), *([time] if time else [])).groupBy("image_id")
    return grouped.transformWithStateInPandas(ImageCounts(background, threshold, keep_ms if time else 0), CHANGES, "append", "eventTime" if time else "none")


def totals(changes: DataFrame) -> DataFrame:
    """(kind, pred, gt, n) of all changes so far; cells that are empty again are left out."""
    return changes.groupBy("kind", "pred", "gt").agg(F.sum("n").alias("n")).where("n <> 0")
