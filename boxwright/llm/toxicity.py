"""Toxicity: non-negative positive-unlabelled learning of a linear classifier on word and word-prefix presence.

Only confirmed toxic texts carry a label. With the class prior p, the risk of calling unlabelled text clean is
``mean over unlabelled - p * mean over positives``, which the empirical form can drive below zero; non-negative
PU learning turns the gradient round while it is negative. Training sees a bounded sample of the rows of the label table
(at most POSITIVES toxic ones, and at most UNLABELLED of all of them, whose labels are then not looked at, so that the
prior is the toxic share of just these), the features are chosen from it by counts that Spark aggregates, and every
whole text is scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Saved, map_batches, text_steps
from .words import hashes_of, mixed, texts_of, words_of

#: Bounds of the training sample (documents), of the counted features, and of the features that the model keeps.
POSITIVES, UNLABELLED, CANDIDATES, FEATURES = 4_000, 12_000, 20_000, 1_024
#: How many times likelier a feature must be among positives than among negatives.
LEAST_RATIO = 4
PREFIXES = range(3, 10)
PREDICTED_FROM = 0.7
_MASK = (1 << 20) - 1


class Model(NamedTuple):
    """Sorted feature hashes, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features_of(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(row, hash) arrays of the words and their first bytes, by kind of feature, and the number of rows."""
    texts = texts_of(pc.utf8_lower(column.cast(pa.large_string())))
    words = words_of(texts)
    rows = np.repeat(np.arange(len(column)), np.diff(words.firsts))
    kinds = [(rows, hashes_of(texts.data, words))]
    at, size = words.starts, words.ends - words.starts
    value = np.zeros(len(at), np.uint64)
    for k in range(1, PREFIXES.stop):
        long_enough = size >= k
        if not long_enough.all():
            at, size, rows, value = at[long_enough], size[long_enough], rows[long_enough], value[long_enough]
        value = mixed(value * np.uint64(0x100000001B3) + texts.data[at + k - 1])
        if k in PREFIXES:
            kinds.append((rows, value))
    return kinds, len(column)


def present(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, index into keys) of the features that texts have, in order of rows, and the number of rows."""
    kinds, n = features_of(column)
    maybe = np.zeros(_MASK + 1, bool)
    maybe[(keys & np.uint64(_MASK)).astype(np.int64)] = True
    cells = [np.zeros(0, np.int64)]
    for rows, hashes in kinds if len(keys) else ():
        hit = np.flatnonzero(maybe[(hashes & np.uint64(_MASK)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, hashes[hit]), len(keys) - 1)
        same = keys[at] == hashes[hit]
        cells.append(np.unique(rows[hit[same]] * len(keys) + at[same]))
    cell = np.unique(np.concatenate(cells))
    return cell // max(1, len(keys)), cell % max(1, len(keys)), n


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in text_steps(batch):
            for rows, hashes in features_of(step.column("text"))[0]:
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                found, n = np.unique(hashes[first], return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], names=["feature", "n"])


def _presence(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                rows, at, n = present(step.column("text"), keys)
                bounds = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32)))
                yield pa.record_batch([step.column("positive"), step.column("unlabelled"), lists], names=["positive", "unlabelled", "features"])

    return run


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic losses, by Adam on the whole sample."""
    x = np.concatenate((x_pos, x_unl)).astype(np.float32)
    n_pos, n_unl = len(x_pos), len(x_unl)
    theta = np.zeros(x.shape[1] + 1, np.float64)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = x @ theta[:-1].astype(np.float32) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative = np.logaddexp(0, z[n_pos:]).mean() - prior * np.logaddexp(0, z[:n_pos]).mean()
        as_negative = np.concatenate((-prior * s[:n_pos] / n_pos, s[n_pos:] / n_unl))
        slope = -as_negative if negative < 0 else as_negative
        if negative >= 0:
            slope[:n_pos] += prior * (s[:n_pos] - 1) / n_pos
        grad = np.append(x.T @ slope.astype(np.float32), slope.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def choose_features(hashes: np.ndarray, n_pos: np.ndarray, n_unl: np.ndarray, positives: int, unlabelled: int, prior: float, most: int) -> np.ndarray:
    """Features whose share among positives is above that among negatives, which the prior gives: sorted hashes."""
    p, u = n_pos / max(1, positives), n_unl / max(1, unlabelled)
    n = np.maximum(0, (u - prior * p) / (1 - prior))
    floor = 1 / max(1, unlabelled)
    gain = p * np.log((p + floor) / (n + floor))
    order = np.lexsort((hashes, -gain))
    order = order[(gain[order] > 0.01) & (p[order] + floor >= LEAST_RATIO * (n[order] + floor))][:most]
    return np.sort(hashes[order])


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, prior: float) -> Model:
    """A model from the texts of ``docs`` whose doc_id is in ``positives`` (confirmed toxic) or ``unlabelled``.

    Both samples are the first POSITIVES and UNLABELLED documents in order of a hash of doc_id. Without any positive
    text the model gives every text the prior.
    """
    prior = min(max(prior, 0.001), 0.9)
    draw = lambda ids, most: ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = draw(positives, POSITIVES).withColumn("positive", F.lit(True)).join(draw(unlabelled, UNLABELLED).withColumn("unlabelled", F.lit(True)), "doc_id", "full")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most POSITIVES + UNLABELLED rows
    sample = Saved(chosen.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled")), "sample")
    n_pos, n_unl = sample.df.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not n_pos or not n_unl:
        sample.drop()
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = map_batches(sample.df.where("positive"), _document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(2, n_pos // 200)).orderBy(F.desc("n"), "feature").limit(CANDIDATES).toPandas()
    keys = top["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, in_pos = keys[order], top["n"].to_numpy()[order]
    seen = map_batches(sample.df.where("unlabelled"), _presence(keys), "positive boolean, unlabelled boolean, features array<int>")
    seen = seen.select(F.explode("features").alias("i")).groupBy("i").count().toPandas()
    in_unl = np.zeros(len(keys))
    in_unl[seen["i"].to_numpy(np.int64)] = seen["count"].to_numpy()
    keys = choose_features(keys, in_pos, in_unl, n_pos, n_unl, prior, FEATURES)
    rows = map_batches(sample.df, _presence(keys), "positive boolean, unlabelled boolean, features array<int>").toPandas()
    sample.drop()
    x = np.zeros((len(rows), len(keys)), np.float32)
    sizes = np.array([len(f) for f in rows["features"]], np.int64)
    x[np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.asarray(f, np.int64) for f in rows["features"]])] = 1
    # rows come in any order; sums over them must not
    order = np.lexsort(np.packbits(x > 0, axis=1).T) if len(keys) else np.arange(len(rows))
    x, is_pos, is_unl = x[order], rows["positive"].to_numpy(bool)[order], rows["unlabelled"].to_numpy(bool)[order]
    weights, bias = fit_nnpu(x[is_pos], x[is_unl], prior)
    return Model(keys, weights, bias)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                rows, at, n = present(step.column("text"), model.keys)
                z = model.bias + np.bincount(rows, model.weights[at], n)
                columns = [c for c in step.schema.names if c != "text"]
                yield pa.record_batch([*(step.column(c) for c in columns), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*columns, "score"])

    return run


def held_out(doc_id: Column | str) -> Column:
    """Documents whose labels must not be learnt: crc32 of the identifier as text, mod 3, is 1; false for a null one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) from those rows of ``labels`` (doc_id, toxic) that are not held out.

    The class prior is the toxic share of those rows. Null labels are left out.
    """
    seen = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = seen.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train(docs, seen.where("toxic = 1"), seen, 0.1 if prior is None else prior)


def toxicity(docs: DataFrame, model: Model, cut: float = PREDICTED_FROM) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text; further columns are ignored).

    Null, empty and blank texts get the score of a text without features. Equal texts get equal scores. An empty
    table gives an empty result.
    """
    scored = map_batches(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), _scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def _accepting(model: Model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                rows, at, n = present(step.column("text"), model.keys)
                z = np.clip(model.bias + np.bincount(rows, model.weights[at], n), -40, 40)
                yield step.filter(pa.array(1 / (1 + np.exp(-z)) < cut))

    return run


def accepted(docs: DataFrame, model: Model, cut: float = PREDICTED_FROM) -> DataFrame:
    """The rows of ``docs`` whose score is below the cut, with all their columns, in one pass."""
    return map_batches(docs, _accepting(model, cut), docs.schema)
