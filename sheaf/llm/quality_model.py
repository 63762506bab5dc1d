"""Quality scores by Naive Bayes support vectors.

Texts become indicators of hashed byte n-grams. Each indicator is scaled by the
log ratio of its smoothed shares in good and bad documents, rows have length one,
and a linear model with hinge loss is fitted by dual coordinate descent. A
logistic curve fitted on documents kept out of that turns margins into scores.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import settled, whole

#: Hashed indicators, and the lengths of n-grams in bytes.
BUCKETS = 1 << 17
SIZES = (1, 2, 3, 4)
#: Word n-grams of one word over and over are indicators of their own, whatever the word: the first buckets.
REPEATS = (2, 3, 4, 7, 13)
#: Labelled rows that the model is fitted on, at most: those of the smallest hashes.
MAX_LABELLED = 5_000
#: Indicators of all these rows together, at most: 256 MB in the one task that fits.
MAX_INDICATORS = 1 << 26
#: Bytes hashed at a time.
STEP = 1 << 20
EPOCHS, COST, SMOOTH = 15, 1.0, 1.0
THRESHOLD = 0.7


class Model(NamedTuple):
    scale: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # of each scaled bucket
    bias: float
    slope: float
    offset: float


def indicators(text: str | None) -> np.ndarray:
    """Sorted buckets of the n-grams that occur in a text; the whole text is read."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(BUCKETS, bool)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + SIZES[-1] - 1].astype(np.uint32)
        folded = np.zeros(len(part), np.uint32)
        for k in range(SIZES[-1]):
            n = len(part) - k
            if n <= 0:
                break
            folded = (folded[:n] + part[k:] + np.uint32(1)) * np.uint32(0x9E3779B1)
            if k + 1 in SIZES:
                seen[(folded ^ np.uint32(k * 0x05EBCA6B)) >> np.uint32(33 - BUCKETS.bit_length())] = True
    words = (text or "").split()
    same = bytes(map(operator.eq, words, words[1:]))
    for bucket, n in enumerate(REPEATS):
        seen[bucket] |= b"\x01" * (n - 1) in same
    return np.flatnonzero(seen).astype(np.int32)


def margin(found: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float) -> float:
    x = scale[found]
    norm = math.sqrt(float(x @ x))
    return bias + (float(x @ weight[found]) / norm if norm else 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of rows of buckets and labels 0 or 1. One class only: a constant score."""
    labels = np.asarray(labels, np.int64)
    n, good = len(labels), int(labels.sum())
    zeros = np.zeros(BUCKETS, np.float32)
    if not 0 < good < n:
        return Model(zeros, zeros, 0.0, 0.0, math.log((good + 1) / (n - good + 1)))
    # Every fifth row of either class is kept for the logistic curve.
    rank = np.empty(n, np.int64)
    for c in (0, 1):
        rank[labels == c] = np.arange((labels == c).sum())
    kept_out = rank % 5 == 4
    used = np.flatnonzero(~kept_out)
    counts = np.full((2, BUCKETS), SMOOTH)
    for i in used:
        counts[labels[i], rows[i]] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    scale = np.log(shares[1] / shares[0])
    norms = np.array([math.sqrt(scale[r] @ scale[r]) for r in rows])
    inverse = np.where(norms > 0, 1 / np.maximum(norms, 1e-300), 0.0)
    w, bias = np.zeros(BUCKETS), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    most = np.full(n, COST)
    alpha, q = np.zeros(n), 1.0 + (norms > 0)
    draw = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(used):
            x = scale[rows[i]] * inverse[i]  # made anew each time: only indicators are kept
            g = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), most[i])
            if (d := new - alpha[i]) != 0.0:
                w[rows[i]] += d * y[i] * x
                bias += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    margins = np.array([w[r] @ scale[r] * k + bias for r, k in zip(rows, inverse, strict=True)])
    slope, offset = _logistic(margins[kept_out], labels[kept_out]) if len(set(labels[kept_out])) == 2 else (2.0, 0.0)
    return Model(scale.astype(np.float32), w.astype(np.float32), bias, slope, offset)


def _logistic(m: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, towards smoothed targets; the slope isn't negative."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    t = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def score(text: str | None, model: Model) -> float:
    z = model.slope * margin(indicators(text), model.scale, model.weight, model.bias) + model.offset
    return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of the labelled documents that aren't held out, ``max_labelled`` at most.

    Its rows of buckets meet in one task: so many of them, in the order of their
    hashes, as hold ``MAX_INDICATORS`` buckets together, of 4 bytes each. Both bounds
    concern the fit only. The driver gets the fitted arrays, 1 MB. A document with several labels
    counts as its lowest.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("__i"), whole(F.col("text")).alias("text"))
    some = texts.join(F.broadcast(chosen), F.col("__i") == F.col("__id")).select("__id", "__y", "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "y", "found"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "found"])
        m = fit([np.frombuffer(b, np.int32) for b in group["found"]], group["y"].to_numpy())
        return pd.DataFrame({"scale": [m.scale.tobytes()], "weight": [m.weight.tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    # Rows with one doc_id could exceed the bound, so it is applied to them again.
    in_order = Window.orderBy(F.xxhash64("id"), "id", "found")
    held = F.sum(F.octet_length("found") / 4).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    indexed = settled(some.mapInArrow(index, "id long, y int, found binary"))
    numbered = indexed.withColumn("nth", F.row_number().over(in_order)).withColumn("held", held)
    rows = numbered.where((F.col("nth") <= max_labelled) & (F.col("held") <= MAX_INDICATORS)).select("id", "y", "found")
    fitted = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        run, "scale binary, weight binary, bias double, slope double, offset double"
    )
    found = fitted.collect()
    if not found:
        return fit([], np.zeros(0))
    r = found[0]
    return Model(np.frombuffer(r.scale, np.float32), np.frombuffer(r.weight, np.float32), r.bias, r.slope, r.offset)


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Labels are learned only from rows whose crc32 of the id as text, modulo 4, isn't
    2; a score sees nothing but the text. ``score`` is between 0 and 1, higher where
    label 1 is likelier, ``predicted`` is 1 from ``threshold`` on. Null and empty
    texts have the score of a text without n-grams. Without usable labels every score
    is 0.5. Equal rows stay separate rows; a null doc_id is held out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t.as_py(), model.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
