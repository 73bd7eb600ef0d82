"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every run of letters gives its byte n-grams, hashed into buckets; a text is the average embedding of its
n-grams, and a linear softmax over that average names the language. Embeddings and softmax are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows, for which executors count
buckets, so what reaches the driver does not grow with text length or table size. A part of the sample
is kept from training: on it the temperature of the softmax is fitted, and the probability below which
a prediction is rejected is read off.

Applying the model needs no embedding: averaging and the linear layer commute, so each bucket has one
score per language, and texts are scored block by block over their whole length.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; without
labelled rows everything is ``und``; with a single label it is predicted with score 1. Equal texts get
equal results. Other columns are kept; columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripweave.llm import text_blocks

UNKNOWN = "und"
SAMPLE_ROWS = 4000  # labelled rows that are trained on, at most twice as many by chance
BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (1, 2, 3)
EPOCHS = 6
LEAST_STEPS = 400  # a small sample is passed more often
BATCH = 64
BLOCK_BYTES = 1 << 18  # text whose n-grams are numbered at once, at some 80 bytes of memory for each byte
RATE = 0.5
CALIBRATION_SHARE = 5  # one in so many sampled rows calibrates
REJECTED_SHARE = 0.001  # of rightly labelled texts that may be rejected
HIGHEST_THRESHOLD = 0.6

# Bytes of letters: ASCII letters and all of non-ASCII; the text is lower-cased by Spark before.
_LETTERS = text_blocks.byte_class(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)
RESULT = "struct<lang:string,score:double>"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def bucket_ids(block: text_blocks.Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block and the number of the text each belongs to.

    A word is the run of letters with the byte before and after it, all other bytes being one
    boundary mark; n-grams with a boundary mark inside are left out.
    """
    n = len(block.data)
    if n == 0:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    letter = _LETTERS[block.data]
    code = np.where(letter, block.data, np.uint8(0)).astype(np.uint32)
    text = np.repeat(np.arange(block.texts), np.diff(block.offsets))
    found, owners = [], []
    for size in SIZES:
        if n < size:
            continue
        count = n - size + 1
        value = np.full(count, np.uint32(size), np.uint32)
        for step in range(size):
            value = value * np.uint32(0x01000193) + code[step : step + count]
        usable = text[:count] == text[size - 1 :]
        for step in range(1 if size > 2 else 0, size - 1 if size > 2 else size):
            usable &= letter[step : step + count]
        if size == 2:
            usable = (text[:count] == text[1:]) & (letter[:count] | letter[1:])
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(12)
        found.append((value[usable] & np.uint32(buckets - 1)).astype(np.int32))
        owners.append(text[:count][usable])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    """Labels, one score per bucket and label, and the calibration."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = sums / np.maximum(counts, 1)[:, None] + self.bias
        p = softmax(mean / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_texts(model: Model, column: pa.Array) -> list[tuple[str, float]]:
    rows: list[tuple[str, float]] = []
    for block in text_blocks.blocks(column, BLOCK_BYTES):
        sums = np.zeros((block.texts, len(model.labels)))
        ids, owner = bucket_ids(block)
        counts = np.bincount(owner, minlength=block.texts)
        for number in range(len(model.labels)):
            sums[:, number] = np.bincount(
                owner, weights=model.scores[ids, number], minlength=block.texts
            )
        best, p = model.predict(sums, counts)
        rows.extend(
            (model.labels[b], float(q)) if c else (UNKNOWN, 0.0) for b, q, c in zip(best, p, counts)
        )
    return rows


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for block in text_blocks.blocks(text, BLOCK_BYTES):
            ids, owner = bucket_ids(block)
            buckets, weights = [], []
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(block.texts + 1))
            for row in range(block.texts):
                own, count = np.unique(ids[order[ends[row] : ends[row + 1]]], return_counts=True)
                buckets.append(own)
                weights.append(count.astype(np.float32) / max(count.sum(), 1))
            part = batch.slice(block.first, block.texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("order"),
                    part.column("label"),
                    pa.array(buckets, pa.list_(pa.int32())),
                    pa.array(weights, pa.list_(pa.float32())),
                ],
                ["order", "label", "buckets", "weights"],
            )


def sample(labelled: DataFrame, text: Column, label: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` distinct labelled texts, those of the lowest hashes, with their bucket shares.

    Copies of a text are one, so that no group of them decides what else is taken, and the choice does
    not depend on how the rows are dealt over partitions.
    """
    known = labelled.where(label.isNotNull() & text.isNotNull())
    total = known.count()
    highest = -(2**63) + (2**64 - 1) * min(rows, total) // max(total, 1)
    order = F.xxhash64(text, label)
    chosen = (
        known.select(order.alias("order"), label.cast("string").alias("label"), F.lower(text).alias("text"))
        .where(F.col("order") <= highest)
        .groupBy("order", "label")
        .agg(F.min("text").alias("text"))
        .orderBy("order", "label")
        .limit(2 * rows)
    )
    return chosen.mapInArrow(
        _features, "order bigint, label string, buckets array<int>, weights array<float>"
    )


def train(rows: list, seed: int = 7) -> Model | None:
    """Fit on sampled rows (order, label, buckets, weights); None without any."""
    rows = sorted((r for r in rows if len(r.buckets)), key=lambda r: (r.order, r.label))
    labels = sorted({r.label for r in rows})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    held = [r for r in rows if r.order % CALIBRATION_SHARE == 0]
    fit = [r for r in rows if r.order % CALIBRATION_SHARE] or rows
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    averages = np.zeros((BATCH, BUCKETS), np.float32)
    batches = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps = epochs * batches
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for begin in range(0, len(fit), BATCH):
            part = [fit[i] for i in order[begin : begin + BATCH]]
            x = averages[: len(part)]
            x[:] = 0
            for row, r in enumerate(part):
                x[row, r.buckets] = r.weights
            used = np.flatnonzero(x.any(axis=0))
            dense = x[:, used]
            rate = RATE * len(part) / 4 * (1 - step / steps)
            hidden = dense @ table[used]
            p = softmax(hidden @ layer + bias)
            p[np.arange(len(part)), [number[r.label] for r in part]] -= 1
            p /= len(part)
            back = p @ layer.T
            layer -= rate * hidden.T @ p
            bias -= rate * 0.1 * p.sum(axis=0)
            table[used] -= rate * 20 * dense.T @ back
            step += 1
    # Buckets never met carry no evidence, so a text of strange n-grams stays near even odds.
    met = np.zeros(BUCKETS, bool)
    for r in fit:
        met[r.buckets] = True
    scores = np.where(met[:, None], table @ layer, 0.0).astype(np.float64)
    model = Model(labels, scores, bias.astype(np.float64), 1.0, 0.0)
    calibrate(model, held or fit, number)
    return model


def calibrate(model: Model, rows: list, number: dict[str, int]) -> None:
    """Temperature of least log loss, then the threshold that few right labels fall below."""
    logits = np.array(
        [np.asarray(r.weights, float) @ model.scores[list(r.buckets)] + model.bias for r in rows]
    )
    truth = np.array([number[r.label] for r in rows])
    at = np.arange(len(rows))
    # Smoothed targets, as in Platt scaling: separable rows must not make the model certain.
    off = 1.0 / (len(rows) + 2)
    target = np.full(logits.shape, off / max(logits.shape[1] - 1, 1))
    target[at, truth] = 1 - off
    grid = np.geomspace(0.02, 20, 60)
    losses = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    right = p[at, truth][p.argmax(axis=1) == truth]
    lowest = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    model.threshold = min(lowest, HIGHEST_THRESHOLD)


def fit(
    labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS
) -> Model | None:
    return train(sample(labelled, F.col(text), F.col(label), rows).collect())


def predicted(model: Model, text: Column) -> Column:
    """Struct of language and probability for a text column."""

    # Declared nondeterministic so that a filter on the result does not run the model twice.
    @arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = score_texts(model, batch)
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                fields=list(_RESULT),
            )

    return predict.asNondeterministic()(F.lower(text))


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``."""
    added = ("lang_pred", "score", "rejected")
    names = [name for name in df.columns if name not in added]
    kept = [F.col(f"`{name}`") for name in names]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.select(
            *kept,
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"),
        )
    found = df.select(
        *kept, letters.alias("__letters"), predicted(model, F.col(text)).alias("__found")
    )
    known = F.col("__letters") & (F.col("__found.lang") != UNKNOWN)
    return found.select(
        *kept,
        F.when(known, F.col("__found.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("__found.score")).otherwise(F.lit(0.0)).alias("score"),
        (~known | (F.col("__found.score") < F.lit(model.threshold))).alias("rejected"),
    )
