"""Quality classifier: cumulative-link (proportional-odds) regression on graded ratings over hashed text.

P(grade <= k | text) = sigmoid(threshold[k] - weights . x). The weights are shared by all grades, and the thresholds are kept in order by being sums of positive
steps. x has hashed 3-byte windows of the text as it is (square roots of their shares, so |x| <= 1) and two hashed word events: a word that equals the one
before it, and any other word. A document gets its expected grade and the tail probability P(grade >= the grade asked for); selection is by the tail.

The fit reads a bounded sample, at most `per_grade` labelled documents of each grade (a documented parameter), and of each such id one text. Features travel as their nonzero places; on the driver they
are at most per_grade * grades * DIM * 4 bytes, filled once and read in blocks of rows. Scoring is one pass over all whole texts without a shuffle.

Defined cases: a NULL or empty text has x = 0 and gets the prior; without labels, or with one grade only, nothing can be told apart, the tail is 1 and all is kept;
repeated rows each get their own score; labels of ids without a document are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.sample import training_ids
from cinelake.llm.words import SPACED, Words, mix, text_slices

DIM = 2048
PER_GRADE = 2500
MAX_GRADES = 10
KEEP = 0.5
RATE, STEPS, RIDGE = 0.05, 400, 1e-4
_ROWS = 512


def features(column: pa.Array) -> np.ndarray:
    """One row of DIM values for each text."""
    words = Words(column, SPACED, lower=False)
    raw = words.raw.astype(np.uint64)
    tri = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16) if len(raw) > 2 else np.zeros(0, np.uint64)
    slot = (mix(tri) % np.uint64(DIM - 2)).astype(np.int64)
    again = np.zeros(len(words), bool)
    hashes = words.hashes()
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][words.counts > 0]] = False
    out = np.zeros((len(column), DIM), np.float32)
    for i in range(len(column)):
        lo, hi = words.text_at[i], words.text_at[i + 1] - 2
        if hi > lo:
            out[i] = np.bincount(slot[lo:hi], minlength=DIM) / (2 * (hi - lo))
        if n := words.counts[i]:
            repeats = again[words.first[i] : words.first[i + 1]].sum()
            out[i, DIM - 2 :] = repeats / (2 * n), (n - repeats) / (2 * n)
    return np.sqrt(out)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one less than grades, ascending
    grades: list[int]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P of each grade, in order, for each row."""
        below = _sigmoid(self.thresholds[None, :] - (x @ self.weights)[:, None])
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, grades: list[int], prior: np.ndarray) -> Model:
    """Weighted maximum likelihood by Adam with a ridge. y: positions in grades. prior: the share of each grade among all labels, which weights the rows."""
    k = len(grades)
    if k < 2 or not len(x):
        return Model(np.zeros(DIM), np.zeros(0), grades[:1] or [0])
    share = np.bincount(y, minlength=k) / len(y)
    row = (prior / np.maximum(share, 1e-9))[y]
    row = row / row.sum()
    cumulative = np.clip(np.cumsum(prior)[:-1], 1e-4, 1 - 1e-4)
    edges = np.log(cumulative / (1 - cumulative))
    at = np.concatenate([np.zeros(DIM), edges[:1], np.log(np.maximum(np.diff(edges), 1e-3))])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, STEPS + 1):
        w, steps = at[:DIM], np.exp(at[DIM + 1 :])
        thresholds = at[DIM] + np.concatenate([[0.0], np.cumsum(steps)])
        padded = np.concatenate([[-np.inf], thresholds, [np.inf]])
        s = np.concatenate([x[i : i + _ROWS].astype(float) @ w for i in range(0, len(x), _ROWS)])
        upper, lower = _sigmoid(padded[y + 1] - s), _sigmoid(padded[y] - s)
        upper[y == k - 1], lower[y == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / p * row, lower * (1 - lower) / p * row
        grad_edge = np.zeros(k - 1)
        np.subtract.at(grad_edge, np.minimum(y, k - 2), np.where(y < k - 1, d_up, 0))
        np.add.at(grad_edge, np.maximum(y - 1, 0), np.where(y > 0, d_low, 0))
        after = np.cumsum(grad_edge[::-1])[::-1]
        slope = d_up - d_low
        pull = sum(slope[i : i + _ROWS] @ x[i : i + _ROWS].astype(float) for i in range(0, len(x), _ROWS))
        grad = np.concatenate([pull + RIDGE * w, after[:1], after[1:] * steps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        rate = RATE * 4 * (1 if t < STEPS * 0.7 else 0.25)
        at = at - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    thresholds = at[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(at[DIM + 1 :]))])
    return Model(at[:DIM], thresholds, grades)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", per_grade: int = PER_GRADE) -> Model:
    shares = labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL").groupBy(F.col(column).cast("int").alias("value")).count().limit(MAX_GRADES + 1).collect()
    if len(shares) > MAX_GRADES:
        raise ValueError(f"{column} has over {MAX_GRADES} grades")
    counts = {r["value"]: r["count"] for r in sorted(shares, key=lambda r: r["value"])}
    grades = list(counts)
    if len(grades) < 2:
        return fit(np.zeros((0, DIM)), np.zeros(0, int), grades, np.zeros(0))
    ids = training_ids(labels, column, per_grade, grades).select("doc_id", "value")  # per_grade * MAX_GRADES rows at most

    def extract(batches):
        for batch in text_slices(batches):
            x = features(batch.column("text"))
            packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("value"), pa.array(packed, pa.binary())], names=["doc_id", "value", "x"])

    # one text of each sampled id, so per_grade * grades rows at most, in the same order in every run
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, value int, x binary")
    rows = found.groupBy("doc_id", "value").agg(F.min("x").alias("x")).select("value", "x").toArrow().sort_by([("value", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return fit(np.zeros((0, DIM)), np.zeros(0, int), grades[:1], np.zeros(0))
    x = np.zeros((rows.num_rows, DIM), np.float32)
    for row, value in zip(x, rows["x"]):
        data = value.as_buffer()
        if n := len(data) // 6:
            row[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float32, n, 2 * n)
    y = np.array([grades.index(v) for v in rows["value"].to_pylist()])
    prior = np.array([counts[g] for g in grades], float)
    return fit(x, y, grades, prior / prior.sum())


def grade(docs: DataFrame, model: Model, tail: int | None = None, keep: float = KEEP, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry`, expected_grade, tail_probability of grade >= tail (the highest grade if None) and kept, for each row."""
    levels = np.array(model.grades, float)
    reached = levels >= (levels[-1] if tail is None else tail)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p = model.probabilities(features(batch.column("text")))
            top = p @ reached
            found = [pa.array(p @ levels), pa.array(top), pa.array(top >= keep)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *found], names=[*carry, "expected_grade", "tail_probability", "kept"])

    return docs.select(*carry, "text").mapInArrow(score, f"{kinds}, expected_grade double, tail_probability double, kept boolean")


def select_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", keep: float = KEEP, per_grade: int = PER_GRADE) -> DataFrame:
    """The documents that the model keeps, with their own columns."""
    model = train(docs, labels, column, per_grade)
    if len(model.grades) < 2:
        return docs
    packed = docs.select(F.struct(*docs.columns).alias("row_"), F.col("text"))
    return grade(packed, model, keep=keep, carry=("row_",)).where("kept").select("row_.*")
