"""Toxicity by two class-conditional Kneser-Ney models over the letters of words, which share their lowest orders.

A word is read as its UTF-8 bytes and one end, after starts. For a class c and k from ORDER down to SHARED + 1,
P_c(x | last k - 1) = max(n_c - D, 0) / n_c(context) + D * followers_c(context) / n_c(context) * P_c(x | last k - 2), where n_c counts texts at the highest order and different
bytes before below it. Under that stands one count of both classes together, so a rare expression that neither class tells apart adds nothing to the difference, and
one that is made of known parts, such as a new compound, is judged by them.

The evidence of a text is log P_toxic - log P_ordinary, normalised by length: over the whole text, and over its strongest word, so that one expression tells in a text of any length. A
logistic curve, fitted on labelled texts that the models have not seen, turns it into a score from 0 to 1.

Words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Labels, language, source and id are no inputs of a score.

The models are fitted on a bounded sample: at most `per_class` labelled texts of each class count, and half as many again calibrate (documented parameters). Spark
counts in how many of them a word stands; the tasks get sorted arrays of exact byte runs, with the difference of the two models for each. Scoring is one pass over all whole
texts without a shuffle.

Defined cases: a NULL or empty text has no evidence and gets the score of evidence 0; without labels of both classes the score is the share of the label 1 (0 without any);
repeated rows each get their own score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.sample import fold, training_ids
from cinelake.llm.words import ALNUM, Words, ragged, text_slices

PER_CLASS = 2000
DISCOUNT = 0.75
THRESHOLD = 0.3
ORDER, SHARED = 6, 2  # bytes of the longest run (8 at most, it is packed in 64 bits) and of the runs counted for both classes
START, END = 1, 0  # no bytes of words


def _runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER bytes at each byte and end of each word, packed with the last one lowest, and how many each word has."""
    size = end - start + 1
    at = ragged(start, size)
    byte = np.append(data, np.uint8(END))[at].astype(np.uint64)
    last = np.cumsum(size) - 1
    byte[last] = END
    place = np.arange(len(byte)) - np.repeat(last + 1 - size, size)
    packed = byte.copy()
    for j in range(1, ORDER):
        before = np.full(len(byte), np.uint64(START))
        before[j:] = np.where(place[j:] >= j, byte[:-j], np.uint64(START))
        packed |= before << np.uint64(8 * j)
    return packed, size


def _last(packed: np.ndarray, k: int) -> np.ndarray:
    return packed & np.uint64((1 << 8 * k) - 1)


@dataclass
class Table:
    """Sorted byte runs and a number for each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of `keys` is, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of `keys`, 0 for others."""
        at, there = self.find(keys)
        return np.where(there, self.values[at], 0.0) if len(self.keys) else np.zeros(len(keys))


def _summed(keys: np.ndarray, values: np.ndarray) -> Table:
    found, where = np.unique(keys, return_inverse=True)
    return Table(found, np.bincount(where, values, minlength=len(found)))


def _counts(packed: np.ndarray, weight: np.ndarray) -> dict[int, Table]:
    """Runs of k bytes with their counts: texts for ORDER, different bytes before for fewer."""
    out = {ORDER: _summed(packed, weight)}
    for k in range(ORDER - 1, SHARED - 1, -1):
        keys = _last(out[k + 1].keys, k)
        out[k] = _summed(keys, np.ones(len(keys)))
    return out


def _contrast(classes: list[dict[int, Table]]) -> tuple[dict[int, Table], dict[int, Table]]:
    """By k: log P of class 0 - class 1 of each run that either has, and the same of what is left for shorter runs after a context."""
    both = np.concatenate([c[SHARED].keys for c in classes])
    pool = _summed(both, np.concatenate([c[SHARED].values for c in classes]))
    contexts = _summed(pool.keys >> np.uint64(8), pool.values)
    known = (pool.values + 0.5) / (contexts.of(pool.keys >> np.uint64(8)) + 128)
    below, chance = pool, [known, known]
    runs, rests = {}, {}
    for k in range(SHARED + 1, ORDER + 1):
        keys = np.unique(np.concatenate([c[k].keys for c in classes]))
        context = keys >> np.uint64(8)
        heads = np.unique(context)
        shorter, _ = below.find(_last(keys, k - 1))  # every run ends in one of the order below
        left, now = [], []
        for c, p in zip(classes, chance):
            own = c[k]
            total = _summed(own.keys >> np.uint64(8), own.values)
            kinds = Table(total.keys, np.bincount(np.searchsorted(total.keys, own.keys >> np.uint64(8)), minlength=len(total.keys)))
            n = total.of(heads)
            rest = np.where(n > 0, DISCOUNT * kinds.of(heads) / np.maximum(n, 1), 1.0)
            at = np.searchsorted(heads, context)
            now.append(np.maximum(own.of(keys) - DISCOUNT, 0) / np.maximum(n[at], 1) + rest[at] * p[shorter])
            left.append(np.log(rest))
        runs[k] = Table(keys, (np.log(now[0]) - np.log(now[1])).astype(np.float32))
        rests[k] = Table(heads, (left[0] - left[1]).astype(np.float32))
        below, chance = runs[k], now
    return runs, rests


@dataclass
class Model:
    runs: dict[int, Table]
    rests: dict[int, Table]
    slope: np.ndarray
    intercept: float

    def gain(self, packed: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of each byte; the longest known run tells, or none."""
        out, open_ = np.zeros(len(packed)), np.arange(len(packed))
        for k in range(ORDER, SHARED, -1):
            keys = _last(packed[open_], k)
            at, there = self.runs[k].find(keys)
            out[open_[there]] += self.runs[k].values[at[there]]
            open_, keys = open_[~there], keys[~there]
            out[open_] += self.rests[k].of(keys >> np.uint64(8))
        return out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """A row for each text: the mean over its bytes, the strongest word, and the strongest word by its length."""
        out = np.zeros((len(column), 3))
        words = Words(column, ALNUM)
        if not self.runs or not len(words):
            return out
        _, one, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        packed, size = _runs(words.low, words.start[one], words.end[one])
        gain = np.add.reduceat(self.gain(packed), np.cumsum(size) - size)
        full = words.counts > 0
        cuts = words.first[:-1][full]
        out[full, 0] = np.add.reduceat(gain[of], cuts) / np.add.reduceat(size[of], cuts)
        out[full, 1] = np.maximum.reduceat(gain[of], cuts)
        out[full, 2] = np.maximum.reduceat((gain / size)[of], cuts)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(column) @ self.slope + self.intercept, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton steps with a small ridge; rows are weighted so that label 1 has the share `prior`."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-6)
    at, design = np.zeros(x.shape[1] + 1), np.column_stack([x / scale, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        grad = design.T @ (weight * (p - y)) + 1e-4 * at
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-4 * np.eye(len(at))
        step = np.linalg.solve(hess, grad)
        at = at - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return at[:-1] / scale, float(at[-1])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins, and the end."""
    one = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    at = np.frombuffer(one.buffers()[1], np.int64)[: len(one) + 1] if len(one) else np.zeros(1, np.int64)
    return np.frombuffer(one.buffers()[2], np.uint8) if len(one) else np.zeros(0, np.uint8), at


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS, skip_fold: tuple[int, int] | None = (4, 2)) -> Model:
    """skip_fold (m, r): labels of ids whose crc32(id as text) mod m is r are not looked at."""
    used = labels.where(f"doc_id IS NOT NULL AND {column} IN (0, 1)")
    if skip_fold:
        used = used.where(fold("doc_id", skip_fold[0]) != skip_fold[1])
    share = used.agg(F.avg(F.col(column).cast("double"))).first()[0]
    if share is None or share in (0.0, 1.0):
        p = min(max(share or 0.0, 1e-12), 1 - 1e-12)
        return Model({}, {}, np.zeros(3), float(np.log(p / (1 - p))))
    ids = training_ids(labels, column, per_class + per_class // 2, [0, 1], skip_fold)  # 3 * per_class rows at most
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("value"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) < 2).alias("counts"))

    def count(batches):
        for batch in text_slices(batches):
            value = np.asarray(batch.column("value"))
            words = Words(batch.column("text"), ALNUM)
            hashes, doc = words.hashes(), words.doc()
            for c in (0, 1):
                own = np.flatnonzero(value[doc] == c)
                order = own[np.lexsort((doc[own], hashes[own]))]
                new = np.ones(len(order), bool)  # a word counts once for each text
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                order = order[new]
                _, first, n = np.unique(hashes[order], return_index=True, return_counts=True)
                start, end = words.start[order[first]], words.end[order[first]]
                found = pa.Array.from_buffers(
                    pa.large_binary(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(end - start))), pa.py_buffer(words.low[ragged(start, end - start)])]
                )
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), c, np.int32)), found.cast(pa.binary()), pa.array(n)], names=["value", "word", "n"])

    rows = texts.where("counts").mapInArrow(count, "value int, word binary, n long").groupBy("value", "word").agg(F.sum("n").alias("n")).toArrow()
    kind, n = np.asarray(rows["value"]), np.asarray(rows["n"])
    data, at = _flat(rows["word"])
    classes = []
    for c in (1, 0):
        packed, size = _runs(data, at[:-1][kind == c], at[1:][kind == c])
        classes.append(_counts(packed, np.repeat(n[kind == c], size).astype(float)))
    model = Model(*_contrast(classes), np.zeros(3), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in text_slices(batches):
            found = sent.value.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("value"), *(pa.array(found[:, i]) for i in range(3))], names=["value", "whole", "word", "letters"])

    held = texts.where("NOT counts").mapInArrow(measure, "value int, whole double, word double, letters double").toArrow()
    x, y = np.column_stack([np.asarray(held[k]) for k in ("whole", "word", "letters")]), np.asarray(held["value"])
    order = np.lexsort((*x.T, y))  # the same sums in every run
    if len(set(y.tolist())) == 2:
        model.slope, model.intercept = _logistic(x[order], y[order], share)
    else:
        model.slope, model.intercept = np.array([1.0, 0.0, 0.0]), float(np.log(share / (1 - share)))
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p = sent.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
