"""Benchmark decontamination: word n-grams of the test items as a hash set in every task, and one pass over the documents.

Words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `n` consecutive item words; an item with fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

The items are read in blocks of at most `block_windows` windows, so what a task holds is bounded; further blocks are further passes that go on
from the written result of the one before. Documents are never shuffled.

Defined cases: a NULL or empty text has no words, and neither hits nor is hit; an item without id has no windows; repeated rows each get their
own answer; items of equal text all count. A document longer than a slice is scanned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.store import Workspace
from cinelake.llm.words import ALNUM, Words, gram_hashes, gram_starts, text_slices

NGRAM = 10
BLOCK_WINDOWS = 1_000_000
_BLANKS = bytes(c + 32 if 65 <= c < 91 else c if ALNUM[c] else 32 for c in range(256))


def _normal(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_BLANKS).split())


class Windows:
    """The windows of a block of items: by length, sorted hashes, a bitmap in front of them, and per hash the texts and items to verify."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[bytes, list[str]] = {}
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM)
        hashes, found = words.hashes(), {}
        for i, (key, _) in enumerate(items):
            lo, hi = words.first[i], words.first[i + 1]
            size = min(n, hi - lo)
            for at in range(lo, hi - size + 1 if size else lo):
                text = _normal(words.raw[words.start[at] : words.end[at + size - 1]].tobytes())
                found.setdefault(int(size), set()).add(int(gram_hashes(hashes[at : at + size], size)[0]))
                if str(key) not in self.items.setdefault(text, []):
                    self.items[text].append(str(key))
        for size, keys in found.items():
            table = np.array(sorted(keys), np.uint64)
            bits = max(12, int(len(table) * 16).bit_length())
            front = np.zeros(1 << bits, bool)
            front[table >> np.uint64(64 - bits)] = True
            self.tables[size] = (table, front)

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """First word, length and items of each verified occurrence."""
        for size, (table, front) in self.tables.items():
            starts = gram_starts(words.first, size)
            grams = gram_hashes(hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)
            shift = np.uint64(64 - (len(front) - 1).bit_length())
            maybe = np.flatnonzero(front[grams >> shift])
            at = np.minimum(np.searchsorted(table, grams[maybe]), len(table) - 1)
            for w in starts[maybe[table[at] == grams[maybe]]].tolist():
                text = _normal(words.raw[words.start[w] : words.end[w + size - 1]].tobytes())
                if items := self.items.get(text):
                    yield w, size, items


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about `limit` words. A text of n bytes has at most (n + 1) / 2 words."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in rows.toLocalIterator():
        words = len(row.text.encode()) // 2 + 1
        if block and size + words > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += words
    if block:
        yield block


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """Adds what this block hits to the columns `spans` (disjoint, in order) and `items` that earlier blocks left."""
    schema = docs.schema

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = Words(batch.column("text"), ALNUM)
            of = words.doc()
            change = np.zeros(len(words) + 1, np.int32)
            touched: dict[int, set[str]] = {}
            for w, size, items in windows.hits(words, words.hashes()):
                change[w] += 1
                change[w + size] -= 1
                touched.setdefault(int(of[w]), set()).update(items)
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for i in touched:
                lo = int(words.first[i])
                for s in spans[i]:
                    change[lo + s["start"]] += 1
                    change[lo + s["end"]] -= 1
            hit = np.cumsum(change[:-1]) > 0
            for i, more in touched.items():
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8)))
                spans[i] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                items[i] = sorted({*items[i], *more})
            new = {"spans": spans, "items": items, "n_words": words.counts.astype(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(scan, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, text, n_words, the hit word ranges `spans` and the `items` (ids as text, sorted) of each document."""
    spark = docs.sparkSession
    out = docs.select(
        *keep, "text", F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    ).withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    space, done = None, 0
    blocks = _blocks(benchmark, block_windows)
    block = next(blocks, [])
    while True:
        out = _scan(out, Windows(block, n))
        block = next(blocks, None)
        if block is None:
            return out
        space = space or Workspace(spark, "decontaminate")
        out = space.write(out, str(done))
        space.drop(str(done - 1))
        done += 1


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, n, block_windows)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def cut_words(column: pa.Array, spans: list[list[dict]]) -> list[str | None]:
    """Each text without the given word ranges, from the first byte of a range's first word to the first byte of the word after it."""
    words = Words(column, ALNUM)
    out = column.to_pylist()
    for i, ranges in enumerate(spans):
        if not ranges:
            continue
        lo, n, end = int(words.first[i]), int(words.counts[i]), int(words.text_at[i + 1])
        at, parts = int(words.text_at[i]), []
        for r in ranges:
            parts.append(words.raw[at : words.start[lo + r["start"]]].tobytes())
            at = int(words.start[lo + r["end"]]) if r["end"] < n else end
        out[i] = b"".join([*parts, words.raw[at:end].tobytes()]).decode()
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, mode: str = "documents", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with their own columns: mode "documents" leaves contaminated ones out, "spans" takes the hit words out of the text."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row_"), "text") if rest else docs.select(F.struct(F.lit(0).alias("_")).alias("row_"), "text")
    found = find_contamination(packed, benchmark, n, block_windows, ("row_",))
    if mode == "documents":
        found = found.where(F.size("items") == 0)
    else:

        def cut(batches):
            for batch in text_slices(batches):
                text = pa.array(cut_words(batch.column("text"), batch.column("spans").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([text if f.name == "text" else batch.column(f.name) for f in batch.schema], schema=batch.schema)

        found = found.mapInArrow(cut, found.schema)
    return found.select(*[F.col("text") if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])


def items_digest(items: Iterable[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
