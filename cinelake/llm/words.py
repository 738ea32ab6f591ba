"""Words of many texts at once, over the buffers of an Arrow string column.

A text is handled as its UTF-8 bytes: both word classes below are defined by ASCII characters only, so every byte of a longer character is a
word byte. All arrays are per slice of a few MB (`text_slices`), so memory follows the slice, or a single text that is larger than one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(separators: Iterable[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: words [^\x20\x09-\x0D]+
SPACED = _class([0x20, *range(0x09, 0x0E)])


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in slices of about `limit` bytes of text, one row at least; a NULL text has no bytes."""
    for batch in batches:
        ends = _offsets(_filled(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _filled(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_STEP = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** i and its inverse modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = next(x for x in ((1 << 19) + 1, SLICE_BYTES + 1, n) if x >= n)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of the texts of one slice.

    raw, low: bytes as they are and with A-Z lower-cased. text_at: where each text begins, and the end. start, end: bytes of each word.
    first: the first word of each text, and the number of all.
    """

    def __init__(self, column: pa.Array, word_class: np.ndarray, lower: bool = True):
        column = _filled(column)
        at = _offsets(column).astype(np.int64)
        data = column.buffers()[2] if len(column) else None
        self.raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.low = _LOWER[self.raw] if lower else self.raw
        self.text_at = at - at[0]
        inside = word_class[self.low]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = self.text_at[(self.text_at > 0) & (self.text_at < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.text_at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits of each word, the same in every slice, task and run."""
        return span_hashes(self.low, self.start, self.end, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each range of bytes: a polynomial over a table of bytes, from running sums."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(stream(seed, 256)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def pair_hashes(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each pair of 64-bit values; the order counts."""
    x, y = stream(seed + 29, 2)
    return mix(mix(a * x) + b * y)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64 bits of each run of k consecutive words; the order of words counts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j, factor in enumerate(stream(seed + 17, k)):
        out += words[j : n + j] * factor
    return mix(out)


def window_hashes(words: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64 bits of the runs of k words that begin at the places `at`, from running sums; the order of words counts."""
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * up[: len(words)], out=total[1:])
    return mix((total[at + k] - total[at]) * down[at] + np.uint64(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """First words of the runs of k words that stay in one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return ragged(first[:-1], counts)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] values), then the same for the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(np.asarray(start, np.int64) - before, count)
