"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each byte the automaton's state names, through its output links, all pieces that end there, longest first; each relaxes the best score of the position.
Pieces are UTF-8 bytes with a blank for the piece mark U+2581, a blank is put before every text that isn't empty, and a byte that no piece covers is a byte piece. A U+2581
in a text itself is three byte pieces, so decoding gives back every text exactly.

No piece has a blank after another character, so a text falls apart before each run of blanks into chunks that are encoded alone; equal chunks of a slice are encoded once,
and all different chunks of a slice advance together, one byte a step, longest first.

The public vocabulary is of the merge kind: its scores are ranks, whose sum means nothing. The score of rank r is taken as log(1 / (r + 2)) against the sum over all
ranks, in integer steps, so that ties are exact; of equal segmentations the one whose last piece is longer wins, at each position. The vocabulary's size bounds the
automaton (256 * 4 bytes for each of its states).

Defined cases: a NULL or empty text has no pieces, and NULL decodes to NULL; repeated rows each get their own pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinelake.llm.words import _filled, _offsets, ragged, span_hashes, text_slices

UNIT = 1 << 20
SLICE = 4 << 20


def load_vocabulary(path: str) -> tuple[tuple[bytes, ...], tuple[int, ...], tuple[int, ...]]:
    """Bytes of each piece by id (empty: not for text), its integer score, and the id of each byte piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
    pieces = tuple(b"" if i in special else model.id_to_piece(i).replace("▁", " ").encode() for i in range(size))
    ranks = np.array([-model.get_score(i) if i not in special else 0.0 for i in range(size)])
    scores = -np.log(ranks + 2)
    scores -= np.log(np.exp(scores[[i for i in range(size) if i not in special]]).sum())
    return pieces, tuple(np.round(scores * UNIT).astype(int).tolist()), tuple(byte_ids)


class Pieces:
    """The automaton. step[state, byte] is the next state; found[state] the state of the longest piece that ends here (0: none), link[state] that of the next shorter one."""

    def __init__(self, pieces: tuple[bytes, ...], scores: tuple[int, ...], byte_ids: tuple[int, ...]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            if not piece:
                continue
            at = 0
            for byte in piece:
                to = children[at].get(byte)
                if to is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                at = to
            if at not in ends or scores[i] > scores[ends[at]]:
                ends[at] = i
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        self.piece, self.link, self.found = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for state, i in ends.items():
            self.piece[state] = i
        fail = np.zeros(n, np.int32)
        for byte, to in children[0].items():
            self.step[0, byte] = to
        level = list(children[0].values())
        while level:
            below = []
            for state in level:
                suffix = fail[state]
                self.link[state] = self.found[suffix]
                self.found[state] = state if self.piece[state] >= 0 else self.link[state]
                self.step[state] = self.step[suffix]
                for byte, to in children[state].items():
                    fail[to] = self.step[suffix, byte]
                    self.step[state, byte] = to
                    below.append(to)
            level = below
        self.bytes_of = [bytes([byte_ids.index(i)]) if i in byte_ids else p for i, p in enumerate(pieces)] if len(byte_ids) == 256 else list(pieces)
        self.length = np.array([len(p) for p in self.bytes_of], np.int64)
        self.score = np.array(scores, np.int64)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.byte_score = int(min(scores)) - 10 * UNIT
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.table_at = np.concatenate([[0], np.cumsum(self.length)])

    def segment(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of all ranges of bytes, and how many each range has."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        at = np.cumsum(size + 1) - size - 1  # of position 0 of each range in best and back
        best = np.zeros(int((size + 1).sum()), np.int64)
        back = np.zeros(len(best), np.int32)
        state = np.zeros(len(size), np.int32)
        active = len(size)
        for t in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= t:
                active -= 1
            byte = data[start[:active] + t]
            state[:active] = self.step[state[:active], byte]
            here = at[:active] + t + 1
            top, piece = best[here - 1] + self.byte_score, self.byte_ids[byte]
            out = self.found[state[:active]]
            live = np.flatnonzero(out)
            out = out[live]
            while len(live):
                i = self.piece[out]
                score = best[here[live] - self.length[i]] + self.score[i]
                more = score > top[live]
                top[live[more]], piece[live[more]] = score[more], i[more]
                out = self.link[out]
                keep = out > 0
                live, out = live[keep], out[keep]
            best[here], back[here] = top, piece
        left, places, ids, rows = at + size, at, [], np.arange(len(size))
        while len(rows):  # from the ends back
            rows = rows[left[rows] > places[rows]]
            i = back[left[rows]]
            ids.append((rows, i))
            left[rows] -= self.length[i]
        row = np.concatenate([r for r, _ in ids] or [np.zeros(0, np.int64)])
        found = np.concatenate([i for _, i in ids] or [np.zeros(0, np.int32)])[::-1]
        row = order[row[::-1]]
        by = np.argsort(row, kind="stable")
        return found[by], np.bincount(row, minlength=len(size))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        column = _filled(column)
        at = _offsets(column).astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        some = np.diff(at) > 0
        data = np.insert(raw, at[:-1][some], 32)
        text_at = at + np.concatenate([[0], np.cumsum(some)])
        blank = data == 32
        first = np.zeros(len(data), bool)
        first[1:] = blank[:-1]
        first[text_at[:-1][some]] = False
        start = np.flatnonzero(blank & ~first)
        end = np.append(start[1:], len(data)) if len(start) else start
        _, pick, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        ids, counts = self.segment(data, start[pick], (end - start)[pick])
        ids_at = np.cumsum(counts) - counts
        out = ids[ragged(ids_at[which], counts[which])]
        chunk_of = np.searchsorted(start, text_at)
        running = np.concatenate([[0], np.cumsum(counts[which])])
        return out, np.diff(running[chunk_of])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and how many each has, without the blank in front."""
        length = self.length[ids]
        data = self.table[ragged(self.table_at[ids], length)]
        running = np.concatenate([[0], np.cumsum(length)])
        at = running[np.concatenate([[0], np.cumsum(counts)])]
        some = np.diff(at) > 0
        return np.delete(data, at[:-1][some]), np.diff(at) - some


@lru_cache(maxsize=2)
def automaton(vocabulary: tuple) -> Pieces:
    return Pieces(*vocabulary)


def _with(batch: pa.RecordBatch, drop: str, **more: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more.values()], names=[*names, *more])


def _kinds(docs: DataFrame, carry: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)


def encode(docs: DataFrame, vocabulary: tuple, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry` and piece_ids of each row."""

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(sent.value)
        for batch in text_slices(batches, limit=SLICE):
            ids, counts = pieces.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield _with(batch, "text", piece_ids=lists)

    return docs.select(*carry, "text").mapInArrow(run, f"{_kinds(docs, carry)}piece_ids array<int>")


def decode(encoded: DataFrame, vocabulary: tuple, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry` and the text of piece_ids; NULL for NULL."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(sent.value)
        for batch in batches:
            lists = batch.column("piece_ids")
            counts = np.asarray(lists.value_lengths().fill_null(0))
            data, sizes = pieces.decode(np.asarray(lists.flatten()), counts)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())
            if lists.null_count:
                text = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)
            yield _with(batch, "piece_ids", text=text)

    return encoded.select(*carry, "piece_ids").mapInArrow(run, f"{_kinds(encoded, carry)}text string")


def encoding_report(docs: DataFrame, vocabulary: tuple) -> DataFrame:
    """Per row: doc_id, n_pieces, n_byte_pieces, pieces_sha256 (of the ids as little-endian 32-bit numbers) and exact: whether decoding gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(sent.value)
        is_byte = np.zeros(len(pieces.length), np.int64)
        is_byte[pieces.byte_ids] = 1
        for batch in text_slices(batches, limit=SLICE):
            column = _filled(batch.column("text"))
            ids, counts = pieces.encode(column)
            data, sizes = pieces.decode(ids, counts)
            at = _offsets(column).astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
            same = sizes == np.diff(at)
            if same.all():
                wrong = np.concatenate([[0], np.cumsum(data != raw)])
                same = np.diff(wrong[at - at[0]]) == 0
            ends = np.concatenate([[0], np.cumsum(counts)])
            byte_pieces = np.concatenate([[0], np.cumsum(is_byte[ids])])
            view = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
            digest = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield _with(batch, "text", n_pieces=pa.array(counts.astype(np.int64)), n_byte_pieces=pa.array(np.diff(byte_pieces[ends])), pieces_sha256=pa.array(digest, pa.string()), exact=pa.array(same))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, pieces_sha256 string, exact boolean")
