"""Structure of containers of any size, walked over pieces of objects.

A walk goes from node to node and skips payloads, so it needs few of an object's bytes, and no object is ever one value. It keeps a state (next offset, open nodes) and goes in rounds: the
objects that are still open ask for the pieces from their next offset on, an equality join brings these, and a task takes them in order as far as they go. Each round is a written
table of nodes and states, and asks for four times as many pieces as the one before, so that long objects end in few rounds; a task holds a piece or two at a time, whatever
the run. Nesting costs an entry of the state for each open node, not a level of recursion.

pieces(key, length, piece_no, offset, content) are those of `sources.pieces`, with a fixed size and no halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.functions import binary as B, rational
from cinelake.session import checkpointed
from cinelake.sources.pieces import PIECE

#: Ids of nodes that hold nodes.
RIFF_LISTS = frozenset({b"RIFF", b"LIST"})
ISO_LISTS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"edts", b"dinf", b"mvex"})

RUN = 16
_STATE = {
    "pos": pa.int64(), "seq": pa.int64(), "ends": pa.list_(pa.int64()), "resumes": pa.list_(pa.int64()), "parents": pa.list_(pa.int64()), "body": pa.int64(), "ident": pa.string(),
    "error": pa.string(), "done": pa.bool_(),
}
_STATE_DDL = "struct<pos:bigint,seq:bigint,ends:array<bigint>,resumes:array<bigint>,parents:array<bigint>,body:bigint,ident:string,error:string,done:boolean>"
_NODE_DDL = "seq bigint, parent bigint, id string, data_off bigint, data_len bigint, truncated boolean, head binary"


class Walk:
    """A walk of one object, ahead of the bytes seen so far. `more` takes the window of bytes from `pos` on and goes until a node needs bytes behind it."""

    def __init__(self, family: str, length: int, state: dict | None = None):
        self.family, self.length = family, length
        self.pos, self.seq, self.body, self.ident, self.error, self.done = 0, 0, None, None, None, False
        self.lists = True
        self.ends: list[int] = []
        self.resumes: list[int] = []
        self.parents: list[int] = []
        for name, value in (state or {}).items():
            setattr(self, name, value)
        self.nodes: list[tuple] = []
        self._step = getattr(self, f"_{family}")

    def state(self) -> dict:
        return {name: getattr(self, name) for name in _STATE}

    def more(self, window: memoryview, start: int) -> None:
        """window: bytes from offset `start` on, start <= pos."""
        self.window, self.start = window, start
        self.stop = start + len(window)
        while not self.done and self._step():
            pass

    def seen(self, n: int) -> bool:
        """Whether n bytes from pos on are in the window, or all that the object has. A node that claims more than its parent has can lead back to before the window."""
        return self.start <= self.pos and min(self.pos + n, self.length) <= self.stop

    def at(self, offset: int, n: int) -> bytes:
        return bytes(self.window[offset - self.start : offset - self.start + n])

    def emit(self, ident: bytes, off: int, size: int, end: int, head: bytes | None = None) -> int:
        cut = off + size > end
        self.nodes.append((self.seq, self.parents[-1] if self.parents else None, ident.decode("latin-1"), off, size, cut, head))
        if cut and not self.error:
            self.error = "truncated node"
        self.seq += 1
        return self.seq - 1

    def fail(self, error: str) -> bool:
        self.error, self.done = self.error or error, True
        return False

    def open(self, node: int, first: int, end: int, resume: int) -> None:
        self.ends.append(end)
        self.resumes.append(resume)
        self.parents.append(node)
        self.pos = first

    def close(self) -> None:
        self.ends.pop()
        self.parents.pop()
        self.pos = self.resumes.pop()

    def _end(self) -> int | None:
        """The end of the innermost node that has room for another header; None when the walk is over."""
        while self.ends and self.pos + 8 > self.ends[-1]:
            self.close()
        end = self.ends[-1] if self.ends else self.length
        if self.pos + 8 > end:
            self.done = True
            if self.pos < self.length:
                self.fail("short header")
            return None
        return end

    def _riff(self) -> bool:
        end = self._end()
        if end is None or not self.seen(8):
            return False
        head = self.at(self.pos, 8)
        ident, size = head[:4], int.from_bytes(head[4:], "little")
        first, after = self.pos + 8, self.pos + 8 + size + (size & 1)
        node = self.emit(ident, first, size, end)
        if self.lists and ident in RIFF_LISTS and size >= 4:
            self.open(node, first + 4, min(first + size, end), after)
        else:
            self.pos = after
        return True

    def _iso(self) -> bool:
        end = self._end()
        if end is None or not self.seen(16):
            return False
        head = self.at(self.pos, 16)
        size, ident, used = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1 and self.pos + 16 <= end:
            size, used = int.from_bytes(head[8:], "big"), 16
        elif size == 0:
            size = end - self.pos
        if size < used:
            self.error = self.error or "bad size"
            if not self.ends:
                return self.fail("bad size")
            self.close()
            return True
        node = self.emit(ident, self.pos + used, size - used, end)
        if ident in ISO_LISTS:
            self.open(node, self.pos + used, min(self.pos + size, end), self.pos + size)
        else:
            self.pos += size
        return True

    def _ogg(self) -> bool:
        if self.pos >= self.length:
            self.done = True
            return False
        if not self.seen(27):
            return False
        head = self.at(self.pos, 27)
        if len(head) < 27:
            return self.fail("short header")
        if head[:4] != b"OggS":
            return self.fail("lost sync")
        if not self.seen(27 + head[26]):
            return False
        head = self.at(self.pos, 27 + head[26])
        body = self.pos + 27 + head[26]
        size = sum(head[27:])
        self.emit(b"OggS", body, size, self.length, head)
        self.pos = body + size
        return True

    def _gif(self) -> bool:
        table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
        if self.ident is not None:  # sub-blocks of a node: a length byte each, 0 ends them
            while self.pos < self.length:
                if self.pos >= self.stop:
                    return False
                n = self.window[self.pos - self.start]
                self.pos += 1 + n
                if not n:
                    break
            else:
                self.pos += 1  # the end is missing
            self.emit(self.ident.encode("latin-1"), self.body, self.pos - self.body, self.length)
            self.ident = self.body = None
            return True
        if not self.seq and self.pos == 0:
            if not self.seen(13):
                return False
            if self.length < 13:
                return self.fail("short header")
            self.pos = 13 + table(self.at(10, 1)[0])
        if self.pos >= self.length:
            self.done = True
            return False
        if not self.seen(10):
            return False
        head = self.at(self.pos, 10)
        if head[0] == 0x21 and len(head) >= 3:
            self.ident, self.body, self.pos = f"X{head[1]:02X} ", self.pos + 2, self.pos + 2
        elif head[0] == 0x2C and len(head) == 10:
            self.ident, self.body, self.pos = "IMG ", self.pos + 1, self.pos + 11 + table(head[9])
        elif head[0] in (0x21, 0x2C):
            self.nodes.append((self.seq, None, "CUT ", self.pos + (2 if head[0] == 0x21 else 1), 0, True, None))
            self.seq += 1
            return self.fail("truncated node")
        else:
            self.done = True
            return self.fail("trailing bytes") if head[0] != 0x3B else False
        return True


FAMILIES = ("riff", "iso", "ogg", "gif")


def _round(asked: DataFrame, key: str, family: str) -> DataFrame:
    """asked: pieces of open objects, each with the state of its object on its first row. Nodes (kind 0) and states (kind 1)."""
    key_type = asked.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, name, window, start = None, None, memoryview(b""), 0
        rows: list[tuple] = []
        schema = None

        def batch() -> pa.RecordBatch:
            states = [r[-1] for r in rows]
            columns = [pa.array(c, t.type) for c, t in zip(zip(*[r[:-1] for r in rows]), schema)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.struct(list(_STATE.items())))], names=[f.name for f in schema] + ["state"])
            rows.clear()
            return out

        def take() -> None:
            rows.extend((name, 0, *node, None) for node in walk.nodes)
            walk.nodes.clear()

        def finish() -> None:
            take()
            rows.append((name, 1, None, None, None, walk.length, None, None, None, walk.state()))

        for part in batches:
            schema = schema or pa.schema([
                (key, part.schema.field(key).type), ("kind", pa.int32()), ("seq", pa.int64()), ("parent", pa.int64()), ("id", pa.string()), ("data_off", pa.int64()), ("data_len", pa.int64()),
                ("truncated", pa.bool_()), ("head", pa.binary()),
            ])
            small = [part.column(c).to_pylist() for c in (key, "length", "offset", "state")]
            for (who, length, offset, state), content in zip(zip(*small), part.column("content")):
                if walk is None or who != name:
                    if walk is not None:
                        finish()
                    walk, name, window, start = Walk(family, length, state), who, memoryview(b""), offset
                data = memoryview(content.as_buffer()).cast("B")
                if walk.done or walk.pos >= offset + len(data) > 0 and offset + len(data) < length:
                    continue
                if walk.pos < offset:  # a header goes over the border; what was seen of it is kept
                    if walk.pos < start or start + len(window) != offset:
                        continue
                    window = memoryview(bytes(window[walk.pos - start :]) + bytes(data))
                    start = walk.pos
                else:
                    window, start = data, offset
                walk.more(window, start)
                take()
                window, start = window[min(max(walk.pos - start, 0), len(window)) :], min(max(walk.pos, start), start + len(window))
                if len(rows) >= 1 << 14:
                    yield batch()
        if walk is not None:
            finish()
        if rows:
            yield batch()

    return asked.mapInArrow(run, f"`{key}` {key_type}, kind int, {_NODE_DDL}, state {_STATE_DDL}")


def walk_boxes(pieces: DataFrame, family: str, key: str = "path", piece: int = PIECE, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejects) of containers of one family (`riff`, `iso`, `ogg`, `gif`).

    nodes(key, seq, parent, id, data_off, data_len, truncated, head) are numbered in file order, parents before their children; `head` is an Ogg page's header and NULL elsewhere: bytes of
    nodes come from `range_bytes`. rejects(key, error, at) are objects whose walk did not end at their end: `truncated node`, `short header`, `bad size`, `lost sync`, `trailing bytes`; what was found
    before stays in nodes.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    objects = pieces.groupBy(key).agg(F.max("length").alias("length"))
    state = F.lit(None).cast(_STATE_DDL)
    frontier = objects.select(key, "length", F.lit(0).cast("long").alias("first"), state.alias("state"))
    nodes, ended = None, None
    while True:
        last = F.greatest(F.col("first"), rational.int_div(F.col("length") - 1, F.lit(piece)))
        numbers = F.explode(F.sequence("first", F.least(last, F.col("first") + run - 1)))
        wanted = frontier.select(key, "first", "state", numbers.alias("piece_no"))
        wanted = wanted.select(key, "piece_no", F.when(F.col("piece_no") == F.col("first"), F.col("state")).alias("state"))
        asked = pieces.select(key, "length", "piece_no", "offset", "content").join(wanted, [key, "piece_no"])
        out = checkpointed(_round(asked.repartition(key).sortWithinPartitions(key, "piece_no"), key, family))
        found = out.where("kind = 0").drop("kind", "state")
        states = out.where("kind = 1").select(key, F.col("data_off").alias("length"), "state")
        over = states.where("state.done or state.pos >= length").select(key, "length", "state")
        nodes = found if nodes is None else nodes.unionByName(found)
        ended = over if ended is None else ended.unionByName(over)
        frontier = states.where("not (state.done or state.pos >= length)").select(key, "length", rational.int_div(F.col("state.pos"), F.lit(piece)).alias("first"), "state")
        if not frontier.limit(1).count():
            break
        run *= 4
    rejects = ended.where("state.error is not null").select(key, F.col("state.error").alias("error"), F.col("state.pos").alias("at"))
    return nodes, rejects


def range_bytes(ranges: DataFrame, pieces: DataFrame, keys: list[str], key: str = "path", piece: int = PIECE, off: str = "off", length: str = "len") -> DataFrame:
    """Bytes of ranges (key, off, len, ...) of objects, as ordered parts (keys, part_no, bytes): a range is cut at the borders of pieces, so that parts meet their pieces by an equality join, and
    no range is one value. Bytes past the end of an object are not there; a range of no bytes has no part."""
    first, last = rational.int_div(F.col(off), F.lit(piece)), rational.int_div(F.col(off) + F.col(length) - 1, F.lit(piece))
    parts = ranges.where(F.col(length) > 0).select(*{*keys, key}, off, length, first.alias("__first"), F.explode(F.sequence(first, last)).alias("piece_no"))
    held = pieces.select(key, "piece_no", F.col("offset").alias("__offset"), "content")
    joined = parts.join(held, [key, "piece_no"])
    start = F.greatest(F.lit(0).cast("long"), F.col(off) - F.col("__offset"))
    size = F.least(F.col(off) + F.col(length), F.col("__offset") + piece) - F.greatest(F.col(off), F.col("__offset"))
    return joined.select(*keys, (F.col("piece_no") - F.col("__first")).alias("part_no"), B.slice_bytes("content", start, size).alias("bytes"))


# ---- Ogg packets --------------------------------------------------------------------------------------------------

def packet_ranges(pages: DataFrame, numbered: DataFrame) -> DataFrame:
    """Where the bytes of packets lie: (path, serial, packet_no, page_no, off, len), a range for each page of a packet.

    pages are those of `containers.ogg_pages`, numbered those of `containers.packets_from_segments` over their segments, keyed by (path, serial).
    """
    ends = F.transform(F.sequence(F.lit(1), F.size("lens")), lambda n: F.aggregate(F.slice("lens", F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x))
    places = pages.select("path", "serial", "page_no", "data_off", F.arrays_zip(F.col("lens").alias("len"), ends.alias("end")).alias("z")).where(F.size("z") > 0)
    placed = places.select("path", "serial", "page_no", "data_off", F.posexplode_outer("z").alias("i", "z")).where("i is not null")
    placed = placed.select("path", "serial", "page_no", (F.col("page_no") * 256 + F.col("i")).alias("seg_no"), (F.col("data_off") + F.col("z.end") - F.col("z.len")).alias("off"), F.col("z.len").alias("len"))
    own = placed.join(numbered.select("path", "serial", "seg_no", "packet_no"), ["path", "serial", "seg_no"])
    return own.groupBy("path", "serial", "packet_no", "page_no").agg(F.min("off").alias("off"), F.sum("len").cast("long").alias("len"))
