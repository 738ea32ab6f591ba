"""Container tables: records, chunks, programs, sample tables, timing runs, pages and packets.

Keys such as a path may hold a large share of all rows, so running values go through `functions.ordered` (blocks of a
key), per-key facts through aggregation with map-side combine, and payloads are assembled in bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cinelake import rules as R
from cinelake.functions import binary as B, generate, grouped, ordered, rational
from cinelake.functions.grouped import GROUP
from cinelake.operators import boxes
from cinelake.session import checkpointed



def _zero() -> Column:
    return F.lit(0).cast("long")


# ---- records and chunks -----------------------------------------------------------------------------------------

def split_records(objects: DataFrame, size: int, content: str = "content") -> DataFrame:
    """Whole fixed-size records. An object is cut into blocks of records first, so that no array grows with it; blocks are cut before the explode, so the content itself is not repeated per row."""
    keep = [c for c in objects.columns if c != content]
    per = max(1, (1 << 18) // size)
    n = rational.int_div(B.size_of(content), F.lit(size))
    starts = F.when(n > 0, F.sequence(_zero(), n - 1, F.lit(per).cast("long")))
    block = lambda at: F.struct(at.alias("at"), F.least(F.lit(per), n - at).alias("n"), B.slice_bytes(content, at * size, F.least(F.lit(per), n - at) * size).alias("b"))
    # the outer forms keep the optimizer from testing (and so computing) the slices a second time in a filter
    blocks = objects.select(*keep, F.explode_outer(F.transform(starts, block)).alias("__x")).where("__x is not null")
    slices = F.transform(F.sequence(_zero(), F.col("__x.n") - 1), lambda i: B.slice_bytes(F.col("__x.b"), i * size, size))
    out = blocks.select(*keep, F.col("__x.at").alias("__at"), F.posexplode_outer(slices).alias("__i", "payload")).where("__i is not null")
    return out.select(*keep, (F.col("__at") + F.col("__i")).alias("record_no"), "payload")


#: Boxes whose bytes are media or filling; all other ISO boxes come whole.
_ISO_BULK = frozenset({"mdat", "free", "skip", "wide", "idat"}) | {i.decode() for i in boxes.ISO_LISTS}
#: RIFF chunks that come whole: formats, headers and indexes.
_RIFF_WHOLE = frozenset({"fmt ", "strf", "strh", "avih", "fact", "bext", "idx1"})


def _walked(family: str, data: memoryview, **state) -> list[tuple]:
    """Nodes of one object that is in memory."""
    walk = boxes.Walk(family, len(data), state)
    walk.more(data, 0)
    return walk.nodes


def _whole(family: str, ident: str) -> bool:
    return ident not in _ISO_BULK if family == "iso" else ident in _RIFF_WHOLE


def chunk_index(objects: DataFrame, family: str, key: str = "path", content: str = "content", head_bytes: int = 40, batch_rows: int = 1 << 15) -> DataFrame:
    """Nodes of size-prefixed containers, in file order: `riff` (padded, little endian), `iso` (32/64-bit, 0 = to the end), `ogg` pages, `gif` blocks.

    The walk inside one object is sequential, so each row is walked where it lies; nodes leave in bounded batches. `head`
    holds the bytes of a node: all of an ISO box without media, of RIFF formats, headers and indexes, and the header of an Ogg page; of others the first `head_bytes`. Objects
    that are no one value, and nodes whose whole bytes are wanted, go through `boxes`.
    """
    if family not in boxes.FAMILIES:
        raise ValueError(f"unknown family {family}")
    key_type = objects.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema(
                [batch.schema.field(0), ("seq", pa.int64()), ("parent", pa.int64()), ("id", pa.string()), ("data_off", pa.int64()),
                 ("data_len", pa.int64()), ("truncated", pa.bool_()), ("head", pa.binary())]
            )
            rows: list[tuple] = []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not blob.is_valid:
                    continue
                data = memoryview(blob.as_buffer()).cast("B")
                for seq, parent, ident, off, size, truncated, head in _walked(family, data):
                    if head is None:
                        head = bytes(data[off : off + (size if _whole(family, ident) else min(size, head_bytes))])
                    rows.append((name, seq, parent, ident, off, size, truncated, head))
                while len(rows) >= batch_rows:
                    head, rows[:] = rows[:batch_rows], rows[batch_rows:]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*head), schema)], schema=schema)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = f"{key} {key_type}, seq bigint, parent bigint, id string, data_off bigint, data_len bigint, truncated boolean, head binary"
    return objects.select(key, content).mapInArrow(run, out)


_CHUNK_LIST = "array<struct<seq:bigint,id:string,data_off:bigint,data_len:bigint,truncated:boolean,head:binary>>"


def chunk_list(content: Column, family: Column, head_bytes: int = 40) -> Column:
    """Top-level chunks of one object as an array, for objects with few of them (`wave`: below the RIFF node, `gif`: blocks).

    Unlike `chunk_index` this is a column of the row at hand, so a plan that also looks at the bytes reads them once.
    Objects without a family are passed on as NULL and cost nothing.
    """
    def walk(blobs: pa.Array, families: pa.Array) -> pa.Array:
        out = []
        for blob, name in zip(blobs, families.to_pylist()):
            if name is None or not blob.is_valid:
                out.append(None)
                continue
            data = memoryview(blob.as_buffer()).cast("B")
            rows = []
            found = _walked("gif", data) if name == "gif" else _walked("riff", data, pos=12, lists=False)
            for seq, (_, _, ident, off, size, truncated, _) in enumerate(found):
                rows.append({"seq": seq, "id": ident, "data_off": off, "data_len": size, "truncated": truncated, "head": bytes(data[off : off + min(size, head_bytes)])})
            out.append(rows)
        item = pa.struct([("seq", pa.int64()), ("id", pa.string()), ("data_off", pa.int64()), ("data_len", pa.int64()), ("truncated", pa.bool_()), ("head", pa.binary())])
        return pa.array(out, pa.list_(item))

    # annotations by value: the module's own are texts
    walk.__annotations__ = {"blobs": pa.Array, "families": pa.Array, "return": pa.Array}
    return F.arrow_udf(walk, _CHUNK_LIST)(F.when(family.isNotNull(), content), family)


def tail_policy(chunks: DataFrame, mode: str, length: str = "length", key: str = "path") -> DataFrame:
    """Truncated chunks: `clamp` shortens them to the bytes present, `ignore` drops them, `stop` also drops what follows one."""
    if mode == "clamp":
        return chunks.withColumn("data_len", F.greatest(_zero(), F.least("data_len", F.col(length) - F.col("data_off"))))
    if mode == "ignore":
        return chunks.where(~F.col("truncated"))
    if mode == "stop":
        stops = chunks.where("truncated").groupBy(F.col(key).alias("__k")).agg(F.min("seq").alias("__stop"))
        return chunks.join(stops, F.col(key).eqNullSafe(F.col("__k")), "left").where(F.col("__stop").isNull() | (F.col("seq") < F.col("__stop"))).drop("__k", "__stop")
    raise ValueError(f"unknown tail policy {mode}")


def route_chunks(chunks: DataFrame, suffix: str, id_col: str = "id") -> DataFrame:
    """Chunks of interleaved streams: two decimal digits and a kind suffix name the stream."""
    return chunks.where(F.col(id_col).rlike(f"^[0-9]{{2}}{suffix}$")).withColumn("stream_index", F.substring(id_col, 1, 2).cast("int"))


def cap_length(streams: DataFrame, observed: DataFrame, keys: Sequence[str] = ("path", "stream_index"), length: str = "length") -> DataFrame:
    """Declared lengths limited by the number of chunks seen (a stream with none seen keeps its declared length)."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("__seen"))
    return (
        streams.join(counts, list(keys), "left")
        .withColumn(length, F.when(F.col("__seen") > 0, F.least(F.col(length), F.col("__seen"))).otherwise(F.col(length)))
        .drop("__seen")
    )


# ---- transport streams ------------------------------------------------------------------------------------------

def transport_packets(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Header columns of 188-byte packets; `data` is the packet payload after the adaptation field."""
    p = F.col(payload)
    byte = lambda i: B.uint(p, i, 1)
    control = B.bits(byte(3), 4, 3)
    start = F.when(control.isin(2, 3), byte(4) + 5).otherwise(_zero() + 4)
    return records.select(
        "*",
        (byte(0) == 0x47).alias("synced"),
        B.uint(p, 1, 2).bitwiseAND(F.lit(0x1FFF)).alias("pid"),
        (byte(1).bitwiseAND(F.lit(0x40)) != 0).alias("unit_start"),
        F.when(control.isin(1, 3) & (start < 188), B.slice_bytes(p, start, F.lit(188) - start)).alias("data"),
    )


def pes_pts(data: Column) -> Column:
    """33-bit presentation time of a packet that starts with a PES header, NULL when it has none."""
    b = lambda i: B.uint(data, i, 1)
    pts = (
        F.shiftleft(B.bits(b(9), 1, 7), 30) + F.shiftleft(b(10), 22) + F.shiftleft(B.bits(b(11), 1, 127), 15)
        + F.shiftleft(b(12), 7) + B.bits(b(13), 1, 127)
    )
    return F.when(B.bytes_at(data, 0, b"\0\0\x01") & (b(7).bitwiseAND(F.lit(0x80)) != 0), pts)


def _section(data: Column) -> Column:
    """Table section of a packet that starts a unit: the bytes after the pointer field."""
    start = B.uint(data, 0, 1) + 1
    return F.when(start < B.size_of(data), B.slice_bytes(data, start, B.size_of(data) - start))


def _section_end(section: Column) -> Column:
    """End of the entries: the checksum is left out, and nothing is read past the packet."""
    return F.least(B.uint(section, 1, 2).bitwiseAND(F.lit(0xFFF)) - 1, B.size_of(section))


def pat_entries(packets: DataFrame) -> DataFrame:
    """pat(path, packet_no, program, pmt_pid) of `transport_packets` rows keyed by (path, packet_no)."""
    s = packets.where("synced and pid = 0 and unit_start and data is not null").select("path", "packet_no", _section(F.col("data")).alias("s"))
    s = s.where((B.size_of("s") >= 12) & (B.uint("s", 0, 1) == 0)).withColumn("n", rational.int_div(_section_end(F.col("s")) - 8, F.lit(4)))
    entry = lambda i: F.struct(B.uint("s", i * 4 + 8, 2).alias("program"), B.uint("s", i * 4 + 10, 2).bitwiseAND(F.lit(0x1FFF)).alias("pmt_pid"))
    rows = F.when(F.col("n") > 0, F.transform(F.sequence(_zero(), F.col("n") - 1), entry))
    return s.select("path", "packet_no", F.explode(rows).alias("e")).select("path", "packet_no", "e.*")


def _walk_lengths(start: Column, end: Column, limit: int, head: int, length, item, whole: bool) -> Column:
    """Array of variable-length items: `length(pos)` bytes follow each `head`; at most `limit` fit. With `whole`, an item past the end stops the walk."""
    state = F.struct(start.cast("long").alias("pos"), F.array(item(start.cast("long"), end)).alias("out"))
    empty = F.slice(state["out"], 1, 0)

    def step(acc: Column, _: Column) -> Column:
        def advance(n: Column) -> Column:
            nxt = acc["pos"] + head + n
            fits = (nxt <= end) if whole else F.lit(True)
            stop = F.struct((end + 1).cast("long").alias("pos"), acc["out"].alias("out"))
            return F.when(fits, F.struct(F.least(nxt, end).cast("long").alias("pos"), F.concat(acc["out"], F.array(item(acc["pos"], F.least(nxt, end)))).alias("out"))).otherwise(stop)

        return F.when(acc["pos"] + head <= end, B.let(length(acc["pos"]), advance)).otherwise(acc)

    begin = F.struct(start.cast("long").alias("pos"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), begin, step, lambda a: a["out"])


def pmt_entries(packets: DataFrame) -> DataFrame:
    """pmt(path, packet_no, pid, entry_no, es_pid, stream_type, registration, descriptors) of `transport_packets` rows. A section lies in one packet,
    so it holds at most 36 entries and an entry at most 91 descriptors."""
    s = packets.where("synced and pid <> 0 and unit_start and data is not null").select("path", "packet_no", "pid", _section(F.col("data")).alias("s"))
    s = s.where((B.size_of("s") >= 16) & (B.uint("s", 0, 1) == 2)).withColumn("end", _section_end(F.col("s")))
    u12 = lambda o: B.uint("s", o, 2).bitwiseAND(F.lit(0xFFF))
    entry = lambda pos, stop: F.struct(
        B.uint("s", pos, 1).alias("stream_type"), B.uint("s", pos + 1, 2).bitwiseAND(F.lit(0x1FFF)).alias("es_pid"), B.slice_bytes("s", pos + 5, stop - pos - 5).alias("d"))
    entries = _walk_lengths(u12(10) + 12, F.col("end"), 36, 5, lambda pos: u12(pos + 3), entry, whole=False)
    e = s.select("path", "packet_no", "pid", F.posexplode_outer(entries).alias("entry_no", "e")).where("e is not null").select("path", "packet_no", "pid", F.col("entry_no").cast("long").alias("entry_no"), "e.*")
    descriptor = lambda pos, stop: F.struct(B.uint("d", pos, 1).cast("int").alias("tag"), B.slice_bytes("d", pos + 2, stop - pos - 2).alias("data"))
    found = _walk_lengths(_zero(), B.size_of("d"), 91, 2, lambda pos: B.uint("d", pos + 1, 1), descriptor, whole=True)
    e = e.withColumn("__d", found)
    registration = F.get(F.filter("__d", lambda x: (x["tag"] == 5) & (F.octet_length(x["data"]) >= 4)), F.lit(0))["data"]
    return e.select("path", "packet_no", "pid", "entry_no", "es_pid", "stream_type", F.decode(F.substring(registration, 1, 4), "ISO-8859-1").alias("registration"),
                    F.transform("__d", lambda x: x["tag"]).alias("descriptors"))


def sync_errors(packets: DataFrame) -> DataFrame:
    """(path, packet_no): the first packet of each object that does not start with the sync byte."""
    return packets.where(~F.col("synced")).groupBy("path").agg(F.min("packet_no").alias("packet_no"))


def program_streams(pat: DataFrame, pmt: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Elementary streams of the first program map that has any.

    pat(path, packet_no, program, pmt_pid); pmt(path, packet_no, pid, entry_no, es_pid, codec): only maps on a pid announced in
    an earlier packet count, and with `errors` (see `sync_errors`) only those before an object's first packet out of sync. Repeated pids are merged: AC-3 wins, else the first known codec.
    """
    known = pat.where("program <> 0").groupBy("path", F.col("pmt_pid").alias("pid")).agg(F.min("packet_no").alias("__from"))
    live = pmt.join(known, ["path", "pid"]).where(F.col("packet_no") > F.col("__from")).drop("__from")
    if errors is not None:
        live = live.join(errors.select("path", F.col("packet_no").alias("__bad")), "path", "left").where(F.col("__bad").isNull() | (F.col("packet_no") < F.col("__bad"))).drop("__bad")
    first = live.groupBy("path").agg(F.min("packet_no").alias("packet_no"))
    return merge_codecs(live.join(first, ["path", "packet_no"], "left_semi"))


def sync_rejects(errors: DataFrame, streams: DataFrame) -> DataFrame:
    """Objects that lost sync before a program map with streams: (path, packet_no, error_kind)."""
    return errors.join(streams.select("path").distinct(), "path", "left_anti").select("path", "packet_no", F.lit("invalid_data").alias("error_kind"))


def merge_codecs(entries: DataFrame) -> DataFrame:
    codec = F.coalesce(
        F.max(F.when(F.col("codec") == "ac3", "ac3")),
        F.min_by("codec", F.when(F.col("codec").isNotNull(), F.col("entry_no"))),
    )
    return entries.groupBy("path", "es_pid").agg(F.min("entry_no").alias("entry_no"), codec.alias("codec"))


def ts_codec(entries: DataFrame, rules: Sequence[tuple] = R.TS_CODEC_RULES) -> DataFrame:
    """Codec by the first rule on (stream_type, registration, descriptor tags) that applies."""
    out = None
    for stream_type, registration, descriptor, codec in rules:
        tests = []
        if stream_type is not None:
            tests.append(F.col("stream_type") == stream_type)
        if registration is not None:
            tests.append(F.col("registration") == registration)
        if descriptor is not None:
            tests.append(F.array_contains("descriptors", descriptor))
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        out = F.when(test, codec) if out is None else out.when(test, codec)
    return entries.withColumn("codec", out)


def pes_payload(data: Column, unit_start: Column) -> Column:
    """Bytes of a packet that belong to the elementary stream."""
    head = B.uint(data, 8, 1) + 9
    rest = F.when(head <= B.size_of(data), B.slice_bytes(data, head, B.size_of(data) - head)).otherwise(F.lit(bytearray(b"")))
    return F.when(unit_start & (B.size_of(data) >= 9) & B.bytes_at(data, 0, b"\0\0\x01"), rest).otherwise(data)


def assemble(records: DataFrame, pids: DataFrame, keys: Sequence[str] = ("path", "pid"), ordinal: str = "packet_no", data: str = "data",
             part_rows: int = 4096) -> DataFrame:
    """Payload of the selected streams in packet order, as consecutive parts of at most `part_rows` packets each."""
    part = F.floor(F.col(ordinal) / part_rows).cast("long")
    return (
        records.join(pids, list(keys), "left_semi")
        .where(F.col(data).isNotNull())
        .groupBy(*keys, part.alias("part_no"))
        .agg(F.expr(f"unhex(listagg(hex({data}), '') WITHIN GROUP (ORDER BY {ordinal}))").alias("payload"), F.count("*").alias("n_packets"))
    )


def pts_span(packets: DataFrame, keys: Sequence[str] = ("path", "pid"), pts: str = "pts", with_last: bool = True, block: int = 1 << 22) -> DataFrame:
    """Seconds between the smallest and largest distinct 90 kHz time, plus the smallest gap for the last frame; below two, 0."""
    times = packets.where(F.col(pts).isNotNull()).select(*keys, F.col(pts).alias("__t")).distinct()
    steps = ordered.previous_value(times, keys, "__t", F.col("__t"), "__p", block)
    agg = steps.groupBy(*keys).agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"), F.min(F.col("__t") - F.col("__p")).alias("gap"), F.count("*").alias("n_times"))
    ticks = F.col("hi") - F.col("lo") + (F.col("gap") if with_last else _zero())
    return agg.select(*keys, "n_times", F.when(F.col("n_times") < 2, 0.0).otherwise(ticks / F.lit(90000.0)).alias("duration_seconds"))


def first_last_span(packets: DataFrame, keys: Sequence[str] = ("path", "pid"), pts: str = "pts", ordinal: str = "packet_no") -> DataFrame:
    """Seconds from the first seen to the last seen time."""
    agg = packets.where(F.col(pts).isNotNull()).groupBy(*keys).agg(F.min_by(pts, ordinal).alias("a"), F.max_by(pts, ordinal).alias("b"))
    return agg.select(*keys, (F.greatest(_zero(), F.col("b") - F.col("a")) / F.lit(90000.0)).alias("duration_seconds"))


# ---- tables from chunks -------------------------------------------------------------------------------------------

def iso_sample_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """stsc, stco, stsz and stts of `chunk_index(..., "iso")` as tables keyed by (path, track); tracks are numbered by their box. A table that declares more entries than
    its box holds is no table, but a row of `rejects`. Sizes are runs (sample_no, count, size): samples that all have one size are one row.

    Boxes come in depth-first order, so a table belongs to the last track box before it.
    """
    track = F.when(F.col("id") == "trak", F.col("seq"))
    named = checkpointed(chunks.where(F.col("id").isin("trak", "stsc", "stco", "co64", "stsz", "stts")).select("path", "seq", "id", "head"))  # the objects are walked once, here
    boxes = ordered.previous_value(named, ["path"], "seq", track, "track", skip_nulls=True).where(F.col("track").isNotNull())
    h = F.col("head")
    u = lambda o, n=4: B.uint(h, o, n)
    keys = ["path", "track"]
    tables = boxes.where("id <> 'trak'").select(*keys, "id", "head", u(4).alias("__a"), u(8).alias("__b"))
    whole = (F.col("id") == "stsz") & (F.col("__a") != 0)
    count = F.when(F.col("id") == "stsz", F.col("__b")).otherwise(F.col("__a"))
    width = F.when(F.col("id") == "stsc", 12).when(F.col("id").isin("stts", "co64"), 8).otherwise(4)
    first = F.when(F.col("id") == "stsz", 12).otherwise(8)
    fits = count.isNotNull() & (whole | (first + count * width <= B.size_of(h)))
    tables = tables.select("*", count.alias("__n"), width.alias("__w"), first.alias("__f"), F.coalesce(fits, F.lit(False)).alias("__ok"), F.coalesce(whole, F.lit(False)).alias("__whole"))

    def entries(ids: Sequence[str], entry) -> DataFrame:
        """Entries of tables whose box holds them all, in blocks, so that no array is as long as a table."""
        per = 1 << 14
        b = tables.where(F.col("id").isin(*ids) & F.col("__ok") & ~F.col("__whole") & (F.col("__n") > 0))
        starts = F.explode(F.sequence(_zero(), F.col("__n") - 1, F.lit(per).cast("long")))
        b = b.select(*keys, "id", "head", "__n", "__w", "__f", starts.alias("__at"))
        b = b.select(*keys, "id", "__at", F.least(F.lit(per), F.col("__n") - F.col("__at")).alias("__n"), "__w", B.slice_bytes("head", F.col("__f") + F.col("__at") * F.col("__w"), F.col("__w") * per).alias("__t"))
        rows = F.transform(F.sequence(_zero(), F.col("__n") - 1), lambda i: F.struct((F.col("__at") + i).alias("i"), *entry(lambda o, n=4: B.uint("__t", i * F.col("__w") + o, n))))
        return b.select(*keys, F.explode_outer(rows).alias("e")).where("e is not null").select(*keys, "e.*")

    offset = lambda at: F.when(F.col("id") == "co64", at(0, 8)).otherwise(at(0))
    own = entries(["stsz"], lambda at: [at(0).alias("size")]).select(*keys, F.col("i").alias("sample_no"), F.lit(1).cast("long").alias("count"), "size")
    same = tables.where("__whole and __n > 0").select(*keys, _zero().alias("sample_no"), F.col("__n").alias("count"), F.col("__a").alias("size"))
    return {
        "stsc": entries(["stsc"], lambda at: [at(0).alias("first_chunk"), at(4).alias("samples_per_chunk")]).drop("i"),
        "stco": entries(["stco", "co64"], lambda at: [offset(at).alias("offset")]).withColumn("chunk_no", F.col("i") + 1).drop("i"),
        "stsz": own.unionByName(same),
        "stts": entries(["stts"], lambda at: [at(0).alias("count"), at(4).alias("delta")]).withColumnRenamed("i", "run_no"),
        "rejects": tables.where(~F.col("__ok")).select(*keys, "id", F.lit("short table").alias("error"), F.col("__n").alias("declared")),
    }


def ogg_pages(chunks: DataFrame) -> DataFrame:
    """pages(path, page_no, serial, granule, truncated, data_off, lens) of `chunk_index(..., "ogg")`; granule -1 is unknown."""
    h = F.col("head")
    lens = F.transform(F.sequence(F.lit(27), F.octet_length(h) - 1), lambda i: B.uint(h, i, 1))
    return chunks.select(
        "path", F.col("seq").alias("page_no"), B.uint(h, 14, 4, "le").alias("serial"), F.coalesce(B.uint(h, 6, 8, "le"), F.lit(-1).cast("long")).alias("granule"), "truncated",
        "data_off", F.when(F.octet_length(h) > 27, lens).otherwise(F.array().cast("array<bigint>")).alias("lens"))


def ogg_segments(pages: DataFrame) -> DataFrame:
    """segments(path, serial, seg_no, len): lacing values in file order; a page has at most 255, so numbers never meet."""
    s = pages.select("path", "serial", "page_no", F.posexplode_outer("lens").alias("__i", "len")).where("len is not null")
    return s.select("path", "serial", (F.col("page_no") * 256 + F.col("__i")).alias("seg_no"), F.col("len").cast("int").alias("len"))


# ---- sample tables ----------------------------------------------------------------------------------------------

def resolve_samples(stsc: DataFrame, stco: DataFrame, stsz: DataFrame, keys: Sequence[str] = ("path", "track"), wanted: DataFrame | None = None) -> DataFrame:
    """(keys, chunk_no, sample_no, size, sample_offset) of every sample, or of those of wanted(keys, sample_no); tracks whose chunks do not cover all samples are left out (see `unmapped_tracks`).

    stsz(keys, sample_no, size) has a row for each sample, or with `count` for each run of samples of one size. A rank directory answers where a sample lies: for each block of
    sample numbers, the bytes of all samples before it and the chunk that goes on into it. Offset = the chunk's offset + running size at the sample - running size at the chunk's first sample,
    so samples are neither expanded from chunks nor matched with them, and runs only where their samples are asked for.
    """
    keys, block = list(keys), ordered.BLOCK
    chunks = checkpointed(chunk_samples(stsc, stco, keys))
    covered = _coverage(chunks, stsz, keys).where("__room >= __need").select(*keys)
    count = F.col("count") if "count" in stsz.columns else F.lit(1)
    runs = stsz.select(*keys, F.col("sample_no").cast("long").alias("at"), count.cast("long").alias("n"), F.col("size").cast("long").alias("size")).where("n > 0")
    if "count" in stsz.columns:  # runs end with their block
        edges = F.explode(F.sequence(rational.int_div(F.col("at"), F.lit(block)), rational.int_div(F.col("at") + F.col("n") - 1, F.lit(block))))
        runs = runs.select("*", edges.alias("__e"))
        low, high = F.greatest("at", F.col("__e") * block), F.least(F.col("at") + F.col("n"), (F.col("__e") + 1) * block)
        runs = runs.select(*keys, low.alias("at"), (high - low).alias("n"), "size")
    none, listed = F.lit(None).cast("long"), wanted is not None
    rows = runs.select(*keys, "at", F.lit(0).alias("kind"), F.col("n").alias("v1"), F.col("size").alias("v2"))
    rows = rows.unionByName(chunks.where("samples_per_chunk > 0").select(*keys, F.col("first_sample").alias("at"), F.lit(1).alias("kind"), F.col("offset").alias("v1"), F.col("chunk_no").alias("v2")))
    if listed:
        rows = rows.unionByName(wanted.select(*keys, F.col("sample_no").cast("long").alias("at"), F.lit(2).alias("kind"), none.alias("v1"), none.alias("v2")))
    rows = rows.join(covered, keys, "left_semi")

    def parts(g: dict) -> tuple:
        """Runs and chunks of many blocks: places are numbers that ascend over all blocks, so that one search answers all."""
        order = np.lexsort((g["kind"], g["at"], g[GROUP]))
        at, kind, v1, v2, group = (g[c][order] for c in ("at", "kind", "v1", "v2", GROUP))
        run, chunk, blocks = kind == 0, kind == 1, int(group[-1]) + 1
        first, n, size = at[run], v1[run].astype(np.int64), v2[run].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n * size)])
        place = lambda x, of: of * block + x % block
        places, lows = place(first, group[run]), np.searchsorted(group[run], np.arange(blocks + 1))

        def before(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            i = np.searchsorted(places, place(x, of), side="right") - 1
            has, i = i >= lows[of], np.maximum(i, 0)
            return np.where(has, total[i] - total[lows[of]] + np.minimum(x - first[i], n[i]) * size[i], 0) if len(first) else np.zeros(len(x), np.int64)

        starts, offsets, numbers = at[chunk], v1[chunk].astype(np.int64), v2[chunk].astype(np.int64)
        return at, kind, group, first, n, size, total, lows, place, before, starts, offsets - before(starts, group[chunk]), numbers

    def facts(g: dict) -> dict:
        _, kind, group, *_, total, lows, _, _, _, bases, numbers = parts(g)
        ends = np.searchsorted(group[kind == 1], np.arange(len(lows)))
        some, last = np.diff(ends) > 0, ends[1:] - 1
        base, number = np.full(len(some), None, object), np.full(len(some), None, object)
        base[some], number[some] = bases[last[some]], numbers[last[some]]
        return {"total": total[lows[1:]] - total[lows[:-1]], "base": base, "number": number}

    def link(blocks: DataFrame) -> DataFrame:
        earlier = W.partitionBy(*keys).orderBy(ordered.BLOCK_COLUMN).rowsBetween(W.unboundedPreceding, -1)
        blocks = blocks.withColumn("size_in", F.coalesce(F.sum("total").over(earlier), _zero()))
        carried = F.last(F.when(F.col("number").isNotNull(), F.struct((F.col("base") - F.col("size_in")).alias("base"), "number")), ignorenulls=True).over(earlier)
        return blocks.withColumn("chunk_in", carried).select(*keys, ordered.BLOCK_COLUMN, "size_in", F.col("chunk_in.base").alias("base_in"), F.col("chunk_in.number").alias("number_in"))

    def finish(g: dict, entry: dict) -> dict | None:
        at, kind, group, first, n, size, total, lows, place, before, starts, bases, numbers = parts(g)
        run, chunk = group[kind == 0], group[kind == 1]
        if listed:
            ask, of = at[kind == 2], group[kind == 2]
            own = np.searchsorted(place(first, run), place(ask, of), side="right") - 1
            there = (own >= lows[of]) & (ask < (first + n)[np.maximum(own, 0)]) if len(first) else np.zeros(len(ask), bool)
            ask, of, own = ask[there], of[there], own[there]
        else:
            own = np.repeat(np.arange(len(first)), n)
            ask, of = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), run[own]
        if not len(ask):
            return None
        whole = lambda c: np.array([0 if v is None or v != v else int(v) for v in entry[c].tolist()], np.int64)
        size_in, base_in, number_in = whole("size_in"), whole("base_in"), whole("number_in")
        which = np.searchsorted(place(starts, chunk), place(ask, of), side="right") - 1
        inside = which >= np.searchsorted(chunk, np.arange(len(lows)))[of]
        pick = lambda own_one, came: np.where(inside, own_one[np.maximum(which, 0)], came[of]) if len(starts) else came[of]
        return {"chunk_no": pick(numbers, number_in), "sample_no": ask, "size": size[own], "sample_offset": pick(bases - size_in[chunk], base_in) + size_in[of] + before(ask, of), GROUP: of}

    return ordered.two_pass(rows, keys, "at", facts, "total bigint, base bigint, number bigint", link, finish, "chunk_no bigint, sample_no bigint, size bigint, sample_offset bigint", block)


def _coverage(placed: DataFrame, stsz: DataFrame, keys: list[str]) -> DataFrame:
    room = placed.groupBy(*keys).agg(F.sum("samples_per_chunk").alias("__room"))
    need = stsz.groupBy(*keys).agg((F.sum("count") if "count" in stsz.columns else F.count("*")).alias("__need"))
    return need.join(room, keys, "left").withColumn("__room", F.coalesce("__room", _zero()))


def chunk_samples(stsc: DataFrame, stco: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks (keys, chunk_no, offset) with their samples_per_chunk, of the last run that begins at or before them (of the first run if none does), and first_sample, the 0-based number
    of their first sample. Objects without runs have no chunks here."""
    keys = list(keys)
    rows = stco.select(*keys, F.col("chunk_no").alias("at"), F.lit(1).alias("kind"), F.col("offset").cast("long").alias("v"))
    rows = rows.unionByName(stsc.select(*keys, F.col("first_chunk").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("samples_per_chunk").cast("long").alias("v")))

    def parts(g: dict) -> tuple:
        """Chunks and runs of many blocks: how many runs a chunk has before it, over all blocks, and whether one of them is of its own block."""
        order = np.lexsort((g["kind"], g["at"], g[GROUP]))
        at, run, v, group = g["at"][order], g["kind"][order] == 0, g["v"][order].astype(np.int64), g[GROUP][order]
        which = np.cumsum(run)[~run]
        low = np.searchsorted(group[run], np.arange(int(group[-1]) + 2))
        return at[~run], v[~run], group[~run], v[run], which, which > low[group[~run]], low

    def facts(g: dict) -> dict:
        _, _, group, counts, which, own, low = parts(g)
        some, rest = np.diff(low) > 0, np.zeros(len(low) - 1, np.int64)
        np.add.at(rest, group[own], counts[which[own] - 1])
        first, last = np.full(len(some), None, object), np.full(len(some), None, object)
        first[some], last[some] = counts[low[:-1][some]], counts[low[1:][some] - 1]
        return {"lead": np.bincount(group[~own], minlength=len(some)), "rest": rest, "first_run": first, "last_run": last}

    def link(blocks: DataFrame) -> DataFrame:
        over = W.partitionBy(*keys).orderBy(ordered.BLOCK_COLUMN)
        earlier = over.rowsBetween(W.unboundedPreceding, -1)
        lead = F.first("first_run", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        blocks = blocks.withColumn("run_in", F.coalesce(F.last("last_run", ignorenulls=True).over(earlier), lead)).where("run_in is not null")
        return blocks.select(*keys, ordered.BLOCK_COLUMN, "run_in", F.coalesce(F.sum(F.col("lead") * F.col("run_in") + F.col("rest")).over(earlier), _zero()).alias("first_in"))

    def finish(g: dict, entry: dict) -> dict | None:
        at, offsets, group, counts, which, own, _ = parts(g)
        if not len(at):
            return None
        per = entry["run_in"].astype(np.int64)[group]
        per[own] = counts[which[own] - 1]
        passed = np.cumsum(per) - per
        first = passed - passed[np.searchsorted(group, group)]  # from the first chunk of the block
        return {"chunk_no": at, "offset": offsets, "samples_per_chunk": per, "first_sample": entry["first_in"].astype(np.int64)[group] + first, GROUP: group}

    return ordered.two_pass(rows, keys, "at", facts, "lead bigint, rest bigint, first_run bigint, last_run bigint", link, finish, "chunk_no bigint, offset bigint, samples_per_chunk bigint, first_sample bigint", block=1 << 20)  # chunk numbers can be sparse


def unmapped_tracks(stsc: DataFrame, stco: DataFrame, stsz: DataFrame, keys: Sequence[str] = ("path", "track")) -> DataFrame:
    keys = list(keys)
    return _coverage(chunk_samples(stsc, stco, keys), stsz, keys).where("__room < __need").select(*keys)


def sample_budget(table_samples: Column, duration: Column, rate: Column, timescale: Column) -> Column:
    """min(samples in the tables, duration * rate div timescale); exact, unknown timing leaves the table count."""
    wide = lambda c: c.cast("decimal(20,0)")
    by_time = F.floor(F.try_divide(wide(duration) * wide(rate), wide(timescale))).cast("decimal(38,0)")
    return F.when((timescale > 0) & (duration > 0), F.least(table_samples.cast("decimal(38,0)"), by_time)).otherwise(table_samples).cast("long")


def cap_chunks(chunks: DataFrame, keys: Sequence[str] = ("path",), n: str = "n", budget: str = "budget", align: str = "block_align",
               length: str = "length") -> DataFrame:
    """Chunks up to a sample budget: the last is trimmed, and reading stops at the first chunk past the end of the object.

    An object whose very first chunk is past the end keeps nothing (it belongs to the rejects).
    """
    keys = list(keys)
    taken = ordered.running_sum(checkpointed(chunks), keys, "chunk_no", {"pts": n})
    taken = checkpointed(taken.withColumn("take", F.greatest(_zero(), F.least(F.col(n), F.col(budget) - F.col("pts")))).where("take > 0"))
    past = F.col("offset") + F.col("take") * F.col(align) > F.col(length)
    stops = taken.where(past).groupBy(*keys).agg(F.min("chunk_no").alias("__stop"))
    return taken.join(stops, keys, "left").where(F.col("__stop").isNull() | (F.col("chunk_no") < F.col("__stop"))).drop("__stop")


def timing(stts: DataFrame, timescale: str = "timescale", keys: Sequence[str] = ("path", "track")) -> DataFrame:
    """Frames, ticks and the frame rate in lowest terms from (count, delta) runs."""
    g = stts.groupBy(*keys).agg(
        F.sum("count").alias("frames"), F.sum(F.col("count") * F.col("delta")).alias("ticks"), F.max(timescale).alias("timescale")
    )
    rate = rational.reduce_fraction(F.col("frames") * F.col("timescale"), F.col("ticks"))
    return g.where("frames > 0 AND ticks > 0").withColumn("__r", rate).select(
        *keys, "frames", "ticks", F.col("__r.num").alias("rate_num"), F.col("__r.den").alias("rate_den"))


def frame_times(stts: DataFrame, keys: Sequence[str] = ("path", "track")) -> DataFrame:
    """One row per frame with its decode time: run bases come from blocked running sums, frames inside a run are arithmetic."""
    runs = ordered.running_sum(stts, keys, "run_no", {"__frame": "count", "__tick": F.col("count") * F.col("delta")})
    out = generate.expand(runs, F.col("count"), "__i", [*keys, "run_no"])
    return out.select(
        *keys, (F.col("__frame") + F.col("__i")).alias("frame_no"), (F.col("__tick") + F.col("__i") * F.col("delta")).alias("dts"), F.col("delta").alias("duration"))


def fragment_duration(traf: DataFrame, trun: DataFrame, movie: DataFrame) -> DataFrame:
    """Longest fragment end per object, in seconds.

    traf(path, traf_no, base_time, default_duration); trun(path, traf_no, duration or NULL per sample); movie(path, timescale,
    default_duration). A sample takes its own duration, else the fragment's default, else the movie's.
    """
    t = traf.join(movie.select("path", "timescale", F.col("default_duration").alias("__movie")), "path")
    own = trun.groupBy("path", "traf_no").agg(F.sum("duration").alias("__own"), F.count("*").alias("__n"), F.count("duration").alias("__with"))
    t = t.join(own, ["path", "traf_no"], "left")
    default = F.coalesce("default_duration", "__movie", _zero())
    end = F.coalesce("base_time", _zero()) + F.coalesce("__own", _zero()) + (F.coalesce("__n", _zero()) - F.coalesce("__with", _zero())) * default
    out = t.groupBy("path").agg(F.max(end).alias("end_ticks"), F.max("timescale").alias("timescale"))
    return out.where("end_ticks <> 0 AND timescale <> 0").select("path", (F.col("end_ticks") / F.col("timescale")).alias("fragment_seconds"))


def fill_durations(streams: DataFrame, fragments: DataFrame, movies: DataFrame) -> DataFrame:
    """Missing or zero durations: the fragment's, then the longest sibling's; all are capped at the movie's."""
    d = F.coalesce("duration_seconds", F.lit(0.0))
    s = streams.join(fragments, "path", "left").withColumn("__d", F.when(d == 0, F.col("fragment_seconds")).otherwise(F.col("duration_seconds")))
    longest = s.groupBy("path").agg(F.max("__d").alias("__max"))
    s = s.join(longest, "path", "left").join(movies, "path", "left")
    filled = F.when((F.coalesce("__d", F.lit(0.0)) == 0) & (F.col("__max") > 0), F.col("__max")).otherwise(
        F.coalesce("__d", "duration_seconds"))
    capped = F.when(filled > F.col("movie_seconds"), F.col("movie_seconds")).otherwise(filled)
    return s.withColumn("duration_seconds", capped).drop("fragment_seconds", "movie_seconds", "__d", "__max")


def associate(items: DataFrame, props: DataFrame) -> DataFrame:
    """Items with a codec and a size. items(path, item_id, props ARRAY of 1-based property numbers); props(path, prop_no, codec, width, height)."""
    pairs = items.select("path", "item_id", F.posexplode("props").alias("__at", "__p")).where("__p > 0")
    p = props.select("path", F.col("prop_no").alias("__p"), "codec", "width", "height")
    joined = pairs.join(p, ["path", "__p"])
    last = lambda c, when: F.max_by(c, F.when(when, F.col("__at")))
    sized = F.col("width").isNotNull()
    out = joined.groupBy("path", "item_id").agg(
        last(F.col("codec"), F.col("codec").isNotNull()).alias("codec"),
        last(F.col("width"), sized).alias("width"), last(F.col("height"), sized).alias("height"),
    )
    return out.where("codec is not null and width is not null")


# ---- pages and packets ------------------------------------------------------------------------------------------

def last_granule(pages: DataFrame, sentinel: int = -1) -> DataFrame:
    """Last known position per logical stream on complete pages, streams numbered by first appearance; a truncated page ends the object."""
    ends = pages.where("truncated").groupBy("path").agg(F.min("page_no").alias("__end"))
    p = pages.join(ends, "path", "left").where(F.col("__end").isNull() | (F.col("page_no") <= F.col("__end")))
    known = ~F.col("truncated") & (F.col("granule") != sentinel)
    agg = p.groupBy("path", "serial").agg(
        F.max_by("granule", F.when(known, F.col("page_no"))).alias("last_granule"), F.min("page_no").alias("first_page"), F.count("*").alias("n_pages"))
    return ordered.row_index(agg, ["path"], "first_page", "stream_index")


def granule_frames(granule: Column, shift: Column) -> Column:
    """Frame count of a split position: key-frame part plus the offset part."""
    high = F.call_function("shiftright", granule, shift)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
    return F.when(shift == 0, granule).otherwise(high + granule.bitwiseAND(mask))


def packets_from_segments(segments: DataFrame, keys: Sequence[str] = ("path",), ordinal: str = "seg_no", length: str = "len") -> DataFrame:
    """Number the packet of each lacing segment: one below 255 closes its packet. Objects that end inside a packet are rejected."""
    keys = list(keys)
    closes = (F.col(length) < 255).cast("long")
    numbered = ordered.running_sum(segments, keys, ordinal, {"packet_no": closes})
    return numbered.join(open_packets(segments, keys, ordinal, length), keys, "left_anti")


def open_packets(segments: DataFrame, keys: Sequence[str], ordinal: str, length: str) -> DataFrame:
    last = segments.groupBy(*keys).agg(F.max_by(length, ordinal).alias("__last"))
    return last.where("__last = 255").select(*keys)


def packet_sizes(numbered: DataFrame, keys: Sequence[str] = ("path",), ordinal: str = "seg_no", length: str = "len") -> DataFrame:
    return numbered.groupBy(*keys, "packet_no").agg(F.sum(length).cast("long").alias("size"), F.count("*").alias("n_segments"), F.min(ordinal).alias("first_seg"))


def attach_tag_duration(streams: DataFrame, tags: DataFrame, segments: DataFrame) -> DataFrame:
    """Durations of h264/hevc tracks without one: the track's tag, else the segment's for a lone, untagged track that starts late.

    tags(path, track_uid, name, value, has_language, tag_no); segments(path, segment_seconds, first_cluster_time).
    """
    parts = F.split("value", ":")
    num = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    seconds = F.when(F.size(parts) == 3, num(0) * 3600 + num(1) * 60 + num(2))
    usable = tags.where("name = 'DURATION' and not has_language").withColumn("__s", seconds).where("__s is not null")
    by_track = usable.groupBy("path", "track_uid").agg(F.max_by("__s", "tag_no").alias("tag_seconds"))
    tagged = tags.groupBy("path").agg(F.lit(True).alias("__tagged"))
    counts = streams.groupBy("path").agg(F.count("*").alias("__n"))
    s = streams.join(by_track, ["path", "track_uid"], "left").join(counts, "path").join(tagged, "path", "left").join(segments, "path", "left")
    takes = F.col("codec_name").isin("h264", "hevc") & F.col("duration_seconds").isNull()
    lone = F.col("__tagged").isNull() & (F.col("__n") == 1) & (F.col("first_cluster_time") != 0)
    out = F.when(takes, F.coalesce(F.col("tag_seconds"), F.when(lone, F.col("segment_seconds")))).otherwise(F.col("duration_seconds"))
    return s.withColumn("duration_seconds", out).drop("tag_seconds", "__n", "__tagged", "segment_seconds", "first_cluster_time")


def accept_empty(objects: DataFrame, tracks: DataFrame, ignored: Sequence[str] = ("sbtl", "subt", "text"), supported: str = "supported") -> DataFrame:
    """Objects kept: with a supported stream, or with tracks that are all of an ignored kind (then without streams)."""
    facts = tracks.groupBy("path").agg(
        F.bool_and(F.col("kind").isin(*ignored)).alias("__ignored"), F.count_if(F.col(supported)).alias("n_streams"))
    out = objects.join(facts, "path", "left").withColumn("n_streams", F.coalesce("n_streams", _zero()))
    return out.where((F.col("n_streams") > 0) | F.coalesce("__ignored", F.lit(False))).drop("__ignored")


# ---- frame chains -----------------------------------------------------------------------------------------------

def _frames(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, targets and marks (candidates without a length) of a block."""
    length = g["frame_len"].astype(float)
    marks = np.isnan(length)
    return g["off"], g["off"] + np.where(marks, 0, length).astype(np.int64), marks


def _local_chain(offs: np.ndarray, targets: np.ndarray, marks: np.ndarray, resync: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate of a block: frames up to the last that is reached inside it, which that is, and whether the chain ends there for good (pointer doubling)."""
    nxt = np.searchsorted(offs, targets)
    at = np.minimum(nxt, len(offs) - 1)
    found = (nxt < len(offs)) & (resync | (offs[at] == targets)) & ~marks
    over = marks | (found & marks[at]) | (~found & (nxt < len(offs)))
    at = np.where(found & ~marks[at], at, np.arange(len(offs)))
    steps = (at != np.arange(len(offs))).astype(np.int64)
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return steps + 1, at, over[at]
        steps, at = steps + steps[at], further


def frame_chain(candidates: DataFrame, keys: Sequence[str] = ("path",), resync: bool = True, block: int = 1 << 20) -> DataFrame:
    """Frames met when following off -> off + frame_len from the first candidate header of each object: count, first and last offset.

    With `resync` the next candidate at or after the target is taken, without it the chain stops at a missing header. A NULL frame_len is a mark that ends the chain
    without being a frame; a frame_len below 1 is no candidate.

    Offsets are cut into blocks. A join with the last offsets of the blocks finds the targets that leave one; each is sent to the block where it lands, and a second pass answers what follows from there
    inside that block: frames, last offset, next target. These links between blocks are then ranked by pointer jumping: each round is a join of the written links with themselves that
    doubles their reach, so a chain over n blocks takes log2(n) rounds. Frames may have any length, and no task sees more than a block of an object.
    """
    keys = list(keys)
    rows = candidates.where("frame_len is null or frame_len > 0").select(
        *keys, F.col("off").cast("long").alias("off"), F.col("frame_len").cast("long").alias("frame_len"), F.floor(F.col("off") / block).cast("long").alias("__b"))
    rows = checkpointed(rows)

    spans = checkpointed(rows.groupBy(*keys, "__b").agg(F.min("off").alias("first_off"), F.max("off").alias("end_off")))
    ahead = F.col("off") + F.col("frame_len")
    leave = rows.where("frame_len is not null").join(spans, [*keys, "__b"]).where(ahead > F.col("end_off")).select(*keys, ahead.alias("target")).distinct()
    starts = spans.groupBy(*keys).agg(F.min("first_off").alias("target"))
    asked = checkpointed(leave.unionByName(starts).distinct())
    # a target lands in its own block, or at the first candidate of the next block that has any
    both = spans.select(*keys, "__b", "first_off", "end_off", F.lit(None).cast("long").alias("target")).unionByName(
        asked.select(*keys, F.floor(F.col("target") / block).cast("long").alias("__b"), F.lit(None).cast("long").alias("first_off"), F.lit(None).cast("long").alias("end_off"), "target"))
    by_block = both.groupBy(*keys, "__b").agg(F.min("first_off").alias("first_off"), F.max("end_off").alias("end_off"))
    ahead = W.partitionBy(*keys).orderBy("__b").rowsBetween(1, W.unboundedFollowing)
    by_block = by_block.withColumn("next_off", F.first("first_off", ignorenulls=True).over(ahead))
    routed = asked.withColumn("__b", F.floor(F.col("target") / block).cast("long")).join(by_block, [*keys, "__b"])
    lands = F.when(F.col("end_off") >= F.col("target"), F.col("target")).otherwise(F.col("next_off"))
    routed = routed.select(*keys, "target", lands.alias("off")).where(F.col("off").isNotNull() if resync else F.col("off") == F.col("target"))
    together = rows.select(*keys, "__b", "off", "frame_len", F.lit(None).cast("long").alias("target")).unionByName(
        routed.select(*keys, F.floor(F.col("off") / block).cast("long").alias("__b"), "off", F.lit(None).cast("long").alias("frame_len"), "target"))

    def landing(g: dict) -> dict | None:
        ask = ~np.isnan(g["target"].astype(float))
        if not ask.any() or ask.all():
            return None
        offs, targets, marks = _frames({c: g[c][~ask] for c in ("off", "frame_len")})
        n, last, over = _local_chain(offs, targets, marks, resync)
        at = np.searchsorted(offs, g["off"][ask])
        found = at < len(offs)
        if not resync:
            found &= offs[np.minimum(at, len(offs) - 1)] == g["off"][ask]
        at = at[found]
        following = targets[last[at]].astype(object)
        following[over[at]] = None
        return {"target": g["target"][ask][found].astype(np.int64), "first_off": offs[at], "n": np.where(marks[at], 0, n[at]), "last_off": offs[last[at]], "next": following}

    links = checkpointed(grouped.map_groups(together, [*keys, "__b"], "off", landing, "target bigint, first_off bigint, n bigint, last_off bigint, next bigint", keep=keys))
    while links.where("next is not null").limit(1).count():
        ahead = links.select(*keys, F.col("target").alias("next"), F.col("n").alias("__n"), F.col("last_off").alias("__last"), F.col("next").alias("__next"))
        more = links.where("next is not null").join(ahead, [*keys, "next"], "left")
        goes = F.coalesce(F.col("__n") > 0, F.lit(False))
        stepped = more.select(*keys, "target", "first_off", F.when(goes, F.col("n") + F.col("__n")).otherwise(F.col("n")).alias("n"),
                              F.when(goes, F.col("__last")).otherwise(F.col("last_off")).alias("last_off"), F.col("__next").alias("next"))
        links = checkpointed(links.where("next is null").unionByName(stepped))
    return links.join(starts, [*keys, "target"], "left_semi").where("n > 0").select(*keys, F.col("n").alias("n_frames"), "first_off", "last_off")


def inject_params(units: DataFrame, params: DataFrame, keys: Sequence[str] = ("path", "packet_no")) -> DataFrame:
    """Start-coded units of each packet, with the parameter sets put before its first key-frame unit unless the packet has already shown both.

    units(path, packet_no, unit_no, unit); params(path, param_no, unit): sequence sets first. The decision needs only the
    first positions of the three unit types, so it is an aggregate, not an ordered scan.
    """
    keys = list(keys)
    u = units.where(F.octet_length("unit") > 0).withColumn("unit_type", B.uint("unit", 0, 1).bitwiseAND(F.lit(31)))
    at = lambda t: F.min(F.when(F.col("unit_type") == t, F.col("unit_no")))
    facts = u.groupBy(*keys).agg(at(5).alias("idr"), at(7).alias("sps"), at(8).alias("pps"))
    seen = F.coalesce((F.col("sps") < F.col("idr")) & (F.col("pps") < F.col("idr")), F.lit(False))
    need = facts.where(F.col("idr").isNotNull() & ~seen).select(*keys, F.col("idr").alias("unit_no"))
    sets = need.join(params, "path").select(*keys, "unit_no", F.col("param_no").cast("long").alias("sub"), "unit")
    own = u.select(*keys, "unit_no", F.lit(1 << 30).cast("long").alias("sub"), "unit")
    start_code = F.lit(bytearray(b"\0\0\x01"))
    return own.unionByName(sets).withColumn("unit", F.concat(start_code, F.col("unit")))
