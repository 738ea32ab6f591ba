"""Literal facts per operator on tiny tables."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.functions import binary as B
from cinelake.operators import audio as A, conformance as Q, containers as C, frames as V, identify as I
from cinelake.sources import synth, wav


def one(spark, **cols):
    return [r[0] for r in spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()][0] if len(cols) == 1 else spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0]


def test_frame_len(spark):
    df = spark.createDataFrame([(8000,), (22050,), (44100,), (48000,), (9,), (10,)], "r long")
    assert [r[0] for r in df.select(A.frame_len(F.col("r"))).collect()] == [512, 2048, 4096, 4096, None, 1]


def test_silent_frames(spark):
    s = spark.range(1100).select(F.lit("a").alias("path"), F.col("id").alias("n"), F.lit(0).alias("ch"), F.lit(0).alias("v"))
    header = spark.createDataFrame([("a", 8000, 1)], "path string, sample_rate long, channels int")
    rows = sorted(A.frame_hashes(s, header).collect(), key=lambda r: r.frame_no)
    assert [r.duration for r in rows] == [512, 512, 76]
    assert rows[0].size == 1024 and rows[0].hash == "0f343b0931126a20f133d67c2b018a3b"


def test_frames_from_payload(spark):
    chunk = spark.createDataFrame([("a", 0, 1, 8000, bytearray(2200))], "path string, chunk_no long, channels int, sample_rate long, payload binary")
    rows = sorted(A.frame_hashes_by_chunk(chunk, A.frame_len(F.col("sample_rate"))).collect(), key=lambda r: r.pts)
    assert [r.duration for r in rows] == [512, 512, 76] and rows[0].hash == "0f343b0931126a20f133d67c2b018a3b" and all(r.silent for r in rows)


@pytest.mark.parametrize("fmt,payload,want", [
    ("u8", "0080FF", [-32768, 0, 32512]),
    ("s24le", "000000008000000080FFFF7F", [0, 128, -32768, 32767]),
    ("s32le", "000000000000010000000080FFFFFF7F", [0, 1, -32768, 32767]),
    ("s16be", "0102FFFE", [258, -2]),
    ("f32le", struct.pack("<4f", 0.5, -2.0, 1.0, 1.5 / 32768).hex(), [16384, -32768, 32767, 2]),
])
def test_to_s16(spark, fmt, payload, want):
    df = spark.createDataFrame([("a", 10, bytearray(bytes.fromhex(payload)))], "path string, base long, payload binary")
    rows = sorted(A.decode_pcm(df, fmt).collect(), key=lambda r: r.n)
    assert [r.v for r in rows] == want and rows[0].n == 10


def test_volume(spark):
    df = spark.createDataFrame([(407,), (541,), (-407,), (-541,), (32767,)], "v int")
    assert [r.v for r in A.volume(df, 0.5).collect()] == [204, 270, -204, -270, 16384]
    assert [r.v for r in A.volume(df, 100.0).collect()] == [32767, 32767, -32768, -32768, 32767]


def test_decimal_samples(spark):
    df = spark.createDataFrame([("0.1", 44100), (".25", 48000), ("2.", 8000), ("-1", 8000), (".", 8000), ("", 8000), ("0." + "9" * 28, 8000), ("1." + "3" * 500, 3), ("0." + "0" * 40 + "1", 8000), ("9" * 17 + ".5", 48000), ("000000000000000000000000000000000001.5", 2)], "t string, r long")
    assert [r[0] for r in df.select(A.decimal_samples(F.col("t"), F.col("r"))).collect()] == [4410, 12000, 16000, None, None, None, 7999, 3, 0, None, 3]


def test_edge_index(spark):
    df = spark.createDataFrame([(-2,), (-1,), (0,), (5,), (6,)], "i long")
    assert [r[0] for r in df.select(A.edge_index(F.col("i"), F.lit(5))).collect()] == [2, 1, 0, 4, 3]


def test_taps(spark):
    assert A.tap_count(44100, 16000) == 93
    got = A.taps(spark.createDataFrame([(44100, 16000)], "source long, target long")).collect()
    assert len({r.phase for r in got}) == 160 and {r.n_taps for r in got} == {93}
    phases = np.arange(160) * 100 / 16000
    coefs, total = A._coefficients(phases, 44100, 16000)
    for r in got:
        assert abs(r.weight - coefs[r.tap, r.phase] / total[r.phase]) < 1e-12


def plain_resample(v, source, target):
    """Direct loop over outputs and taps."""
    import math

    n, taps = len(v), A.tap_count(source, target)
    cutoff, radius = min(target / source, 1.0) * 0.97, (taps - 1) / 2
    i0 = lambda x: sum((x * x / 4) ** k / math.factorial(k) ** 2 for k in range(33))
    out = []
    for o in range((n * target + source // 2) // source):
        center = o * source / target
        base = math.floor(center)
        acc, cs = [], 0.0
        for t in range(taps):
            p = t - radius - (center - base)
            w = p / radius
            if abs(w) > 1:
                continue
            i = base + t - taps // 2
            if n <= 1:
                i = 0
            elif i >= n:
                i = min(max(2 * n - 1 - i, 0), n - 1)
            else:
                m = i % (2 * n - 2)
                i = 2 * n - 2 - m if m >= n else m
            x = cutoff * p
            c = cutoff * (1.0 if abs(x) < 2.3e-16 else math.sin(math.pi * x) / (math.pi * x)) * i0(9 * math.sqrt(max(1 - w * w, 0))) / i0(9)
            cs += c
            acc.append((i, c))
        out.append(int(np.clip(np.rint(sum(v[i] * c / cs for i, c in acc)), -32768, 32767)))
    return out


@pytest.mark.parametrize("source,target,n", [(4, 2, 4), (44100, 16000, 700), (8000, 11025, 500), (3, 7, 1)])
def test_resample_blocks(spark, source, target, n):
    rng = np.random.default_rng(1)
    v = rng.integers(-32768, 32767, n)
    df = spark.createDataFrame([("a", i, 0, int(x)) for i, x in enumerate(v)], "path string, n long, ch int, v int").repartition(4)
    want = plain_resample([int(x) for x in v], source, target)
    for block in (1, 1 << 15):
        got = [r.v for r in A.resample(df, source, target, block=block).orderBy("n").collect()]
        assert got == want


def test_channel_layout(spark):
    df = spark.createDataFrame([(1,), (2,), (6,)], "c int")
    assert [r[0] for r in df.select(A.channel_layout(F.col("c"))).collect()] == ["mono", "stereo", None]


def test_route_chunks(spark):
    df = spark.createDataFrame([("01wb",), ("12wb",), ("01dc",), ("A1wb",)], "id string")
    assert [(r.id, r.stream_index) for r in C.route_chunks(df, "wb").collect()] == [("01wb", 1), ("12wb", 12)]


def test_last_granule(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, False), ("a", 1, 1, 220500, False), ("a", 1, 2, 230000, True)], "path string, serial long, page_no long, granule long, truncated boolean")
    assert C.last_granule(df).collect()[0].last_granule / 44100 == 5.0


def test_counts(spark):
    r = one(spark, n=V.frame_count(F.lit(1.0), F.lit(10), F.lit(1)), s=V.frame_size(F.lit(64), F.lit(48)), z=V.frame_count(F.lit(-1.0), F.lit(10), F.lit(1)))
    assert (r.n, r.s, r.z) == (10, 4608, 0)


def test_wav_size(spark):
    s = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 2), ("a", 1, 0, 3), ("a", 1, 1, -4)], "path string, n long, ch int, v int")
    header = spark.createDataFrame([("a", 44100, 2)], "path string, sample_rate int, channels int")
    blob = b"".join(bytes(r.bytes) for r in wav.remux_wav(s, header).orderBy("part_no").collect())
    assert len(blob) == 86 and blob[70:74] == b"data" and blob[78:] == struct.pack("<4h", 1, 2, 3, -4)


@pytest.mark.parametrize("text,want", [
    ("[Script Info]\nScriptType: v4.00+\n", "ass"), ("﻿WEBVTT\n\n00:01.000 --> 00:02.000\n", "webvtt"),
    ("1\n00:00:01,000 --> 00:00:02,000\nhello\n", "srt"), ("{790}{917}hello\n", "microdvd"), ("<SAMI>\n<HEAD></HEAD>\n", "sami"),
    ("# VobSub index file, v7\n", "vobsub"), ("Scenarist_SCC V1.0\n", "scc"), ("plain prose", None),
])
def test_classify_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert I.classify_text(df, "t").collect()[0].text_format == want


def formats(spark, blobs):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    return [r.format for r in I.match_signatures(df).orderBy("i").collect()]


def test_signatures(spark):
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    ts = (b"\x47" + bytes(187)) * 3
    assert formats(spark, [
        b"\xff", b"RIFF0000WAVE", b"RIFF0000XXXX", frame * 2, b"xx" + frame * 2, frame[:300], ts, ts[:-1], b"ID3", b"fLaC", b"....ftyp", b"\x89PNG\r\n\x1a\n",
        b"KVAG\0\0\0\0\x40\x1f\0\0\0\0\0\0", b"KVAG\0\0\0\0\x01\0\0\0\0\0\0\0", b"x" * 20 + b"TRUEVISION-XFILE.\0", b"",
    ]) == [None, "wav", None, "mp3", "mp3", None, "mpegts", None, "mp3", "flac", "mp4", "png_pipe", "kvag", None, "tga_pipe", None]


def test_mpeg_header(spark):
    r = one(spark, h=I.mpeg_audio_header(F.lit(0xFFFB9064)))
    assert (r.codec_name, r.frame_len, r.sample_rate, r.channels, r.samples_per_frame) == ("mp3", 417, 44100, 2, 1152)
    assert one(spark, h=I.mpeg_audio_header(F.lit(0xFFFFFFFF))) is None


def test_extension(spark):
    cases = {"a/b.WAV": "wav", "a/.hidden": "", "a.b/c": "", "a/.x.y": "y", "c.tar.gz": "gz", "noext": "", "dot.": ""}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.ext for r in I.with_extension(df).collect()} == cases


def test_overrides_and_deny(spark):
    from cinelake import rules as R

    blob = bytearray(b"ID3\x04" + bytes(25065))
    denied = bytearray(33894)
    for o, b in R.DENY_LIST[0][1]:
        denied[o : o + len(b)] = b
    df = spark.createDataFrame([("a.mp3", "mp3", blob), ("a.wav", "wav", blob), ("u.mp4", "mp4", denied)], "path string, ext string, content binary")
    rows = {r.path: r.override_doc for r in I.apply_overrides(df).collect()}
    assert rows["a.wav"] is None and [s.codec_name for s in rows["a.mp3"].streams] == ["mp3", "mjpeg"]
    assert {r.path for r in I.deny(df).collect()} == {"a.mp3", "a.wav"}


def test_observations(spark):
    """Every observation is found by an object made from it, and entries of one suffix do not hide each other."""
    from cinelake.observations import OBSERVATIONS

    rows = []
    for i, (ext, length, terms, fmt, streams) in enumerate(OBSERVATIONS):
        size = length or 600
        if size > 600000:
            continue
        blob = bytearray(size)
        for o, b in terms:
            blob[o : o + len(b)] = b
        rows.append((i, "*" if ext is None else ext, blob, fmt, streams[0][1]))
    df = spark.createDataFrame(rows, "i int, ext string, content binary, fmt string, codec string").repartition(8)
    got = df.select("i", "fmt", "codec", I.observed_document(F.col("ext"), F.col("content")).alias("d")).collect()
    assert len(got) > 100
    assert [(r.i, r.d and r.d.format) for r in got if r.d is None or r.d.format != r.fmt or r.d.streams[0].codec_name != r.codec] == []


def test_chunk_index(spark):
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    iso = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", bytes(20)) + box(b"trak", box(b"tkhd", b""))) + struct.pack(">I4sQ", 1, b"mdat", 20) + bytes(4) + struct.pack(">I4s", 0, b"free") + b"rest"
    page = lambda segs: b"OggS" + bytes(22) + bytes([len(segs)]) + bytes(segs) + bytes(sum(segs))
    df = spark.createDataFrame([("iso", bytearray(iso))], "path string, content binary")
    rows = C.chunk_index(df, "iso").orderBy("seq").collect()
    assert [(r.id, r.parent, r.data_len, r.truncated) for r in rows] == [
        ("ftyp", None, 4, False), ("moov", None, 44, False), ("mvhd", 1, 20, False), ("trak", 1, 8, False), ("tkhd", 3, 0, False), ("mdat", None, 4, False), ("free", None, 4, False)]
    ogg = spark.createDataFrame([("o", bytearray(page([255, 3]) + page([10])[:-2]))], "path string, content binary")
    assert [(r.data_len, r.truncated) for r in C.chunk_index(ogg, "ogg").orderBy("seq").collect()] == [(258, False), (10, True)]
    riff = b"RIFF\x10\0\0\0WAVEJUNK\x05\0\0\0odd!!\0data\xff\0\0\0abc"
    r = C.chunk_index(spark.createDataFrame([("r", bytearray(riff))], "path string, content binary"), "riff").where("id = 'RIFF'").collect()[0]
    assert (r.data_off, r.data_len) == (8, 16)


def test_iso_sample_tables(spark):
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    table = lambda name, n, *v: box(name, struct.pack(">II", 0, n) + struct.pack(f">{len(v)}I", *v))
    stbl = lambda sizes, chunks: box(b"stbl", table(b"stsc", 2, 1, 2, 1, 3, 1, 1) + table(b"stco", len(chunks), *chunks) + box(b"stsz", struct.pack(">III", 0, 0, len(sizes)) + struct.pack(f">{len(sizes)}I", *sizes))
                                     + table(b"stts", 2, 3, 10, 2, 5))
    trak = lambda *a: box(b"trak", box(b"tkhd", bytes(8)) + box(b"mdia", box(b"minf", stbl(*a))))
    blob = box(b"ftyp", b"isom") + box(b"moov", trak([5, 6, 7, 8, 9], [100, 200, 300]) + trak([1, 1], [40, 50, 60]))
    t = C.iso_sample_tables(C.chunk_index(spark.createDataFrame([("m", bytearray(blob))], "path string, content binary"), "iso"))
    rows = C.resolve_samples(t["stsc"], t["stco"], t["stsz"]).orderBy("track", "sample_no").collect()
    assert [r.sample_offset for r in rows] == [100, 105, 200, 207, 300, 40, 41]
    timing = C.timing(t["stts"].withColumn("timescale", F.lit(600).cast("long"))).collect()
    assert [(r.frames, r.ticks, r.rate_num, r.rate_den) for r in timing] == [(5, 40, 75, 1)] * 2
    times = [(r.frame_no, r.dts) for r in C.frame_times(t["stts"]).where(F.col("track") == rows[0].track).orderBy("frame_no").collect()]
    assert times == [(0, 0), (1, 10), (2, 20), (3, 30), (4, 35)]


def test_ogg_tables(spark):
    page = lambda serial, granule, segs: b"OggS\0\0" + struct.pack("<qI", granule, serial) + bytes(8) + bytes([len(segs)]) + bytes(segs) + bytes(sum(segs))
    blob = page(7, 0, [30]) + page(9, 0, [40]) + page(7, -1, [255, 255]) + page(7, 220500, [10, 4])
    pages = C.ogg_pages(C.chunk_index(spark.createDataFrame([("o", bytearray(blob))], "path string, content binary"), "ogg"))
    g = {r.serial: (r.last_granule, r.stream_index) for r in C.last_granule(pages).collect()}
    assert g == {7: (220500, 0), 9: (0, 1)}
    packets = C.packet_sizes(C.packets_from_segments(C.ogg_segments(pages), keys=["path", "serial"]), keys=["path", "serial"]).orderBy("serial", "packet_no").collect()
    assert [(r.serial, r.size, r.n_segments) for r in packets] == [(7, 30, 1), (7, 520, 3), (7, 4, 1), (9, 40, 1)]


def test_transport(spark):
    pes = b"\0\0\x01\xe0\0\0\x80\x80\x05" + bytes([0x21 | (1 << 1), 0x00, 0x01 | (2 << 1), 0x00, 0x01 | (3 << 1)]) + b"PAY"
    packet = bytes([0x47, 0x41, 0x00, 0x10]) + pes + bytes(184 - len(pes))
    stuffed = bytes([0x47, 0x01, 0x00, 0x30, 180]) + bytes(180) + b"END"
    df = spark.createDataFrame([("t", bytearray(packet + stuffed))], "path string, content binary")
    rows = C.transport_packets(C.split_records(df, 188)).select("record_no", "pid", "unit_start", C.pes_pts(F.col("data")).alias("pts"), C.pes_payload(F.col("data"), F.col("unit_start")).alias("p")).orderBy("record_no").collect()
    assert [(r.pid, r.unit_start) for r in rows] == [(256, True), (256, False)]
    assert rows[0].pts == (1 << 30) | (2 << 15) | 3 and bytes(rows[0].p)[:3] == b"PAY" and bytes(rows[1].p) == b"END"


def test_program_tables(spark):
    def packet(pid, section):
        body = b"\0" + section
        return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + body + b"\xff" * (184 - len(body))

    def section(table, body):
        return bytes([table, 0xB0, len(body) + 9 - 4 + 4]) + bytes(5) + body + b"CRC!"

    pat = section(0, struct.pack(">HH", 0, 0xE010) + struct.pack(">HH", 1, 0xE100))
    es = lambda kind, pid, d=b"": bytes([kind]) + struct.pack(">HH", 0xE000 | pid, 0xF000 | len(d)) + d
    early = packet(0x100, section(2, b"\xe1\0\xf0\0" + es(0x02, 0x150)))
    pmt = section(2, b"\xe1\0\xf0\x03abc" + es(0x1B, 0x101) + es(0x06, 0x102, b"\x0a\x01x\x05\x04Opus") + es(0x06, 0x103, b"\x6a\x01\0") + es(0x99, 0x104, b"\x05\x09HEVC") + es(0x03, 0x103))
    blob = early + packet(0, pat) + packet(0x200, pmt.replace(b"Opus", b"none")) + packet(0x100, section(2, b"\xe1\0\xf0\0")) + packet(0x100, pmt)
    records = C.split_records(spark.createDataFrame([("t", bytearray(blob))], "path string, content binary"), 188)
    packets = C.transport_packets(records).withColumnRenamed("record_no", "packet_no")
    assert [(r.program, r.pmt_pid) for r in C.pat_entries(packets).collect()] == [(0, 0x10), (1, 0x100)]
    entries = C.pmt_entries(packets)
    rows = {(r.packet_no, r.entry_no): (r.stream_type, r.es_pid, r.registration, r.descriptors) for r in entries.collect()}
    assert rows[4, 1] == (6, 0x102, "Opus", [10, 5]) and rows[4, 3] == (0x99, 0x104, None, []) and (3, 0) not in rows and len(rows) == 11
    streams = {r.es_pid: r.codec for r in C.program_streams(C.pat_entries(packets), C.ts_codec(entries)).collect()}
    assert streams == {0x101: "h264", 0x102: "opus", 0x103: "ac3", 0x104: None}
    # a packet out of sync: objects with a map before it keep their streams, the others are rejects
    lost = lambda n: bytearray(blob[: n * 188]) + bytearray(b"\0") + bytearray(blob[n * 188 + 1 :])
    records = C.split_records(spark.createDataFrame([("before", lost(3)), ("after", bytearray(blob) + bytearray(188)), ("pat", lost(1))], "path string, content binary"), 188)
    packets = C.transport_packets(records).withColumnRenamed("record_no", "packet_no")
    errors = C.sync_errors(packets)
    found = C.program_streams(C.pat_entries(packets), C.ts_codec(C.pmt_entries(packets)), errors)
    assert {r.path for r in found.collect()} == {"after"}
    assert {(r.path, r.packet_no, r.error_kind) for r in C.sync_rejects(errors, found).collect()} == {("before", 3, "invalid_data"), ("pat", 1, "invalid_data")}


def test_records_over_blocks(spark):
    blob = bytes(i % 251 for i in range(1000)) * 700
    rows = C.split_records(spark.createDataFrame([("t", bytearray(blob)), ("short", bytearray(5)), ("none", None)], "path string, content binary"), 188).orderBy("record_no").collect()
    assert [(r.path, r.record_no) for r in rows] == [("t", i) for i in range(len(blob) // 188)] and all(bytes(r.payload) == blob[r.record_no * 188 :][:188] for r in rows)


def test_blend_fold(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    div = lambda v: (v + 127) // 255
    for pixel in range(3):
        canvas = (0, 0, 0, 0)
        for f in range(40):
            s = tuple(rng.randrange(256) for _ in range(3)) + (rng.choice([0, 255, 80, 200]),)
            op, dispose = rng.choice(["over", "over", "source"]), rng.choice(["keep", "keep", "clear", "restore"])
            rows.append(("a", f, pixel, s, op, dispose))
            if op == "source" or s[3] == 255:
                shown = s
            elif s[3] == 0:
                shown = canvas
            else:
                inv = 255 - s[3]
                oa = s[3] + div(canvas[3] * inv)
                shown = tuple((s[c] * s[3] + div(canvas[c] * canvas[3] * inv) + oa // 2) // oa for c in range(3)) + (oa,)
            want[f, pixel] = shown
            canvas = shown if dispose == "keep" else (0, 0, 0, 0) if dispose == "clear" else canvas
    df = spark.createDataFrame(rows, "path string, frame_no long, pixel int, rgba struct<r:int,g:int,b:int,a:int>, op string, dispose string")
    assert {(r.frame_no, r.pixel): (r.r, r.g, r.b, r.a) for r in V.blend_frames(df).collect()} == want


def test_frame_chain_blocks(spark):
    import random

    rng = random.Random(5)
    rows = [("a", o, rng.randrange(1, 60)) for o in sorted(rng.sample(range(5000), 900))]
    df = spark.createDataFrame(rows, "path string, off long, frame_len long")
    offs = [o for _, o, _ in rows]
    lens = {o: n for _, o, n in rows}
    for resync in (True, False):
        o, n, last = offs[0], 0, None
        while o is not None:
            n, last = n + 1, o
            target = o + lens[o]
            nxt = [x for x in offs if x >= target] if resync else [x for x in offs if x == target]
            o = nxt[0] if nxt else None
        for block in (64, 1 << 20):
            r = C.frame_chain(df, resync=resync, block=block).collect()[0]
            assert (r.n_frames, r.first_off, r.last_off) == (n, offs[0], last)


def test_float_text(spark):
    cases = {1.5: "1.5", 2.0: "2.0", 0.0: "0.0", 0.00005: "5e-05", 0.000012: "1.2e-05", 0.000003: "3e-06", 12345678.25: "12345678.25", -0.5: "-0.5", 0.1: "0.1"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r.x: r.t for r in df.select("x", Q.float_text(F.col("x")).alias("t")).collect()} == cases


def test_unknown_status_fails(spark):
    df = spark.createDataFrame([("passed",), ("odd",)], "status string")
    with pytest.raises(Exception, match="unknown test status"):
        Q.score(df).collect()


def test_tones(spark):
    import math

    got = synth.synth(synth.standard_spec(spark), block=128).where("path in ('stereo_44k_sine', 'short_100ms', 'pcm_u8', 'odd_chunks')")
    rows = {(r.path, r.n, r.ch): r.v for r in got.collect()}
    assert len(rows) == 88200 + 800 + 800 + 64
    for i in (0, 1, 63, 500, 44099):
        for ch in (0, 1):
            assert rows["stereo_44k_sine", i, ch] == int(math.sin(2 * math.pi * (220 + ch * 220) * i / 44100) * 12000)
    assert rows["short_100ms", 65, 0] == -31 * 128 and rows["odd_chunks", 3, 0] == -443
    assert rows["pcm_u8", 9, 0] == 128 + int(80 * math.sin(2 * math.pi * 220 * 9 / 8000))


def test_pcm_nan_is_silence(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(A.to_s16(F.col("x"), "f64le")).collect()] == [0, 16384, 32767]
    assert A._decode(np.array([np.nan, 0.5, -np.inf], "<f4"), "f32le").tolist() == [0, 16384, -32768]


def test_palette_with_a_repeated_index(spark):
    df = spark.createDataFrame([("a", 0, 1, 2, 3, 255), ("a", 0, 9, 2, 3, 255), ("a", 1, 0, 0, 0, 0)], "path string, index long, r long, g long, b long, a long")
    assert V.palette_bytes(df).collect()[0].palette_hex.startswith("030209FF00000000")


def test_glob_brackets(spark):
    df = spark.createDataFrame([("src/a.rs",), ("src/b.rs",), ("src/[x].rs",), ("src/c",)], "path string")
    found = lambda *p: [r.path for r in Q.protected_paths(df, p).orderBy("path").collect()]
    assert found("src/[ab].rs") == ["src/a.rs", "src/b.rs"] and found("src/[!a].rs") == ["src/b.rs"] and found("*/[[]x].rs") == ["src/[x].rs"] and found("src/[c") == []


def test_first_success_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", int(o), "s" if o % 3 else " t  u ", "fail", ["", "e r", "long  " * 7, "\n"][int(rng.integers(4))]) for o in sorted(rng.choice(5_000_000, 3000, replace=False))]
    rows += [("late", i, "s", "fail", "x") for i in range(400)] + [("late", 900, "z", "ok", "")]
    got = {r.path: r for r in Q.first_success(spark.createDataFrame(rows, "path string, ord long, surface string, result string, stderr string")).collect()}
    text = " ".join(" | ".join(f"{s}: {' '.join(e.split())[:500]}" for p, _, s, _, e in rows if p == "hot").split())[:500]
    assert (got["hot"].status, got["hot"].details) == ("failed", text) and (got["late"].status, got["late"].command_surface) == ("passed", "z")
