"""Objects in pieces: source and sink, walks, byte ranges, digests, sample lookups and frame chains of any length."""

import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinelake.functions import digests
from cinelake.operators import boxes, containers as C, identify as I, mpeg_audio
from cinelake.sources import corpus, pieces
from cinelake.session import checkpointed


def objects(spark, data):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in data.items()], "path string, content binary")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# source and sink


def test_an_object_of_three_gib(spark, folder):
    with open(f"{folder}/big.png", "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480))
        f.seek((3 << 30) - 4)
        f.write(b"tail")
    open(f"{folder}/empty", "wb").close()
    p = pieces.scan_pieces(spark, folder, piece=1 << 20, content="ends")
    got = {(r.path, r.piece_no): (r.length, r.offset, r.size) for r in p.select("path", "length", "piece_no", "offset", F.octet_length("content").alias("size")).collect()}
    assert got == {("big.png", 0): (3 << 30, 0, 1 << 20), ("big.png", 3071): (3 << 30, 3071 << 20, 1 << 20), ("empty", 0): (0, 0, 0)}
    both = pieces.ends(p).where("path = 'big.png'")
    assert both.collect()[0].tail[-4:] == b"tail"
    found = I.match_signatures(both.select("path", F.lit("png").alias("ext"), F.col("head").alias("content"))).collect()[0]
    assert found.format == "png_pipe"
    every = pieces.scan_pieces(spark, folder, piece=1 << 20)
    assert every.rdd.getNumPartitions() >= 48  # 64 MB a task
    bare = pieces.scan_pieces(spark, folder, content="none").collect()
    assert sorted((r.path, r.ext, r.length, r.content) for r in bare) == [("big.png", "png", 3 << 30, None), ("empty", "", 0, None)]


def test_limit_and_halo(spark, folder):
    os.makedirs(f"{folder}/d")
    for name, data in {"b c.x": b"0123456789", "a[1].x": b"abc", "d/é.x": b"zz"}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = pieces.scan_pieces(spark, folder, piece=4, halo=2, limit=2).orderBy("path", "piece_no").collect()
    assert [(r.path, r.piece_no, bytes(r.content)) for r in rows] == [("a[1].x", 0, b"abc"), ("b c.x", 0, b"012345"), ("b c.x", 1, b"456789"), ("b c.x", 2, b"89")]
    assert [(r.path, bytes(r.content)) for r in corpus.scan_corpus(spark, folder, limit=1).collect()] == [("a[1].x", b"abc")]
    table = objects(spark, {"b c.x": b"0123456789", "e": b"", "n": None})
    assert [(r.path, r.piece_no, bytes(r.content)) for r in pieces.cut(table, 4, 2).orderBy("path", "piece_no").collect()] == [(r.path, r.piece_no, bytes(r.content)) for r in rows[1:]] + [("e", 0, b"")]
    with pytest.raises(Exception, match="content is all"):
        pieces.scan_pieces(spark, folder, content="some").collect()


def test_written_objects_keep_apart(spark, folder):
    names = ["a/b", "a_b", "_a", ".a", "a%2Fb", "ä b", "a+b"]
    data = [(n, i, bytearray(f"{n}{i}".encode())) for n in names for i in (1, 0)]
    pieces.write_objects(spark.createDataFrame(data, "path string, part_no int, bytes binary"), folder)
    assert sorted(os.listdir(folder)) == sorted(map(pieces.object_name, names)) and [pieces.object_path(pieces.object_name(n)) for n in names] == names
    assert all(open(f"{folder}/{pieces.object_name(n)}", "rb").read() == f"{n}0{n}1".encode() for n in names)


def test_a_failed_write_leaves_nothing(spark, folder):
    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.lit(0).alias("part_no"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken part"))).otherwise(F.encode("id", "utf-8")).alias("bytes"))
    with pytest.raises(Exception, match="broken part"):
        pieces.write_objects(rows, folder)
    assert os.listdir(folder) == []


# walks


def riff(ident, *children):
    body = b"list" + b"".join(children)
    return ident + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def chunk(ident, data):
    return ident + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def box(ident, data, wide=False):
    return struct.pack(">I", 1) + ident + struct.pack(">Q", 16 + len(data)) + data if wide else struct.pack(">I", 8 + len(data)) + ident + data


def nested(ident, depth):
    out, size = [], 4
    for _ in range(depth):
        out.append(ident + struct.pack("<I", size) + b"list")
        size += 12
    return b"".join(reversed(out))


def test_nesting_of_a_hundred_thousand(spark):
    data = objects(spark, {"deep": nested(b"LIST", 100_000), "boxes": b"".join(struct.pack(">I", 8 * (3000 - i)) + b"moov" for i in range(3000))})
    nodes, rejects = boxes.walk_boxes(checkpointed(pieces.cut(data.where("path = 'deep'"), 1 << 16)), "riff", piece=1 << 16)
    found = nodes.agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count_if(F.col("parent") == F.col("seq") - 1).alias("own")).collect()[0]
    assert (found.n, found.last, found.own) == (100_000, 99_999, 99_999) and rejects.count() == 0
    assert C.chunk_index(data.where("path = 'boxes'"), "iso").count() == 3000


def random_container(rng, family):
    payload = lambda n: bytes(rng.randrange(256) for _ in range(rng.randrange(n)))
    if family == "riff":
        tree = lambda d: riff(b"LIST", *[tree(d - 1) if d and rng.random() < 0.4 else chunk(b"data", payload(90)) for _ in range(rng.randrange(5))])
        return tree(3)
    if family == "iso":
        tree = lambda d: box(b"trak", b"".join(tree(d - 1) if d and rng.random() < 0.4 else box(b"mdat", payload(90), rng.random() < 0.3) for _ in range(rng.randrange(5))))
        return tree(3)
    if family == "ogg":
        lens = [[rng.choice([0, 10, 255]) for _ in range(rng.randrange(5))] for _ in range(8)]
        return b"".join(b"OggS" + bytes(22) + bytes([len(x), *x]) + bytes(sum(x)) for x in lens)
    blocks = [b"!\xf9" + bytes([len(p)]) * bool(p) + p + b"\0" if rng.random() < 0.6 else b"," + bytes(8) + b"\x80" + bytes(7) + bytes([len(p)]) * bool(p) + p + b"\0" for p in (payload(255) for _ in range(6))]
    return b"GIF89a" + bytes(4) + b"\x81\0\0" + bytes(12) + b"".join(blocks) + b";"


@pytest.mark.parametrize("family", boxes.FAMILIES)
def test_pieces_give_what_the_whole_gives(spark, family):
    rng = random.Random(family)
    data = {}
    for i in range(30):
        whole = random_container(rng, family)
        damaged = bytearray(whole)
        for _ in range(rng.randrange(3)):
            damaged[rng.randrange(len(whole))] = rng.randrange(256)
        data[f"w{i}"], data[f"c{i}"], data[f"d{i}"] = whole, whole[: rng.randrange(len(whole) + 1)], bytes(damaged)
    want, errors = {}, {}
    for name, blob in data.items():
        walk = boxes.Walk(family, len(blob))
        walk.more(memoryview(blob), 0)
        want[name] = walk.nodes
        if walk.error:
            errors[name] = walk.error
    nodes, rejects = boxes.walk_boxes(checkpointed(pieces.cut(objects(spark, data), 37)), family, piece=37, run=2)
    got = {name: [] for name in data}
    for r in nodes.orderBy("path", "seq").collect():
        got[r.path].append((r.seq, r.parent, r.id, r.data_off, r.data_len, r.truncated, None if r.head is None else bytes(r.head)))
    assert got == want and {r.path: r.error for r in rejects.collect()} == errors
    assert not any(n in errors for n in data if n[0] == "w")


def test_bytes_of_ranges(spark):
    rng = random.Random(2)
    data = {k: bytes(rng.randrange(256) for _ in range(1000)) for k in "ab"}
    ranges = [(k, i, rng.randrange(1000), rng.randrange(400)) for k in "ab" for i in range(30)] + [("a", 99, 0, 1000), ("b", 98, 990, 50)]
    parts = boxes.range_bytes(spark.createDataFrame(ranges, "path string, i int, off long, len long"), pieces.cut(objects(spark, data), 64), ["path", "i"], piece=64)
    got = {(r.path, r.i): (r.size, r.hash) for r in digests.fold_md5(parts, ["path", "i"], ["part_no"]).collect()}
    want = {(k, i): (len(b), hashlib.md5(b).hexdigest()) for k, i, o, n in ranges if (b := data[k][o : o + n]) and n}
    assert got == want


def test_fold_over_many_parts(spark):
    parts = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.encode(F.repeat(F.col("id").cast("string"), 50), "utf-8").alias("bytes"))
    got = {r.k: (r.n_parts, r.hash) for r in digests.fold_md5(parts, ["k"], ["n"]).collect()}
    for k in range(3):
        assert got[k] == (len(range(k, 5000, 3)), hashlib.md5(b"".join(str(i).encode() * 50 for i in range(k, 5000, 3))).hexdigest())


# sample tables


def sample_table(ident, *numbers):
    return box(ident, struct.pack(f">{len(numbers) + 1}I", 0, *numbers))


def test_tables_that_declare_too_much(spark):
    short = box(b"moov", box(b"trak", sample_table(b"stsz", 0, 0xFFFFFFFF, 1, 2) + sample_table(b"stco", 1, 9) + sample_table(b"stsc", 1, 1, 1, 1) + sample_table(b"stts", 2, 5, 1)))
    good = box(b"moov", box(b"trak", sample_table(b"stsz", 7, 200_000_000) + sample_table(b"stco", 2, 1000, 5_000_000_00) + sample_table(b"stsc", 2, 1, 50_000_000, 1, 2, 150_000_000, 1)))
    t = C.iso_sample_tables(C.chunk_index(objects(spark, {"short": short, "good": good}), "iso"))
    assert {(r.path, r.id, r.declared) for r in t["rejects"].collect()} == {("short", "stsz", 0xFFFFFFFF), ("short", "stts", 2)}
    assert "MapInArrow" not in plan(t["stsz"].join(t["stco"], ["path", "track"]))  # objects are walked once, before
    asked = spark.createDataFrame([("good", 1, n) for n in (0, 49_999_999, 50_000_000, 199_999_999, 200_000_000)], "path string, track long, sample_no long")
    t["stsc"] = t["stsc"].where("path = 'good'")
    got = {r.sample_no: (r.chunk_no, r.size, r.sample_offset) for r in C.resolve_samples(t["stsc"], t["stco"], t["stsz"], wanted=asked).collect()}
    assert got == {0: (1, 7, 1000), 49_999_999: (1, 7, 1000 + 7 * 49_999_999), 50_000_000: (2, 7, 500_000_000), 199_999_999: (2, 7, 500_000_000 + 7 * 149_999_999)}


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_samples_against_a_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(C.ordered, "BLOCK", block)
    rng = random.Random(block)
    stsc, stco, stsz, want = [], [], [], {}
    for k in range(12):
        n_chunks = rng.randrange(1, 30)
        runs = sorted(rng.sample(range(1, n_chunks + 1), rng.randrange(1, min(5, n_chunks) + 1)))
        per = {c: rng.randrange(0, 4) for c in runs}
        stsc += [(k, c, n) for c, n in per.items()]
        places = [(c, 10_000 * c + rng.randrange(99)) for c in range(1, n_chunks + 1)]
        stco += [(k, *p) for p in places]
        counts = [per[max([r for r in runs if r <= c], default=runs[0])] for c, _ in places]
        need = max(0, sum(counts) + rng.choice([0, 0, -1, 1]))
        sizes = [rng.randrange(1, 9) for _ in range(need)]
        stsz += [(k, i, s) for i, s in enumerate(sizes)]
        if sum(counts) >= need:
            at = iter(range(need))
            for (c, off), n in zip(places, counts):
                for i in [x for _, x in zip(range(n), at)]:
                    want[k, i] = (c, sizes[i], off)
                    off += sizes[i]
    frames = [spark.createDataFrame(r, d) for r, d in ((stsc, "path int, first_chunk long, samples_per_chunk long"), (stco, "path int, chunk_no long, offset long"), (stsz, "path int, sample_no long, size long"))]
    assert {(r.path, r.sample_no): (r.chunk_no, r.size, r.sample_offset) for r in C.resolve_samples(*frames, keys=("path",)).collect()} == want


# frame chains


def plain_chain(rows, resync):
    at = {o: n for o, n in rows}
    offs, o, n, last = sorted(at), min(at), 0, None
    while o is not None and at[o] is not None:
        n, last, target = n + 1, o, o + at[o]
        o = next((x for x in offs if x >= target), None) if resync else target if target in at else None
    return n, last


@pytest.mark.parametrize("resync", [True, False])
def test_chains_with_marks_and_long_frames(spark, resync):
    rng = random.Random(resync)
    data, want = [], {}
    for k in range(25):
        rows = [(o, rng.choice([1, 2, 7, 64, 500, 3000, None if k % 4 == 0 and rng.random() < 0.05 else 9])) for o in sorted(rng.sample(range(4000), rng.choice([1, 40, 900])))]
        data += [(k, *r) for r in rows]
        n, last = plain_chain(rows, resync)
        if n:
            want[k] = (n, rows[0][0], last)
    df = spark.createDataFrame(data, "path int, off long, frame_len long")
    for block in (64, 1 << 20):
        assert {r.path: (r.n_frames, r.first_off, r.last_off) for r in C.frame_chain(df, resync=resync, block=block).collect()} == want


def test_a_frame_of_a_megabyte_and_a_long_chain(spark):
    df = spark.range(40_000).select(F.lit("a").alias("path"), (F.col("id") * 1000 + F.when(F.col("id") > 20_000, 5 << 20).otherwise(0)).alias("off"), F.when(F.col("id") == 20_000, 1_000_000).otherwise(1000).cast("long").alias("frame_len"))
    r = C.frame_chain(df, block=1 << 16).collect()[0]
    assert (r.n_frames, r.first_off, r.last_off) == (40_000, 0, 39_999_000 + (5 << 20))


def test_mpeg_headers_are_those_of_the_column_form(spark):
    rng = np.random.default_rng(0)
    raw = np.concatenate([rng.integers(0, 1 << 32, 2000, dtype=np.uint64), 0xFFE00000 | rng.integers(0, 1 << 21, 6000, dtype=np.uint64)])
    df = spark.createDataFrame(pa.table({"raw": pa.array(raw.astype(np.int64))}).to_pandas())
    want = {r.raw: None if r.h is None else (r.h.frame_len, r.h.sample_rate, r.h.channels) for r in df.select("raw", I.mpeg_audio_header(F.col("raw")).alias("h")).collect()}
    for v in raw.tolist():
        h = mpeg_audio.headers(np.frombuffer(int(v).to_bytes(4, "big"), np.uint8))
        at = np.flatnonzero(h["place"] == 0)
        assert (None if not len(at) else tuple(int(h[c][at[0]]) for c in ("frame_len", "sample_rate", "channels"))) == want[v]
