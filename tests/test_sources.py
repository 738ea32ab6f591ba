"""Round trips over written files, the probe and conformance plans, and the incremental scan."""

import json
import os
import struct

from pyspark.sql import functions as F

from cinelake.operators import audio as A, conformance as Q, identify as I
from cinelake.plans.conformance import conformance_run
from cinelake.plans.probe import probe_corpus
from cinelake.plans.transform import transform_manifest
from cinelake.sources import corpus, framehash, probe_json, reports, synth, wav
from cinelake.streaming.ingest import identify_stream, stream_corpus


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def plain_wav(channels, rate, bits, payload, tag=1):
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits)
    body = b"WAVE" + b"JUNK\x05\0\0\0odd!!\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def sample_corpus(folder):
    put(folder, "a/tone.wav", plain_wav(1, 8000, 16, bytes(1600)))
    put(folder, "a/cut.wav", plain_wav(2, 44100, 16, bytes(4000))[:-1000])
    put(folder, "a/bad.wav", plain_wav(1, 8000, 12, bytes(100)))
    put(folder, "b/truncated.wav", b"RIFF\x08\0\0\0WAVEfmt ")
    put(folder, "b/pic.png", b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + bytes(9))
    put(folder, "b/song.qoa", b"qoaf" + struct.pack(">I", 88200) + b"\x02" + (44100).to_bytes(3, "big"))
    put(folder, "c/deep/speech.G722", bytes(16000))
    put(folder, "c/sub.srt", b"1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    put(folder, "junk", b"\xff")


def test_scan(spark, folder):
    sample_corpus(folder)
    all_ = corpus.scan_corpus(spark, folder)
    rows = {r.path: r for r in all_.collect()}
    assert sorted(rows) == ["a/bad.wav", "a/cut.wav", "a/tone.wav", "b/pic.png", "b/song.qoa", "b/truncated.wav", "c/deep/speech.G722", "c/sub.srt", "junk"]
    assert rows["c/deep/speech.G722"].ext == "g722" and rows["junk"].ext == "" and rows["junk"].length == 1
    assert [r.path for r in corpus.scan_corpus(spark, folder, limit=2).orderBy("path").collect()] == ["a/bad.wav", "a/cut.wav"]
    bare = corpus.scan_corpus(spark, folder, content=False)
    assert "content" not in bare.columns
    assert "content" not in bare._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_probe(spark, folder):
    sample_corpus(folder)
    p = probe_corpus(corpus.scan_corpus(spark, folder))
    docs = {r.path: r for r in p.documents.collect()}
    rejects = {r.path: r for r in p.rejects.collect()}
    assert len(docs) + len(rejects) == 9 and not set(docs) & set(rejects)
    s = docs["a/tone.wav"].streams[0]
    assert (s.codec_name, s.sample_rate, s.channels, s.bits_per_sample, s.duration_seconds) == ("pcm_s16le", 8000, 1, 16, 0.1)
    assert abs(docs["a/cut.wav"].streams[0].duration_seconds - 3000 / 4 / 44100) < 1e-9
    assert (docs["b/pic.png"].streams[0].width, docs["b/pic.png"].streams[0].height) == (640, 480)
    assert docs["b/song.qoa"].streams[0].duration_seconds == 2.0
    assert docs["c/deep/speech.G722"].streams[0].duration_seconds == 2.0
    assert docs["c/sub.srt"].format == "srt" and docs["c/sub.srt"].streams == []
    assert set(rejects) == {"a/bad.wav", "b/truncated.wav", "junk"}
    assert p.streams.count() == 5


def test_probe_more_formats(spark, folder):
    u16, u32 = lambda v: struct.pack("<H", v), lambda v: struct.pack("<I", v)
    put(folder, "a.ac3", bytes([0x0B, 0x77, 0, 0, 0x1E, 0x40, 0x43, 0]) + bytes(1592))
    put(folder, "a.eac3", bytes([0x0B, 0x77, 0x01, 0xFF, 0x34, 0x80, 0, 0]) + bytes(1016))
    put(folder, "core.bmp", b"BM" + bytes(12) + u32(12) + u16(30) + u16(20))
    put(folder, "up.bmp", b"BM" + bytes(12) + u32(40) + u32(30) + struct.pack("<i", -20))
    put(folder, "x.ivf", b"DKIF" + u16(0) + u16(32) + b"VP80" + u16(320) + u16(240) + u32(30) + u32(1) + u32(60) + bytes(8))
    put(folder, "y.alp", b"ALP " + u32(8) + b"ADPCM\0" + b"\0\x02" + bytes(22050))
    put(folder, "m.cam", bytes(2) + u16(160) + u16(120) + bytes(6) + b"ML20")
    put(folder, "k.cdg", (b"\x09" + bytes(23)) * 600)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 8, 9) + bytes(9)
    put(folder, "anim.png", png + b"\0\0\0\0acTL" + bytes(4) + b"\0\0\0\0IDAT")
    gce = b"\x21\xf9\x04\0" + u16(25) + b"\0\0"
    image = b"\x2c" + bytes(4) + u16(4) + u16(4) + b"\0" + b"\x02" + b"\x02ab" + b"\0"
    put(folder, "two.gif", b"GIF89a" + u16(4) + u16(4) + b"\0\0\0" + (gce + image) * 2 + b";")
    put(folder, "still.gif", b"GIF89a" + u16(4) + u16(4) + b"\0\0\0" + image + b";")
    put(folder, "cap.txt", b"\x1b[" + bytes(500))
    d = {r.path: (r.format, [(s.codec_name, s.sample_rate, s.channels, s.width, s.height, None if s.duration_seconds is None else round(s.duration_seconds, 6)) for s in r.streams])
         for r in probe_corpus(corpus.scan_corpus(spark, folder)).documents.collect()}
    assert d["a.ac3"] == ("ac3", [("ac3", 48000, 2, None, None, round(1600 * 8 / 448000, 6))])
    assert d["a.eac3"] == ("eac3", [("eac3", 48000, 2, None, None, round(1024 * 8 / (1024 * 8 * 48000 // (6 * 256)), 6))])
    assert d["core.bmp"][1][0][3:5] == (30, 20) and d["up.bmp"][1][0][3:5] == (30, 20) and d["core.bmp"][0] == "bmp_pipe"
    assert d["x.ivf"] == ("ivf", [("vp8", None, None, 320, 240, 2.0)])
    assert d["y.alp"] == ("alp", [("adpcm_ima_alp", 22050, 2, None, None, 1.0)])
    assert d["m.cam"] == ("msnwctcp", [("mimic", None, None, 160, 120, 0.0)])
    assert d["k.cdg"] == ("cdg", [("cdgraphics", None, None, 300, 216, 2.0)])
    assert d["anim.png"] == ("apng", [("apng", None, None, 8, 9, 0.0)])
    assert d["two.gif"][1][0][5] == 0.5 and d["still.gif"][1][0][5] == 0.1
    assert d["cap.txt"] == ("tty", [("ansi", None, None, 640, 400, 0.12)])


def test_framehash_round_trip(spark, folder):
    s = synth.synth(synth.standard_spec(spark).where("path in ('tiny', 'short_100ms')"))
    header = spark.createDataFrame([("tiny", 8000, 1), ("short_100ms", 8000, 1)], "path string, sample_rate long, channels int")
    frames = A.frame_hashes(s, header)
    full = header.select("*", F.lit("audio").alias("media"), F.lit(1).alias("tb_num"), F.lit(8000).alias("tb_den"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
    framehash.write_framehash(frames, full, f"{folder}/out")
    got, rejects = framehash.read_framehash(spark, f"{folder}/out")
    key = lambda rows: sorted((r.pts, r.duration, r.size, r.hash) for r in rows)
    assert key(got.collect()) == key(frames.collect()) and rejects.count() == 0
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/out/path=tiny") for f in fs if f.endswith(".txt")]
    text = open(files[0]).read().splitlines()
    assert text[0] == "#format: frame checksums" and text[8] == "#channel_layout_name 0: mono" and text[10].startswith("0, 0, 0, 512, 1024, ")


def test_wav_round_trip(spark, folder):
    s = synth.synth(synth.standard_spec(spark).where("path = 'tiny'"))
    header = spark.createDataFrame([("tiny", 8000, 1)], "path string, sample_rate int, channels int")
    os.makedirs(f"{folder}/out")
    wav.write_wav(wav.remux_wav(s, header, part_frames=100), f"{folder}/out")
    assert os.listdir(f"{folder}/out") == ["tiny"]
    blob = open(f"{folder}/out/tiny", "rb").read()
    put(folder, "in/tiny.wav", blob)
    doc = probe_corpus(corpus.scan_corpus(spark, f"{folder}/in")).documents.collect()[0]
    assert doc.streams[0].duration_seconds == 0.1
    pcm = struct.unpack("<800h", blob[78:])
    assert list(pcm) == [r.v for r in s.orderBy("n").collect()]


def test_transform_plan(spark):
    s = synth.synth(synth.standard_spec(spark).where("path = 'tiny'"))
    header = spark.createDataFrame([("tiny", 8000, 1)], "path string, sample_rate long, channels int")
    assert [r.duration for r in transform_manifest(s, header, start="0.05").orderBy("pts").collect()] == [400]
    out = transform_manifest(s, header, gain=0.5, source_rate=8000, target_rate=4000).orderBy("pts").collect()
    assert [r.duration for r in out] == [256, 144]


def test_reports_and_logs(spark, folder):
    rows = spark.createDataFrame([(1, "passed", 0, 0), (2, "failed", 0, 1)], "ord long, status string, oracle_returncode int, our_returncode int")
    reports.write_report(rows, Q.status_summary(rows), {"generated_at": "now"}, f"{folder}/report")
    assert spark.read.parquet(f"{folder}/report/tests").count() == 2
    back = spark.read.parquet(f"{folder}/report/summary").collect()[0]
    assert (back.passed, back.rejected_by_us, back.generated_at) == (1, 1, "now")
    put(folder, "bench.json", json.dumps({"results": [{"command": "ours x", "mean": 2.0, "stddev": 1}, {"command": "oracle x", "mean": 1.0}]}).encode())
    pairs = Q.benchmark_ratio(Q.pair_benchmarks(reports.read_bench(spark, f"{folder}/bench.json"), ("oracle", "ours"))).collect()
    assert [(p.task, p.relative) for p in pairs] == [("x", "ours is 2.00x slower")]
    put(folder, "logs/20240101-000000.md", b"# run\n\nstatus: x\n\n- reason: ok\n- after_score: 12\n```\n5 / 8 strict media matches\n```\n")
    log = {(r.run_id, r.key): r.value for r in reports.read_run_logs(spark, f"{folder}/logs").collect()}
    assert log == {("20240101-000000", "reason"): "ok", ("20240101-000000", "after_score"): "12", ("20240101-000000", "strict"): "5", ("20240101-000000", "accepted"): "8"}


def test_probe_json_round_trip(spark, folder):
    sample_corpus(folder)
    p = probe_corpus(corpus.scan_corpus(spark, folder))
    texts = probe_json.to_probe_json(p.streams, p.documents)
    rows = {r.path: r.json for r in texts.collect()}
    assert json.loads(rows["a/tone.wav"]) == {"format": "wav", "streams": [{"index": 0, "codec_type": "audio", "codec_name": "pcm_s16le", "sample_rate": 8000, "channels": 1, "bits_per_sample": 16, "duration_seconds": 0.1}]}
    assert '"duration_seconds":0.100000' in rows["a/tone.wav"] and rows["c/sub.srt"] == '{"format":"srt","streams":[]}'
    back = probe_json.read_probe_json(texts).where("path = 'b/pic.png'").collect()[0].doc
    assert back.format == "png_pipe" and back.streams[0].width == 640


def test_conformance_plan(spark):
    stream = "array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:bigint,bits_per_sample:bigint,bits_per_raw_sample:string,width:bigint,height:bigint,duration:string>>"
    audio = ("audio", "aac", "44100", 2, None, None, None, None, "1.02")
    oracle = spark.createDataFrame(
        [("same", 0, ("mov,mp4", [audio])), ("far", 0, ("wav", [("audio", "pcm_s16le", "8000", 1, 16, None, None, None, "1.0")])), ("both", 1, (None, [])), ("false", 1, (None, [])), ("miss", 0, ("wav", []))],
        f"path string, returncode int, doc struct<format_name:string,streams:{stream}>")
    ours = "array<struct<codec_type:string,codec_name:string,sample_rate:bigint,channels:int,bits_per_sample:int,duration_seconds:double,width:bigint,height:bigint>>"
    mine = spark.createDataFrame(
        [("same", 0, ("mp4", [("audio", "aac", 44100, 2, 0, 1.0, None, None)]), "", False, False), ("far", 0, ("wav", [("video", "h264", None, None, None, 2.0, 10, 10)]), "", False, False),
         ("both", 1, None, "bad", False, False), ("false", 0, ("wav", []), "", False, False), ("miss", 1, None, "no  header", False, False)],
        f"path string, returncode int, doc struct<format:string,streams:{ours}>, stderr string, timed_out boolean, panic boolean")
    r = {x.name: x for x in conformance_run(oracle, mine).collect()}
    assert {k: v.status for k, v in r.items()} == {"same": "passed", "far": "failed", "both": "passed", "false": "failed", "miss": "failed"}
    assert r["far"].details == ("stream 0.codec_type: expected audio, got video; stream 0.codec_name: expected pcm_s16le, got h264; stream 0.sample_rate: expected 8000, got None; "
                                "stream 0.channels: expected 1, got None; stream 0.bits_per_sample: expected 16, got None; stream 0.duration_seconds: expected 1.0, got 2.0")
    assert r["miss"].details == "oracle accepted input but probe rejected it: no header"
    summary = Q.status_summary(conformance_run(oracle, mine)).collect()[0]
    assert (summary.total, summary.passed, summary.rejected_by_us) == (5, 2, 1)


def test_stream(spark, folder):
    sample_corpus(f"{folder}/in")
    for extra in (None, "new/late.flac"):
        if extra:
            put(f"{folder}/in", extra, b"fLaC")
        q = identify_stream(stream_corpus(spark, f"{folder}/in", max_files=4), f"{folder}/out", f"{folder}/ckpt")
        assert q.awaitTermination(120)
    rows = {r.path: r.format for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(rows) == 10 and rows["new/late.flac"] == "flac" and rows["b/pic.png"] == "png_pipe"
