"""Registered queries against their SQL on small odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cinelake.plans.registry import load_all
from tests.test_queries import norm

WORDY = "alpha be gamma delta epsilon 12345678 x"
TEXTS = ["a", "ab", "éx", "abc", "abcd", "two\nlines", None, "", "x" * 199, "y" * 200, "z" * 201, "w " * 300, "line\n" * 150, WORDY * 40, "世界 " * 500]


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given tables; each is (ddl, rows)."""
    con = duckdb.connect()
    for table, (ddl, rows) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    q = load_all()[name]
    df = q.run(spark, folder)
    cols = sorted(df.columns)
    cur = con.execute(q.sql)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()), sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def texts(values=TEXTS, first=0):
    return "doc_id long, text string", [(first + i, t) for i, t in enumerate(values)]


def test_bit_fields_of_short_texts(spark, folder):
    got, want = against_sql(spark, folder, "bit_fields_p18", documents=texts([t for t in TEXTS if t != ""]))
    assert got == want


@pytest.mark.parametrize("name", ["box_rejects_c2", "walk_boxes_c2"])
def test_containers_of_odd_texts(spark, folder, name):
    """Text 7 is empty, and its container would be cut short."""
    got, want = against_sql(spark, folder, name, documents=texts())
    assert got == want


@pytest.mark.parametrize("family", ["riff", "iso", "ogg", "gif"])
def test_containers_are_built_once(spark, folder, family):
    """A filter on the object, or a use of a text's bytes in each slice, would repeat the encoding."""
    from cinelake.plans.catalog import containers

    spark.createDataFrame(texts()[1], texts()[0]).write.parquet(f"{folder}/documents.parquet")
    objects = containers.riff_objects(spark, folder) if family == "riff" else containers.family_objects(spark, folder, family)
    plan = objects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 1 and plan.count("encode(") <= 1


def test_mpeg_candidates_of_a_batch(spark):
    """Pieces of one batch lie next to each other: a header that begins in the halo of one or goes over into the next object is none of it."""
    from cinelake.operators import mpeg_audio
    from cinelake.sources.pieces import cut

    frame = bytes.fromhex("FFFB9000") + bytes(413)
    objects = {1: frame * 3, 2: b"\xff\xfb", 3: b"\x90\x00" + frame, 4: b"", 5: b"\xffTA", 6: b"G" + frame + b"TAG", 7: None}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in objects.items()], "path long, content binary").coalesce(1)
    for piece in (100, 417, 5000):
        found = mpeg_audio.candidates(cut(df, piece, halo=mpeg_audio.HALO), piece).collect()
        got = sorted((r.path, r.off, r.frame_len or 0) for r in found)
        assert got == [(1, 0, 417), (1, 417, 417), (1, 834, 417), (3, 2, 417), (6, 1, 417), (6, 418, 0)]


def test_mpeg_headers_are_searched_once(spark, monkeypatch):
    from cinelake.operators import mpeg_audio
    from cinelake.sources.pieces import cut

    chained = []
    monkeypatch.setattr(mpeg_audio, "frame_chain", lambda c, keys: chained.append(c) or c.groupBy(*keys).agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count("*").alias("n_frames")))
    df = spark.createDataFrame([(1, bytearray(bytes.fromhex("FFFB9000") + bytes(413)))], "path long, content binary")
    assert mpeg_audio.streams(cut(df, 5000, halo=mpeg_audio.HALO), 5000).count() == 1
    assert "MapInArrow" not in chained[0]._jdf.queryExecution().optimizedPlan().toString()


def test_plane_runs(spark):
    """Sums of runs against the values as rows."""
    from cinelake.operators import frames as V

    data = [None, b"", b"\x00", b"\xff" * 7, bytes(range(256)) * 5, bytes(range(255, -1, -1)) * 600]
    p = spark.createDataFrame([(i // 2, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "k long, u binary").withColumn("j", F.monotonically_increasing_id())
    for run in (8, 4096):
        got = sorted(map(tuple, V.plane_runs(p, "u", (1, 4, 8), ["k", "j"], run).collect()))
        want = []
        for bits in (1, 4, 8):
            v = V.unpack_pieces(p, "u", bits, ["k", "j"]).withColumn("bits", F.lit(bits)).withColumn("row_no", F.call_function("div", F.col("pos"), F.lit(run)))
            pos = F.col("pos") % run + 1
            want += v.groupBy("k", "j", "bits", "row_no").agg(F.count("*"), F.sum("v"), F.sum(F.col("v") * pos)).collect()
        assert got == sorted(map(tuple, want))


def test_oracle_streams(spark, folder):
    """Streams are built once: a generator that drops empty arrays would build them in a filter as well."""
    pairs = ("doc_id long, text string, lang string", [(i, t, "en") for i, t in enumerate(TEXTS)])
    got, want = against_sql(spark, folder, "normalise_oracle_q1", documents=pairs)
    assert got == want
    plan = load_all()["normalise_oracle_q1"].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_diff_probe_without_a_join(spark, folder):
    got, want = against_sql(spark, folder, "diff_probe_q4", documents=texts())
    assert got == want
    assert "Join" not in load_all()["diff_probe_q4"].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_float_text(spark):
    from cinelake.operators import conformance as Q

    said = {0.0: "0.0", 5e-05: "5e-05", 1.5: "1.5", 2.0: "2.0", 1.2e-05: "1.2e-05", 9.94e-05: "9.9e-05", 1e-04: "0.0001", -3e-06: "-3e-06", 100.0: "100.0", 1e-7: "0.0", 0.00099: "0.00099", -120.050001: "-120.050001"}
    rows = spark.createDataFrame([(x,) for x in said], "x double").select("x", Q.float_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == said


def test_chain_walks_its_blocks_once(spark, monkeypatch):
    """Targets that leave their block come from a join; Python sees each block once."""
    from cinelake.operators import containers as C

    passes, groups = [], C.grouped.map_groups
    monkeypatch.setattr(C.grouped, "map_groups", lambda *a, **kw: passes.append(a) or groups(*a, **kw))
    rows = [("a", 0, 5), ("a", 5, 30), ("a", 36, 4), ("a", 40, None), ("a", 44, 3), ("b", 7, 9), (None, 1, 2)]
    c = spark.createDataFrame(rows, "path string, off long, frame_len long")
    got = sorted(map(tuple, C.frame_chain(c, block=8).where("path is not null").collect()))
    assert got == [("a", 3, 0, 36), ("b", 1, 7, 7)] and len(passes) == 1
