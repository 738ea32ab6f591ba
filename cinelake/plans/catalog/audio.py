"""Audio queries: embeddings stand for clips, events for long mono or stereo streams, documents for raw PCM bytes."""

from pyspark.sql import functions as F

from cinelake.functions import binary as B, ordered
from cinelake.operators import audio as A
from cinelake.plans.catalog.common import documents, pick, sql_list
from cinelake.plans.catalog.containers import EV, events
from cinelake.plans.registry import query, table

CLIPS = "clips AS (SELECT vec_id AS path, generate_subscripts(embedding, 1) - 1 AS n, greatest(-32768, least(32767, round_even(greatest(-1.0, least(1.0, unnest(embedding)::DOUBLE * 4)) * 32768, 0)))::INTEGER AS v FROM embeddings)"
STREAMS = f"{EV}, st AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, round(value * 100)::BIGINT % 30000 AS a FROM (SELECT e.*, x.value FROM ev e JOIN events x USING (event_id))), samples AS (SELECT path, n, c::INTEGER AS ch, (CASE WHEN c = 0 THEN a ELSE -a // 2 END)::INTEGER AS v FROM st, (SELECT unnest(range(2)) AS c))"


def clips(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("n", "x"))
    return e.select("path", F.col("n").cast("long").alias("n"), F.lit(0).alias("ch"), A.to_s16(F.col("x").cast("double") * 4, "f64le").alias("v"))


def streams(spark, sf):
    """Users as stereo streams: one frame per event in event order (left = amplitude, right = half of it inverted)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), "event_id", (F.round(F.col("value") * 100).cast("long") % 30000).alias("a"))
    e = ordered.row_index(e, ["path"], "event_id", "n")
    return e.select("path", "n", F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.col("a").cast("int").alias("v")),
                                                   F.struct(F.lit(1).alias("ch"), F.call_function("div", -F.col("a"), F.lit(2)).cast("int").alias("v")))).alias("s")).select("path", "n", "s.ch", "s.v")


@query("to_s16_a1", """SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS n,
  greatest(-32768, least(32767, round_even(greatest(-1.0, least(1.0, unnest(embedding)::DOUBLE * 3)) * 32768, 0)))::INTEGER AS v FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "x"))
    return e.select("vec_id", F.col("n").cast("long").alias("n"), A.to_s16(F.col("x").cast("double") * 3, "f64le").alias("v"))


def _pcm_sql():
    parts = []
    for fmt, w in (("u8", 1), ("s16le", 2), ("s16be", 2), ("s24le", 3), ("s32le", 4)):
        digits = "||".join(f"substr(hx, (i * {2 * w} + {2 * b + 1})::BIGINT, 2)" for b in (range(w) if fmt == "s16be" else reversed(range(w))))
        u = f"('0x' || {digits})::BIGINT"
        s = u if fmt == "u8" else f"(CASE WHEN {u} >= {1 << (8 * w - 1)} THEN {u} - {1 << (8 * w)} ELSE {u} END)"
        v = {"u8": f"({s} - 128) * 256", "s24le": f"{s} >> 8", "s32le": f"{s} >> 16"}.get(fmt, s)
        parts.append(f"SELECT doc_id, '{fmt}' AS fmt, count(*) AS n, sum(v)::BIGINT AS sum_v, sum(v * (i % 101))::BIGINT AS sum_iv FROM (SELECT doc_id, i, {v} AS v FROM t, LATERAL (SELECT unnest(range(len // {w})) AS i) WHERE len % {w} = 0) GROUP BY doc_id")
    return "WITH t AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS len FROM documents) " + " UNION ALL ".join(parts)


@query("decode_pcm_a1", _pcm_sql())
def _(spark, sf):
    d = documents(spark, sf).select("doc_id", F.lit(0).cast("long").alias("base"), F.encode("text", "utf-8").alias("payload"))
    d = d.withColumn("length", B.size_of("payload"))
    out = None
    for fmt in ("u8", "s16le", "s16be", "s24le", "s32le"):
        whole = A.aligned(d, A.SAMPLE_BYTES[fmt], 1).where("error_kind is null")
        s = A.decode_pcm(whole, fmt, key="doc_id").groupBy("doc_id").agg(
            F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("v").alias("sum_v"), F.sum(F.col("v") * (F.col("n") % 101)).alias("sum_iv"))
        out = s if out is None else out.unionByName(s)
    return out


@query("aligned_a2", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invalid_data: zero channels' WHEN strlen(text) % 2 <> 0 THEN 'invalid_data: partial sample'
  WHEN (strlen(text) // 2) % (doc_id % 3) <> 0 THEN 'invalid_data: not channel-aligned' END AS error_kind FROM documents""")
def _(spark, sf):
    d = documents(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return A.aligned(d, 2, F.col("doc_id") % 3).select("doc_id", "error_kind")


@query("frame_len_a3", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CASE WHEN t > 0 THEN CASE WHEN t // 2 = 0 THEN 1 ELSE 1::BIGINT << length(bin(t // 2)) END END AS frame_len
  FROM (SELECT *, (l_partkey * l_linenumber % 100000) // 10 AS t FROM lineitem)""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", A.frame_len(F.col("l_partkey") * F.col("l_linenumber") % 100000).alias("frame_len"))


S16HEX = "(substr(lpad(hex(v & 65535), 4, '0'), 3, 2) || substr(lpad(hex(v & 65535), 4, '0'), 1, 2))"


@query("frame_hashes_a4", f"""WITH {STREAMS}, f AS (SELECT *, CASE WHEN path % 5 = 0 THEN 4 ELSE 16 END AS len FROM samples)
  SELECT path, n // len AS frame_no, n // len * len AS pts, count(*) // 2 AS duration, count(*) * 2 AS size, md5(unhex(string_agg({S16HEX}, '' ORDER BY n, ch))) AS hash FROM f GROUP BY path, n // len, len""")
def _(spark, sf):
    s = streams(spark, sf)
    header = s.select("path").distinct().select("path", F.when(F.col("path") % 5 == 0, 60).otherwise(200).cast("long").alias("sample_rate"), F.lit(2).alias("channels"))
    return A.frame_hashes(s, header).select("path", "frame_no", "pts", "duration", "size", "hash")


def _doc_chunks(spark, sf):
    """Sources as streams, documents as chunks of s16le mono payload (odd lengths lose their last byte to stay whole samples)."""
    d = documents(spark, sf)
    text = F.encode("text", "utf-8")
    even = F.octet_length("text") - F.octet_length("text") % 2
    return d.select(F.col("source").alias("path"), F.col("doc_id").alias("chunk_no"), F.lit(1).alias("channels"), B.slice_bytes(text, 0, even).alias("payload"))


CHUNKS = """c AS (SELECT source AS path, doc_id AS chunk_no, hex(encode(text)) AS hx, strlen(text) // 2 AS d FROM documents),
  b AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY path ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c)"""


@query("frame_hashes_by_chunk_a5", f"""WITH {CHUNKS}, p AS (SELECT *, i FROM b, LATERAL (SELECT unnest(range((d + 255) // 256)) AS i))
  SELECT path, chunk_no, base + i * 256 AS pts, least(256, d - i * 256) AS duration, least(256, d - i * 256) * 2 AS size, md5(unhex(substr(hx, i * 1024 + 1, least(256, d - i * 256) * 4))) AS hash FROM p
  UNION ALL SELECT path, chunk_no, base, d, d * 2, md5(unhex(substr(hx, 1, d * 4))) FROM b WHERE d > 0""")
def _(spark, sf):
    c = _doc_chunks(spark, sf)
    cols = ["path", "chunk_no", "pts", "duration", "size", "hash"]
    return A.frame_hashes_by_chunk(c, 256).select(*cols).unionByName(A.frame_hashes_by_chunk(c, None).select(*cols))


@query("drop_silent_tail_a6", f"""WITH {EV}, f AS (SELECT user_id AS path, event_id AS pts, k * 16 AS duration, k % 2 = 0 AS silent, CASE WHEN user_id % 3 = 0 THEN 'pcm_s16le' ELSE 'pcm_s16be' END AS codec FROM ev)
  SELECT path, pts, duration FROM (SELECT *, max(pts) OVER (PARTITION BY path) AS m FROM f) WHERE NOT (pts = m AND duration < 1024 AND silent AND codec = 'pcm_s16be')""")
def _(spark, sf):
    f = events(spark, sf).select(
        F.col("user_id").alias("path"), F.col("event_id").alias("pts"), (F.col("k") * 16).alias("duration"), (F.col("k") % 2 == 0).alias("silent"),
        F.when(F.col("user_id") % 3 == 0, "pcm_s16le").otherwise("pcm_s16be").alias("codec_name"))
    return A.drop_silent_tail(f).select("path", "pts", "duration")


@query("volume_a7", f"WITH {STREAMS} SELECT path, n, ch, greatest(-32768, least(32767, round_even(v * 2.5::DOUBLE, 0)))::INTEGER AS v FROM samples")
def _(spark, sf):
    return A.volume(streams(spark, sf), 2.5)


_STARTS = ["0.1", ".25", "0", "1.5", "-1", "x", "2.", "0.0000333"]


@query("decimal_samples_a8", f"""WITH t AS (SELECT o_orderkey, ({sql_list(_STARTS)})[o_orderkey % 8 + 1] AS s, o_custkey + 8000 AS rate FROM orders)
  SELECT o_orderkey, CASE WHEN regexp_matches(s, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN
    (split_part(s, '.', 1) || '0')::BIGINT // 10 * rate + (rpad(split_part(s, '.', 2), 9, '0')::BIGINT * rate) // 1000000000 END AS start FROM t""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", A.decimal_samples(pick(_STARTS, F.col("o_orderkey")), F.col("o_custkey") + 8000).alias("start"))


@query("seek_a8", f"WITH {STREAMS} SELECT path, n - 12 AS n, ch, v FROM samples WHERE n >= 12")
def _(spark, sf):
    return A.seek(streams(spark, sf), A.decimal_samples(F.lit("0.25"), F.lit(48)))


def _edge(i, n):
    return f"(CASE WHEN {n} <= 1 THEN 0 WHEN {i} >= {n} THEN greatest(0, least({n} - 1, 2 * {n} - 1 - {i})) ELSE (SELECT CASE WHEN m >= {n} THEN 2 * {n} - 2 - m ELSE m END FROM (SELECT ((({i}) % (2 * {n} - 2)) + (2 * {n} - 2)) % (2 * {n} - 2) AS m)) END)"


_RS, _RT = 64, 24
_NT = A.tap_count(_RS, _RT)


def _i0_sql(x):
    """I0 by its series, written out as a list sum."""
    return f"list_sum(list_transform(range(0, 33), lambda k: pow(({x}) * ({x}) / 4.0, k) / pow(gamma(k + 1.0), 2)))"


TAP_SQL = f"""i AS (SELECT unnest(range({_RT * 1000})) AS o), ph AS (SELECT DISTINCT (o * {_RS}) % {_RT} AS ph FROM i),
  tp AS (SELECT ph, tap, tap - {(_NT - 1) / 2} - ph / {float(_RT)} AS p FROM ph, (SELECT unnest(range({_NT})) AS tap)),
  w AS (SELECT *, p / {(_NT - 1) / 2} AS w, {min(_RT / _RS, 1.0) * 0.97} AS cut FROM tp),
  c AS (SELECT ph, tap, cut * CASE WHEN abs(cut * p) < 2.3e-16 THEN 1.0 ELSE sin(pi() * cut * p) / (pi() * cut * p) END * {_i0_sql('9.0 * sqrt(greatest(0.0, 1.0 - w * w))')} / {_i0_sql('9.0')} AS coef FROM w WHERE abs(w) <= 1.0),
  k AS (SELECT ph, tap, coef / sum(coef) OVER (PARTITION BY ph) AS wt FROM c)"""


@query("resample_a9", f"""WITH {CLIPS}, {TAP_SQL}, len AS (SELECT path, count(*) AS frames FROM clips GROUP BY path),
  o AS (SELECT path, frames, unnest(range((frames * {_RT} + {_RS // 2}) // {_RS})) AS o FROM len),
  x AS (SELECT path, o, {_edge(f'(o * {_RS} // {_RT} + tap - {_NT // 2})', 'frames')} AS n, wt FROM o JOIN k ON k.ph = (o * {_RS}) % {_RT})
  SELECT x.path, o AS n, 0::INTEGER AS ch, greatest(-32768, least(32767, round_even(sum(v * wt), 0)))::INTEGER AS v FROM x JOIN clips USING (path, n) GROUP BY x.path, o""")
def _(spark, sf):
    return A.resample(clips(spark, sf), _RS, _RT)


@query("taps_a10", f"""WITH r AS (SELECT DISTINCT p_size % 12 + 4 AS source, length(p_name) % 7 + 3 AS target FROM part),
  n AS (SELECT *, least(target::DOUBLE / source, 1.0) * 0.97 AS cut FROM r), m AS (SELECT *, ceil(32.0 / cut)::BIGINT + 2 AS t0 FROM n), t AS (SELECT *, t0 + (1 - t0 % 2) AS nt FROM m),
  p AS (SELECT *, unnest(range(target // gcd(source, target))) AS phase FROM t), q AS (SELECT *, unnest(range(nt)) AS tap FROM p),
  w AS (SELECT *, tap - (nt - 1) / 2.0 - phase * gcd(source, target) / target::DOUBLE AS pos FROM q), u AS (SELECT *, pos / ((nt - 1) / 2.0) AS w FROM w),
  c AS (SELECT source, target, phase, tap, cut * CASE WHEN abs(cut * pos) < 2.3e-16 THEN 1.0 ELSE sin(pi() * cut * pos) / (pi() * cut * pos) END * {_i0_sql('9.0 * sqrt(greatest(0.0, 1.0 - w * w))')} / {_i0_sql('9.0')} AS coef FROM u WHERE abs(w) <= 1.0)
  SELECT source::BIGINT AS source, target::BIGINT AS target, phase::BIGINT AS phase, tap, round(coef / sum(coef) OVER (PARTITION BY source, target, phase), 6) + 0.0 AS weight FROM c""")
def _(spark, sf):
    rates = table(spark, sf, "part").select((F.col("p_size") % 12 + 4).cast("long").alias("source"), (F.length("p_name") % 7 + 3).cast("long").alias("target")).distinct()
    return A.taps(rates).select("source", "target", "phase", "tap", (F.round("weight", 6) + 0.0).alias("weight"))


@query("edge_index_a11", f"""WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 21 - 8 AS i, l_suppkey % 6 + 1 AS n FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (CASE WHEN n <= 1 THEN 0 WHEN i >= n THEN greatest(0, least(n - 1, 2 * n - 1 - i))
    ELSE CASE WHEN ((i % (2 * n - 2)) + (2 * n - 2)) % (2 * n - 2) >= n THEN 2 * n - 2 - ((i % (2 * n - 2)) + (2 * n - 2)) % (2 * n - 2) ELSE ((i % (2 * n - 2)) + (2 * n - 2)) % (2 * n - 2) END END)::BIGINT AS idx FROM t""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", A.edge_index(F.col("l_partkey") % 21 - 8, F.col("l_suppkey") % 6 + 1).alias("idx"))


@query("trim_a12", f"""WITH {STREAMS}, t AS (SELECT path, max(n) + 1 AS total FROM samples GROUP BY path),
  g AS (SELECT *, ((ceil((path % 4 + 1) * 0.0101 * 48000)::BIGINT + 1023) // 1024) * 1024 AS aac FROM t),
  l AS (SELECT path, CASE path % 3 WHEN 0 THEN 10 WHEN 1 THEN CASE WHEN total >= aac + 1024 THEN 1024 ELSE 0 END ELSE 0 END AS skip,
    CASE path % 3 WHEN 0 THEN greatest(0, round(0.0011 * (path % 7 + 1) * 8000)::BIGINT - 10) WHEN 1 THEN aac ELSE greatest(0, total - 16) END AS keep FROM g)
  SELECT path, n - skip AS n, ch, v FROM samples JOIN l USING (path) WHERE n - skip >= 0 AND n - skip < keep""")
def _(spark, sf):
    s = streams(spark, sf)
    total = s.groupBy("path").agg((F.max("n") + 1).alias("total"))
    p = F.col("path")
    opus = A.opus_limits((p % 7 + 1) * 0.0011, F.lit(8000), F.lit(10).cast("long"))
    aac = A.aac_limits((p % 4 + 1) * 0.0101, F.lit(48000), F.col("total"))
    vorbis = A.vorbis_limits(F.col("total"), F.lit(32))
    choose = lambda i: F.when(p % 3 == 0, opus[i]).when(p % 3 == 1, aac[i]).otherwise(vorbis[i])
    return A.trim(s, total.select("path", choose(0).alias("skip"), choose(1).alias("keep"))).select("path", "n", "ch", "v")


@query("interleave_a13", f"WITH {STREAMS} SELECT path, n * 2 + ch AS i, n AS frame, ch, v FROM samples")
def _(spark, sf):
    s = streams(spark, sf).select("path", A.interleave(F.col("n"), F.lit(2), F.col("ch")).alias("i"), "v")
    frame, ch = A.deinterleave(F.col("i"), F.lit(2).cast("long"))
    return s.select("path", "i", frame.alias("frame"), ch.cast("int").alias("ch"), "v").select("path", "i", "frame", "ch", "v")


@query("constant_per_stream_a14", f"""WITH {EV}, p AS (SELECT user_id AS path, 8000 + CASE WHEN k = 7 THEN 1 ELSE 0 END AS r, 1 + (user_id % 2) AS c FROM ev)
  SELECT path, count(*) AS n_packets, count(DISTINCT r) = 1 AND count(DISTINCT c) = 1 AS constant FROM p GROUP BY path""")
def _(spark, sf):
    p = events(spark, sf).select(F.col("user_id").alias("path"), (F.when(F.col("k") == 7, 1).otherwise(0) + 8000).alias("sample_rate"), (F.col("user_id") % 2 + 1).alias("channels"))
    return A.constant_per_stream(p)


@query("channel_layout_a15", "SELECT p_partkey, CASE p_size % 7 WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' END AS layout FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.channel_layout(F.col("p_size") % 7).alias("layout"))


@query("empty_manifest_a16", """SELECT o_orderkey AS path, coalesce(n, 0) AS n_frames FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(spark, sf):
    frames = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return A.empty_manifest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path")), frames)


@query("transform_manifest_a7", f"""WITH {STREAMS}, g AS (SELECT path, n - 10 AS n, ch, greatest(-32768, least(32767, round_even(v * 0.5::DOUBLE, 0)))::INTEGER AS v FROM samples WHERE n >= 10)
  SELECT path, n // 16 AS frame_no, n // 16 * 16 AS pts, count(*) // 2 AS duration, count(*) * 2 AS size, md5(unhex(string_agg({S16HEX}, '' ORDER BY n, ch))) AS hash FROM g GROUP BY path, n // 16""")
def _(spark, sf):
    """Gain and seek, then the frame manifest, as one plan."""
    from cinelake.plans.transform import transform_manifest

    s = streams(spark, sf)
    header = s.select("path").distinct().select("path", F.lit(200).cast("long").alias("sample_rate"), F.lit(2).alias("channels"))
    return transform_manifest(s, header, gain=0.5, start="0.05").select("path", "frame_no", "pts", "duration", "size", "hash")
