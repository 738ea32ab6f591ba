"""Container queries: events stand for packets, pages and segments, lineitem for chunks and runs, documents for files."""

from pyspark.sql import functions as F

from cinelake import rules as R
from cinelake.functions import binary as B, ordered
from cinelake.functions import digests
from cinelake.operators import boxes, containers as C, mpeg_audio
from cinelake.plans.catalog.common import documents, pick, sql_list
from cinelake.plans.registry import query, table
from cinelake.session import checkpointed
from cinelake.sources.pieces import cut

EV = "ev AS (SELECT event_id, user_id, event_type, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, (epoch_us(ts) * 9) // 100 AS pts, props FROM events)"


def events(spark, sf):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        F.call_function("div", micros * 9, F.lit(100)).alias("pts"), "props",
    )


@query("split_records_c1", """WITH t AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) // 188 AS n FROM documents)
  SELECT doc_id, i AS record_no, md5(unhex(substr(hx, (i * 376 + 1)::BIGINT, 376))) AS hash FROM t, LATERAL (SELECT unnest(range(n)) AS i)""")
def _(spark, sf):
    d = documents(spark, sf).select("doc_id", F.encode("text", "utf-8").alias("content"))
    return C.split_records(d, 188).select("doc_id", "record_no", F.md5("payload").alias("hash"))


def riff_objects(spark, sf):
    """Each document as a RIFF file with one chunk per line (built row by row, no shuffle)."""
    def chunk(line, i):
        n = F.octet_length(line)
        return F.concat(F.hex(F.lpad((i % 1000).cast("string"), 4, "l")), B.le_hex(n, 4), F.hex(line), F.when(n % 2 == 1, "00").otherwise(""))

    size = lambda body: B.le_hex(F.call_function("div", F.length(body).cast("long"), F.lit(2)), 4)
    whole = lambda body: F.unhex(F.concat(F.hex(F.lit("RIFF")), size(body), body))
    body = F.concat(F.hex(F.lit("WAVE")), F.array_join(F.transform(F.split("text", "\n"), chunk), ""))
    return documents(spark, sf).where("text is not null").select("doc_id", B.let(body, whole).alias("content"))


@query("chunk_index_c2", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  o AS (SELECT doc_id, i, strlen(line) AS n, coalesce(sum(8 + strlen(line) + strlen(line) % 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
  SELECT doc_id, (i + 1)::BIGINT AS seq, 0::BIGINT AS parent, lpad((i % 1000)::VARCHAR, 4, 'l') AS id, (before + 20)::BIGINT AS data_off, n::BIGINT AS data_len, false AS truncated FROM o
  UNION ALL SELECT doc_id, 0, NULL, 'RIFF', 8, (4 + sum(8 + n + n % 2))::BIGINT, false FROM o GROUP BY doc_id""")
def _(spark, sf):
    return C.chunk_index(riff_objects(spark, sf), "riff", key="doc_id").drop("head")


_SLICE = 200


def family_objects(spark, sf, family):
    """Each document with a text as a container: its text in nodes of at most 200 bytes. ISO: boxes inside moov/trak; Ogg: a page each; GIF: a comment block each; the last node of every seventh is cut short.

    A long text has thousands of slices: its bytes, each slice and the object are bound once (`let`), and the rows are chosen by the text, because a filter would build the objects again.
    """
    def node(part):
        size = lambda more, width: B.be_hex(F.octet_length(part) + more, width)
        if family == "iso":
            return F.concat(size(8, 4), F.hex(F.lit("sdat")), F.hex(part))
        if family == "ogg":
            return F.concat(F.hex(F.lit("OggS")), F.lit("00" * 22 + "01"), size(0, 1), F.hex(part))
        return F.concat(F.lit("21FE"), size(0, 1), F.hex(part), F.lit("00"))

    def whole(body):
        if family == "iso":
            size = F.call_function("div", F.length(body).cast("long"), F.lit(2))
            return F.concat(B.be_hex(size + 16, 4), F.hex(F.lit("moov")), B.be_hex(size + 8, 4), F.hex(F.lit("trak")), body)
        return body if family == "ogg" else F.concat(F.hex(F.lit("GIF89a")), F.lit("0" * 14), body, F.lit("3B"))

    starts = lambda b: F.sequence(F.lit(0), F.octet_length(b) - 1, F.lit(_SLICE))
    parts = lambda b: F.transform(starts(b), lambda at: F.substring(b, at + 1, F.lit(_SLICE)))
    body = B.let(F.encode("text", "utf-8"), lambda b: F.array_join(F.transform(parts(b), node), ""))
    cut_off = F.when(F.col("doc_id") % 7 == 0, 2 if family == "gif" else 1).otherwise(0)
    short = lambda x: F.substring(x, F.lit(1), F.octet_length(x) - cut_off)
    return documents(spark, sf).where("octet_length(text) > 0").select("doc_id", B.let(F.unhex(B.let(body, whole)), short).alias("content"))


_NODES = """f AS (SELECT doc_id, strlen(text) AS len, doc_id % 7 = 0 AS cut FROM documents WHERE strlen(text) > 0),
  s AS (SELECT doc_id, len, cut, i, least(200, len - i * 200) AS n, i = (len - 1) // 200 AS last FROM f, LATERAL (SELECT unnest(range((len + 199) // 200)) AS i))"""


@query("walk_boxes_c2", f"""WITH {_NODES}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  o AS (SELECT doc_id, i, strlen(line) AS n, coalesce(sum(8 + strlen(line) + strlen(line) % 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
  SELECT 'riff' AS family, doc_id, (i + 1)::BIGINT AS seq, 0::BIGINT AS parent, lpad((i % 1000)::VARCHAR, 4, 'l') AS id, (before + 20)::BIGINT AS data_off, n::BIGINT AS data_len, false AS truncated FROM o
  UNION ALL SELECT 'riff', doc_id, 0, NULL, 'RIFF', 8, (4 + sum(8 + n + n % 2))::BIGINT, false FROM o GROUP BY doc_id
  UNION ALL SELECT 'iso', doc_id, 0, NULL, 'moov', 8, len + (len + 199) // 200 * 8 + 8, cut FROM f UNION ALL SELECT 'iso', doc_id, 1, 0, 'trak', 16, len + (len + 199) // 200 * 8, cut FROM f
  UNION ALL SELECT 'iso', doc_id, i + 2, 1, 'sdat', i * 208 + 24, n, cut AND last FROM s
  UNION ALL SELECT 'ogg', doc_id, i, NULL, 'OggS', i * 228 + 28, n, cut AND last FROM s
  UNION ALL SELECT 'gif', doc_id, i, NULL, 'XFE ', i * 204 + 15, n + 2, cut AND last FROM s""")
def _(spark, sf):
    """All four families, walked over pieces of 512 bytes, so that nodes lie over borders and walks take several rounds."""
    out = None
    for family in boxes.FAMILIES:
        objects = riff_objects(spark, sf) if family == "riff" else family_objects(spark, sf, family)
        nodes, _ = boxes.walk_boxes(checkpointed(cut(objects, 512, key="doc_id")), family, key="doc_id", piece=512)
        part = nodes.select(F.lit(family).alias("family"), "doc_id", "seq", "parent", "id", "data_off", "data_len", "truncated")
        out = part if out is None else out.unionByName(part)
    return out


@query("box_rejects_c2", """WITH f AS (SELECT doc_id FROM documents WHERE strlen(text) > 0 AND doc_id % 7 = 0), k AS (SELECT unnest(['iso', 'ogg', 'gif']) AS family)
  SELECT family, doc_id, 'truncated node' AS error FROM f CROSS JOIN k""")
def _(spark, sf):
    """Containers whose last node is cut short."""
    out = None
    for family in ("iso", "ogg", "gif"):
        objects = family_objects(spark, sf, family)
        _, rejects = boxes.walk_boxes(checkpointed(cut(objects, 4096, key="doc_id")), family, key="doc_id", piece=4096)
        part = rejects.select(F.lit(family).alias("family"), "doc_id", "error")
        out = part if out is None else out.unionByName(part)
    return out


def _tail_chunks(spark, sf):
    return events(spark, sf).select(
        F.col("user_id").alias("path"), F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("data_off"), F.col("k").alias("data_len"),
        (F.col("event_id") * 10 + F.col("user_id") % 60).alias("length"), (F.col("k") > 95).alias("truncated"))


@query("tail_policy_c3", f"""WITH {EV}, c AS (SELECT user_id AS path, event_id AS seq, event_id * 10 AS data_off, k AS data_len, event_id * 10 + user_id % 60 AS length, k > 95 AS truncated FROM ev),
  s AS (SELECT path, min(seq) AS stop FROM c WHERE truncated GROUP BY path)
  SELECT 'clamp' AS mode, path, seq, greatest(0, least(data_len, length - data_off)) AS data_len FROM c
  UNION ALL SELECT 'ignore', path, seq, data_len FROM c WHERE NOT truncated
  UNION ALL SELECT 'stop', c.path, seq, data_len FROM c LEFT JOIN s ON s.path = c.path WHERE stop IS NULL OR seq < stop""")
def _(spark, sf):
    c = _tail_chunks(spark, sf)
    out = None
    for mode in ("clamp", "ignore", "stop"):
        part = C.tail_policy(c, mode).select(F.lit(mode).alias("mode"), "path", "seq", "data_len")
        out = part if out is None else out.unionByName(part)
    return out


@query("program_streams_c4", f"""WITH {EV}, known AS (SELECT user_id, k % 16 AS pid, min(event_id) AS f FROM ev WHERE event_type = 'signup' AND k % 4 <> 0 GROUP BY ALL),
  e AS (SELECT user_id, event_id, k % 16 AS pid, i AS entry_no, (k + i * i) % 3 AS es_pid, CASE (k * (i + 1)) % 4 WHEN 0 THEN 'ac3' WHEN 1 THEN 'h264' WHEN 2 THEN 'mp2' END AS codec
        FROM ev, (SELECT unnest(range(5)) AS i) WHERE event_type = 'view'),
  live AS (SELECT e.* FROM e JOIN known USING (user_id, pid) WHERE event_id > f), fst AS (SELECT user_id, min(event_id) AS event_id FROM live GROUP BY user_id),
  r AS (SELECT live.* FROM live JOIN fst USING (user_id, event_id))
  SELECT user_id AS path, es_pid, min(entry_no) AS entry_no, coalesce(max(codec) FILTER (codec = 'ac3'), arg_min(codec, entry_no) FILTER (codec IS NOT NULL)) AS codec
  FROM r GROUP BY user_id, es_pid""")
def _(spark, sf):
    e = events(spark, sf)
    pat = e.where("event_type = 'signup'").select(F.col("user_id").alias("path"), F.col("event_id").alias("packet_no"), (F.col("k") % 4).alias("program"), (F.col("k") % 16).alias("pmt_pid"))
    i = F.col("entry_no")
    pmt = e.where("event_type = 'view'").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("entry_no")).select(
        F.col("user_id").alias("path"), F.col("event_id").alias("packet_no"), (F.col("k") % 16).alias("pid"), "entry_no", ((F.col("k") + i * i) % 3).alias("es_pid"),
        F.get(F.array(F.lit("ac3"), F.lit("h264"), F.lit("mp2"), F.lit(None).cast("string")), (F.col("k") * (i + 1) % 4).cast("int")).alias("codec"))
    return C.program_streams(pat, pmt)


_TYPES = [0x02, 0x03, 0x04, 0x06, 0x1B, 0x24, 0x33, 0x11, 0x15, 0x81]
_REGS = ["H264", "HEVC", "HDMV", "DOVI", "VVC-", "Opus", "none", "none", "none"]


@query("ts_codec_c5", f"""WITH {EV}, e AS (SELECT event_id, ({_TYPES})[k % 10 + 1] AS st, ({sql_list(_REGS)})[event_id % 9 + 1] AS rg, CASE WHEN user_id % 2 = 0 THEN [10, 106] ELSE [k] END AS ds FROM ev),
  r(rank, st, rg, ds, codec) AS (VALUES {','.join(f"({i},{'NULL' if a is None else a},{'NULL' if b is None else repr(b)},{'NULL' if c is None else c},'{d}')" for i, (a, b, c, d) in enumerate(R.TS_CODEC_RULES))})
  SELECT event_id, arg_min(r.codec, r.rank) AS codec FROM e LEFT JOIN r ON (r.st IS NULL OR r.st = e.st) AND (r.rg IS NULL OR r.rg = e.rg) AND (r.ds IS NULL OR list_contains(e.ds, r.ds))
  GROUP BY event_id""")
def _(spark, sf):
    e = events(spark, sf).select(
        "event_id", F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("k") % 10).cast("int")).alias("stream_type"), pick(_REGS, F.col("event_id")).alias("registration"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit(10), F.lit(106))).otherwise(F.array(F.col("k").cast("int"))).alias("descriptors"))
    return C.ts_codec(e).select("event_id", "codec")


@query("assemble_c6", f"""WITH {EV} SELECT user_id AS path, event_id // 512 AS part_no, md5(string_agg(props, '' ORDER BY event_id)) AS hash, count(*) AS n_packets
  FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND k < 10) GROUP BY ALL""")
def _(spark, sf):
    e = events(spark, sf)
    pids = e.where("event_type = 'purchase' and k < 10").select(F.col("user_id").alias("path")).distinct()
    r = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("packet_no"), F.encode("props", "utf-8").alias("data"))
    return C.assemble(r, pids, keys=("path",), part_rows=512).select("path", "part_no", F.md5("payload").alias("hash"), "n_packets")


@query("pts_span_c7", f"""WITH {EV}, d AS (SELECT DISTINCT user_id, event_type, pts FROM ev), g AS (SELECT *, pts - lag(pts) OVER (PARTITION BY user_id, event_type ORDER BY pts) AS gap FROM d)
  SELECT user_id AS path, event_type AS pid, count(*) AS n_times, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE (max(pts) - min(pts) + min(gap)) / 90000.0 END, 6) AS duration_seconds
  FROM g GROUP BY ALL""")
def _(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_type").alias("pid"), "pts")
    return C.pts_span(e, block=1 << 32).withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("first_last_span_c7", f"""WITH {EV} SELECT user_id AS path, round(greatest(0, arg_max(p, event_id) - arg_min(p, event_id)) / 90000.0, 6) AS duration_seconds
  FROM (SELECT *, pts + k * 1000 AS p FROM ev) GROUP BY user_id""")
def _(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("path"), (F.col("pts") + F.col("k") * 1000).alias("pts"), F.col("event_id").alias("packet_no"))
    return C.first_last_span(e, keys=("path",)).withColumn("duration_seconds", F.round("duration_seconds", 6))


_SUFFIX = ["wb", "dc", "db", "wbx"]


@query("route_chunks_c8", f"""WITH {EV}, c AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN 'A' || (k % 10) ELSE lpad((k % 20)::VARCHAR, 2, '0') END || ({sql_list(_SUFFIX)})[event_id % 4 + 1] AS id FROM ev)
  SELECT event_id, id, substr(id, 1, 2)::INTEGER AS stream_index FROM c WHERE regexp_matches(id, '^[0-9][0-9]wb$')""")
def _(spark, sf):
    k = F.col("k")
    c = events(spark, sf).select("event_id", F.concat(
        F.when(k % 11 == 0, F.concat(F.lit("A"), (k % 10).cast("string"))).otherwise(F.lpad((k % 20).cast("string"), 2, "0")), pick(_SUFFIX, F.col("event_id"))).alias("id"))
    return C.route_chunks(c, "wb")


@query("cap_length_c9", """SELECT p_partkey AS path, (CASE WHEN n > 0 THEN least(p_size, n) ELSE p_size END)::BIGINT AS length FROM part
  LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def _(spark, sf):
    streams = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("length"))
    seen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"))
    return C.cap_length(streams, seen, keys=("path",))


def sample_tables(spark, sf):
    """Suppliers as tracks: orders are chunks, lines are samples; every seventh track has more samples than room."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("chunk_no")).agg(F.count("*").alias("n"))
    l = checkpointed(l)  # four tables come from it
    stco = l.select("path", "chunk_no", (F.col("chunk_no") * 1000).alias("offset"))
    group = F.call_function("div", F.col("chunk_no"), F.lit(100))
    stsc = l.select("path", (group * 100).alias("first_chunk")).distinct().withColumn("samples_per_chunk", F.call_function("div", F.col("first_chunk"), F.lit(100)) % 4 + 1)
    counted = l.withColumn("n", F.when(F.col("path") % 7 == 0, F.col("n") * 4).otherwise(F.col("n")))
    based = ordered.running_sum(counted, ["path"], "chunk_no", {"base": "n"})
    stsz = based.select("path", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("sample_no")).withColumn("size", F.col("sample_no") % 37 + 100)
    return stsc, stco, checkpointed(stsz)


@query("resolve_samples_c10", """WITH l AS (SELECT l_suppkey AS path, l_orderkey AS chunk_no, count(*) AS n FROM lineitem GROUP BY ALL),
  r AS (SELECT DISTINCT path, chunk_no // 100 * 100 AS first_chunk, (chunk_no // 100) % 4 + 1 AS spc FROM l),
  c AS (SELECT l.path, l.chunk_no, r.spc, coalesce(sum(r.spc) OVER (PARTITION BY l.path ORDER BY l.chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_sample
        FROM l ASOF JOIN r ON l.path = r.path AND l.chunk_no >= r.first_chunk),
  need AS (SELECT path, sum(CASE WHEN path % 7 = 0 THEN n * 4 ELSE n END) AS need FROM l GROUP BY path),
  room AS (SELECT path, sum(spc) AS room FROM c GROUP BY path),
  s AS (SELECT c.path, chunk_no, first_sample + i AS sample_no, i FROM c, LATERAL (SELECT unnest(range(spc)) AS i) JOIN need ON need.path = c.path JOIN room ON room.path = c.path
        WHERE room >= need AND first_sample + i < need)
  SELECT path, chunk_no, sample_no::BIGINT AS sample_no, (sample_no % 37 + 100)::BIGINT AS size,
    (chunk_no * 1000 + coalesce(sum(sample_no % 37 + 100) OVER (PARTITION BY path, chunk_no ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS sample_offset FROM s""")
def _(spark, sf):
    return C.resolve_samples(*sample_tables(spark, sf), keys=("path",)).select("path", "chunk_no", "sample_no", "size", "sample_offset")


@query("cap_chunks_c11", """WITH c AS (SELECT l_suppkey AS path, l_orderkey AS chunk_no, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL),
  b AS (SELECT path, sum(n) AS total FROM c GROUP BY path),
  t AS (SELECT c.*, least(total, ((9000 + path * 50) * 48000) // 44100) AS budget, coalesce(sum(n) OVER (PARTITION BY c.path ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts FROM c JOIN b USING (path)),
  k AS (SELECT *, greatest(0, least(n, budget - pts))::BIGINT AS take FROM t),
  s AS (SELECT path, min(chunk_no) AS stop FROM k WHERE take > 0 AND chunk_no * 4 + take * 2 > 30000 + path * 10 GROUP BY path)
  SELECT k.path, chunk_no, pts, take FROM k LEFT JOIN s USING (path) WHERE take > 0 AND (stop IS NULL OR chunk_no < stop)""")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("chunk_no")).agg(F.sum("l_quantity").cast("long").alias("n"))
    totals = c.groupBy("path").agg(F.sum("n").alias("total"))
    c = c.join(totals, "path").select(
        "path", "chunk_no", "n", (F.col("chunk_no") * 4).alias("offset"), F.lit(2).alias("block_align"), (F.col("path") * 10 + 30000).alias("length"),
        C.sample_budget(F.col("total"), F.col("path") * 50 + 9000, F.lit(48000), F.lit(44100)).alias("budget"))
    return C.cap_chunks(c).select("path", "chunk_no", "pts", "take")


def _stts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("run_no")).agg(F.sum("l_linenumber").alias("count")).select(
        "path", "run_no", "count", (F.col("run_no") % 5 + 1).alias("delta"), F.lit(1000).cast("long").alias("timescale"))


STTS = "r AS (SELECT l_suppkey AS path, l_orderkey AS run_no, sum(l_linenumber)::BIGINT AS count, l_orderkey % 5 + 1 AS delta FROM lineitem GROUP BY ALL)"


@query("timing_c12", f"""WITH {STTS}, g AS (SELECT path, sum(count)::BIGINT AS frames, sum(count * delta)::BIGINT AS ticks FROM r GROUP BY path)
  SELECT path, frames, ticks, frames * 1000 // gcd(frames * 1000, ticks) AS rate_num, ticks // gcd(frames * 1000, ticks) AS rate_den FROM g""")
def _(spark, sf):
    return C.timing(_stts(spark, sf), keys=("path",))


@query("frame_times_c12", f"""WITH {STTS}, b AS (SELECT *, coalesce(sum(count) OVER w, 0) AS f0, coalesce(sum(count * delta) OVER w, 0) AS t0 FROM r
    WINDOW w AS (PARTITION BY path ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT path, f0 + i AS frame_no, t0 + i * delta AS dts, delta FROM b, LATERAL (SELECT unnest(range(count)) AS i))
  SELECT path, (dts // 50)::BIGINT AS bucket, count(*) AS n, sum(frame_no)::BIGINT AS frames, sum(dts)::BIGINT AS dts, sum(delta)::BIGINT AS duration FROM f GROUP BY ALL""")
def _(spark, sf):
    f = C.frame_times(_stts(spark, sf), keys=("path",))
    return f.groupBy("path", F.call_function("div", F.col("dts"), F.lit(50)).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("frame_no").alias("frames"), F.sum("dts").alias("dts"), F.sum("duration").alias("duration"))


@query("fragment_duration_c13", f"""WITH {EV}, u AS (SELECT user_id AS path, event_id // 500 AS traf_no, event_id, CASE WHEN k % 3 <> 0 THEN k END AS duration FROM ev),
  t AS (SELECT path, traf_no, min(event_id) AS base_time, CASE WHEN traf_no % 2 = 0 THEN 40 END AS dflt, count(*) AS n, sum(coalesce(duration, CASE WHEN traf_no % 2 = 0 THEN 40 END, path % 7)) AS d FROM u GROUP BY ALL)
  SELECT path, round(max(base_time + d) / 600.0, 6) AS fragment_seconds FROM t GROUP BY path""")
def _(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("path"), F.call_function("div", F.col("event_id"), F.lit(500)).alias("traf_no"), "event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("duration"))
    traf = e.groupBy("path", "traf_no").agg(F.min("event_id").alias("base_time")).withColumn("default_duration", F.when(F.col("traf_no") % 2 == 0, 40).cast("long"))
    movie = e.groupBy("path").agg(F.lit(600).cast("long").alias("timescale")).withColumn("default_duration", F.col("path") % 7)
    return C.fragment_duration(traf, e, movie).withColumn("fragment_seconds", F.round("fragment_seconds", 6))


@query("fill_durations_c14", """WITH s AS (SELECT l_orderkey AS path, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 0.0 ELSE l_quantity END AS d FROM lineitem),
  a AS (SELECT s.*, CASE WHEN coalesce(d, 0) = 0 AND path % 3 = 0 THEN 2.5 WHEN coalesce(d, 0) = 0 THEN NULL ELSE d END AS f FROM s),
  b AS (SELECT *, max(f) OVER (PARTITION BY path) AS m FROM a),
  c AS (SELECT *, CASE WHEN coalesce(f, 0) = 0 AND m > 0 THEN m ELSE coalesce(f, d) END AS g FROM b)
  SELECT path, l_linenumber, l_partkey, l_suppkey, CASE WHEN path % 2 = 0 AND g > 20.0 THEN 20.0 ELSE g END AS duration_seconds FROM c""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_partkey") % 3 == 1, 0.0).when(F.col("l_partkey") % 3 == 2, F.col("l_quantity")).alias("duration_seconds"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    return C.fill_durations(s, o.where("path % 3 = 0").withColumn("fragment_seconds", F.lit(2.5)), o.where("path % 2 = 0").withColumn("movie_seconds", F.lit(20.0)))


@query("associate_c15", f"""WITH {EV}, p AS (SELECT DISTINCT user_id AS path, k % 9 + 1 AS prop_no FROM ev WHERE event_type = 'click'),
  q AS (SELECT path, prop_no, CASE prop_no % 3 WHEN 0 THEN 'hevc' END AS codec, CASE prop_no % 3 WHEN 1 THEN path * 16 END AS width, CASE prop_no % 3 WHEN 1 THEN prop_no * 8 END AS height FROM p),
  i AS (SELECT user_id AS path, event_id AS item_id, unnest([k % 5, k % 7, k // 10, k % 11]) AS p, unnest([0, 1, 2, 3]) AS pos FROM ev WHERE event_type <> 'click'),
  j AS (SELECT i.*, codec, width, height FROM i JOIN q ON q.path = i.path AND q.prop_no = i.p WHERE i.p > 0)
  SELECT path, item_id, arg_max(codec, pos) FILTER (codec IS NOT NULL) AS codec, arg_max(width, pos) FILTER (width IS NOT NULL) AS width, arg_max(height, pos) FILTER (width IS NOT NULL) AS height
  FROM j GROUP BY path, item_id HAVING count(codec) > 0 AND count(width) > 0""")
def _(spark, sf):
    e = events(spark, sf)
    k, n = F.col("k"), F.col("prop_no")
    props = e.where("event_type = 'click'").select(F.col("user_id").alias("path"), (k % 9 + 1).alias("prop_no")).distinct().select(
        "path", "prop_no", F.when(n % 3 == 0, "hevc").alias("codec"), F.when(n % 3 == 1, F.col("path") * 16).alias("width"), F.when(n % 3 == 1, n * 8).alias("height"))
    items = e.where("event_type <> 'click'").select(
        F.col("user_id").alias("path"), F.col("event_id").alias("item_id"), F.array(k % 5, k % 7, F.call_function("div", k, F.lit(10)), k % 11).alias("props"))
    return C.associate(items, props)


@query("last_granule_c16", f"""WITH {EV}, p AS (SELECT user_id % 10 AS path, user_id AS serial, event_id AS page_no, k - 1 AS granule, event_id % 1777 = 1776 AS truncated FROM ev),
  e AS (SELECT path, min(page_no) AS stop FROM p WHERE truncated GROUP BY path),
  q AS (SELECT p.* FROM p LEFT JOIN e USING (path) WHERE stop IS NULL OR page_no <= stop),
  g AS (SELECT path, serial, arg_max(granule, page_no) FILTER (NOT truncated AND granule <> -1) AS last_granule, min(page_no) AS first_page, count(*) AS n_pages FROM q GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_page) - 1 AS stream_index FROM g""")
def _(spark, sf):
    p = events(spark, sf).select(
        (F.col("user_id") % 10).alias("path"), F.col("user_id").alias("serial"), F.col("event_id").alias("page_no"), (F.col("k") - 1).alias("granule"),
        (F.col("event_id") % 1777 == 1776).alias("truncated"))
    return C.last_granule(p)


SEG = "s AS (SELECT user_id AS path, event_id AS seg_no, CASE WHEN k < 40 THEN 255 ELSE k END AS len FROM ev), lastseg AS (SELECT path FROM s GROUP BY path HAVING arg_max(len, seg_no) = 255), p AS (SELECT *, coalesce(sum((len < 255)::INT) OVER (PARTITION BY path ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS packet_no FROM s WHERE path NOT IN (SELECT path FROM lastseg))"


def _segments(spark, sf):
    return events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("seg_no"), F.when(F.col("k") < 40, 255).otherwise(F.col("k")).alias("len"))


@query("packets_from_segments_c17", f"WITH {EV}, {SEG} SELECT path, seg_no, packet_no FROM p")
def _(spark, sf):
    return C.packets_from_segments(_segments(spark, sf)).select("path", "seg_no", "packet_no")


@query("packet_sizes_c17", f"WITH {EV}, {SEG} SELECT path, packet_no, sum(len)::BIGINT AS size, count(*) AS n_segments, min(seg_no) AS first_seg FROM p GROUP BY path, packet_no")
def _(spark, sf):
    return C.packet_sizes(C.packets_from_segments(_segments(spark, sf)))


_PAGES = (510, 510, 300)


def ogg_packet_objects(spark, sf):
    """Each document as an Ogg object: pages of 510, 510 and 300 bytes in turn, so that a packet goes over three pages; a last page that fills its last segment leaves its packet open."""
    d = documents(spark, sf).select("doc_id", F.encode("text", "utf-8").alias("b"))
    n = F.octet_length("b")
    whole = F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(sum(_PAGES))).cast("int"))
    spans = F.flatten(F.transform(whole, lambda k: F.array(*[F.struct((k * sum(_PAGES) + sum(_PAGES[:i])).alias("at"), F.lit(size).alias("size")) for i, size in enumerate(_PAGES)])))

    def page(x):
        size = F.least(x["size"], n - x["at"])
        full, rest = F.call_function("div", size, F.lit(255)).cast("int"), size % 255
        lacing = F.concat(F.repeat(F.lit("FF"), full), F.when(rest > 0, B.be_hex(rest, 1)).otherwise(""))
        return F.concat(F.hex(F.lit("OggS")), F.lit("00" * 22), B.be_hex(full + F.when(rest > 0, 1).otherwise(0), 1), lacing, F.hex(F.substring("b", x["at"] + 1, size)))

    pages = F.transform(F.filter(spans, lambda x: x["at"] < n), page)
    return d.where(n > 0).select("doc_id", F.unhex(F.array_join(pages, "")).alias("content"))


def _ogg_packets(spark, sf, piece=1000):
    pieces = checkpointed(cut(ogg_packet_objects(spark, sf).withColumnRenamed("doc_id", "path"), piece))
    nodes, _ = boxes.walk_boxes(pieces, "ogg", piece=piece)
    pages = checkpointed(C.ogg_pages(nodes))
    return pieces, pages, C.ogg_segments(pages)


_OPEN = "CASE WHEN len % 1320 = 0 THEN 300 WHEN len % 1320 <= 510 THEN len % 1320 WHEN len % 1320 <= 1020 THEN len % 1320 - 510 ELSE len % 1320 - 1020 END % 255 = 0"


@query("packet_payload_c17", f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS len FROM documents WHERE strlen(text) > 0)
  SELECT doc_id AS path, i AS packet_no, least(1320, len - i * 1320) AS size, md5(unhex(substr(hx, (i * 2640 + 1)::BIGINT, 2640))) AS hash FROM d, LATERAL (SELECT unnest(range((len + 1319) // 1320)) AS i) WHERE NOT ({_OPEN})""")
def _(spark, sf):
    """Packets of Ogg objects: pages walked over pieces, segments numbered, bytes fetched from the pieces they lie in, and digested part by part."""
    pieces, pages, segments = _ogg_packets(spark, sf)
    ranges = boxes.packet_ranges(pages, C.packets_from_segments(segments, keys=("path", "serial")))
    parts = boxes.range_bytes(ranges, pieces, ["path", "packet_no", "page_no"], piece=1000)
    return digests.fold_md5(parts, ["path", "packet_no"], ["page_no", "part_no"]).select("path", "packet_no", "size", "hash")


@query("open_packets_c17", f"SELECT doc_id AS path FROM (SELECT doc_id, strlen(text) AS len FROM documents WHERE strlen(text) > 0) WHERE {_OPEN}")
def _(spark, sf):
    _, _, segments = _ogg_packets(spark, sf)
    return C.open_packets(segments, ["path", "serial"], "seg_no", "len").select("path")


@query("granule_frames_c18", f"""WITH {EV}, g AS (SELECT event_id, event_id * 977 + k AS g, k % 12 AS s FROM ev)
  SELECT event_id, CASE WHEN s = 0 THEN g ELSE (g >> s) + (g & ((1::BIGINT << s) - 1)) END AS frames, (g * 4294967296 // 4294967296) AS high FROM g""")
def _(spark, sf):
    g = (F.col("event_id") * 977 + F.col("k")).alias("g")
    e = events(spark, sf).select("event_id", g, (F.col("k") % 12).cast("int").alias("s"))
    return e.select("event_id", C.granule_frames(F.col("g"), F.col("s")).alias("frames"), F.shiftright(F.shiftleft("g", 32), 32).alias("high"))


@query("attach_tag_duration_c19", f"""WITH {EV}, e AS (SELECT *, event_id // 4 AS path FROM ev),
  s AS (SELECT path, event_id AS stream_id, k % 3 AS track_uid, ['h264', 'hevc', 'vp9'][k % 3 + 1] AS codec_name, CASE WHEN k % 2 = 0 THEN 1.5 END AS d FROM e WHERE event_type IN ('view', 'signup')),
  t AS (SELECT path, k % 3 AS track_uid, CASE WHEN k % 5 = 0 THEN 'TITLE' ELSE 'DURATION' END AS name, k % 7 = 0 AS has_language,
    CASE WHEN k % 11 = 0 THEN 'x:1:2' WHEN k % 13 = 0 THEN '1:2' ELSE (k % 3) || ':' || (k % 60) || ':' || (event_id % 60) || '.250' END AS value, event_id AS tag_no FROM e WHERE event_type = 'click'),
  u AS (SELECT path, track_uid, arg_max(split_part(value, ':', 1)::DOUBLE * 3600 + split_part(value, ':', 2)::DOUBLE * 60 + split_part(value, ':', 3)::DOUBLE, tag_no) AS secs FROM t
        WHERE name = 'DURATION' AND NOT has_language AND regexp_matches(value, '^[0-9]+:[0-9]+:[0-9.]+$') GROUP BY ALL),
  n AS (SELECT path, count(*) AS n FROM s GROUP BY path)
  SELECT s.path, stream_id, CASE WHEN codec_name IN ('h264', 'hevc') AND d IS NULL THEN coalesce(secs, CASE WHEN n = 1 AND s.path % 2 <> 0 AND s.path NOT IN (SELECT path FROM t) THEN s.path * 0.5 END) ELSE d END AS duration_seconds
  FROM s LEFT JOIN u USING (path, track_uid) JOIN n USING (path)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("path", F.call_function("div", F.col("event_id"), F.lit(4)))
    k = F.col("k")
    s = e.where("event_type in ('view', 'signup')").select(
        "path", F.col("event_id").alias("stream_id"), (k % 3).alias("track_uid"), pick(["h264", "hevc", "vp9"], k).alias("codec_name"), F.when(k % 2 == 0, 1.5).alias("duration_seconds"))
    clock = F.concat((k % 3).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":"), (F.col("event_id") % 60).cast("string"), F.lit(".250"))
    tags = e.where("event_type = 'click'").select(
        "path", (k % 3).alias("track_uid"), F.when(k % 5 == 0, "TITLE").otherwise("DURATION").alias("name"), (k % 7 == 0).alias("has_language"),
        F.when(k % 11 == 0, "x:1:2").when(k % 13 == 0, "1:2").otherwise(clock).alias("value"), F.col("event_id").alias("tag_no"))
    segments = e.select("path").distinct().select("path", (F.col("path") * 0.5).alias("segment_seconds"), (F.col("path") % 2).alias("first_cluster_time"))
    return C.attach_tag_duration(s, tags, segments).select("path", "stream_id", "duration_seconds")


_HANDLERS = {"view": "sbtl", "signup": "subt", "click": "text", "purchase": "soun"}


@query("accept_empty_c20", f"""WITH {EV}, e AS (SELECT *, event_id // 3 AS path FROM ev), o AS (SELECT DISTINCT path FROM e),
  t AS (SELECT path, CASE event_type WHEN 'view' THEN 'sbtl' WHEN 'signup' THEN 'subt' WHEN 'click' THEN 'text' ELSE 'soun' END AS kind, event_type = 'purchase' AND k > 50 AS ok FROM e WHERE event_type <> 'error'),
  f AS (SELECT path, bool_and(kind IN ('sbtl', 'subt', 'text')) AS ign, count(*) FILTER (ok) AS n FROM t GROUP BY path)
  SELECT o.path, coalesce(n, 0) AS n_streams FROM o LEFT JOIN f USING (path) WHERE coalesce(n, 0) > 0 OR coalesce(ign, false)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("path", F.call_function("div", F.col("event_id"), F.lit(3)))
    kind = F.when(F.col("event_type") == "view", "sbtl").when(F.col("event_type") == "signup", "subt").when(F.col("event_type") == "click", "text").otherwise("soun")
    tracks = e.where("event_type <> 'error'").select("path", kind.alias("kind"), ((F.col("event_type") == "purchase") & (F.col("k") > 50)).alias("supported"))
    return C.accept_empty(e.select("path").distinct(), tracks)


CHAIN_SQL = f"""WITH RECURSIVE {EV}, c AS (SELECT user_id AS path, event_id AS off, event_id + k * 20 + 1 AS target FROM ev),
  n AS (SELECT c.path, c.off, min(d.off) AS nxt FROM c JOIN c AS d ON d.path = c.path AND d.off >= c.target GROUP BY ALL),
  w(path, off) AS (SELECT path, min(off) FROM c GROUP BY path UNION ALL SELECT n.path, n.nxt FROM w JOIN n ON n.path = w.path AND n.off = w.off)
  SELECT path, count(*) AS n_frames, min(off) AS first_off, max(off) AS last_off FROM w GROUP BY path"""


@query("frame_chain_c21", CHAIN_SQL)
def _(spark, sf):
    c = events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("off"), (F.col("k") * 20 + 1).alias("frame_len"))
    return C.frame_chain(c, block=4096)


@query("frame_chain_strict_c21", """WITH RECURSIVE c AS (SELECT event_type AS path, event_id AS off, event_id + regexp_extract(props, '([0-9]+)', 1)::BIGINT % 3 + 1 AS target FROM events),
  w(path, off) AS (SELECT path, min(off) FROM c GROUP BY path UNION ALL SELECT d.path, d.off FROM w JOIN c ON c.path = w.path AND c.off = w.off JOIN c AS d ON d.path = c.path AND d.off = c.target)
  SELECT path, count(*) AS n_frames, min(off) AS first_off, max(off) AS last_off FROM w GROUP BY path""")
def _(spark, sf):
    c = events(spark, sf).select(F.col("event_type").alias("path"), F.col("event_id").alias("off"), (F.col("k") % 3 + 1).alias("frame_len"))
    return C.frame_chain(c, resync=False, block=256)


@query("mpeg_streams_c21", """WITH d AS (SELECT doc_id, strlen(text) // 413 AS n FROM documents) SELECT doc_id, 'mp3' AS codec_name, 44100::BIGINT AS sample_rate, 2::BIGINT AS channels, n AS n_frames,
  CASE WHEN doc_id % 3 = 0 THEN 110 ELSE 0 END::BIGINT AS first_off, round(n * 1152 / 44100.0::DOUBLE, 6) AS duration_seconds FROM d WHERE n > 0""")
def _(spark, sf):
    """Each document as an MPEG audio object: its text as frames of 417 bytes, stray bytes between some of them, a leading tag on every third, and a trailing one with a frame behind it on every fifth."""
    d = documents(spark, sf).select("doc_id", F.encode("text", "utf-8").alias("b"))
    n = F.call_function("div", F.octet_length("b"), F.lit(413)).cast("int")
    frame = lambda i: F.concat(F.lit("FFFB9000"), F.hex(F.substring("b", i * 413 + 1, F.lit(413))), F.when(i % 4 == 3, F.lit("00FF00")).otherwise(""))
    lead = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("49443303000000000064"), F.repeat(F.lit("FF"), 100))).otherwise("")
    trail = F.when(F.col("doc_id") % 5 == 0, F.concat(F.hex(F.lit("TAG")), F.lit("FFFB9000"), F.repeat(F.lit("00"), 413))).otherwise("")
    body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), frame), "")
    objects = d.where(n > 0).select(F.col("doc_id"), F.unhex(F.concat(lead, body, trail)).alias("content"))
    found = mpeg_audio.streams(checkpointed(cut(objects, 1000, halo=mpeg_audio.HALO, key="doc_id")), 1000, key="doc_id")
    return found.drop("last_off").withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("inject_params_c22", """WITH u AS (SELECT conv_id % 7 AS path, conv_id AS packet_no, turn AS unit_no, CASE length(text) % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'G' WHEN 2 THEN 'H' ELSE 'a' END || text AS unit FROM conversations),
  y AS (SELECT *, ascii(unit) & 31 AS ty FROM u), f AS (SELECT path, packet_no, min(unit_no) FILTER (ty = 5) AS idr, min(unit_no) FILTER (ty = 7) AS sps, min(unit_no) FILTER (ty = 8) AS pps FROM y GROUP BY ALL),
  n AS (SELECT * FROM f WHERE idr IS NOT NULL AND NOT coalesce(sps < idr AND pps < idr, false))
  SELECT path, packet_no, unit_no, 1073741824::BIGINT AS sub, md5(chr(0) || chr(0) || chr(1) || unit) AS hash FROM y
  UNION ALL SELECT path, packet_no, idr, i, md5(chr(0) || chr(0) || chr(1) || ['Gset', 'Gmore', 'Hset'][i + 1] || path) FROM n, (SELECT unnest(range(3)) AS i)""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    lead = pick(["E", "G", "H", "a"], F.length("text"))
    units = c.select((F.col("conv_id") % 7).alias("path"), F.col("conv_id").alias("packet_no"), F.col("turn").alias("unit_no"), F.encode(F.concat(lead, F.col("text")), "utf-8").alias("unit"))
    params = units.select("path").distinct().select(
        "path", F.posexplode(F.array(F.lit("Gset"), F.lit("Gmore"), F.lit("Hset"))).alias("param_no", "t")).select("path", "param_no", F.encode(F.concat("t", F.col("path").cast("string")), "utf-8").alias("unit"))
    return C.inject_params(units, params).select("path", "packet_no", "unit_no", "sub", F.md5("unit").alias("hash"))
