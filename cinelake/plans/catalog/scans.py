"""Source and sink queries: text, JSON and object forms derived from the driver tables, read or written by the library."""

from pyspark.sql import functions as F

from cinelake.operators import audio as A
from cinelake.plans.catalog.audio import S16HEX, STREAMS, streams
from cinelake.plans.catalog.common import documents, pick, sql_list
from cinelake.plans.catalog.containers import EV, events
from cinelake.plans.registry import query, table
from cinelake.session import fresh_folder
from cinelake.sources import corpus, framehash, pieces, probe_json, reports, synth, wav


@query("scan_corpus_s1")
def _(spark, sf):
    """The data folder itself as a corpus: names, suffixes and lengths of all files, bytes unread."""
    return corpus.scan_corpus(spark, sf, content=False)


@query("scan_pieces_s1", """WITH d AS (SELECT source || '/' || lang || '_' || doc_id || '.TXT' AS path, hex(encode(text)) AS hx, strlen(text) AS length FROM documents)
  SELECT path, 'txt' AS ext, length, i AS piece_no, i * 1000 AS "offset", least(1000, length - i * 1000) AS size, md5(unhex(substr(hx, (i * 2000 + 1)::BIGINT, 2000))) AS hash
  FROM d, LATERAL (SELECT unnest(range(greatest(1, (length + 999) // 1000))) AS i)""")
def _(spark, sf):
    """Each document written as an object of two parts, and read back in pieces of 1,000 bytes."""
    d = documents(spark, sf).select(F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), F.encode("text", "utf-8").alias("b"))
    half = F.call_function("div", F.octet_length("b"), F.lit(2)).cast("int")
    parts = d.select("path", F.posexplode(F.array(F.substring("b", F.lit(1), half), F.substring("b", half + 1, F.octet_length("b")))).alias("part_no", "bytes"))
    folder = fresh_folder(spark, "objects")
    pieces.write_objects(parts, folder)
    p = pieces.scan_pieces(spark, folder, piece=1000)
    return p.select(F.url_decode("path").alias("path"), "ext", "length", "piece_no", "offset", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("hash"))


_ROWS = ["0, {e}, {e}, 1, {k}, ab{k}", "# comment {k}", "  ", "0,{e},{e},2,{k},cd{k}", "0,{e},x,2,{k},cd{k}", "0,{e},{e},2,{k}", " 1 , -{e}, {e} ,3, {k} , ef{k} "]
_LINES = [r.replace("{e}", "%1$d").replace("{k}", "%2$d") for r in _ROWS]
_SQL_LINE = "CASE event_id % 7 " + " ".join(
    f"WHEN {i} THEN '" + r.replace("{e}", "' || event_id || '").replace("{k}", "' || k || '") + "'" for i, r in enumerate(_ROWS)) + " END"


def _hash_lines(spark, sf):
    e = events(spark, sf)
    line = None
    for i, r in enumerate(_LINES):
        text = F.format_string(r, "event_id", "k")
        line = F.when(F.col("event_id") % 7 == i, text) if line is None else line.when(F.col("event_id") % 7 == i, text)
    return e.select("event_id", line.alias("value"))


@query("read_framehash_s4", f"""WITH {EV} SELECT event_id, CASE event_id % 7 WHEN 6 THEN 1 ELSE 0 END::INTEGER AS stream_index, CASE event_id % 7 WHEN 6 THEN -event_id ELSE event_id END AS dts, event_id AS pts,
  CASE event_id % 7 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END::BIGINT AS duration, k AS size, CASE event_id % 7 WHEN 0 THEN 'ab' WHEN 3 THEN 'cd' ELSE 'ef' END || k AS hash FROM ev WHERE event_id % 7 IN (0, 3, 6)""")
def _(spark, sf):
    return framehash.parse_framehash(_hash_lines(spark, sf))[0]


@query("framehash_rejects_s4", f"""WITH {EV} SELECT event_id, 'invalid_data' AS error_kind, 'invalid frame row: ' || {_SQL_LINE} AS message FROM ev WHERE event_id % 7 IN (4, 5)""")
def _(spark, sf):
    return framehash.parse_framehash(_hash_lines(spark, sf))[1]


@query("framehash_lines_s5", f"""WITH {STREAMS}, f AS (SELECT path, n // 16 AS frame_no, n // 16 * 16 AS pts, count(*) // 2 AS duration, count(*) * 2 AS size, md5(unhex(string_agg({S16HEX}, '' ORDER BY n, ch))) AS hash FROM samples GROUP BY path, n // 16),
  h AS (SELECT path, unnest(['#format: frame checksums', '#version: 2', '#hash: MD5', '#software: cinelake', '#tb 0: 1/200', '#media_type 0: audio', '#codec_id 0: pcm_s16le', '#sample_rate 0: 200', '#channel_layout_name 0: stereo', '#stream#, dts, pts, duration, size, hash']) AS line,
    unnest(range(10)) - 100 AS line_no FROM (SELECT DISTINCT path FROM samples))
  SELECT path, line_no, line FROM h UNION ALL SELECT path, frame_no, printf('0, %d, %d, %d, %d, %s', pts, pts, duration, size, hash) FROM f""")
def _(spark, sf):
    s = streams(spark, sf)
    header = s.select("path").distinct().withColumn("sample_rate", F.lit(200).cast("long")).withColumn("channels", F.lit(2))
    full = header.select("*", F.lit("audio").alias("media"), F.lit(1).alias("tb_num"), F.lit(200).alias("tb_den"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
    return framehash.framehash_lines(A.frame_hashes(s, header), full)


@query("read_probe_json_s6", """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_custkey FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN 'wav' END AS format, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey % 50000 END AS sample_rate, CASE WHEN o_orderkey % 10 <> 0 AND o_custkey % 2 = 0 THEN round(o_totalprice / 1000, 6) END AS duration_seconds, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS codec_name FROM t""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(
        F.lit('{"format": "wav", "streams": [{"index": 0, "codec_type": "audio", "codec_name": "'), F.col("o_orderpriority"), F.lit('", "sample_rate": '), (F.col("o_custkey") % 50000).cast("string"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(', "duration_seconds": '), F.round(F.col("o_totalprice") / 1000, 6).cast("string"))).otherwise(""), F.lit("}]}"))
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "{broken").otherwise(text).alias("json"))
    s = F.get("doc.streams", F.lit(0))
    d = probe_json.read_probe_json(o)
    return d.select("o_orderkey", "doc.format", s["sample_rate"].alias("sample_rate"), s["duration_seconds"].alias("duration_seconds"), s["codec_name"].alias("codec_name"))


@query("to_probe_json_s7", """WITH s AS (SELECT p_partkey AS path, i, '{"index":' || i || ',"codec_type":"' || CASE WHEN i = 0 THEN 'audio' ELSE 'video' END || '","codec_name":"' || p_type || '"' || CASE WHEN i = 0 THEN ',"sample_rate":' || (p_size * 1000) ELSE '' END
    || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"duration_seconds":' || printf('%.6f', p_size / 4.0) END || CASE WHEN i = 1 THEN ',"width":' || p_size ELSE '' END || '}' AS j FROM part, (SELECT unnest(range(2)) AS i) WHERE p_partkey % 5 <> 0)
  SELECT p_partkey AS path, '{"format":"' || p_brand || '","streams":[' || coalesce((SELECT string_agg(j, ',' ORDER BY i) FROM s WHERE s.path = p_partkey), '') || ']}' AS json FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = p.where("p_partkey % 5 <> 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("index"))
    audio = F.col("index") == 0
    s = s.select(
        F.col("p_partkey").alias("path"), "index", F.when(audio, "audio").otherwise("video").alias("codec_type"), F.col("p_type").alias("codec_name"), F.when(audio, F.col("p_size") * 1000).alias("sample_rate"),
        F.lit(None).cast("int").alias("channels"), F.lit(None).cast("int").alias("bits_per_sample"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 4.0).alias("duration_seconds"),
        F.when(~audio, F.col("p_size")).alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("string").alias("frame_rate"))
    return probe_json.to_probe_json(s, p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("format")))


@query("remux_wav_s10", f"""WITH {STREAMS}, b AS (SELECT path, n // 32 + 1 AS part_no, string_agg({S16HEX}, '' ORDER BY n, ch) AS hx FROM samples GROUP BY ALL)
  SELECT path, part_no, length(hx) // 2 AS size, md5(unhex(hx)) AS hash FROM b UNION ALL
  SELECT DISTINCT path, 0, 78, md5(unhex('52494646FFFFFFFF57415645666D7420100000000100' || '0200' || '401F0000' || '007D0000' || '0400' || '1000' || hex('LIST') || '1A000000' || hex('INFOISFT') || '0D000000' || hex('Lavf62.3.100') || '0000' || hex('data') || 'FFFFFFFF')) FROM samples""")
def _(spark, sf):
    s = streams(spark, sf)
    header = s.select("path").distinct().select("path", F.lit(8000).alias("sample_rate"), F.lit(2).alias("channels"))
    return wav.remux_wav(s, header, part_frames=32).select("path", "part_no", F.octet_length("bytes").cast("long").alias("size"), F.md5("bytes").alias("hash"))


_TONES = [s[0] for s in synth.SAMPLES.values()]


@query("synth_s11", f"""WITH p AS (SELECT p_partkey AS path, ({sql_list(_TONES)})[p_partkey % 6 + 1] AS kind, 8000 + p_size AS rate, p_size % 2 + 1 AS channels, p_size AS frames FROM part),
  s AS (SELECT path, kind, rate, i, c FROM p, LATERAL (SELECT unnest(range(frames)) AS i), LATERAL (SELECT unnest(range(channels)) AS c)),
  v AS (SELECT path, i AS n, c::INTEGER AS ch, trunc(CASE kind WHEN 'silence' THEN 0 WHEN 'sine_per_channel' THEN sin(2 * pi() * (220 + c * 220) * i / rate) * 12000 WHEN 'ramp' THEN (i % 64 - 32) * 128 WHEN 'sine' THEN sin(2 * pi() * 440 * i / rate) * 9000
    WHEN 'saw' THEN i * 23 - 512 ELSE 128 + trunc(sin(2 * pi() * 220 * i / rate) * 80) END)::INTEGER AS v FROM s) SELECT * FROM v""")
def _(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("path"), pick(_TONES, F.col("p_partkey")).alias("kind"), (F.col("p_size") + 8000).alias("rate"), (F.col("p_size") % 2 + 1).alias("channels"), F.col("p_size").alias("frames"))
    return synth.synth(p, block=16)


@query("read_bench_s12", """SELECT c_custkey, i::INTEGER AS ord, CASE i WHEN 0 THEN 'oracle probe ' || c_mktsegment ELSE 'ours probe ' || c_mktsegment END AS label, CASE i WHEN 0 THEN c_acctbal ELSE c_nationkey::DOUBLE END AS mean FROM customer, (SELECT unnest(range(2)) AS i)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    entry = lambda tool, mean: F.struct(F.concat(F.lit(f"{tool} probe "), "c_mktsegment").alias("command"), mean.cast("double").alias("mean"), F.lit(0.1).alias("stddev"))
    docs = c.select("c_custkey", F.to_json(F.struct(F.array(entry("oracle", F.col("c_acctbal")), entry("ours", F.col("c_nationkey"))).alias("results"))).alias("json"))
    return reports.parse_bench(docs, keep=("c_custkey",))


@query("read_run_logs_s13", """WITH t AS (SELECT doc_id, lang, n_chars FROM documents)
  SELECT doc_id AS run_id, 0::INTEGER AS ord, 'status' AS key, lang AS value FROM t UNION ALL SELECT doc_id, 1, 'after_score', n_chars::VARCHAR FROM t
  UNION ALL SELECT doc_id, 2, 'strict', (n_chars // 2)::VARCHAR FROM t UNION ALL SELECT doc_id, 3, 'accepted', n_chars::VARCHAR FROM t""")
def _(spark, sf):
    d = documents(spark, sf)
    n = F.col("n_chars").cast("string")
    text = F.concat(F.lit("# run\n\n- status: "), "lang", F.lit("\r\n- after_score: "), n, F.lit("\n\n```text\n"), F.call_function("div", F.col("n_chars"), F.lit(2)).cast("string"), F.lit(" / "), n, F.lit(" strict media matches\n```\nx - no: field\n"))
    return reports.parse_run_logs(d.select("doc_id", text.alias("text")), name="doc_id")


@query("report_rows_s8", """SELECT o_orderkey AS ord, o_orderstatus AS status, '2024-01-01T00:00:00Z' AS generated_at, 'abc123' AS commit FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return reports.stamped(rows, {"generated_at": "2024-01-01T00:00:00Z", "commit": "abc123"})
