"""Frame queries: embeddings stand for 8x8 images, lineitem for runs, rates and delays, events for patches over a small canvas."""

from pyspark.sql import functions as F

from cinelake.functions import binary as B, rational
from cinelake.operators import frames as V
from cinelake.plans.catalog.audio import S16HEX
from cinelake.plans.catalog.common import documents, pick, sql_list
from cinelake.plans.catalog.containers import EV, events
from cinelake.plans.registry import query, table

LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LK = ", ".join(LKEY)
_RATES = ["30000/1001", "25/1", "0/1", "24/0", "abc", "12", "60/1"]
PIX = """img AS (SELECT vec_id AS path, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
  px AS (SELECT path, i, i // 8 AS y, i % 8 AS x, greatest(0, least(255, floor(e * 400 + 128)))::BIGINT AS v, e FROM img)"""


def pixels(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("i", "e"))
    i, e8 = F.col("i").cast("long"), F.col("e").cast("double")
    v = F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), F.floor(e8 * 400 + 128)))
    return e.select("path", i.alias("i"), F.call_function("div", i, F.lit(8)).alias("y"), (i % 8).alias("x"), v.alias("v"), e8.alias("e"))


def rgba(spark, sf):
    """Lines as colours."""
    l = table(spark, sf, "lineitem")
    return l.select(*LKEY, F.struct((F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"), ((F.col("l_quantity") * 5).cast("long") % 256).alias("a")).alias("p"))


RGBA = f"p AS (SELECT {LK}, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b, (l_quantity * 5)::BIGINT % 256 AS a FROM lineitem)"


@query("frame_count_v1", f"""WITH t AS (SELECT {LK}, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (l_quantity - 5) / 3 END AS d, ({sql_list(_RATES)})[l_partkey % 7 + 1] AS r FROM lineitem),
  p AS (SELECT *, CASE WHEN regexp_matches(r, '^[0-9]+/[0-9]+$') THEN nullif(split_part(r, '/', 1)::BIGINT, 0) END AS n, CASE WHEN regexp_matches(r, '^[0-9]+/[0-9]+$') THEN nullif(split_part(r, '/', 2)::BIGINT, 0) END AS m FROM t)
  SELECT {LK}, CASE WHEN d > 0 THEN CASE WHEN n IS NOT NULL AND m IS NOT NULL THEN round(d * n / m)::BIGINT END ELSE 0 END AS n_frames FROM p""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(
        *LKEY, F.when(F.col("l_partkey") % 10 != 0, (F.col("l_quantity") - 5) / 3).alias("d"), rational.parse_rate(pick(_RATES, F.col("l_partkey"))).alias("r"))
    return l.select(*LKEY, V.frame_count(F.col("d"), F.col("r.num"), F.col("r.den")).alias("n_frames"))


@query("baseline_manifest_v2", """WITH t AS (SELECT p_partkey AS path, p_size AS n, 6 * (p_size % 8) AS size FROM part)
  SELECT path, f AS frame_no, f AS pts, size::BIGINT AS size, md5(unhex(repeat('00', size))) AS hash FROM t, LATERAL (SELECT unnest(range(n)) AS f)""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("n_frames"), (F.col("p_size") % 8 * 6).cast("long").alias("size"))
    return V.baseline_manifest(p, block=16).select("path", "frame_no", "pts", "size", "hash")


@query("frame_size_v3", f"SELECT {LK}, (l_partkey % 50 + 2) * (l_suppkey % 40 + 2) * 3 // 2 AS size FROM lineitem WHERE (l_partkey % 50) % 2 = 0 AND (l_suppkey % 40) % 2 = 0")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, (F.col("l_partkey") % 50 + 2).alias("width"), (F.col("l_suppkey") % 40 + 2).alias("height"))
    return V.even_dimensions(l).select(*LKEY, V.frame_size(F.col("width"), F.col("height")).alias("size"))


@query("frame_rate_v4", f"""WITH t AS (SELECT {LK}, ({sql_list(_RATES)})[l_partkey % 7 + 1] AS r, l_suppkey FROM lineitem)
  SELECT {LK}, CASE WHEN l_suppkey % 4 = 0 THEN 1000 WHEN r IN ('30000/1001', '25/1', '60/1') THEN split_part(r, '/', 1)::BIGINT ELSE 25 END::BIGINT AS num,
    CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey + 1 WHEN r IN ('30000/1001', '25/1', '60/1') THEN split_part(r, '/', 2)::BIGINT ELSE 1 END::BIGINT AS den FROM t""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(
        *LKEY, pick(_RATES, F.col("l_partkey")).alias("frame_rate"), F.when(F.col("l_suppkey") % 4 == 0, F.struct(F.lit(1000).cast("long").alias("num"), (F.col("l_suppkey") + 1).alias("den"))).alias("timing"))
    return V.frame_rate(l).select(*LKEY, "rate.num", "rate.den")


@query("delays_v5", f"""WITH t AS (SELECT {LK}, l_quantity::BIGINT % 7 AS cs, l_partkey % 9 AS n, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_suppkey END AS d FROM lineitem), u AS (SELECT *, CASE WHEN d = 0 THEN 100 ELSE d END AS e FROM t)
  SELECT {LK}, CASE WHEN cs = 0 THEN 10 ELSE cs END AS delay, CASE WHEN n = 0 THEN 1 ELSE n // gcd(n, e) END AS num, CASE WHEN n = 0 THEN 10 ELSE e // gcd(n, e) END AS den FROM u""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(
        *LKEY, V.gif_delay(F.col("l_quantity").cast("long") % 7).alias("delay"),
        V.fraction_delay(F.col("l_partkey") % 9, F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_suppkey"))).alias("f"))
    return l.select(*LKEY, "delay", "f.num", "f.den")


def _delays(spark, sf):
    """Users as animations, their events as frames; the gcd differs per user."""
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("frame_no"), ((F.col("k") + 1) * (F.col("user_id") % 6 + 1)).alias("delay"))


TICK = f"{EV}, d AS (SELECT user_id AS path, event_id AS frame_no, (k + 1) * (user_id % 6 + 1) AS delay FROM ev), t AS (SELECT path, list_reduce(list(delay), lambda a, b: gcd(a, b)) AS tick FROM d GROUP BY path)"


@query("tick_timing_v6", f"WITH {TICK} SELECT path, tick, 100 // gcd(100, tick) AS rate_num, tick // gcd(100, tick) AS rate_den FROM t")
def _(spark, sf):
    return V.tick_timing(_delays(spark, sf))


@query("frame_durations_v7", f"""WITH {TICK}, u AS (SELECT path, frame_no, greatest(1, (delay + tick - 1) // tick) AS duration FROM d JOIN t USING (path))
  SELECT *, coalesce(sum(duration) OVER (PARTITION BY path ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts, greatest(1, ((duration * 109) + 600) // 1200) AS rescaled FROM u""")
def _(spark, sf):
    d = _delays(spark, sf)
    f = V.frame_durations(d, V.tick_timing(d))
    return f.select("path", "frame_no", "duration", "pts", V.rescale(F.col("duration"), F.lit(109), F.lit(12)).alias("rescaled"))


@query("pattern_timing_v8", """WITH f AS (SELECT o_custkey AS path, o_orderkey AS frame_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
  d AS (SELECT path, frame_no, CASE WHEN n = 3 THEN [1, 300, 100][rn] WHEN path % 3 = 0 THEN 11 WHEN path % 3 = 1 AND rn = n THEN 200 WHEN path % 3 = 1 THEN 11 ELSE 12 END AS delay FROM f),
  l AS (SELECT path, list(delay ORDER BY frame_no) AS ds FROM d GROUP BY path)
  SELECT path, CASE WHEN ds = [1, 300, 100] THEN 'steps_1_1' ELSE 'rate_109_12' END AS pattern FROM l WHERE ds = [1, 300, 100] OR len(list_filter(ds, lambda x: x <> 11)) = 0
    OR (len(ds) > 1 AND ds[-1] = 200 AND len(list_filter(ds[1:-2], lambda x: x <> 11)) = 0)""")
def _(spark, sf):
    from cinelake.functions import ordered

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("frame_no"))
    o = ordered.row_index(o, ["path"], "frame_no", "rn").join(o.groupBy("path").agg(F.count("*").alias("n")), "path")
    p, last = F.col("path") % 3, F.col("rn") == F.col("n") - 1
    delay = F.when(F.col("n") == 3, F.get(F.array(F.lit(1), F.lit(300), F.lit(100)), F.col("rn").cast("int"))).when(p == 0, 11).when((p == 1) & last, 200).when(p == 1, 11).otherwise(12)
    return V.pattern_timing(o.select("path", "frame_no", delay.alias("delay")))


@query("fraction_timing_v8", f"""WITH {EV}, d AS (SELECT user_id AS path, event_id, CASE WHEN user_id % 4 = 0 THEN 18 ELSE k % 6 END AS n, CASE WHEN user_id % 4 = 0 THEN 100 ELSE k % 5 * 25 END AS d0 FROM ev),
  e AS (SELECT path, event_id, n, CASE WHEN d0 = 0 THEN 100 ELSE d0 END AS d FROM d), f AS (SELECT path, event_id, CASE WHEN n = 0 THEN 1 ELSE n // gcd(n, d) END AS num, CASE WHEN n = 0 THEN 10 ELSE d // gcd(n, d) END AS den FROM e),
  g AS (SELECT path, bool_and(num = 9 AND den = 50) AS al, arg_min(num, event_id) AS num, arg_min(den, event_id) AS den FROM f GROUP BY path)
  SELECT path, CASE WHEN al THEN 50 ELSE den END AS rate_num, CASE WHEN al THEN 3 ELSE num END AS rate_den, CASE WHEN al THEN 3 ELSE 1 END::BIGINT AS duration FROM g""")
def _(spark, sf):
    k, fixed = F.col("k"), F.col("user_id") % 4 == 0
    d = events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("frame_no"), F.when(fixed, 18).otherwise(k % 6).alias("num"), F.when(fixed, 100).otherwise(k % 5 * 25).alias("den"))
    return V.fraction_timing(d)


_DISPOSE = ["keep", "clear", "restore"]
COMP = f"""{EV}, f AS (SELECT user_id AS path, event_id AS frame_no, ({sql_list(_DISPOSE)})[event_id % 3 + 1] AS dispose, k FROM ev),
  c AS (SELECT DISTINCT user_id AS path, k // 10 AS pixel FROM ev)"""


@query("composite_v9", f"""WITH {COMP}, g AS (SELECT f.*, c.pixel, c.pixel BETWEEN k % 10 AND k % 10 + 3 AS inside, CASE WHEN (c.pixel + k) % 4 <> 0 THEN k * 10 + c.pixel END AS dv FROM f JOIN c USING (path)),
  h AS (SELECT *, CASE WHEN inside THEN dv END AS drawn, CASE WHEN dispose = 'clear' AND inside THEN -1 WHEN dispose IN ('keep', 'clear') AND inside THEN dv END AS persist FROM g)
  SELECT path, frame_no, pixel, coalesce(drawn, last_value(persist IGNORE NULLS) OVER (PARTITION BY path, pixel ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM h""")
def _(spark, sf):
    e = events(spark, sf)
    k, px = F.col("k"), F.col("pixel")
    f = e.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("frame_no"), pick(_DISPOSE, F.col("event_id")).alias("dispose"), F.lit(-1).cast("long").alias("clear_v"), "k")
    canvas = e.select(F.col("user_id").alias("path"), F.call_function("div", k, F.lit(10)).alias("pixel")).distinct()
    patches = f.select("path", "frame_no", "k", F.explode(F.sequence(k % 10, k % 10 + 3)).alias("pixel")).select(
        "path", "frame_no", "pixel", F.when((px + k) % 4 != 0, k * 10 + px).alias("v"))
    return V.composite(f.drop("k"), patches, canvas)


@query("alpha_over_v10", f"""WITH {RGBA}, q AS (SELECT {LK}, r AS sr, g AS sg, b AS sb, a AS sa, g AS dr, b AS dg, a AS db, r AS da FROM p),
  m AS (SELECT *, sa + (da * (255 - sa) + 127) // 255 AS oa FROM q)
  SELECT {LK}, CASE sa WHEN 0 THEN dr WHEN 255 THEN sr ELSE (sr * sa + (dr * da * (255 - sa) + 127) // 255 + oa // 2) // oa END AS r,
    CASE sa WHEN 0 THEN dg WHEN 255 THEN sg ELSE (sg * sa + (dg * da * (255 - sa) + 127) // 255 + oa // 2) // oa END AS g,
    CASE sa WHEN 0 THEN db WHEN 255 THEN sb ELSE (sb * sa + (db * da * (255 - sa) + 127) // 255 + oa // 2) // oa END AS b, CASE sa WHEN 0 THEN da WHEN 255 THEN sa ELSE oa END AS a FROM m""")
def _(spark, sf):
    l = rgba(spark, sf)
    p = F.col("p")
    below = F.struct(p["g"].alias("r"), p["b"].alias("g"), p["a"].alias("b"), p["r"].alias("a"))
    return l.select(*LKEY, V.alpha_over(p, below).alias("o")).select(*LKEY, "o.*")


def _blend_sql():
    """The fold as a recursion over the draws of each pixel: c* is the canvas left behind, s* what the frame shows."""
    oa = "(a + (ca * (255 - a) + 127) // 255)"
    mix = lambda x: f"CASE WHEN op = 'source' OR a = 255 THEN {x} WHEN a = 0 THEN c{x} ELSE ({x} * a + (c{x} * ca * (255 - a) + 127) // 255 + {oa} // 2) // {oa} END"
    alpha = f"CASE WHEN op = 'source' OR a = 255 THEN a WHEN a = 0 THEN ca ELSE {oa} END"
    after = lambda x: f"CASE dispose WHEN 'keep' THEN s{x} WHEN 'clear' THEN 0 ELSE c{x} END"
    return f"""WITH RECURSIVE {EV}, p AS (SELECT user_id AS path, k % 4 AS pixel, event_id AS frame_no, k * 2 AS r, k + 50 AS g, 255 - k AS b, CASE WHEN k % 5 = 0 THEN 255 ELSE k * 2 END AS a,
        CASE WHEN event_type = 'view' THEN 'source' ELSE 'over' END AS op, ['keep', 'keep', 'clear', 'restore'][event_id % 4 + 1] AS dispose,
        row_number() OVER (PARTITION BY user_id, k % 4 ORDER BY event_id) AS rn FROM ev),
      w(path, pixel, rn, frame_no, cr, cg, cb, ca, sr, sg, sb, sa) AS (
        SELECT DISTINCT path, pixel, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM p
        UNION ALL SELECT path, pixel, rn, frame_no, {', '.join(after(x) for x in 'rgba')}, sr, sg, sb, sa FROM (
          SELECT p.path, p.pixel, p.rn, p.frame_no, dispose, cr, cg, cb, ca, {', '.join(f'{mix(x)} AS s{x}' for x in 'rgb')}, {alpha} AS sa FROM w JOIN p ON p.path = w.path AND p.pixel = w.pixel AND p.rn = w.rn + 1))
      SELECT path, pixel, frame_no, sr AS r, sg AS g, sb AS b, sa AS a FROM w WHERE rn > 0"""


@query("blend_frames_v10", _blend_sql())
def _(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    p = e.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("frame_no"), (k % 4).alias("pixel"),
        F.struct((k * 2).alias("r"), (k + 50).alias("g"), (255 - k).alias("b"), F.when(k % 5 == 0, 255).otherwise(k * 2).alias("a")).alias("rgba"),
        F.when(F.col("event_type") == "view", "source").otherwise("over").alias("op"), pick(["keep", "keep", "clear", "restore"], F.col("event_id")).alias("dispose"))
    return V.blend_frames(p)


@query("orient_v11", f"WITH {PIX} SELECT path, CASE WHEN path % 2 = 0 THEN 7 - y ELSE y END AS y, CASE WHEN path % 3 = 0 THEN 7 - x ELSE x END AS x, v FROM px")
def _(spark, sf):
    p = pixels(spark, sf).withColumn("width", F.lit(8).cast("long")).withColumn("height", F.lit(8).cast("long"))
    return V.orient(p, F.col("path") % 2 == 0, F.col("path") % 3 == 0).select("path", "y", "x", "v")


@query("pack_planes_v12", f"WITH {PIX} SELECT path, i, ([2, 0, 1][i % 3 + 1] * 8 + y) * 8 + x AS pos, v FROM px")
def _(spark, sf):
    p = pixels(spark, sf).withColumn("c", F.col("i") % 3).withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    return V.pack_planes(p).select("path", "i", "pos", "v")


@query("palette_lookup_v13", f"""WITH {PIX}, pal AS (SELECT DISTINCT path, v AS idx FROM px WHERE v % 7 <> 0)
  SELECT px.path, i, CASE WHEN idx IS NOT NULL THEN (v * 3 + px.path) % 256 END AS r, CASE WHEN idx IS NOT NULL THEN (v * 5) % 256 END AS g FROM px LEFT JOIN pal ON pal.path = px.path AND idx = v""")
def _(spark, sf):
    p = pixels(spark, sf)
    pal = p.where("v % 7 <> 0").select("path", F.col("v").alias("index")).distinct()
    pal = pal.select("*", ((F.col("index") * 3 + F.col("path")) % 256).alias("r"), (F.col("index") * 5 % 256).alias("g"))
    return V.palette_lookup(p, pal).select("path", "i", "r", "g")


@query("palette_bytes_v13", f"""WITH {PIX}, pal AS (SELECT DISTINCT path, v AS idx FROM px WHERE v % 7 <> 0), a AS (SELECT path, i FROM (SELECT DISTINCT path FROM px), (SELECT unnest(range(256)) AS i)),
  h AS (SELECT a.path, i, CASE WHEN idx IS NULL THEN '00000000' ELSE printf('%02X%02X%02XFF', i % 256, i * 5 % 256, (i * 3 + a.path) % 256) END AS h FROM a LEFT JOIN pal ON pal.path = a.path AND idx = i)
  SELECT path, md5(string_agg(h, '' ORDER BY i)) AS hash FROM h GROUP BY path""")
def _(spark, sf):
    pal = pixels(spark, sf).where("v % 7 <> 0").select("path", F.col("v").alias("index")).distinct()
    i = F.col("index")
    pal = pal.select("*", ((i * 3 + F.col("path")) % 256).alias("r"), (i * 5 % 256).alias("g"), i.alias("b"), F.lit(255).alias("a"))
    return V.palette_bytes(pal).select("path", F.md5("palette_hex").alias("hash"))


@query("unpack_bits_v14", """WITH t AS (SELECT page_id, hex(encode(html)) AS hx FROM pages), b AS (SELECT page_id, i, ('0x' || substr(hx, i * 2 + 1, 2))::BIGINT AS b FROM t, LATERAL (SELECT unnest(range(length(hx) // 2)) AS i)),
  v AS (SELECT page_id, 1::INTEGER AS bits, i * 8 + j AS pos, (b >> (7 - j)) & 1 AS v FROM b, (SELECT unnest(range(8)) AS j) UNION ALL SELECT page_id, 4, i * 2 + j, (b >> (4 - 4 * j)) & 15 FROM b, (SELECT unnest(range(2)) AS j)
    UNION ALL SELECT page_id, 8, i, b FROM b)
  SELECT page_id, bits, pos // 4096 AS row_no, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (pos % 4096 + 1))::BIGINT AS placed FROM v GROUP BY ALL""")
def _(spark, sf):
    """Whole pages as bit planes: counts, sums and sums by place of each run of 4,096 values."""
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("u"))
    runs = V.plane_runs(p, "u", (1, 4, 8), ["page_id"], run=4096)
    return runs.groupBy("page_id", "bits", "row_no").agg(*[F.sum(c).alias(c) for c in ("n", "total", "placed")])


@query("unpack_10bit_v14", f"WITH t AS (SELECT {LK}, l_partkey * 104729 + l_orderkey * 31 AS w FROM lineitem) SELECT {LK}, (w >> 22) & 1023 AS r, (w >> 12) & 1023 AS g, (w >> 2) & 1023 AS b FROM t")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(*LKEY, V.unpack_10bit(F.col("l_partkey") * 104729 + F.col("l_orderkey") * 31).alias("o")).select(*LKEY, "o.*")


@query("scale_depth_v15", f"""WITH t AS (SELECT {LK}, l_suppkey % 300 + 1 AS m, l_partkey % 320 AS v FROM lineitem)
  SELECT {LK}, least(255, round(v * 255.0::DOUBLE / m))::INTEGER AS v8, least(65535, round(v * 65535.0::DOUBLE / m))::INTEGER AS v16, ((v % 32) << 3) | ((v % 32) >> 2) AS e FROM t""")
def _(spark, sf):
    v, m = F.col("l_partkey") % 320, F.col("l_suppkey") % 300 + 1
    return table(spark, sf, "lineitem").select(*LKEY, V.scale_depth(v, m).alias("v8"), V.scale_depth(v, m, 65535).alias("v16"), V.expand_5bit(v % 32).alias("e"))


@query("normalise_range_v16", f"""WITH {PIX}, s AS (SELECT path, i, CASE WHEN v = 100 THEN NULL WHEN path % 9 = 0 THEN 5.0 ELSE e * 2.5 + 10 END AS val FROM px),
  r AS (SELECT path, CASE WHEN path % 4 = 0 THEN 9.5 ELSE min(val) END AS lo, CASE WHEN path % 4 = 0 THEN 10.5 ELSE max(val) END AS hi FROM s GROUP BY path)
  SELECT s.path, i, coalesce(floor(greatest(0.0, least(65535.0, (val - lo) * 65535.0 / (hi - lo))) + 0.5)::INTEGER, 0) AS grey FROM s JOIN r USING (path) WHERE hi > lo""")
def _(spark, sf):
    p = pixels(spark, sf).select("path", "i", F.when(F.col("v") == 100, -999.0).when(F.col("path") % 9 == 0, -2.0).otherwise(F.col("e")).alias("raw"))
    h = p.select("path").distinct().select(
        "path", F.lit(2.5).alias("scale"), F.lit(10.0).alias("zero"), F.lit(-999.0).alias("blank"),
        F.when(F.col("path") % 4 == 0, 9.5).alias("datamin"), F.when(F.col("path") % 4 == 0, 10.5).alias("datamax"))
    return V.normalise_range(p, h).select("path", "i", "grey")


@query("resize_nearest_v17", f"""WITH {PIX}, t AS (SELECT DISTINCT path, path % 11 + 1 AS tw, path % 13 + 3 AS th FROM px), g AS (SELECT path, tw, th, y, x FROM t, LATERAL (SELECT unnest(range(th)) AS y), LATERAL (SELECT unnest(range(tw)) AS x))
  SELECT g.path, g.y, g.x, px.v FROM g JOIN px ON px.path = g.path AND px.y = g.y * 8 // g.th AND px.x = g.x * 8 // g.tw""")
def _(spark, sf):
    p = pixels(spark, sf).withColumn("c", F.lit(0))
    eight = F.lit(8).cast("long")
    shapes = p.select("path").distinct().select("path", eight.alias("width"), eight.alias("height"), (F.col("path") % 11 + 1).alias("target_width"), (F.col("path") % 13 + 3).alias("target_height"))
    return V.resize_nearest(p.select("path", "y", "x", "c", "v"), shapes, keys=("path",)).select("path", "y", "x", "v")


@query("expand_runs_v18", """WITH r AS (SELECT l_suppkey AS path, l_orderkey AS run_no, sum(l_quantity)::BIGINT % 40 AS count, max(l_partkey) AS value FROM lineitem GROUP BY ALL),
  t AS (SELECT *, sum(count) OVER (PARTITION BY path) AS total, min(count) OVER (PARTITION BY path) AS least_run FROM (SELECT path, run_no, CASE WHEN path % 5 = 0 THEN count ELSE count + 1 END AS count, value FROM r)),
  b AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY path ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM t WHERE least_run > 0 AND path % 7 <> 3)
  SELECT path, (at + i)::BIGINT AS pos, value FROM b, LATERAL (SELECT unnest(range(count)) AS i)""".replace("AS at", "AS start_at").replace("(at + i)", "(start_at + i)"))
def _(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("run_no")).agg((F.sum("l_quantity").cast("long") % 40).alias("count"), F.max("l_partkey").alias("value"))
    r = r.withColumn("count", F.when(F.col("path") % 5 == 0, F.col("count")).otherwise(F.col("count") + 1))
    sizes = r.groupBy("path").agg(F.sum("count").alias("size")).withColumn("size", F.col("size") + F.when(F.col("path") % 7 == 3, 1).otherwise(0))
    return V.expand_runs(r, sizes)


@query("colour_transforms_v19", f"""WITH {RGBA}, n AS (SELECT *, (65025 - r * r - g * g) // 2 AS rest, trunc((r - 128)::DOUBLE / (1 << (b >> 3)))::BIGINT AS cos, trunc((g - 128)::DOUBLE / (1 << (b >> 3)))::BIGINT AS cgs FROM p)
  SELECT {LK}, r * a // 255 AS pm_r, CASE WHEN a = 0 THEN g ELSE least(255, g * 255 // a) END AS un_g, greatest(0, least(255, a - (g - 128) + (r - 128))) AS yc_r, greatest(0, least(255, a - cgs - cos)) AS ys_b,
    CASE WHEN 65025 - r * r - g * g < 2 THEN 127 ELSE least(255, round(sqrt(rest::DOUBLE)))::BIGINT END AS blue, a AS sw_r, r AS sw_a FROM n""")
def _(spark, sf):
    p = F.col("p")
    l = rgba(spark, sf)
    return l.select(
        *LKEY, V.premultiply(p)["r"].alias("pm_r"), V.unpremultiply(p)["g"].alias("un_g"), V.ycocg(p)["r"].alias("yc_r"), V.ycocg(p, True)["b"].alias("ys_b"),
        V.normal_blue(p["r"], p["g"]).alias("blue"), V.swizzle(p, "rxgb")["r"].alias("sw_r"), V.swizzle(p, "rxgb")["a"].alias("sw_a"))


@query("interlaced_row_v20", """WITH h AS (SELECT p_partkey, p_size AS h FROM part), r AS (SELECT p_partkey, h, unnest(range(h)) AS y FROM h),
  o AS (SELECT p_partkey, y, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN y % 8 = 0 THEN 0 WHEN y % 8 = 4 THEN 1 WHEN y % 4 = 2 THEN 2 ELSE 3 END, y) - 1 AS src FROM r) SELECT p_partkey, src, y AS row FROM o""")
def _(spark, sf):
    p = table(spark, sf, "part").where("p_size > 0").select("p_partkey", F.col("p_size").cast("long").alias("h"))
    p = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("src"))
    return p.select("p_partkey", "src", V.interlaced_row(F.col("src"), F.col("h")).alias("row"))


@query("split_images_v21", f"""WITH {EV}, i AS (SELECT user_id AS path, event_id AS offset_, k % 10 + 1 AS width, k // 10 + 1 AS height FROM ev)
  SELECT path, offset_ AS "offset", row_number() OVER w - 1 AS frame_no, first_value(width) OVER w AS target_width, first_value(height) OVER w AS target_height FROM i WINDOW w AS (PARTITION BY path ORDER BY offset_)""")
def _(spark, sf):
    i = events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("offset"), (F.col("k") % 10 + 1).alias("width"), (F.call_function("div", F.col("k"), F.lit(10)) + 1).alias("height"))
    return V.split_images(i).select("path", "offset", "frame_no", "target_width", "target_height")


@query("image_manifest_v22", f"""WITH {PIX}, f AS (SELECT label AS path, vec_id AS frame_no, i, v FROM px JOIN embeddings ON vec_id = path)
  SELECT path::INTEGER AS path, frame_no, frame_no AS pts, 1::BIGINT AS duration, count(*) * 2 AS size, md5(unhex(string_agg({S16HEX}, '' ORDER BY i))) AS hash FROM f GROUP BY path, frame_no""")
def _(spark, sf):
    p = pixels(spark, sf).withColumnRenamed("path", "frame_no")
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_no"), F.col("label").alias("path"))
    return V.image_manifest(p.join(labels, "frame_no"), pos="i", width=2, segment=16).select("path", "frame_no", "pts", "duration", "size", "hash")
