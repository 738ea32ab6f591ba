"""Blocked running values equal the plain ones for any block size, with hot, empty and single-row keys."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from cinelake.functions import ordered, rational


def data():
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 400), ("cold", 7), ("", 20), ("one", 1)):
        for o in sorted(rng.sample(range(2000), n)):
            rows.append((key, o, rng.choice([None, 1, 2, 5, 300])))
    return rows


def test_running_sum(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    for block in (1, 16, 1 << 16):
        for inclusive in (False, True):
            got = {(r.k, r.o): r.s for r in ordered.running_sum(df, ["k"], "o", {"s": "v"}, block, inclusive).collect()}
            want, total = {}, {}
            for k, o, v in rows:
                before = total.get(k, 0)
                total[k] = before + (v or 0)
                want[k, o] = total[k] if inclusive else before
            assert got == want


def test_previous_value(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    for block in (1, 16, 1 << 16):
        for skip in (False, True):
            got = {(r.k, r.o): r.p for r in ordered.previous_value(df, ["k"], "o", F.col("v"), "p", block, skip).collect()}
            want, last = {}, {}
            for k, o, v in rows:
                want[k, o] = last.get(k)
                if v is not None or not skip:
                    last[k] = v
            assert got == want


def test_null_keys_fail(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", 1, 1)], "k string, o long, v long")
    with pytest.raises(Exception, match="not NULL"):
        ordered.running_sum(df, ["k"], "o", {"s": "v"}).collect()


def test_gcd(spark):
    df = spark.createDataFrame([(12, 18), (0, 5), (7, 0), (2**40, 2**35 * 3), (1134903170, 701408733)], "a long, b long")
    import math

    for r in df.select("a", "b", rational.gcd(F.col("a"), F.col("b")).alias("g")).collect():
        assert r.g == math.gcd(r.a, r.b)


def test_parse_rate(spark):
    df = spark.createDataFrame([("30000/1001",), ("0/1",), ("1/0",), ("x",), ("5",), ("9999999999/1",)], "t string")
    got = [None if r.r is None else tuple(r.r) for r in df.select(rational.parse_rate(F.col("t")).alias("r")).collect()]
    assert got == [(30000, 1001), None, None, None, None, None]


def test_small_blocks_are_folded_together(spark):
    from cinelake.functions import grouped

    rows = spark.createDataFrame([(k, i, k + i) for k in range(200) for i in range(10)], "k long, i long, v long").repartition(1)
    calls = spark.conf.get("spark.sql.shuffle.partitions")

    def facts(g):
        return {"total": np.bincount(g[grouped.GROUP], g["v"]).astype(np.int64), "blocks": np.full(g[grouped.GROUP][-1] + 1, g[grouped.GROUP][-1] + 1)}

    def link(blocks):
        earlier = W.partitionBy("k").orderBy(ordered.BLOCK_COLUMN).rowsBetween(W.unboundedPreceding, -1)
        return blocks.select("k", ordered.BLOCK_COLUMN, F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long").alias("came"), "blocks").where("k % 5 <> 0")

    def finish(g, entry):
        group = g[grouped.GROUP]
        passed = np.cumsum(g["v"]).astype(np.int64)
        first = np.searchsorted(group, group)
        return {"i": g["i"], "sum": entry["came"].astype(np.int64)[group] + passed - passed[first] + g["v"][first].astype(np.int64), "blocks": entry["blocks"].astype(np.int64)[group], grouped.GROUP: group}

    got = ordered.two_pass(rows, ["k"], "i", facts, "total bigint, blocks bigint", link, finish, "i bigint, sum bigint, blocks bigint", block=4).collect()
    assert {(r.k, r.i): r.sum for r in got} == {(k, i): sum(k + j for j in range(i + 1)) for k in range(200) if k % 5 for i in range(10)}
    assert max(r.blocks for r in got) > 600 / int(calls) / 4  # 600 blocks, and not a call for each


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_composite_makes_its_rows_last(spark, block):
    from cinelake.operators import frames as V

    rng = random.Random(block)
    frames, patches, canvas, want = [], [], [], {}
    for path in ("a", "b", "c"):
        pixels = sorted(rng.sample(range(200), 9))
        canvas += [(path, p) for p in pixels]
        state = dict.fromkeys(pixels, 7)
        for n in sorted(rng.sample(range(40), 15)):
            dispose = rng.choice(["keep", "clear", "restore"])
            frames.append((path, n, dispose, -1))
            drawn = {p: rng.choice([None, (1 << 60) + n]) for p in rng.sample([*pixels, 500], 4)}
            patches += [(path, n, p, v) for p, v in drawn.items()]
            for p in pixels:
                want[path, n, p] = state[p] if drawn.get(p) is None else drawn[p]
                if p in drawn and dispose == "clear":
                    state[p] = -1
                elif dispose == "keep" and drawn.get(p) is not None:
                    state[p] = drawn[p]
    patches.append(("a", 99, canvas[0][1], 5))  # of no frame
    f, p, c = (spark.createDataFrame(r, d) for r, d in ((frames, "path string, frame_no long, dispose string, clear_v long"), (patches, "path string, frame_no long, pixel long, v long"), (canvas, "path string, pixel long")))
    out = V.composite(f, p, c, background=7, block=block)
    assert {(r.path, r.frame_no, r.pixel): r.v for r in out.collect()} == want
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInPandas") < text.index("Exchange")  # the grid of frames and pixels is not shuffled
