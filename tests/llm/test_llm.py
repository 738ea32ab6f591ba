"""The training-data operators against plain forms of them, and their defined cases."""

import hashlib
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinelake.llm import decontaminate, katz, licenses, near_dup, ordinal, pieces, rules, sharding, substring, toxicity
from cinelake.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from cinelake.llm.store import Workspace

from . import brute

BASE = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, items string, `key` long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    w = [f"w{i}" for i in range(400)]
    base = " ".join(w[:120])
    rows = [
        (None, base), (1, None), (2, ""), (3, "   \n\t"), (4, base), (5, base), (5, base), (6, " ".join(w[:118] + ["x", "y"])), (7, "a b c"), (8, "a b c"), (9, "A▁B  日本 \U0001f600\x00"),
        (10, " ".join(w[200:330] + w[:60] + w[330:400])), (11, "same " * 30000), (12, "Licensed under CC BY 4.0.\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\n"),
    ]
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "clash", 1) for d, t in rows], KINDS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in rows_of(QUERIES[name](spark, BASE))) == want


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 17))), (2, "B, C!"), (3, None), (None, "same same"), (4, "")], "item_id long, text string")
    for limit in (10**6, 5):  # one block, and one for each item
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows_of(decontaminate.contamination_report(odd, items, block_windows=limit))}
        digest = decontaminate.items_digest
        assert got[4] == (120, 12, 1, digest([1])) and got[7] == (3, 2, 1, digest([2])) and got[1] == (0, 0, 0, hashlib.sha256(b"").hexdigest()) and got[11][1] == 0
    left = decontaminate.remove_contamination(odd, items, mode="spans")
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in rows_of(left)}[7] == "a "
    assert {r["doc_id"] for r in rows_of(decontaminate.remove_contamination(odd, items))} == {1, 2, 3, 9, 11, 12}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_katz(request, which):
    table = request.getfixturevalue(which)
    data = [(r.doc_id, r.text) for r in table.collect()]
    want, p, words = brute.katz(data)
    for r in rows_of(katz.score_corpus(table, bucket_bytes=100_000)):
        held, n, known, tokens, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, tokens)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, n) and abs(r["score"] - score) < 1e-6 * max(1, n)
    for v in ("<s>", *list(words)[:5]):
        assert abs(sum(p(w, v) for w in words) + p("\0", v) - 1) < 1e-9


def test_katz_slice_memory():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"Word{i}" for i in rng.integers(0, 10**6, 1000)) for _ in range(300)] + [None, "", "a"])
    words = katz.Words(texts, katz.SPACED)
    katz._tokens(texts[:1])  # tables that stay
    tracemalloc.start()
    token, before, doc = katz._tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(token[token != katz.END], words.hashes()) and np.array_equal(np.bincount(doc), words.counts + 1) and (before == katz.START).sum() == len(texts)
    assert peak < 10 * len(words.raw)


def test_katz_answers_are_one_row_a_text(spark, docs):
    rows = docs.select("text", F.xxhash64("text").alias("rid")).where("text IS NOT NULL").distinct().coalesce(1)
    model = katz.train(rows, Workspace(spark, "test"), 8)
    answered = katz._answered(katz._asked(rows, 1, 8), model.unigrams, 1, 0.0, model.tokens, model.kinds)
    assert answered.count() <= rows.count()


def test_katz_bigrams_of_a_frequent_context(spark):
    rows = spark.createDataFrame([(i, " ".join(f"the w{i}x{j}" for j in range(200))) for i in range(50)], "rid long, text string").coalesce(1)
    asked = {r["bucket"]: len(r["keys"]) for r in rows_of(katz._asked(rows, 2, 32))}
    assert max(asked.values()) < 0.3 * sum(asked.values())  # half of all bigrams follow one word
    counted = {r["part"]: len(r["n"]) for r in rows_of(katz._counted(rows, 32)) if r["kind"] == 2}
    assert max(counted.values()) < 0.3 * sum(counted.values())
    assert {p % 32 for p in counted} == set(asked)


def test_katz_rows_of_texts_go_once(spark, docs):
    rows = docs.select("text", F.xxhash64("text").alias("rid")).where("text IS NOT NULL").distinct().coalesce(1)
    model = katz.train(rows, Workspace(spark, "test"), 8)
    for kind, table in ((1, model.unigrams), (2, model.bigrams)):
        asked = katz._asked(rows, kind, 8)
        sent = [x for r in rows_of(asked) for x in r["rids"]]
        assert len(sent) == len(set(sent)) == rows.count()  # and not once for each bucket
        got = katz._answered(asked, table, kind, 0.0, model.tokens, model.kinds)
        assert {r["rid"] for r in rows_of(got)} <= set(sent)


def test_katz_empty(spark):
    assert katz.score_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ordinal():
    rng = np.random.default_rng(1)
    x = rng.random((900, ordinal.DIM)).astype(np.float32) / 40
    y = rng.integers(0, 3, 900)
    x[np.arange(900), 5] += y
    model = ordinal.fit(x, y, [0, 1, 2], np.ones(3) / 3)
    p = model.probabilities(x)
    assert (np.diff(model.thresholds) > 0).all() and np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.95


def test_quality_and_toxicity(spark, odd, docs):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(table, labels)
    quality = {r["doc_id"]: r["quality"] for r in rows_of(labels)}
    got = [(quality[r["doc_id"]], r["kept"]) for r in rows_of(ordinal.grade(table, model)) if r["doc_id"] in quality]
    assert np.mean([q == k for q, k in got]) > 0.97
    fold = "crc32(cast(cast(doc_id AS string) AS binary)) % 4"
    blind = ordinal.train(table, labels.where(f"{fold} <> 2"))  # not fitted on the rows it is measured on
    got = [(quality[r["doc_id"]], r["kept"]) for r in rows_of(ordinal.grade(table.where(f"{fold} = 2"), blind)) if r["doc_id"] in quality]
    assert len(got) > 50 and np.mean([q == k for q, k in got]) > 0.95
    twice = table.unionByName(table.withColumn("text", F.concat(F.lit("other "), "text")))  # one text of each id is fitted, the same in every run
    a, b = (ordinal.train(twice.repartition(n), labels) for n in (3, 7))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    none = labels.limit(0)
    assert ordinal.select_quality(odd, none).count() == odd.count()
    assert ordinal.grade(odd, model).count() == odd.count()
    toxic = toxicity.train(table, labels)
    marks = {r["doc_id"]: r["toxic"] for r in rows_of(labels)}
    held = table.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")
    said = [(marks[r["doc_id"]], r["predicted"]) for r in rows_of(toxicity.score_toxicity(held, toxic)) if r["doc_id"] in marks]
    assert np.mean([t == p for t, p in said]) > 0.9 and sum(p for t, p in said if t) >= 0.6 * sum(t for t, _ in said)
    scores = rows_of(toxicity.score_toxicity(odd, toxic))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scores)
    assert all(r["score"] < 1e-6 for r in rows_of(toxicity.score_toxicity(odd, toxicity.train(table, none))))


def test_pieces(spark, odd):
    v = vocabulary()
    encoded = pieces.encode(odd, v)
    said = {r["doc_id"]: r["text"] for r in rows_of(pieces.decode(encoded, v))}
    assert all(said[r["doc_id"]] == (r["text"] or "") for r in rows_of(odd) if r["doc_id"] != 5)
    assert all(r["exact"] for r in rows_of(pieces.encoding_report(odd, v)))
    best = {}
    for i, p in enumerate(v[0]):
        if p and (p not in best or v[1][i] > v[1][best[p]]):
            best[p] = i
    a = pieces.automaton(v)
    for text in ("Hello  world\n x ▁ é", "   ", "a", "日本語\U0001d54f x\x00y", "the antidisestablishmentarianism of it all"):
        data = b" " + text.encode()
        score, back = [0], [0]
        for e in range(1, len(data) + 1):
            options = [(score[e - 1] + min(v[1]) - 10 * pieces.UNIT, 1, v[2][data[e - 1]])]
            options += [(score[s] + v[1][best[data[s:e]]], e - s, best[data[s:e]]) for s in range(max(0, e - 64), e) if data[s:e] in best]
            top = max(options)
            score.append(top[0])
            back.append(top)
        want, e = [], len(data)
        while e:
            want.append(back[e][2])
            e -= back[e][1]
        assert a.encode(pa.array([text]))[0].tolist() == want[::-1]


@pytest.mark.parametrize("which", ["docs", "odd", "family"])
def test_near_duplicates(request, spark, which):
    if which == "family":  # a centre with copies at all distances, and one passage in many short texts
        rng = np.random.default_rng(5)
        words = np.array([f"v{i}" for i in range(5000)])
        base, data = words[:90], []
        for i in range(160):
            w = base.copy()
            at = rng.choice(90, rng.integers(0, 9), replace=False)
            w[at] = rng.choice(words, len(at))
            data.append((i, " ".join(w)))
        data += [(1000 + i, " ".join([*words[200:250], *rng.choice(words, rng.integers(8, 40))])) for i in range(120)]
        table = spark.createDataFrame(data, "doc_id long, text string")
    else:
        table = request.getfixturevalue(which)
    want = brute.near_duplicates([(r.doc_id, r.text) for r in table.collect() if r.doc_id is not None])
    for r in rows_of(near_dup.find_near_duplicates(table)):
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert near_dup.drop_near_duplicates(table).columns == table.columns


def test_shards(odd):
    got = rows_of(sharding.assign_shards(odd, shards=4))
    assert len(got) == odd.count()
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in got if r["doc_id"] in (4, 5, None)}) == 1
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[7] == (6, zlib.crc32(b"a b c"))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[1] == (1, None)


def test_deal_is_the_greedy_rule():
    import heapq

    rng = np.random.default_rng(2)
    sizes = sorted(((int(s), int(n)) for s, n in zip(rng.choice(200, 40, replace=False) + 1, rng.integers(1, 50, 40))), reverse=True)
    heap = [(0, s) for s in range(5)]
    for size, n in sizes:
        for _ in range(n):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
    loads = dict.fromkeys(range(5), 0)
    for size, s, lo, hi in sharding.deal(sizes, 5):
        loads[s] += size * (hi - lo)
    assert loads == {s: load for load, s in heap}


def test_passages(spark, odd):
    got = {}
    for r in rows_of(substring.passage_report(odd)):
        got[r["doc_id"]] = r
    assert got[4]["n_passages"] == 0 and got[5]["n_repeat_words"] == 120 and got[5]["partners"] == [4]
    assert got[6]["spans"] == "0-118" and got[10]["spans"] == "130-190" and got[10]["partners"] == [4] and got[None]["n_passages"] == 0
    left = substring.remove_passages(odd)
    assert left.columns == odd.columns
    assert {r["doc_id"] for r in rows_of(left)} == {None, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12}


def test_fuzzy_passage(spark):
    rng = np.random.default_rng(3)
    words = [f"u{i}" for i in rng.permutation(3000)]
    edited = words[500:590]
    edited[30], edited[60] = "changed", "also changed"
    table = spark.createDataFrame([(1, " ".join(words[400:700])), (2, " ".join([*words[1000:1100], *edited, *words[1200:1300]])), (3, " ".join(words[2000:2300]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(substring.passage_report(table))}
    assert got[2]["spans"] == "100-191" and got[1]["n_passages"] == got[3]["n_passages"] == 0


def test_chain():
    parts = [(0, 100, 20), (25, 125, 20), (30, 10, 10), (50, 152, 20)]
    assert substring.chain(parts)[0] == [parts[0], parts[1], parts[3]]


def test_chain_past_a_far_heavy_segment():
    parts = [(0, 0, 1000), (1100, 1100, 12), (1116, 1115, 12)]
    assert sorted(substring.chain(parts)) == [parts[:1], parts[1:]]
    rng = np.random.default_rng(7)
    for _ in range(50):  # the best chain of all, by trying every predecessor
        parts = sorted({(int(p), int(o), int(n)) for p, o, n in zip(rng.integers(0, 150, 40), rng.integers(0, 150, 40), rng.integers(8, 20, 40))})
        best = []
        for p, o, n in parts:
            near = [best[j] - 0.1 * (p - a - m + o - b - m) for j, (a, b, m) in enumerate(parts[: len(best)]) if 0 <= p - a - m <= 24 and 0 <= o - b - m <= 24]
            best.append(n + max([0.0, *near]))
        top = substring.chain(parts)[0]
        assert abs(sum(n for *_, n in top) - 0.1 * sum(c - a - m + d - b - m for (a, b, m), (c, d, _) in zip(top, top[1:])) - max(best)) < 1e-9


def test_edited_passage_after_a_long_one(spark):
    words = [f"u{i}" for i in range(4000)]
    edited = [*words[1100:1130], "more", *words[1130:1160]]
    table = spark.createDataFrame([(1, " ".join(words[:1300])), (2, " ".join([*words[:1000], *words[2000:2100], *edited, *words[2200:2300]]))], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows_of(substring.passage_report(table))}
    assert got == {1: "", 2: "0-1000,1100-1161"}


def test_passages_of_one_document_only(spark):
    words = [f"u{i}" for i in range(6000)]
    pieces_of = lambda at: [words[at + 100 * i : at + 100 * i + 20] for i in range(4)]
    data = {i: [*words[5000 + 50 * i : 5040 + 50 * i], *p, *words[4000 + 50 * i : 4040 + 50 * i]] for i, p in enumerate(pieces_of(0))}  # four lines in four documents
    data[10] = sum(pieces_of(0), [])
    data[20] = [*words[3000:3040], *sum(pieces_of(0), []), *words[3100:3140]]  # a passage of document 10 whose lines are in earlier ones
    scattered = pieces_of(1000)
    data[30] = [*scattered[3], *words[2000:2040], *scattered[1], *words[2040:2080], *scattered[0], *words[2080:2120], *scattered[2]]
    data[40] = sum(scattered, [])
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in data.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["partners"]) for r in rows_of(substring.passage_report(table))}
    assert got[10] == got[30] == got[40] == ("", []) and got[20] == ("40-120", [10])
    assert {r["doc_id"] for r in rows_of(substring.remove_passages(table))} == set(data)


def test_passage_whose_seeds_are_in_shorter_pieces(spark):
    words = [f"u{i}" for i in range(4000)]
    data = {d: [*words[1000 + 100 * d : 1040 + 100 * d], *words[at : at + 30], *words[2000 + 100 * d : 2040 + 100 * d]] for d, at in ((1, 0), (2, 15), (3, 30))}
    data[10] = [*words[3000:3040], *words[:60]]
    data[20] = [*words[3100:3130], *words[:60], *words[3200:3220]]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in data.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["partners"]) for r in rows_of(substring.passage_report(table))}
    assert got == {1: ("", []), 2: ("", []), 3: ("", []), 10: ("", []), 20: ("30-90", [10])}


def test_window_matches_are_ends_of_runs(spark):
    words = [f"u{i}" for i in range(4000)]
    again = ["again"] * 200 + ["and"] + ["again"] * 200
    data = {d: " ".join(words[at : at + 30] + words[3000 + 40 * d : 3040 + 40 * d]) for d, at in ((1, 0), (2, 22), (3, 44), (4, 66), (5, 88))}
    data |= {d: " ".join([f"own{d}", *words[:118], f"end{d}", *again]) for d in range(10, 30)}
    table = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    ids = table.select(F.col("doc_id").alias("doc"), "text", F.array(F.lit(0).cast("long")).alias("los"), F.array(F.lit(2**31).cast("long")).alias("his"))
    kinds = "seed long, doc long, pos int, before long, after long, places array<int>"
    windows = ids.mapInArrow(lambda batches: substring._windows(batches, 50), kinds)
    ends = rows_of(substring._run_ends(Workspace(spark, "test"), windows))
    places = sum(len(r["places"]) for r in rows_of(windows) if r["doc"] > 10)
    assert places > 19 * 400 and len(ends) < 19 * 20 and {r["other"] for r in ends} == {10}
    rows = np.array([(r["doc"], r["other"], p, r["place"], r["ends"]) for r in ends for p in r["places"]]).T
    got = {(d, p - o): 0 for d, o, p in zip(*substring.run_matches(rows, 50)[[0, 3, 2]].tolist())}
    assert {(d, 0) for d in range(11, 30)} <= set(got)
    spans = {r["doc_id"]: r["spans"] for r in rows_of(substring.passage_report(table))}
    assert all(spans[d] == "1-521" for d in range(11, 30)) and spans[10] == ""  # one changed word between


def test_chains_extended_together():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, 6000).astype(np.uint64)
    b = np.where(rng.random(6000) < 0.85, a, 9).astype(np.uint64)
    b[2000:2010] = 8
    at, n = rng.integers(300, 5000, 500), rng.integers(0, 300, 500)
    for step in (1, -1):
        got, done = substring._extend_all(a, at, b, at, n, step)
        want = [substring._extend(a[i : i + m] if step > 0 else a[i - m + 1 : i + 1][::-1], b[i : i + m] if step > 0 else b[i - m + 1 : i + 1][::-1]) for i, m in zip(at, n)]
        assert [w for w, d in zip(want, done) if d] == got[done].tolist() and done[n <= 256].all() and (n > 256).any()
    said = substring._agreement(a, at, b, at, n)
    assert said.tolist() == [int((a[i : i + m] == b[i : i + m]).sum()) for i, m in zip(at, n)]


@pytest.mark.parametrize("least", [20, 50])
def test_equal_runs_are_passages(spark, least):
    rng = np.random.default_rng(least)
    stock = [f"s{i}" for i in range(300)]
    cuts = [(int(a), int(a) + int(n)) for a, n in zip(rng.integers(0, 240, 400), rng.integers(4, 2 * least, 400))]
    data = {d: sum((stock[slice(*cuts[i])] + ([f"own{d}x{i}"] if i % 3 else []) for i in rng.integers(0, 400, 4)), []) for d in range(60)}
    data[60] = data[7] + data[8]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in data.items()] + [(7, " ".join(data[9]))], "doc_id long, text string")  # one doc_id twice
    seen: set = set()
    want = {}
    for d, w in data.items():
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        want[d] = {i + j for i, g in enumerate(grams) if g in seen for j in range(least)}
        seen |= set(grams) | ({tuple(data[9][i : i + least]) for i in range(len(data[9]) - least + 1)} if d == 7 else set())
    assert sum(map(len, want.values())) > 500
    for r in rows_of(substring.passage_report(table, least)):
        if r["doc_id"] != 7:
            said = {i for s in r["spans"].split(",") if s for i in range(*map(int, s.split("-")))}
            assert want[r["doc_id"]] <= said, r["doc_id"]


def test_stretches_of_a_chain():
    doc = np.arange(200, dtype=np.uint64)
    other = doc.copy()
    other[60:84] += np.uint64(1000)
    other[96:120] += np.uint64(1000)
    other[132:] += np.uint64(1000)
    assert substring.verified(doc, other, 0, [(0, 0, 60), (84, 84, 12), (120, 120, 12)])[0][:2] == (0, 60)


def test_licenses(odd):
    assert licenses.to_postfix("MIT OR GPL-2.0 WITH x AND ISC") == ["mit", "gpl-2.0", "x", "with", "isc", "and", "or"]
    assert licenses.evaluate("(MIT") is None and licenses.evaluate("OR MIT") is None
    assert licenses.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl-3.0-only"}, 0.2)
    got = {r["doc_id"]: r for r in rows_of(licenses.scan_licenses(odd))}
    assert got[12]["base_labels"] == "cc-by" and got[12]["labels"] == "apache-2.0,cc-by,gpl-2.0-only,mit" and got[12]["n_tags"] == 1
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["last_word"]) == (1, 2, 2)
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)


def test_license_line_that_goes_on(spark):
    assert licenses.evaluate("(MIT OR GPL-2.0-only) This file is") == ({"mit", "gpl-2.0-only"}, 0.2) and licenses.evaluate("MIT) and more") == ({"mit"}, 0.2)
    assert licenses.evaluate("MIT OR OR ISC") is None and licenses.evaluate("MIT AND (ISC this") is None and licenses.evaluate(") MIT") is None and licenses.evaluate("") is None
    table = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT This file and all others"), (2, "SPDX-License-Identifier: Apache-2.0 OR MIT. And more")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_tags"], r["n_broken_tags"]) for r in rows_of(licenses.scan_licenses(table))}
    assert got == {1: ("mit", 0.2, 1, 0), 2: ("apache-2.0,mit", 0.2, 1, 0)}


def test_rules(odd):
    book = rules.ledger(odd)
    got = {r["doc_id"]: r for r in rows_of(rules.apply_policy(book))}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[11]["n_repeat_words"] == 30000 and got[4]["kept"]
    cuts = {r["rule"]: r for r in rows_of(rules.ablations(book))}
    assert cuts["too_few_words"]["rejected"] == sum(r["n_words"] < 50 for r in rows_of(book))


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.contamination_report(none, items).collect() == [] and near_dup.find_near_duplicates(none).collect() == []
    assert sharding.assign_shards(none).collect() == [] and substring.passage_report(none).collect() == [] and licenses.scan_licenses(none).collect() == []
    assert ordinal.grade(none, ordinal.train(none, labels)).collect() == [] and toxicity.score_toxicity(none, toxicity.train(none, labels)).collect() == []
    assert pieces.encoding_report(none, vocabulary()).collect() == [] and rules.apply_policy(rules.ledger(none)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, BASE).collect()
    assert 0 < len(got) < 200 and all(len(r["piece_ids"]) == r["n_pieces"] for r in got)
