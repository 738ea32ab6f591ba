"""Filter audit, Merkle manifest and mixing against plain forms of them, and their defined cases."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from cinelake.llm import filter_audit, merkle, mixing
from cinelake.llm.queries import QUERIES
from cinelake.llm.store import Workspace

from .brute import SPACED


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# filter audit


def plain_audit(docs, marks):
    """Each order, applied step by step to each row."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, s in docs:
        t, words = t or "", SPACED.findall(t or "")
        out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        out["E"] = d is not None and d > least[t]
        fails.append((s or "", {k for k, v in out.items() if v}, *[d is not None and any(m[i] == 1 for m in marks.get(d, [])) for i in (0, 1)]))
    want = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, x in enumerate(order, 1):
                gone = [f for f in alive if x in f[1]]
                alive = [f for f in alive if x not in f[1]]
                shapley[x] += len(gone)
                want[part, order, step] = [len(alive), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                want[part, order, step].append(shapley[x])
    return want


@pytest.mark.parametrize("labelled", [True, False])
def test_audit_odd(spark, plain_odd, labelled):
    marks = [(4, 1, 0), (4, 0, 1), (5, None, 1), (11, 0, 1), (12, 1, None), (None, 1, 1), (99, 1, 1)] if labelled else []
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    by_id = {}
    for d, q, x in marks:
        by_id.setdefault(d, []).append((q, x))
    want = plain_audit([(r.doc_id, r.text, r.source) for r in plain_odd.collect()], by_id)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in rows_of(filter_audit.audit(plain_odd, labels))} == want
    assert filter_audit.audit(plain_odd.limit(0), labels).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_positional_popcounts(n):
    rng = np.random.default_rng(n)
    words, group = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 7, n)
    want = np.zeros((7, 32), np.int64)
    for w, g in zip(words.tolist(), group.tolist()):
        want[g] += [w >> i & 1 for i in range(32)]
    assert (filter_audit.positional_popcounts(words, group, 7) == want).all()


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_merkle(docs):
    """docs: (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for d in docs:
        text = d[4].replace("\n", "") if d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[4]
        trees.setdefault(d[1], []).append((d[0], sha(*map(said, d)), sha(*map(said, [*d[:4], text]))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {s: levels_of([leaf for _, leaf, _ in trees[s]]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, (d, leaf, claimed) in enumerate(trees[s]):
            now, siblings = claimed, []
            for levels, at in ((built[s], i), (top, place)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    now = sha(*run[: at % 3], now, *run[at % 3 + 1 :])
                    at //= 3
            out.append((d, leaf, built[s][-1][0], top[-1][0], sha(*siblings), now))
    return sorted(out, key=str)


def test_merkle_odd(plain_odd):
    got = rows_of(merkle.audit(plain_odd))
    want = plain_merkle([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in plain_odd.collect()])
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")) for r in got), key=str) == want
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and not all(r["verified"] for r in got)
    assert merkle.audit(plain_odd.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 81, 82])
def test_trees_of_several_tiers(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}", None, "s", 2) for i in range(n)] + [(1000 + i, "u", "l", f"s{i}", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    space = Workspace(spark, "test")
    rows = docs.select(merkle.tree_of().alias("tree"), "doc_id", merkle.leaf().alias("digest"))
    manifest = merkle.build(rows, space, tier=2)
    want = {w[0]: w for w in plain_merkle([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])}
    assert manifest.root == want[0][3] and merkle.depth(n) == len(levels_of(["x"] * n)) - 1
    for asked in ("true", "doc_id % 5 = 1", "doc_id = 0"):  # all leaves, some, one
        got = rows_of(merkle.prove(manifest, manifest.leaves.where(asked), Workspace(spark, "test")))
        assert len(got) == manifest.leaves.where(asked).count()
        for r in got:
            assert (r["digest"], r["subroot"], r["proof_sha256"], r["folded_root"]) == (want[r["doc_id"]][1], want[r["doc_id"]][2], want[r["doc_id"]][4], manifest.root)


def test_missing_is_the_minimal_union():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        known = np.unique(rng.integers(0, n, rng.integers(1, 20)))
        given, needed, sizes = {(0, int(i)) for i in known}, set(), [n]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 3))
        for i in known.tolist():
            for level, size in enumerate(sizes[:-1]):
                needed |= {(level, j) for j in range(i // 3 * 3, min(size, i // 3 * 3 + 3))}
                i //= 3
                given.add((level + 1, i))
        assert set(merkle.missing(known, n)) == needed - given


def test_a_leaf_that_is_not_in_the_manifest(spark):
    rows = spark.createDataFrame([("s", i, sha(str(i))) for i in range(20)], "tree string, doc_id long, digest string")
    manifest = merkle.build(rows, Workspace(spark, "test"), tier=2)
    wrong = manifest.leaves.replace({sha("7"): sha("8")}, subset=["digest"])
    with pytest.raises(Exception, match="not those of the manifest"):
        merkle.prove(manifest, wrong, Workspace(spark, "test")).collect()


# mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """sizes: {source: size}. Shares by weight; what is over a stop is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, got, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while rest > 1e-9 and open_:
        share, rest = rest / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += share * weight[s]
            if got[s] > 2 * sizes[s]:
                rest += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_.remove(s)
    return got


def check_mix(rows, texts):
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(SPACED.findall(texts[r["doc_id"]] or "")) or r["doc_id"] is None
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert r["size"] * int(r["rate"]) <= r["size"] * r["copies"] <= 2 * r["size"] and r["copies"] - int(r["rate"]) in (0, 1)
    return want


def test_mixing_odd(spark, plain_odd):
    rows = rows_of(mixing.draw_copies(plain_odd))
    check_mix(rows, {r.doc_id: r.text for r in plain_odd.collect()})
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(mixing.draw_copies(plain_odd.repartition(5)))))
    mixed = mixing.mix(plain_odd)
    assert mixed.columns == plain_odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert Counter(r["doc_id"] for r in rows_of(mixed)) == sum((Counter({r["doc_id"]: r["copies"]}) for r in rows), Counter())
    none = plain_odd.limit(0)
    assert mixing.draw_copies(none).collect() == [] and mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["copies"]) for r in rows_of(mixing.draw_copies(blank))] == [(0, 0.0, 0)] * 2


def test_mixture_query(spark):
    base = "/root/testdata/sf0.01"
    rows = rows_of(QUERIES["op13_mixture"](spark, base))
    want = check_mix(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()})
    for s, target in want.items():
        own = [r for r in rows if r["source"] == s]
        f = target / own[0]["source_size"] % 1
        assert abs(sum(r["taken"] for r in own) - target) <= 4.5 * (f * (1 - f) * sum(r["size"] ** 2 for r in own)) ** 0.5 + 1e-6


# pipeline


def test_stages_on_odd_and_empty_tables(spark, plain_odd):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    for table in (plain_odd, plain_odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before = {r["doc_id"] for r in rows_of(docs.select("doc_id"))}
            out = stage(spark, docs, base)
            assert {r["doc_id"] for r in rows_of(out.select("doc_id"))} <= before, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns, name
                docs = out
    kept = rows_of(out)
    assert kept == []
