"""Merkle manifest of a dataset, and membership proofs by octopus multiproofs.

Leaves are digests of rows. The leaves of a source, by doc_id, are hashed in runs of three, level by level, to the source's root; the roots of the sources, in their order, likewise to the root
of the dataset. A manifest is the written table of nodes (tree, level, idx, digest): the trees of the sources, and the one above them. It is built in tiers: a task takes a block of 3 ** TIER
consecutive nodes and climbs TIER levels at once, so a tree of any size takes a few shuffles, and no task more than a block.

Proofs are made for many leaves at once. The leaves asked for are partitioned by blocks of the tree; each partition computes the minimal union of node coordinates that its paths need and its
own leaves don't give (`missing`), all partitions fetch theirs in one join with the manifest, each derives the shared interior nodes once, and expands the proofs of its leaves from them. A node
far above the leaves is asked for by many partitions; it is laid out in COPIES copies among which the requests choose.

Defined cases: a NULL field is `-`; NULL sources are one source, the first; rows of NULL doc_id come first in their source; repeated rows are leaves of their own, next to each other (leaves of one
doc_id are ordered by digest); no rows, no trees and no root (None). Texts are hashed whole. Columns besides the five fields are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.llm.ranks import ranked
from cinelake.llm.store import Workspace

ARITY = 3
TIER = 7
COPIES = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"
_NODES = "tree string, level int, idx long, digest string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(**replaced: Column) -> Column:
    """The digest of a row; fields may be replaced by other columns."""
    values = [replaced.get(f, F.col(f)).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def tree_of(source: str = "source") -> Column:
    """The name of a source's tree, never NULL and in the order of sources; TOP, the tree above them, is none of these."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source)))


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def parents(digests: list[str]) -> list[str]:
    """The next level of a whole run of nodes that begins with a first child."""
    return [digest(*digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that the paths of the leaves `known` (sorted, distinct) of n need and that these leaves don't give: the minimal union for all of them together."""
    out, level = [], 0
    while n > 1:
        above = np.unique(known // ARITY)
        needed = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        needed = needed[needed < n]
        out += [(level, int(i)) for i in np.setdiff1d(needed, known, assume_unique=True)]
        known, n, level = above, -(-n // ARITY), level + 1
    return out


def _block(tier: int) -> Column:
    return F.floor(F.col("idx") / ARITY**tier)


def _forest(rows: DataFrame, space: Workspace, name: str, tier: int) -> list[DataFrame]:
    """Nodes of the trees over ranked leaves (tree, idx, n, digest), a written table for each tier."""
    tiers, base = [], 0
    nodes = rows.select("tree", "idx", "n", "digest")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        first = not base

        def climb(table: pa.Table) -> pa.Table:
            tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
            at = np.argsort(table["idx"].to_numpy())
            start, level = int(table["idx"].to_numpy()[at[0]]), base
            now = table["digest"].take(pa.array(at)).to_pylist()
            found = [(level, start, now)] if first else []
            while level < base + tier and -(-n // ARITY**level) > 1:
                now, start, level = parents(now), start // ARITY, level + 1
                found.append((level, start, now))
            digests = [d for *_, part in found for d in part]
            return pa.table({
                "tree": pa.array([tree] * len(digests), pa.string()), "level": pa.array([k for k, _, part in found for _ in part], pa.int32()),
                "idx": pa.array([s + i for _, s, part in found for i in range(len(part))], pa.int64()), "digest": pa.array(digests, pa.string()), "n": pa.array([n] * len(digests), pa.int64()), "root": pa.array([n <= ARITY**k for k, _, part in found for _ in part]),
            })

        blocks = nodes.withColumn("block", _block(tier)).groupBy("tree", "block")
        written = space.write(blocks.applyInArrow(climb, f"{_NODES}, n long, root boolean"), f"{name}-{base}")
        tiers.append(written)
        base += tier
        if largest <= ARITY**base:
            return tiers
        nodes = written.where(F.col("level") == base).where(F.col("n") > ARITY**base).select("tree", "idx", "n", "digest")


@dataclass(frozen=True)
class Manifest:
    """leaves: the rows given, with tree, idx and n (their place in their source), top_idx and top_n (their source's place among all). nodes: the written nodes. root: None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    tier: int


def build(rows: DataFrame, space: Workspace, tier: int = TIER) -> Manifest:
    """rows: tree, doc_id, digest, and whatever else goes with a leaf. Tasks hold blocks of 3 ** tier leaves."""
    leaves = space.write(ranked(rows, "tree", ["doc_id", "digest"], space, "placed"), "leaves")
    tiers = _forest(leaves, space, "nodes", tier)
    subroots = _union(tiers).where("root").select("tree", "digest")
    sources = space.write(ranked(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), "tree", ["of"], space, "sources-placed"), "sources")
    tops = _forest(sources, space, "top", tier)
    top = tops[-1].where("root").select("digest").first()
    places = sources.select(F.col("of").alias("tree"), F.col("idx").alias("top_idx"), F.col("n").alias("top_n"))
    return Manifest(leaves.join(places, "tree"), _union([*tiers, *tops]).drop("n", "root"), top[0] if top else None, tier)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _requests(batch: pa.Table) -> list[tuple[str, int, int]]:
    """Coordinates (tree, level, idx) that the leaves of a partition need from the manifest."""
    one = {c: batch[c][0].as_py() for c in ("tree", "n", "top_idx", "top_n")}
    own = [(one["tree"], *at) for at in missing(np.unique(batch["idx"].to_numpy()), one["n"])]
    return own + [(TOP, *at) for at in missing(np.array([one["top_idx"]]), one["top_n"])]


class Paths:
    """What is known to a partition: by level, the digest of each node on or beside its paths; and the steps (left siblings, right siblings) of each node's path to the root."""

    def __init__(self, known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]):
        self.steps: list[dict[int, tuple[str, str]]] = []
        while n > 1:
            level = len(self.steps)
            steps, above = {}, {}
            for p in sorted({i // ARITY for i in known}):
                run = [(i, known[i] if i in known else fetched[level, i]) for i in range(p * ARITY, min(n, (p + 1) * ARITY))]
                above[p] = digest(*[d for _, d in run])
                for i, _ in run:
                    if i in known:
                        steps[i] = ("".join(d for j, d in run if j < i), "".join(d for j, d in run if j > i))
            self.steps.append(steps)
            known, n = above, -(-n // ARITY)
        self.root = known[0]

    def path(self, i: int) -> list[tuple[str, str]]:
        out = []
        for steps in self.steps:
            out.append(steps[i])
            i //= ARITY
        return out


def fold(start: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        start = digest(left, start, right)
    return start


def prove(manifest: Manifest, asked: DataFrame, space: Workspace, claimed: str = "digest") -> DataFrame:
    """Proofs of the leaves `asked`, any rows of manifest.leaves. Per row, in place of its position: subroot, proof_sha256 (the digest of its siblings in order), folded_root
    (what the column `claimed`, a leaf as someone has it, folds to with these siblings). A leaf that the manifest doesn't hold, or a node that is not its own, fails the job."""
    asked = asked.withColumn("block", _block(manifest.tier))
    places = ["tree", "block", "idx", "n", "top_idx", "top_n"]
    coordinates = "tree string, block long, node_tree string, level int, idx long"

    def request(table: pa.Table) -> pa.Table:
        found = _requests(table)
        return pa.table({
            "tree": pa.array([table["tree"][0].as_py()] * len(found), pa.string()), "block": pa.array([table["block"][0].as_py()] * len(found), pa.int64()),
            "node_tree": pa.array([t for t, *_ in found], pa.string()), "level": pa.array([k for _, k, _ in found], pa.int32()), "idx": pa.array([i for *_, i in found], pa.int64()),
        })

    def high(column: str) -> Column:
        return (F.col(column) == TOP) | (F.col("level") >= 2 * manifest.tier)

    wanted = asked.select(*places).groupBy("tree", "block").applyInArrow(request, coordinates)
    wanted = wanted.withColumn("copy", F.when(high("node_tree"), F.pmod(F.xxhash64("tree", "block"), F.lit(COPIES))).otherwise(F.lit(0)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.when(high("node_tree"), F.lit(COPIES - 1)).otherwise(F.lit(0))))
    laid = manifest.nodes.withColumnRenamed("tree", "node_tree").select("*", copies.alias("copy"))
    fetched = space.write(wanted.join(laid, ["node_tree", "level", "idx", "copy"]).select("tree", "block", "node_tree", "level", "idx", "digest"), "fetched")
    others = [c for c in asked.columns if c not in places]
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", subroot string, proof_sha256 string, folded_root string"

    def expand(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({**{c: rows[c] for c in others}, **{c: pa.array([], pa.string()) for c in ("subroot", "proof_sha256", "folded_root")}})
        one = {c: rows[c][0].as_py() for c in ("n", "top_idx", "top_n")}
        given: dict[bool, dict[tuple[int, int], str]] = {True: {}, False: {}}
        for t, k, i, d in zip(*[nodes[c].to_pylist() for c in ("node_tree", "level", "idx", "digest")]):
            given[t == TOP][k, i] = d
        at = rows["idx"].to_pylist()
        own = Paths(dict(zip(at, rows["digest"].to_pylist())), one["n"], given[False])
        above = Paths({one["top_idx"]: own.root}, one["top_n"], given[True])
        if above.root != root:
            raise ValueError("the leaves are not those of the manifest")
        shared = above.path(one["top_idx"])
        proofs, folded = [], []
        for i, mine in zip(at, rows[claimed].to_pylist()):
            path = own.path(i) + shared
            proofs.append(digest(*[part for step in path for part in step]))
            folded.append(fold(mine, path))
        return pa.table({**{c: rows[c] for c in others}, "subroot": pa.array([own.root] * len(at)), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

    root = manifest.root
    return asked.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, out)


def tampered_text() -> Column:
    """The text without its line ends where 2 divides crc32 of the doc_id as text; a NULL doc_id is not tampered with."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows against the manifest of all rows, folded with the leaves of tampered texts. Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    space = Workspace(docs.sparkSession, "merkle")
    rows = docs.select(tree_of().alias("tree"), "doc_id", leaf().alias("digest"), leaf(text=tampered_text()).alias("claimed"))
    manifest = build(rows, space)
    proved = prove(manifest, manifest.leaves, space, "claimed")
    root = F.lit(manifest.root).cast("string")
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
