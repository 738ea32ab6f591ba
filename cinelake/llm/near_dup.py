"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification on full shingle sets.

Words are lower-cased `[^\\x20\\x09-\\x0D]+`; a document's set has its distinct shingles of `k` words, or its whole sequence of fewer words as the only one. Documents
are linked if 100 * |intersection| >= 75 * |union|; a document's component is the smallest doc_id that links reach.

1. Signatures. sigma spreads each shingle over DIM places; pi is one permutation of the places, and coordinate i of the signature is the least value of pi at
   sigma(x) + i over the set (circularly): two permutations give all coordinates. The coordinates of a shingle are neighbours in pi, so that one slice is read for each.
2. Equal sets. Documents with equal sets (128-bit digests of all shingles) are one class, represented by its smallest id; copies go no further.
3. Bands. Each band of ROWS coordinates is a bucket. The members of a bucket are verified against one of them only, the one that meets most others in all its
   buckets, never all with all.
4. The rest, exactly. Buckets whose members are not all in one component yet can hide links between members that the verified one doesn't have. Their documents emit the prefix of their
   set, rarest shingles first: two sets over the threshold share a shingle of both prefixes, whatever the order is, and rare ones first leave passages that many
   documents share out of the prefixes. The order comes from a table of SLOTS counts of hashed shingles, whose size is fixed. For each shared shingle the members outside the largest
   component meet the members of other components. Documents that were verified against the same one, their centre, also emit all shingles that it lacks, to meet only each other there. The intersection of two of
   them is at most the smaller of their overlaps with the centre and the shingles of this kind that they share, which keeps the many edited copies of one text from being compared with
   each other when they are too far apart.
5. Components of all verified links.

A pair at the very threshold shares a bucket with probability 1 - (1 - 0.75 ** ROWS) ** BANDS, 0.999995.

Defined cases: a NULL or empty text has no set, is linked with nothing and kept; a row with NULL doc_id can't be linked: its component is NULL and it is kept; repeated rows
share a component and are all kept or not by their id; of an id with different texts, each row has the component of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.components import components
from cinelake.llm.store import Workspace
from cinelake.llm.words import SPACED, Words, gram_hashes, mix, stream, text_slices

SHINGLE = 5
BANDS, ROWS = 32, 4
DIM = 1 << 20
SLOTS = 1 << 21
_BLOCK = 4096


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, SPACED)
    hashes = words.hashes()
    grams = gram_hashes(hashes, k)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        else:
            out.append(gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """Row x is the slice of pi that begins at place x, going round at the end."""
    pi = np.random.default_rng(20240229).permutation(DIM).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS - 1]]), BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    circle = _circle()
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(DIM - 1)).astype(np.int64)
    out = np.full(BANDS * ROWS, DIM, np.uint32)
    for at in range(0, len(places), _BLOCK):
        np.minimum(out, circle[places[at : at + _BLOCK]].min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return mix((rows * stream(5, ROWS)).sum(axis=2, dtype=np.uint64) + stream(6, BANDS)).view(np.int64)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text"))
        keys = bands(np.stack([signature(s) for s in sets])) if sets else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets and of the intersection."""

    def measure(batches):
        for batch in text_slices(batches, "text_a"):
            left, right = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            sizes = [pa.array([len(s) for s in x], pa.int64()) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "both"])

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(measure, "a long, b long, n_a long, n_b long, both long")


_LINKED = "100 * both >= 75 * (n_a + n_b - both) AND both > 0"


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(texts: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in text_slices(batches):
            for s in shingle_sets(batch.column("text")):
                total += np.bincount(_slots(s), minlength=SLOTS) if len(s) > SLOTS // 8 else 0
                if len(s) <= SLOTS // 8:
                    np.add.at(total, _slots(s), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    rows = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[np.asarray(rows["slot"])] = np.asarray(rows["n"])
    return out


def _prefixes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, id, n, centre, overlap, kind, rest): the shingles of each set that any set over the threshold must share one of (kind 1 if the centre has it, else 0), and all that its centre
    lacks, as keys of this centre (kind 2); overlap: how many it has. rest: how many of the set's
    shingles, or of those that the centre lacks (kind 2), don't come before this one in the order."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches):
        for batch in text_slices(batches):
            out = []
            centres = shingle_sets(batch.column("text_c"))
            for doc, centre, s, c in zip(batch.column("doc_id").to_pylist(), batch.column("centre").to_pylist(), shingle_sets(batch.column("text")), centres):
                n = len(s)
                take = n - (75 * n + 99) // 100 + 1 if n else 0
                first = s[np.lexsort((s, sent.value[_slots(s)]))[:take]]
                inside = np.isin(s, c, assume_unique=True) if centre is not None else np.ones(n, bool)
                lacks = s[~inside]
                lacks = lacks[np.lexsort((lacks, sent.value[_slots(lacks)]))]
                own = mix(lacks ^ np.uint64(centre & (1 << 64) - 1)) if centre is not None else s[:0]  # these keys are the centre's
                inside_first = np.isin(first, s[inside], assume_unique=True)
                rest = np.concatenate([n - np.arange(len(first)), len(own) - np.arange(len(own))])
                out.append((doc, n, centre, int(inside.sum()), np.concatenate([first, own]), np.concatenate([inside_first.astype(np.int32), np.full(len(own), 2, np.int32)]), rest))
            sizes = [len(r[4]) for r in out]
            if out:
                spread = [pa.array(np.repeat([r[i] for r in out], sizes), pa.int64()) for i in (0, 1, 3)]
                centre = pa.array([r[2] for r in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                keys, kinds = pa.array(np.concatenate([r[4] for r in out]).view(np.int64)), pa.array(np.concatenate([r[5] for r in out]))
                rests = pa.array(np.concatenate([r[6] for r in out]), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, *spread[:2], centre, spread[2], kinds, rests], names=["key", "id", "n", "centre", "overlap", "kind", "rest"])

    return texts.select("doc_id", "text", "centre", "text_c").mapInArrow(prefix, "key long, id long, n long, centre long, overlap long, kind int, rest long")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds each id's component so far, itself if it has no link."""
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The keys whose rows are of different components."""
    return rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")


def _main(rows: DataFrame) -> DataFrame:
    """(key, main): the largest component of each key that has several."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts"))
    return main.where("parts > 1").select("key", "main")


def _cross_pairs(rows: DataFrame, main: DataFrame, space: Workspace) -> DataFrame:
    """Pairs of ids of different components that share a key, and whose sizes allow the threshold: members outside the key's main component meet the others.

    Of the shingles that two sets share, the first in the order leaves no more than the smaller rest of both to share; a pair over the threshold passes this bound there, so a meeting that doesn't is left
    out. The same holds for the shingles that a common centre lacks. Pairs that met by these only are bounded once more, by how many of them both have.
    """
    marked = rows.join(main, "key")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component", "centre", "overlap", "rest")]
    a = marked.where("component <> main").select("key", "kind", *side("a"))
    b = marked.select("key", (F.col("component") == F.col("main")).alias("is_main"), *side("b"))
    either = (100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("is_main") | (F.col("id_a") > F.col("id_b")))
    same = F.coalesce(F.col("centre_a") == F.col("centre_b"), F.lit(False))
    both, rest = F.least("overlap_a", "overlap_b"), F.least("rest_a", "rest_b")
    reaches = lambda n: 100 * n >= 75 * (F.col("n_a") + F.col("n_b") - n)
    by_own = same & (F.col("kind") == 2) & reaches(both + rest)
    by_prefix = (F.col("kind") < 2) & reaches(rest) & (~same | ((F.col("kind") == 1) & reaches(both)))
    met = a.join(b, "key").where(either & (by_own | by_prefix))
    met = met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"), "n_a", "n_b", both.alias("both"), (F.col("kind") == 2).alias("own"))
    met = space.write(met.groupBy("a", "b").agg(F.bool_and("own").alias("own"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "both")]), "met")
    lacks = lambda x: rows.where("kind = 2").groupBy(F.col("id").alias(x)).agg(F.collect_list("key").alias(f"keys_{x}"))  # noqa: E731  of one document, at most its set
    bounded = met.where("own").join(lacks("a"), "a").join(lacks("b"), "b")
    bounded = bounded.where(reaches(F.col("both") + F.size(F.array_intersect("keys_a", "keys_b")))).select("a", "b")
    return met.where("not own").select("a", "b").union(bounded)


def _leads(members: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(key, lead) of each bucket with several members: the member that meets most others in all its buckets; and (id, weight), how many each meets."""
    sizes = space.write(members.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "m"), "sizes")
    shared = space.write(members.join(sizes, "key"), "shared")
    weights = space.write(shared.groupBy("id").agg(F.sum("m").alias("weight")), "weights")
    leads = shared.join(weights, "id").groupBy("key").agg(F.max("weight").alias("weight"))
    leads = space.write(leads, "heaviest")
    return shared.join(weights, "id").join(leads, ["key", "weight"]).groupBy("key").agg(F.min("id").alias("lead")), weights


def _centres(tested: DataFrame, found: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, centre): the heaviest member of the component of the heaviest document that doc_id was verified against and shares half of both sets with (or is).

    All that lie around one component have one centre, whichever of its members they met.
    """
    alike = tested.where("2 * both >= n_a + n_b - both").select(F.col("a").alias("doc_id"), F.col("b").alias("id"))
    near = alike.union(tested.select("b", "b").distinct()).join(weights, "id").groupBy("doc_id").agg(F.max_by("id", F.struct("weight", "id")).alias("id"))
    hubs = found.join(weights, "id").groupBy("component").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"))
    return _labelled(near, found).join(hubs, "component", "left").select("doc_id", F.coalesce("hub", "id").alias("centre"))


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    space = Workspace(docs.sparkSession, "near-dup")
    rows = space.write(docs.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "digest").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    classes = space.write(classes.select("digest", F.col("n_shingles").alias("n"), F.col("x.doc_id").alias("id"), F.col("x.bands").alias("bands")), "classes")
    members = classes.select("id", F.explode("bands").alias("key"))
    leads, weights = _leads(members, space)
    leads = space.write(leads, "leads")
    members = space.write(members.join(leads, "key"), "members")  # of buckets with two ids or more
    space.drop("sizes", "shared", "heaviest", "leads")
    pairs = members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h")  # of repeated rows, one
    texts = space.write(texts, "texts")
    tested = space.write(_overlaps(pairs, texts), "tested")
    found = components(tested.where(_LINKED).select("a", "b"), space, "first")
    unsettled = space.write(_labelled(members.select("key", "id"), found), "unsettled")
    open_ids = unsettled.join(space.write(_mixed(unsettled), "mixed"), "key", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    centres = space.write(_centres(tested, found, weights), "centres")
    open_texts = space.write(texts.join(open_ids, "doc_id", "left_semi").join(centres, "doc_id", "left"), "open-texts")
    centre_texts = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("text_c"))
    prefixes = _prefixes(open_texts.join(centre_texts, "centre", "left"), _slot_counts(open_texts))
    prefixes = space.write(_labelled(prefixes, found), "prefixes")
    more = space.write(_overlaps(_cross_pairs(prefixes, space.write(_main(prefixes), "main"), space), open_texts).where(_LINKED).select("a", "b"), "more-links")
    space.drop("main", "met", "prefixes", "mixed", "unsettled", "open-texts", "texts", "members", "centres", "tested", "weights")
    final = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), space, "last")
    labelled = _labelled(classes.select("id", "n", "digest"), final).select(F.col("n").alias("n_shingles"), "digest", "component")
    out = rows.select("doc_id", "n_shingles", "digest").join(labelled, ["n_shingles", "digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns."""
    gone = find_near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
