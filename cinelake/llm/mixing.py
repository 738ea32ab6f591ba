"""Mixing of sources to target weights: tokens per source, a repetition rate for each, and documents that are emitted floor(rate) times plus one hash-seeded Bernoulli copy.

A size is the number of words `[^\\x20\\x09-\\x0D]+`. Sources, in the order of their code points and NULL last, weigh WEIGHTS in turn and share SHARE times all sizes. A target stops at
CAP times its source's size; the excess is shared again by weight until none is above. A round of that is one aggregate over the table of sources, of which the driver gets three sums; no source, however
many there are, is handled on its own. The copy beyond the whole ones is drawn by a digest of seed, doc_id and text, so that reruns and retried tasks agree.

Defined cases: a NULL or empty text has size 0, and takes nothing; a source of size 0 has target 0; NULL is a source of its own, the empty string another; rows that repeat both doc_id and text
share one draw; a NULL doc_id is drawn by its text. Texts are counted whole. Emitted rows keep all columns of the documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.llm.ranks import ranked
from cinelake.llm.store import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 13
_BITS = 52


def _source_key(name: str = "source"):
    """A string that is never NULL, in the order of sources."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name)))


def _draw(seed: int):
    """A uniform number in [0, 1)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long") / F.lit(float(1 << _BITS))


def targets(sizes: DataFrame, space: Workspace, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source_key, size, ...) to (source_key, source_size, target)."""
    totals = ranked(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")).withColumn("whole", F.lit("")), "whole", ["source_key"], space, "totals")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")).cast("long")
    sources = space.write(totals.select("source_key", "source_size", weight.alias("weight")), "sources")
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:  # the level rises and more sources are full, until none is above its stop
        full = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        n, filled, open_ = sources.agg(F.count_if(full), F.sum(F.when(full, cap * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == before or not open_:
            break
        level, before = (share * everything - (filled or 0)) / open_, n
    return sources.select("source_key", "source_size", F.least(F.col("weight") * F.lit(level), cap * F.col("source_size").cast("double")).alias("target"))


def draw_copies(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies."""
    space = Workspace(docs.sparkSession, "mixing")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = space.write(docs.select("doc_id", "source", _source_key().alias("source_key"), words.alias("size"), _draw(seed).alias("draw")), "sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    found = sizes.join(targets(sizes, space, weights, share, cap), "source_key").withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), F.lit(1)).otherwise(F.lit(0))
    return found.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mixed documents: each row as often as it is drawn, with the columns it has."""
    space = Workspace(docs.sparkSession, "mix")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = docs.select(_source_key().alias("source_key"), words.alias("size"))
    rates = targets(sizes, space, weights, share, cap)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _source_key().alias("source_key"), _draw(seed).alias("draw"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = row.join(rates, "source_key").withColumn("rate", rate)
    copies = (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), F.lit(1)).otherwise(F.lit(0))).cast("int")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
