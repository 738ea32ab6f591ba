"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read only the stored bits.

Words are `[^\\x20\\x09-\\x0D]+`. A rule is a condition on the measurements; bit i of `failed_bits` says that rule i of RULES failed. A policy is a version and a
mask of rules that reject; judging a document by another version, or asking what one rule alone rejects, needs no text.

Everything here is made of built-in column functions in one projection over the documents; there is no shuffle. Defined cases: a NULL or empty text has no words and
fails the length rule; repeated rows each get their own ledger row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_BLANK = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # SQL over the measurements


#: The order is the order of bits; new rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE = ("too_few_words", "repeated_words")


def mask(*names: str) -> int:
    known = [r.name for r in RULES]
    return sum(1 << known.index(n) for n in names)


#: Versions of the policy: the rules that reject.
POLICIES = {1: mask(*BASE), 2: mask(*BASE, "symbols", "duplicate_lines"), 3: mask(*(r.name for r in RULES))}
CURRENT = 3


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window which is found twice or more. Windows are sorted with their positions, so that equal ones become neighbours; a repeated
    window covers three words, or as many as its distance to the next repeated one."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("h"), i.alias("i")))
    ordered = F.transform(F.array(F.sort_array(windows)), lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))[0]
    places = F.sort_array(F.transform(ordered, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, "\t\x0b\f\r", "    ")) != "")
    parts = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return parts.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failed_bits of each row: what is stored, once for all policies."""
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs).withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed, policy (the version) and kept (no rule of the policy failed, nor a base rule)."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(*BASE))) != 0
    return book.withColumns({
        "base_failed": base, "policy": F.lit(version),
        "kept": ~base & (F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0),
    })


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For a stored ledger, and each rule of the policy: how many rows it rejects, how many only it rejects, and which rules fail with it in every such row or in any."""
    active = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version]))
    patterns = book.groupBy(active.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if POLICIES[version] >> i & 1]))
    return (
        patterns.select("bits", "n", rules.alias("r")).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum("n").alias("rejected"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"), F.bit_and("bits").alias("always_with"), F.bit_or("bits").alias("ever_with"))
    )
