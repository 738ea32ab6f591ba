"""The registered queries of this package, and the SQL forms of those that SQL can express. Each applies one operator with its production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.llm import decontaminate, filter_audit, katz, licenses, merkle, mixing, near_dup, ordinal, pieces, rules, sharding, substring, toxicity
from cinelake.llm.sample import fold

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> tuple:
    return pieces.load_vocabulary(path)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words inside benchmark windows, the items they come from, and whether there are any."""
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base and Katz log10 probabilities of the whole text; seven folds, one held out."""
    return katz.score_corpus(_table(spark, sf_dir, "documents"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: expected grade, tail probability and whether the classifier keeps it."""
    docs = _table(spark, sf_dir, "documents")
    return ordinal.grade(docs, ordinal.train(docs, _table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: score and prediction from class-conditional Kneser-Ney models; four folds, one held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces of its text and whether they decode to it exactly."""
    return pieces.encoding_report(_table(spark, sf_dir, "documents"), vocabulary())


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its shingle set, its component, and whether it is the one kept."""
    return near_dup.find_near_duplicates(_table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shard and slot under the law of equal bytes."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: passages of 50 words and more that one earlier document has."""
    return substring.passage_report(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: licence phrases and identifier expressions, with labels and a score."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: measurements, failed rules as bits, and the verdict of the current policy."""
    return rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", "policy"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order of the five filters and step: what is kept, removed, redundant, lost of each label, and Shapley sums."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, its proof's digest, and whether its (partly tampered) row still folds to the manifest's root."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and how many words the mix takes of it."""
    return mixing.draw_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_katz, op3_ordinal_quality, op4_toxicity, op5_pieces, op6_near_duplicates, op7_shards, op8_passages, op9_licenses, op10_rules, op11_filter_audit, op12_merkle,
        op13_mixture,
    )
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH w AS (SELECT item_id, regexp_extract_all({_LOW.format('text')}, '{_WORD}') AS words FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM w WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, k, words[i:i + k - 1] AS win FROM g),
d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '{_WORD}') AS words FROM documents),
firsts AS (SELECT DISTINCT win[1] AS head, k FROM windows),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
c AS (SELECT p.doc_id, p.i, f.k, p.words[p.i:p.i + f.k - 1] AS win FROM p JOIN firsts f ON p.words[p.i] = f.head AND p.i + f.k - 1 <= len(p.words)),
h AS (SELECT c.doc_id, c.i, c.k, x.item_id FROM c JOIN windows x ON c.k = x.k AND c.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.said, '')) AS items_sha256, coalesce(items.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM r GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
             CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l.lines) AS BIGINT) AS n_lines,
             CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, 100 * n_symbols > 20 * n_words AS c,
             n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS d, word_chars < 2 * n_words AS e, word_chars > 15 * n_words AS f FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b OR c OR d OR e OR f) AS kept,
       CAST(CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) + 32 * CAST(f AS INT) AS BIGINT) AS failed_bits, 3 AS policy
FROM f
"""

#: Every order is applied step by step to every row.
_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text), regexp_matches(text, '[#$%&*|]'),
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a JOIN s b ON b.x <> a.x JOIN s c ON c.x NOT IN (a.x, b.x) JOIN s d ON d.x NOT IN (a.x, b.x, c.x) JOIN s e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
p AS (SELECT filter_order, unnest(range(1, 6)) AS step, list_transform(string_split(filter_order, ''), lambda c: ascii(c) - 64) AS places FROM o),
u AS (SELECT part, bad, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, bad),
j AS (SELECT part, filter_order, step, n, good, toxic, bad[places[step]] AS fails, len(list_filter(places[1:step - 1], lambda i: bad[i])) > 0 AS gone, len(list_filter(bad, lambda b: b)) AS fails_n FROM u, p),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails AND fails_n = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM j GROUP BY part, filter_order, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_RUNS = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))"
#: Whole levels as lists; paths are folded level by level. crc32 from its table of 256 values, made by the rule.
_OP12 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256])), 4294967295) % 2 = 0 AS tampered FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) CROSS JOIN crc),
d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
             CASE WHEN tampered THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS claimed FROM documents LEFT JOIN c USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
tree AS (SELECT source, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM k GROUP BY source UNION ALL SELECT source, level + 1, {_RUNS} FROM tree WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub UNION ALL SELECT level + 1, {_RUNS} FROM top WHERE len(nodes) > 1),
steps AS (SELECT k.leaf, k.doc_id, k.idx, k.source, tree.level AS climb, tree.nodes[k.idx // CAST(3 ** tree.level AS BIGINT) // 3 * 3 + 1:k.idx // CAST(3 ** tree.level AS BIGINT)] AS before,
                 tree.nodes[k.idx // CAST(3 ** tree.level AS BIGINT) + 2:k.idx // CAST(3 ** tree.level AS BIGINT) // 3 * 3 + 3] AS after
          FROM k JOIN tree ON k.source IS NOT DISTINCT FROM tree.source AND len(tree.nodes) > 1
          UNION ALL
          SELECT k.leaf, k.doc_id, k.idx, k.source, 1000 + top.level, top.nodes[place // CAST(3 ** top.level AS BIGINT) // 3 * 3 + 1:place // CAST(3 ** top.level AS BIGINT)],
                 top.nodes[place // CAST(3 ** top.level AS BIGINT) + 2:place // CAST(3 ** top.level AS BIGINT) // 3 * 3 + 3]
          FROM k JOIN sub ON k.source IS NOT DISTINCT FROM sub.source JOIN top ON len(top.nodes) > 1),
paths AS (SELECT source, idx, list({{'l': array_to_string(before, ''), 'r': array_to_string(after, '')}} ORDER BY climb) AS path FROM steps GROUP BY source, idx),
folded AS (SELECT k.source, k.idx, 1 AS i, claimed AS now, coalesce(path, []) AS path FROM k LEFT JOIN paths ON k.source IS NOT DISTINCT FROM paths.source AND k.idx = paths.idx
           UNION ALL SELECT source, idx, i + 1, sha256(path[i].l || now || path[i].r), path FROM folded WHERE i <= len(path)),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT k.doc_id, k.leaf, sub.subroot, root.root, sha256(array_to_string(list_transform(folded.path, lambda p: p.l || p.r), '')) AS proof_sha256, folded.now AS folded_root, folded.now = root.root AS verified
FROM k JOIN folded ON k.source IS NOT DISTINCT FROM folded.source AND k.idx = folded.idx AND folded.i = len(folded.path) + 1 JOIN sub ON k.source IS NOT DISTINCT FROM sub.source CROSS JOIN root
"""

#: The level of the mix in closed form: sources by the level at which they are full; those before the first that is not above its stop are full.
_OP13 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size,
                  CAST('0x' || substr(sha256('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM s),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
             / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM o),
v AS (SELECT level FROM c WHERE weight * level <= 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(weight * v.level, 2.0::DOUBLE * source_size) AS target FROM c CROSS JOIN v),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, rate, copies
FROM (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op10_rules": _OP10, "op11_filter_audit": _OP11, "op12_merkle": _OP12, "op13_mixture": _OP13}
