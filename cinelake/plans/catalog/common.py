"""Shared derivations of media-shaped tables from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake import rules as R
from cinelake.functions import binary as B
from cinelake.plans.registry import table


def _prefix(sig: R.Signature) -> bytes:
    out = bytearray()
    for offset, data in sig.alternatives[-1]:
        if len(out) < offset:
            out += bytes(offset - len(out))
        out[offset : offset + len(data)] = data
    return bytes(out)


# Media lead-ins put before the text of a document; the last two leave the text as it is or give it a broken header.
PREFIXES: list[bytes] = [_prefix(s) for s in R.SIGNATURES if s.alternatives and s.format not in ("truehd",)]
PREFIXES += [b"\x40\x01\0\0\xc8\0\0\0\x40\x1f\0\0\x01\0\0\0", b"\x34\x12\x10\x10\x08\x08", b"", b"\xff"]
EXTENSIONS = ["wav", "MP3", "png", "mp4", "tar.gz", "", "ivf", "g722", "bin"]


def pick(values: list, index: Column) -> Column:
    texts = [v.hex() if isinstance(v, bytes) else v for v in values]
    out = F.get(B.literal_table(texts, "array<string>"), (index % len(values)).cast("int"))
    return F.unhex(out) if isinstance(values[0], bytes) else out


def sql_list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def tagged_objects(spark, sf) -> DataFrame:
    """documents as media objects: a media lead-in followed by the whole text."""
    d = documents(spark, sf)
    ext = pick(EXTENSIONS, F.col("doc_id"))
    return d.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/.d/doc"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("path"),
        F.concat(pick(PREFIXES, F.col("doc_id")), F.encode("text", "utf-8")).alias("content"),
    )


def _txt(b: bytes) -> str:
    return b.decode("utf-8", "replace").replace("\0", "\x01")


TAGGED_SQL = f"""objects AS (
  SELECT doc_id,
    source || '/.d/doc' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path,
    CASE WHEN e = '' THEN '' ELSE lower(regexp_extract(e, '[^.]*$')) END AS ext,
    p || hex(encode(text)) AS hx, (length(p) // 2 + strlen(text))::BIGINT AS len, t || text AS txt
  FROM (SELECT *, ({sql_list([p.hex().upper() for p in PREFIXES])})[doc_id % {len(PREFIXES)} + 1] AS p,
          ({sql_list([_txt(p) for p in PREFIXES])})[doc_id % {len(PREFIXES)} + 1] AS t,
          ({sql_list(EXTENSIONS)})[doc_id % {len(EXTENSIONS)} + 1] AS e FROM documents))"""


def hx(offset: int, n: int, col: str = "hx") -> str:
    return f"substr({col}, {2 * offset + 1}, {2 * n})"


def sql_uint(offset: int, n: int, endian: str = "be", col: str = "hx") -> str:
    """Unsigned integer at an offset of a hex text; NULL past the end."""
    h = hx(offset, n, col)
    text = h if endian == "be" else "||".join(hx(offset + i, 1, col) for i in reversed(range(n)))
    return f"CASE WHEN length({h}) = {2 * n} THEN ('0x' || {text})::UBIGINT END"
