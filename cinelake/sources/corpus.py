"""Corpus scan: media files as a table of objects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.operators.identify import extension


#: Characters that a path pattern would not take literally.
_PATTERN = re.compile(r"([\\*?\[\]{}])")


def scan_corpus(spark: SparkSession, root: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """Every regular file below `root`: path relative to it, suffix, length and, if asked for, the bytes.

    Without `content` the bytes are never read. A limit takes the first paths in order; they are chosen by name first, and only these files are then read.
    An object of 2 GiB and more can't be one value: see `pieces.scan_pieces`.
    """
    reader = lambda at: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    files = reader(root)
    if limit is not None:
        chosen = [r["path"] for r in files.select("path").orderBy("path").limit(limit).toLocalIterator()]
        files = reader([_PATTERN.sub(r"\\\1", p) for p in chosen]) if chosen else files.limit(0)
    columns = ["path", "ext", "length", "content"] if content else ["path", "ext", "length"]
    return relative_objects(files, root).select(*columns)


def relative_objects(files: DataFrame, root: str) -> DataFrame:
    """binaryFile rows with paths relative to `root`."""
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    base = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    at = F.position(F.lit(base), plain)
    path = F.when(at > 0, F.substring(plain, at + len(base), F.length(plain))).otherwise(plain)
    return files.select(path.alias("path"), extension(path).alias("ext"), "length", "content")
