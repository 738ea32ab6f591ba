"""Probe documents as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.schemas import PROBE_DOC


def read_probe_json(df: DataFrame, column: str = "json", out: str = "doc") -> DataFrame:
    """Parse documents with the fixed schema; malformed text gives NULL."""
    return df.withColumn(out, F.from_json(column, PROBE_DOC))


def to_probe_json(streams: DataFrame, formats: DataFrame, key: str = "path") -> DataFrame:
    """One JSON document per object; absent values are left out, durations keep six decimals.

    A document is one value of the result, so its streams do meet in one row; objects without streams keep an empty list.
    """
    s = F.struct(
        "index", "codec_type", "codec_name", "sample_rate", "channels", "bits_per_sample",
        F.col("duration_seconds").cast("decimal(38,6)").alias("duration_seconds"), "width", "height", "frame_rate",
    )
    grouped = streams.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("streams"))
    docs = formats.select(key, "format").join(grouped, key, "left")
    empty = F.array().cast(grouped.schema["streams"].dataType)
    return docs.select(key, F.to_json(F.struct("format", F.coalesce("streams", empty).alias("streams"))).alias("json"))
