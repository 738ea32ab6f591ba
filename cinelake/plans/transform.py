"""Transform sample tables and hash the result: gain, seek, resample, then fixed-size frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.operators import audio as A


def transform_manifest(samples: DataFrame, header: DataFrame, gain: float | None = None, start: str | None = None, source_rate: int | None = None,
                       target_rate: int | None = None) -> DataFrame:
    """Frame manifest after the given steps. header(path, sample_rate, channels); `source_rate` restricts resampling to that rate."""
    if gain is not None:
        samples = A.volume(samples, gain)
    if start is not None:
        offsets = header.select("path", A.decimal_samples(F.lit(start), F.col("sample_rate")).alias("__start"))
        samples = A.seek(samples.join(offsets, "path"), F.col("__start")).drop("__start")
    if target_rate is not None:
        if source_rate is None:
            raise ValueError("resampling needs the source rate of the objects")
        header = header.where(F.col("sample_rate") == source_rate)
        samples = A.resample(samples.join(header.select("path"), "path", "left_semi"), source_rate, target_rate)
        header = header.withColumn("sample_rate", F.lit(target_rate).cast("long"))
    return A.frame_hashes(samples, header)
