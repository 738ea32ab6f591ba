"""Frame-hash text: comment header, then six comma-separated fields per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinelake.operators.audio import channel_layout

FIELDS = ("stream_index", "dts", "pts", "duration", "size")


def parse_framehash(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of text lines; other columns are kept. Blank and comment lines are skipped, any other line must parse."""
    keep = [c for c in lines.columns if c != line]
    text = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).withColumn("__t", F.transform(F.split(text, ","), lambda p: F.trim(p)))
    at = lambda i: F.get("__t", F.lit(i))
    numbers = [at(i).try_cast("bigint").alias(n) for i, n in enumerate(FIELDS)]
    parsed = rows.select(*keep, F.col(line).alias("__line"), F.size("__t").alias("__n"), *numbers, at(5).alias("hash"))
    bad = (F.col("__n") != 6)
    for n in FIELDS:
        bad = bad | F.col(n).isNull()
    frames = parsed.where(~bad).withColumn("stream_index", F.col("stream_index").cast("int")).drop("__line", "__n")
    rejects = parsed.where(bad).select(*keep, F.lit("invalid_data").alias("error_kind"), F.concat(F.lit("invalid frame row: "), F.col("__line")).alias("message"))
    return frames, rejects


def read_framehash(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_framehash(lines)


def framehash_header(headers: DataFrame, key: str = "path", software: str = "cinelake") -> DataFrame:
    """Header lines per object: headers(key, media audio|video, tb_num, tb_den, sample_rate, channels, width, height)."""
    audio = F.col("media") == "audio"
    layout = channel_layout(F.col("channels"))
    s: list[Column] = [
        F.lit("#format: frame checksums"), F.lit("#version: 2"), F.lit("#hash: MD5"), F.lit(f"#software: {software}"),
        F.format_string("#tb 0: %d/%d", "tb_num", "tb_den"), F.concat(F.lit("#media_type 0: "), F.col("media")),
        F.when(audio, "#codec_id 0: pcm_s16le").otherwise("#codec_id 0: rawvideo"),
        F.when(audio, F.format_string("#sample_rate 0: %d", "sample_rate")).when(F.col("width").isNotNull(), F.format_string("#dimensions 0: %dx%d", "width", "height")),
        F.when(audio, F.coalesce(F.concat(F.lit("#channel_layout_name 0: "), layout), F.format_string("#channels 0: %d", "channels"))).when(
            F.col("width").isNotNull(), F.lit("#sar 0: 1/1")),
        F.lit("#stream#, dts, pts, duration, size, hash"),
    ]
    lines = headers.select(key, F.posexplode(F.array(*s)).alias("__i", "line")).where("line is not null")
    return lines.select(key, (F.col("__i") - 100).cast("long").alias("line_no"), "line")


def framehash_lines(frames: DataFrame, headers: DataFrame, key: str = "path") -> DataFrame:
    """All text lines with their order: header lines are negative, frames follow by number."""
    body = frames.select(
        key, F.col("frame_no").alias("line_no"), F.format_string("%d, %d, %d, %d, %d, %s", "stream_index", "dts", "pts", "duration", "size", "hash").alias("line"))
    return framehash_header(headers, key).unionByName(body)


def write_framehash(frames: DataFrame, headers: DataFrame, out: str, key: str = "path", part_lines: int = 1 << 20) -> None:
    """One folder per object; long manifests become several part files whose names keep the order of lines.

    Lines are range-partitioned by (object, line number), so one long manifest is written by many tasks.
    """
    lines = framehash_lines(frames, headers, key)
    part = F.greatest(F.lit(0), F.floor(F.col("line_no") / part_lines)).cast("long")
    lines.withColumn("part", part).repartition(key, "part").sortWithinPartitions(key, "part", "line_no").select(
        key, "part", "line").write.mode("overwrite").partitionBy(key, "part").text(out)
