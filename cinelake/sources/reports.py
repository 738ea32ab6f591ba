"""Reports, benchmark files and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinelake.schemas import BENCH_DOC


def stamped(rows: DataFrame, provenance: dict[str, str]) -> DataFrame:
    return rows.select("*", *[F.lit(v).alias(k) for k, v in provenance.items()])


def write_report(results: DataFrame, summary: DataFrame, provenance: dict[str, str], out: str, fmt: str = "parquet") -> None:
    """Result rows and the summary, both stamped with provenance, as two datasets below `out`."""
    stamped(results, provenance).write.mode("overwrite").format(fmt).save(f"{out}/tests")
    stamped(summary, provenance).write.mode("overwrite").format(fmt).save(f"{out}/summary")


def parse_bench(df: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """(label, mean, ord) of a benchmark document."""
    docs = df.select(*keep, F.from_json(column, BENCH_DOC).alias("d"))
    return docs.select(*keep, F.posexplode("d.results").alias("ord", "r")).select(*keep, "ord", F.col("r.command").alias("label"), F.col("r.mean").alias("mean"))


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(BENCH_DOC).json(path, multiLine=True)
    return docs.select(F.posexplode("results").alias("ord", "r")).select("ord", F.col("r.command").alias("label"), F.col("r.mean").alias("mean"))


def log_fields(text: Column) -> Column:
    """Array of (key, value): '- key: value' lines, and 'N / M strict' lines as strict and accepted."""
    items = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^- ([A-Za-z_ ]+): (.*?)\r?$"), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, r"^- ([A-Za-z_ ]+): ", 1).alias("key"), F.regexp_replace(m, r"^- [A-Za-z_ ]+: |\r$", "").alias("value")))
    strict = F.regexp_extract_all(text, F.lit(r"(?m)(\d+) / (\d+) strict"), F.lit(0))
    pairs = F.flatten(F.transform(strict, lambda m: F.array(
        F.struct(F.lit("strict").alias("key"), F.regexp_extract(m, r"^(\d+)", 1).alias("value")),
        F.struct(F.lit("accepted").alias("key"), F.regexp_extract(m, r"/ (\d+)", 1).alias("value")))))
    return F.concat(items, pairs)


def parse_run_logs(df: DataFrame, name: str = "run_id", text: str = "text") -> DataFrame:
    """run_log(run_id, ord, key, value), one row per field in file order (keys first, strict lines after)."""
    return df.select(F.col(name).alias("run_id"), F.posexplode(log_fields(F.col(text))).alias("ord", "f")).select("run_id", "ord", "f.key", "f.value")


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True).withColumn("run_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1))
    return parse_run_logs(files.withColumnRenamed("value", "text"))
