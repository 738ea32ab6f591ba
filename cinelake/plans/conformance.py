"""Conformance run: two document tables in, results and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.operators import conformance as Q


def conformance_run(oracle: DataFrame, ours: DataFrame) -> DataFrame:
    """Results of oracle(path, returncode, doc) against ours(path, returncode, doc, stderr, timed_out, panic).

    One join by path, everything after it is row-local until the caller sums up.
    """
    o = Q.normalise_oracle(oracle).select("path", F.col("returncode").alias("oracle_returncode"), "expected")
    u = Q.normalise_actual(ours).select("path", F.col("returncode").alias("our_returncode"), "actual", "stderr", "timed_out", "panic")
    j = Q.diff_probe(o.join(u, "path")).withColumn("exception", F.lit(None).cast("string"))
    j = j.withColumn("differences", F.coalesce(F.array_join("differences", "; "), F.lit("")))
    return Q.decide(j).select(F.col("path").alias("name"), F.lit("upstream-probe-json").alias("kind"), "oracle_returncode", "our_returncode", "status", "details")
