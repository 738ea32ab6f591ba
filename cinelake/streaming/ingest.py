"""Incremental corpus scan: new files are identified as they arrive (stateless, one row per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cinelake.operators import identify as I
from cinelake.sources.corpus import relative_objects

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_corpus(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Objects that appear below `root`, a bounded number per trigger."""
    files = (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).load(root)
    )
    return relative_objects(files, root)


def identify_stream(objects: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append (path, ext, length, format) rows to a dataset until all present files are taken; restarts continue from the checkpoint."""
    rows = I.match_signatures(objects).select("path", "ext", "length", "format")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
