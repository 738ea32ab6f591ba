"""Table schemas. Unsigned 32-bit counts are LONG, media time is integer ticks or DOUBLE seconds."""

from pyspark.sql import types as T

STREAM_FIELDS = [
    T.StructField("index", T.IntegerType()),
    T.StructField("codec_type", T.StringType()),
    T.StructField("codec_name", T.StringType()),
    T.StructField("sample_rate", T.LongType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("bits_per_sample", T.IntegerType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("frame_rate", T.StringType()),
]

STREAM = T.StructType(STREAM_FIELDS)

PROBE_DOC = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("streams", T.ArrayType(STREAM)),
    ]
)

BENCH_DOC = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("command", T.StringType()),
                        T.StructField("mean", T.DoubleType()),
                    ]
                )
            ),
        )
    ]
)
