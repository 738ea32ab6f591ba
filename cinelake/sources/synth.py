"""Generated test tones as sample tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinelake.functions import generate

# The generated samples (name -> kind, rate, channels, frames).
SAMPLES = {
    "mono_silence_8k": ("silence", 8000, 1, 8000),
    "stereo_44k_sine": ("sine_per_channel", 44100, 2, 44100),
    "short_100ms": ("ramp", 8000, 1, 800),
    "tiny": ("sine", 8000, 1, 800),
    "odd_chunks": ("saw", 8000, 1, 64),
    "pcm_u8": ("sine_u8", 8000, 1, 800),
}


def tone(kind: Column, i: Column, ch: Column, rate: Column) -> Column:
    """Sample value before clamping: truncated toward zero."""
    wave = lambda hz: F.sin(F.lit(2 * math.pi) * hz * i / rate)
    v = (
        F.when(kind == "silence", 0.0).when(kind == "sine_per_channel", wave(220 + ch * 220) * 12000).when(kind == "sine", wave(F.lit(440)) * 9000)
        .when(kind == "ramp", (i % 64 - 32) * 128.0).when(kind == "saw", i * 23.0 - 512)
        .when(kind == "sine_u8", 128 + (wave(F.lit(220)) * 80).cast("int"))
    )
    return v.cast("int")


def synth(spec: DataFrame, key: str = "path", block: int = 1 << 16) -> DataFrame:
    """Samples of spec(key, kind, rate, channels, frames): blocks of frames are spread over tasks before they are expanded."""
    rows = generate.expand(spec.select(key, "kind", "rate", "channels", "frames"), F.col("frames"), "n", [key], block)
    rows = rows.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("channels").cast("int") - 1)))
    value = tone(F.col("kind"), F.col("n"), F.col("ch"), F.col("rate"))
    u8 = F.col("kind") == "sine_u8"
    clamped = F.when(u8, F.greatest(F.lit(0), F.least(F.lit(255), value))).otherwise(F.greatest(F.lit(-32768), F.least(F.lit(32767), value)))
    return rows.select(key, "n", "ch", clamped.alias("v"))


def standard_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *s) for n, s in SAMPLES.items()], "path string, kind string, rate int, channels int, frames int")
