"""WAV objects written from sample tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions import binary as B, grouped
from cinelake.sources.pieces import write_objects

# Fixed value: writer name stored in the INFO list (even length, so no pad byte).
ENCODER = b"Lavf62.3.100\0"


def wav_header(rate: Column, channels: Column) -> Column:
    """Header of a streamed PCM file: sizes unknown (all ones), a 16-byte format chunk, an INFO list, then the data chunk."""
    align = channels * 2
    pad = b"\0" if len(ENCODER) % 2 else b""
    info = b"INFOISFT" + len(ENCODER).to_bytes(4, "little") + ENCODER + pad
    text = lambda b: F.lit(b.hex().upper())
    return F.unhex(F.concat(
        text(b"RIFF\xff\xff\xff\xffWAVEfmt \x10\0\0\0\x01\0"), B.le_hex(channels, 2), B.le_hex(rate, 4), B.le_hex(rate * align, 4), B.le_hex(align, 2),
        text(b"\x10\0LIST" + (26).to_bytes(4, "little") + info + b"data\xff\xff\xff\xff")))


def remux_wav(samples: DataFrame, header: DataFrame, keys: Sequence[str] = ("path",), part_frames: int = 1 << 16) -> DataFrame:
    """WAV objects as ordered parts (keys, part_no, bytes): part 0 is the header, later parts hold `part_frames` frames each.

    The streamed header needs no total size, so parts of one long object are made independently; concatenated in order they
    are the file.
    """
    keys = list(keys)
    head = header.select(*keys, F.lit(0).cast("long").alias("part_no"), wav_header(F.col("sample_rate"), F.col("channels")).alias("bytes"))
    s = samples.join(header.select(*keys, "channels"), keys)
    s = s.select(*keys, (F.floor(F.col("n") / part_frames) + 1).cast("long").alias("part_no"), (F.col("n") * F.col("channels") + F.col("ch")).alias("__i"), F.col("v").cast("int").alias("v"))

    def pack(g: dict) -> dict:
        return {"bytes": np.array([g["v"].astype("<i2").tobytes()], object)}

    return head.unionByName(grouped.map_groups(s, [*keys, "part_no"], "__i", pack, "bytes binary"))


def write_wav(parts: DataFrame, folder: str, key: str = "path") -> None:
    """One object for each key in `folder`, under a name that can be turned back into the key (`pieces.object_path`); nothing appears before the whole job has succeeded."""
    write_objects(parts, folder, key)
