"""MPEG audio frames from bytes: candidate headers found in pieces of objects, chained, and summed up as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cinelake import rules as R
from cinelake.operators import identify
from cinelake.operators.containers import frame_chain
from cinelake.session import checkpointed

#: Bytes behind a piece that a header at its last byte needs.
HALO = 3

_VERSION = np.array([4, 0, 2, 1])  # divisor of the sample rate by version bits; 0: reserved
_RATES = np.array([*R.MPEG1_SAMPLE_RATES, 0])
_KBIT = np.zeros((4, 4, 16), np.int64)  # by version, layer code (1: III, 2: II) and index
for _v in (0, 2, 3):
    _KBIT[_v, 1, 1:15] = R.MPEG1_LAYER3_KBPS if _v == 3 else R.MPEG2_LAYER23_KBPS
    _KBIT[_v, 2, 1:15] = R.MPEG1_LAYER2_KBPS if _v == 3 else R.MPEG2_LAYER23_KBPS


def headers(data: np.ndarray) -> dict[str, np.ndarray]:
    """Frame headers that begin at any byte of `data`: place, frame_len, layer, sample_rate, channels, samples."""
    at = np.flatnonzero((data[:-3] == 0xFF) & (data[1:-2] >= 0xE0)) if len(data) > 3 else np.zeros(0, np.int64)
    b1, b2, b3 = (data[at + i].astype(np.int64) for i in (1, 2, 3))
    version, layer = b1 >> 3 & 3, b1 >> 1 & 3
    kbit, base = _KBIT[version, layer, b2 >> 4], _RATES[b2 >> 2 & 3]
    ok = (kbit > 0) & (base > 0)
    at, version, layer, kbit, base, b2, b3 = (x[ok] for x in (at, version, layer, kbit, base, b2, b3))
    rate = base // _VERSION[version]
    half = (layer == 1) & (version != 3)
    return {
        "place": at, "frame_len": np.where(half, 72000, 144000) * kbit // rate + (b2 >> 1 & 1), "layer": layer, "sample_rate": rate, "channels": np.where(b3 >> 6 == 3, 1, 2),
        "samples": np.where(half, 576, 1152),
    }


def candidates(pieces: DataFrame, piece: int, key: str = "path") -> DataFrame:
    """(key, off, frame_len, layer, sample_rate, channels, samples) of every header whose frame lies inside its object, and of every `TAG`, which ends a chain, with a NULL frame_len.

    pieces(key, length, piece_no, offset, content) of `piece` bytes with a halo of HALO bytes or more; a header belongs to the piece where it begins.
    """
    kind = pieces.schema[key].dataType.simpleString()
    names = ["off", "frame_len", "layer", "sample_rate", "channels", "samples"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("content")
            size = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])  # the pieces of a batch are searched as one run of bytes
            data = np.frombuffer(b"".join(v.as_buffer() for v in content if v.is_valid), np.uint8)
            length, offset = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "offset"))
            h = headers(data)

            def placed(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Row and place in its piece of a find, and whether its bytes lie in one piece and it begins there before the halo."""
                of = np.searchsorted(first, at, side="right") - 1
                place = at - first[of]
                return of, place, (place < piece) & (place + width <= size[of])

            of, place, inside = placed(h["place"], 4)
            keep = inside & (offset[of] + place + h["frame_len"] <= length[of])
            marks = np.flatnonzero((data[:-2] == 0x54) & (data[1:-1] == 0x41) & (data[2:] == 0x47)) if len(data) > 2 else np.zeros(0, np.int64)
            of_mark, mark, there = placed(marks, 3)
            columns = [(offset[of] + place)[keep], *(h[c][keep] for c in names[1:])]
            rows = [pa.concat_arrays([pa.array(c.astype(np.int64)), pa.array((offset[of_mark] + mark)[there]) if n == "off" else pa.nulls(int(there.sum()), pa.int64())]) for n, c in zip(names, columns)]
            who = batch.column(key).take(pa.array(np.concatenate([of[keep], of_mark[there]])))
            yield pa.RecordBatch.from_arrays([who, *rows], names=[key, *names])

    return pieces.select(key, "length", "offset", "content").mapInArrow(find, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names))


def streams(pieces: DataFrame, piece: int, key: str = "path") -> DataFrame:
    """(key, codec_name, sample_rate, channels, n_frames, first_off, last_off, duration_seconds) of objects with frames: from the first header behind a leading tag on, over
    gaps, up to a `TAG`. An object with a leading tag that is not valid has no stream."""
    body = pieces.where("piece_no = 0").select(key, identify.payload_start(F.col("content")).alias("body"))
    found = checkpointed(candidates(pieces, piece, key).join(body, key).where("off >= body").drop("body"))  # searched once for the chain and for its first frame
    chain = frame_chain(found.select(key, "off", "frame_len"), keys=(key,))
    first = found.where("frame_len is not null").select(key, F.col("off").alias("first_off"), "layer", "sample_rate", "channels", "samples")
    out = chain.join(first, [key, "first_off"])
    codec = F.when(F.col("layer") == 2, "mp2").otherwise("mp3")
    return out.select(key, codec.alias("codec_name"), "sample_rate", "channels", "n_frames", "first_off", "last_off", (F.col("n_frames") * F.col("samples") / F.col("sample_rate")).alias("duration_seconds"))
