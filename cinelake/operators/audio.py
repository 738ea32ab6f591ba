"""Audio sample tables: PCM normalisation, frame manifests, gain, seek, resampling and trims.

samples(path, n, ch, v): frame number, channel, signed 16-bit value. Frames, chunks and resampling blocks are the grouping
keys, so a long file never becomes one group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions import binary as B, grouped, ordered, rational

S16_MIN, S16_MAX = -32768, 32767


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(S16_MIN), F.least(F.lit(S16_MAX), v.cast("int")))


# ---- PCM --------------------------------------------------------------------------------------------------------

SAMPLE_BYTES = {"u8": 1, "s16le": 2, "s16be": 2, "s24le": 3, "s32le": 4, "f32le": 4, "f64le": 8}


def to_s16(raw: Column, fmt: str) -> Column:
    """One sample value (unsigned byte, signed integer or float) as signed 16 bit."""
    if fmt == "u8":
        return ((raw - 128) * 256).cast("int")
    if fmt in ("s16le", "s16be"):
        return raw.cast("int")
    if fmt == "s24le":
        return F.shiftright(raw, 8).cast("int")
    if fmt == "s32le":
        return F.shiftright(raw, 16).cast("int")
    if fmt in ("f32le", "f64le"):
        x = raw.cast("double")
        return F.when(F.isnan(x), F.lit(0)).otherwise(_clip(F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32768.0)))
    raise ValueError(f"unknown sample format {fmt}")


def _decode(data: np.ndarray, fmt: str) -> np.ndarray:
    if fmt == "u8":
        return (data.astype(np.int32) - 128) << 8
    if fmt == "s24le":
        b = data.reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        return np.where(v & 0x800000, v - 0x1000000, v) >> 8
    if fmt == "s32le":
        return data.view("<i4") >> 16
    if fmt in ("f32le", "f64le"):
        x = np.nan_to_num(data.view("<f4" if fmt == "f32le" else "<f8").astype(np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
        return np.clip(np.rint(np.clip(x, -1.0, 1.0) * 32768.0), S16_MIN, S16_MAX).astype(np.int32)
    return data.view("<i2" if fmt == "s16le" else ">i2").astype(np.int32)


def decode_pcm(pieces: DataFrame, fmt: str, key: str = "path", base: str = "base", payload: str = "payload") -> DataFrame:
    """Samples of raw PCM pieces: (key, n, v) with n counted on from the piece's first sample number. Pieces must be whole
    samples (see `aligned`); cut long payloads with `split_records` first so that they spread over tasks."""
    ddl = f"{key} {pieces.schema[key].dataType.simpleString()}, n bigint, v int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bases, blobs = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            rows, numbers, values, held = [], [], [], 0
            for i in range(batch.num_rows):
                v = _decode(np.frombuffer(blobs[i].as_buffer(), dtype=np.uint8), fmt)
                rows.append(np.full(len(v), i, np.int64))
                numbers.append(np.arange(bases[i], bases[i] + len(v), dtype=np.int64))
                values.append(v.astype(np.int32))
                held += len(v)
                if held >= 1 << 18 or i + 1 == batch.num_rows:
                    columns = [keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(numbers)), pa.array(np.concatenate(values))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "v"])
                    rows, numbers, values, held = [], [], [], 0

    rows = pieces.select(key, F.col(base).cast("long"), payload).where(F.octet_length(payload) > 0)
    return rows.mapInArrow(run, ddl)


def aligned(df: DataFrame, sample_bytes: Column | int, channels: Column | int, length: str = "length") -> DataFrame:
    """Add `error_kind`: a partial sample or a count that is not a multiple of the channels."""
    n, s, c = F.col(length), B.lit(sample_bytes), B.lit(channels)
    per_channel = F.call_function("try_mod", rational.int_div(n, s), c)
    return df.withColumn(
        "error_kind",
        F.when(c == 0, "invalid_data: zero channels")
        .when(F.call_function("try_mod", n, s) != 0, "invalid_data: partial sample")
        .when(per_channel != 0, "invalid_data: not channel-aligned"),
    )


def interleave(frame: Column, channels: Column, ch: Column) -> Column:
    return frame * channels + ch


def deinterleave(n: Column, channels: Column) -> tuple[Column, Column]:
    return rational.int_div(n, channels), F.call_function("try_mod", n, channels)


def channel_layout(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels == 2, "stereo")


def constant_per_stream(packets: DataFrame, keys: Sequence[str] = ("path",), rate: str = "sample_rate", channels: str = "channels") -> DataFrame:
    """Whether rate and channel count stay the same per key; minimum against maximum, so no distinct sets are kept."""
    g = packets.groupBy(*keys).agg(
        F.min(rate).alias("r0"), F.max(rate).alias("r1"), F.min(channels).alias("c0"), F.max(channels).alias("c1"), F.count("*").alias("n_packets"))
    return g.select(*keys, "n_packets", ((F.col("r0") == F.col("r1")) & (F.col("c0") == F.col("c1"))).alias("constant"))


# ---- manifests --------------------------------------------------------------------------------------------------

def frame_len(rate: Column) -> Column:
    """Samples per frame: the smallest power of two above a twentieth of the rate; NULL (reject) below 10 Hz."""
    target = rational.int_div(rate, F.lit(10))
    half = rational.int_div(target, F.lit(2))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(half)))
    return F.when(target > 0, F.when(half == 0, F.lit(1).cast("long")).otherwise(power))


FRAMES_A_BLOCK = 64


def frame_hashes(samples: DataFrame, header: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Fixed-size frames with the MD5 of their s16le bytes. header(keys, sample_rate, channels). Samples travel as numbers; a task holds FRAMES_A_BLOCK frames at a time."""
    keys = list(keys)
    s = samples.join(header.select(*keys, "channels", frame_len(F.col("sample_rate")).alias("__len")), keys).where("__len is not null")
    s = s.select(
        *keys, F.col("__len").cast("long").alias("len"), F.col("channels").cast("long").alias("channels"),
        rational.int_div(F.col("n"), F.col("__len") * FRAMES_A_BLOCK).alias("__b"), interleave(F.col("n"), F.col("channels"), F.col("ch")).cast("long").alias("__i"), F.col("v").cast("int").alias("v"))

    def digest(g: dict) -> dict:
        """MD5 of each frame of a block; samples are in order."""
        frame = g["__i"] // (g["len"][0] * g["channels"][0])
        cuts = [*np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)).tolist(), len(frame)]
        data = g["v"].astype("<i2").tobytes()
        first = cuts[:-1]
        return {
            "frame_no": frame[first], "__len": g["len"][first], "channels": g["channels"][first], "__n": np.diff(cuts),
            "hash": np.array([hashlib.md5(data[2 * lo : 2 * hi], usedforsecurity=False).hexdigest() for lo, hi in zip(cuts, cuts[1:])], object),
        }

    g = grouped.map_groups(s, [*keys, "__b"], "__i", digest, "frame_no bigint, `__len` bigint, channels bigint, `__n` bigint, hash string", keep=keys)
    start = F.col("frame_no") * F.col("__len")
    return g.select(
        *keys, F.lit(0).alias("stream_index"), "frame_no", start.alias("dts"), start.alias("pts"),
        rational.int_div(F.col("__n"), F.col("channels")).alias("duration"), (F.col("__n") * 2).alias("size"), "hash",
    )


def frame_hashes_by_chunk(chunks: DataFrame, cap: int | Column | None, keys: Sequence[str] = ("path",), channels: str = "channels",
                          payload: str = "payload") -> DataFrame:
    """Frames that never cross a chunk: at most `cap` samples each, or the whole chunk. Payloads are s16le and channel-aligned.

    Only chunk durations take part in the running total; payloads are hashed where they lie and do not travel. With the whole
    data as one chunk and `frame_len(rate)` as the cap this is the fixed-size manifest of `frame_hashes`, without a row per sample.
    """
    keys = list(keys)
    block = F.col(channels) * 2
    count = rational.int_div(B.size_of(payload), block)
    step = count if cap is None else B.lit(cap).cast("long")

    def digest(i: Column) -> Column:
        piece = B.slice_bytes(payload, i * step * block, step * block)
        return B.let(piece, lambda p: F.struct(
            i.alias("i"), F.octet_length(p).cast("long").alias("size"), F.md5(p).alias("hash"), (~F.hex(p).rlike("[^0]")).alias("silent")))

    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), rational.ceil_div(count, step) - 1), digest))
    hashed = chunks.select(*keys, "chunk_no", count.alias("__d"), step.alias("__step"), block.cast("long").alias("__block"), pieces.alias("__p"))
    based = ordered.running_sum(hashed, keys, "chunk_no", {"__base": "__d"})
    out = based.select(*keys, "chunk_no", "__base", "__step", "__block", F.explode_outer("__p").alias("p")).where("p is not null")
    pts = F.col("__base") + F.col("p.i") * F.col("__step")
    return out.select(
        *keys, F.lit(0).alias("stream_index"), "chunk_no", pts.alias("dts"), pts.alias("pts"), rational.int_div(F.col("p.size"), F.col("__block")).alias("duration"),
        F.col("p.size").alias("size"), F.col("p.hash").alias("hash"), F.col("p.silent").alias("silent"))


def drop_silent_tail(frames: DataFrame, keys: Sequence[str] = ("path",), codec: str = "codec_name", limit: int = 1024) -> DataFrame:
    """Drop the last frame of big-endian streams when it is short and silent."""
    keys = list(keys)
    last = frames.groupBy(*keys).agg(F.max("pts").alias("__last"))
    tail = (F.col("pts") == F.col("__last")) & (F.col("duration") < limit) & F.col("silent") & (F.col(codec) == "pcm_s16be")
    return frames.join(last, keys).where(~tail).drop("__last")


def empty_manifest(objects: DataFrame, frames: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Header rows with their frame count, zero where nothing could be decoded."""
    counts = frames.groupBy(*keys).agg(F.count("*").alias("n_frames"))
    return objects.join(counts, list(keys), "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0).cast("long")))


# ---- transforms -------------------------------------------------------------------------------------------------

def volume(samples: DataFrame, factor: float) -> DataFrame:
    """Gain with ties to even, saturated."""
    scaled = F.rint(F.col("v") * F.lit(float(factor)))
    return samples.withColumn("v", F.greatest(F.lit(float(S16_MIN)), F.least(F.lit(float(S16_MAX)), scaled)).cast("int"))


def decimal_samples(text: Column, rate: Column) -> Column:
    """floor(decimal seconds * rate), exact for any number of digits; NULL for anything but a non-negative decimal, or a result of 2^63 and more.

    Rates are below 2^32. Fraction digits are taken in blocks of nine from the last to the first: the carry of the blocks behind is floor(their value * rate), and no block's
    product can leave 64 bits.
    """
    t = F.trim(text)
    pattern = r"^(\d*)\.?(\d*)$"
    whole, fraction = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    ok = t.rlike(r"^(\d+\.?\d*|\.\d+)$")
    rate = rate.cast("long")
    n = F.length(fraction)
    starts = F.when(n > 0, F.reverse(F.sequence(F.lit(1), n, F.lit(9)))).otherwise(F.array().cast("array<int>"))
    block = lambda at: F.rpad(F.substring(fraction, at, F.lit(9)), 9, "0").cast("long")
    carry = F.aggregate(starts, F.lit(0).cast("long"), lambda acc, at: F.call_function("div", block(at) * rate + acc, F.lit(10**9).cast("long")))
    digits = F.regexp_replace(whole, "^0+(?=.)", "")
    seconds = F.when(digits == "", "0").otherwise(digits).try_cast("decimal(28,0)")
    return F.when(ok, (seconds * rate.cast("decimal(10,0)") + carry.cast("decimal(19,0)")).try_cast("long"))


def seek(samples: DataFrame, start: Column) -> DataFrame:
    """Drop the first `start` frames and renumber; a start past the end leaves nothing."""
    return samples.where(F.col("n") >= start).withColumn("n", F.col("n") - start)


def edge_index(i: Column, length: Column) -> Column:
    """Index mirrored at both ends: without repeating the first sample on the left, repeating the last on the right."""
    i, length = i.cast("long"), length.cast("long")
    right = F.greatest(F.lit(0).cast("long"), F.least(length - 1, length * 2 - 1 - i))
    period = length * 2 - 2
    left = F.pmod(i, F.when(period > 0, period))
    return F.when(length <= 1, 0).when(i >= length, right).otherwise(F.when(left >= length, period - left).otherwise(left)).cast("long")


# Window shape, cutoff scale and series length of the resampling filter.
KAISER_BETA, CUTOFF_SCALE, SERIES_TERMS = 9.0, 0.97, 32
EPSILON = 2.220446049250313e-16


def tap_count(source: int, target: int) -> int:
    n = math.ceil(32.0 / (min(target / source, 1.0) * CUTOFF_SCALE)) + 2
    return n | 1


def _bessel(x: Column) -> Column:
    """Modified Bessel function of order zero by its power series."""

    def series(y: Column) -> Column:
        def step(a, k):
            return B.let(a["t"] * (y / (k * k)), lambda t: F.struct((a["s"] + t).alias("s"), t.alias("t")))

        start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, step, lambda a: a["s"])

    return B.let(x * x / 4.0, series)


def taps(rates: DataFrame) -> DataFrame:
    """Filter coefficients of windowed-sinc resampling per (source, target) pair, phase and tap; phases repeat after target/gcd outputs.

    `weight` is the coefficient over the sum of its phase; taps outside the window are left out.
    """
    s, t = F.col("source").cast("double"), F.col("target").cast("double")
    cutoff = F.least(t / s, F.lit(1.0)) * CUTOFF_SCALE
    raw = (F.ceil(F.lit(32.0) / cutoff) + 2).cast("long")
    zero = F.lit(0).cast("long")
    r = rates.select("source", "target", cutoff.alias("cutoff"), raw.bitwiseOR(F.lit(1).cast("long")).alias("n_taps"), rational.gcd(F.col("source"), F.col("target"), 47).alias("g"))
    r = r.withColumn("phase", F.explode(F.sequence(zero, rational.int_div(F.col("target"), F.col("g")) - 1)))
    r = r.withColumn("tap", F.explode(F.sequence(zero, F.col("n_taps") - 1)))
    radius = (F.col("n_taps") - 1) / 2.0
    r = r.withColumn("__p", F.col("tap") - radius - F.col("phase") * F.col("g") / F.col("target"))
    r = r.withColumn("__w", F.col("__p") / radius).where(F.abs("__w") <= 1.0)
    x = F.col("cutoff") * F.col("__p")
    sinc = F.when(F.abs(x) < EPSILON, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))
    window = _bessel(F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("__w") * F.col("__w"))) * KAISER_BETA) / _bessel(F.lit(KAISER_BETA))
    r = r.select("source", "target", "n_taps", "phase", "tap", (F.col("cutoff") * sinc * window).alias("coef"))
    total = r.groupBy("source", "target", "phase").agg(F.sum("coef").alias("total"))
    return r.join(total, ["source", "target", "phase"]).withColumn("weight", F.col("coef") / F.col("total")).drop("total")


def _i0(x: np.ndarray) -> np.ndarray:
    y = x * x / 4.0
    total, term = np.ones_like(y), np.ones_like(y)
    for k in range(1, SERIES_TERMS + 1):
        term = term * (y / (k * k))
        total = total + term
    return total


def _coefficients(fraction: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [tap, position] for positions this far past an input frame, and their sum per position."""
    cutoff = min(target / source, 1.0) * CUTOFF_SCALE
    n_taps = tap_count(source, target)
    radius = (n_taps - 1) / 2.0
    p = np.arange(n_taps)[:, None] - radius - fraction[None, :]
    w = p / radius
    window = _i0(KAISER_BETA * np.sqrt(np.maximum(1.0 - w * w, 0.0))) / _i0(np.array([KAISER_BETA]))[0]
    c = np.where(np.abs(w) > 1.0, 0.0, cutoff * np.sinc(cutoff * p) * window)
    return c, c.sum(axis=0)


def _convolve(values: np.ndarray, first: int, outputs: np.ndarray, length: int, source: int, target: int, cache: dict) -> np.ndarray:
    """Outputs of one block. Summing over the leading tap axis adds the taps in order, so results do not depend on the block size.

    Positions repeat after target/gcd outputs; each phase that a task meets is computed once and kept in `cache`.
    """
    g = math.gcd(source, target)
    phase, at = np.unique(outputs * source % target // g, return_inverse=True)
    new = phase if not cache else np.setdiff1d(phase, cache["phase"], assume_unique=True)
    if len(new):
        coefs, total = _coefficients(new * g / target, source, target)
        if cache:
            new, coefs, total = np.concatenate([cache["phase"], new]), np.concatenate([cache["coefs"], coefs], axis=1), np.concatenate([cache["total"], total])
        order = np.argsort(new)
        cache.update(phase=new[order], coefs=coefs[:, order], total=total[order])
    at = np.searchsorted(cache["phase"], phase)[at]
    coefs, total = cache["coefs"], cache["total"]
    i = (outputs * source // target)[None, :] + (np.arange(len(coefs)) - len(coefs) // 2)[:, None]
    if length <= 1:
        i = np.zeros_like(i)
    else:
        m = np.mod(i, 2 * length - 2)
        i = np.where(i >= length, np.clip(2 * length - 1 - i, 0, length - 1), np.where(m >= length, 2 * length - 2 - m, m))
    out = (values[i - first] * coefs[:, at] / total[at]).sum(axis=0)
    return np.clip(np.rint(out), S16_MIN, S16_MAX).astype(np.int32)


def resample(samples: DataFrame, source: int, target: int, keys: Sequence[str] = ("path",), block: int = 1 << 15) -> DataFrame:
    """Windowed-sinc resampling to `target` Hz.

    Input frames are cut into blocks that carry a halo of neighbours wide enough for the filter and its edge mirror, so a
    sample is shuffled about once and each block is one bounded group, however long the file is.
    """
    if source == target:
        return samples
    keys = list(keys)
    halo = 2 * tap_count(source, target) + 2
    block = max(block, 2 * halo)
    lengths = samples.groupBy(*keys).agg((F.max("n") + 1).alias("__frames"))
    s = samples.join(lengths, keys)
    last = rational.int_div(F.col("__frames") - 1, F.lit(block))
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - halo) / F.lit(block)))
    hi = F.least(last, F.floor((F.col("n") + halo) / F.lit(block)))
    s = s.select(*keys, "ch", "n", "v", "__frames", F.explode(F.sequence(lo, hi)).alias("__b"))

    cache: dict = {}

    def one_block(g: dict) -> dict:
        frames, b = int(g["__frames"][0]), int(g["__at"][0])
        n_out = (frames * target + source // 2) // source
        # outputs whose centre floor(o * source / target) lies in this block; the last block also takes the overhang
        start = -(-b * block * target // source)
        stop = n_out if (b + 1) * block >= frames else min(n_out, -(-(b + 1) * block * target // source))
        values, first = g["v"].astype(np.float64), int(g["n"][0])
        n, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for lo in range(start, stop, 4096):
            outs = np.arange(lo, min(stop, lo + 4096), dtype=np.int64)
            n.append(outs)
            v.append(_convolve(values, first, outs, frames, source, target, cache))
        return {"n": np.concatenate(n), "v": np.concatenate(v)}

    s = s.withColumn("__at", F.col("__b"))
    return grouped.map_groups(s, [*keys, "ch", "__b"], "n", one_block, "n bigint, v int", keep=[*keys, "ch"])


# ---- trims ------------------------------------------------------------------------------------------------------

def _zero() -> Column:
    return F.lit(0).cast("long")


def opus_limits(duration: Column, rate: Column, pre_skip: Column) -> tuple[Column, Column]:
    """(frames to skip, frames to keep or NULL for all)."""
    keep = F.greatest(_zero(), F.round(duration * rate).cast("long") - pre_skip)
    return pre_skip.cast("long"), F.when(duration > 0, keep)


def aac_limits(duration: Column, rate: Column, total: Column) -> tuple[Column, Column]:
    target = rational.ceil_div(F.ceil(duration * rate).cast("long"), F.lit(1024)) * 1024
    usable = duration > 0
    return F.when(usable & (total >= target + 1024), 1024).otherwise(0).cast("long"), F.when(usable, target)


def vorbis_limits(last_granule: Column, blocksize0: Column) -> tuple[Column, Column]:
    return _zero(), F.greatest(_zero(), last_granule - rational.int_div(blocksize0, F.lit(2)))


def trim(samples: DataFrame, limits: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Cut lead and tail frames and renumber. limits(keys, skip, keep); NULL keep means to the end."""
    s = samples.join(limits, list(keys))
    n = F.col("n") - F.col("skip")
    return s.where((n >= 0) & (F.col("keep").isNull() | (n < F.col("keep")))).withColumn("n", n).drop("skip", "keep")
