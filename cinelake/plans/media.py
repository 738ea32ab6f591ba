"""Streams of objects whose answer lies in their structure: AVI, Ogg and MPEG audio, from pieces.

Nodes are walked once and written; only the bytes of the few nodes that are read (list types, stream headers, first packets) are fetched from their pieces.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cinelake import rules as R
from cinelake.functions import binary as B
from cinelake.operators import boxes, containers as C, mpeg_audio
from cinelake.session import checkpointed

FORMATS = ("avi", "ogg", "mp3")
#: AVI audio tags (tag, bits or None, codec).
AVI_AUDIO = ((0x0001, 8, "pcm_u8"), (0x0001, 16, "pcm_s16le"), (0x0055, None, "mp3"), (0x0061, None, "adpcm_ima_dk4"), (0x0062, None, "adpcm_ima_dk3"))
_STREAM = "path", "index", "codec_type", "codec_name", "sample_rate", "channels", "bits_per_sample", "duration_seconds", "width", "height"


def _heads(nodes: DataFrame, pieces: DataFrame, piece: int, size: int) -> DataFrame:
    """(path, seq, bytes): the first `size` bytes of nodes, or all they have; nodes are short, so the parts of one meet in a row."""
    ranges = nodes.select("path", "seq", F.col("data_off").alias("off"), F.least(F.lit(size), "data_len").cast("long").alias("len"))
    parts = boxes.range_bytes(ranges, pieces, ["path", "seq"], piece=piece)
    return parts.groupBy("path", "seq").agg(F.expr("unhex(listagg(hex(bytes), '') WITHIN GROUP (ORDER BY part_no))").alias("bytes"))


def _mapped(tag: Column, codecs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*codecs.items()))), tag)


def avi_streams(pieces: DataFrame, piece: int) -> DataFrame:
    """Video and audio streams of AVI objects. A video stream's declared length is limited by the chunks that its `movi` list has; only the first stream has an audio duration."""
    nodes = checkpointed(boxes.walk_boxes(pieces, "riff", piece=piece)[0].drop("head"))
    lists = nodes.where("id = 'LIST'")
    types = checkpointed(_heads(lists.withColumn("data_len", F.lit(4)), pieces, piece, 4).select("path", "seq", F.decode("bytes", "ISO-8859-1").alias("type")))
    strl = types.where("type = 'strl'").select("path", F.col("seq").alias("parent"), (F.row_number().over(W.partitionBy("path").orderBy("seq")) - 1).alias("place"))  # a few an object
    own = nodes.where("id in ('strh', 'strf') and not truncated").join(strl, ["path", "parent"])
    read = own.join(_heads(own, pieces, piece, 64), ["path", "seq"])
    h, f = F.col("strh"), F.col("strf")
    s = read.groupBy("path", "place").agg(F.min_by("bytes", F.when(F.col("id") == "strh", F.col("seq"))).alias("strh"), F.min_by("bytes", F.when(F.col("id") == "strf", F.col("seq"))).alias("strf"))
    s = s.where((B.size_of("strh") >= 56) & B.slice_bytes("strh", 0, 4).isin(F.lit(bytearray(b"vids")), F.lit(bytearray(b"auds"))))
    first_movi = types.where("type = 'movi'").groupBy("path").agg(F.min("seq").alias("movi"))
    movi = lists.select("path", F.col("seq").alias("movi"), (F.col("data_off") + F.col("data_len")).alias("__end")).join(first_movi, ["path", "movi"])
    seen = C.route_chunks(nodes.where("id <> 'LIST'"), "(?:db|dc|wb)").join(movi, "path").where((F.col("seq") > F.col("movi")) & (F.col("data_off") < F.col("__end")))
    s = s.join(seen.groupBy("path", F.col("stream_index").alias("place")).agg(F.count("*").alias("seen")), ["path", "place"], "left")
    video = B.bytes_at(h, 0, b"vids")
    tag = lambda c, at: F.upper(F.decode(B.slice_bytes(c, at, 4), "ISO-8859-1"))
    u = lambda c, at, n=4: B.uint(c, at, n, "le")
    bitmap = F.when((B.size_of(f) >= 20) & (u(f, 0) >= 16), tag(f, 16))
    picture = F.coalesce(_mapped(F.coalesce(bitmap, tag(h, 4)), R.AVI_CODECS), F.when(B.bytes_at(f, 16, b"\x01\0\0\0"), "msrle"))
    sound = None
    wave, bits = u(f, 0, 2), u(f, 14, 2)
    for number, wide, codec in AVI_AUDIO:
        test = (wave == number) if wide is None else (wave == number) & (bits == wide)
        sound = F.when(test, codec) if sound is None else sound.when(test, codec)
    declared = u(h, 32)
    length = F.when(video, F.when(F.col("seen") > 0, F.least(declared, "seen")).otherwise(declared)).otherwise(declared + F.when(wave.isin(0x61, 0x62), 8).otherwise(0))
    seconds = F.try_divide(length.cast("double") * u(h, 20), u(h, 24).cast("double"))
    s = s.select("path", "place", video.alias("video"), F.when(video, picture).when(B.size_of(f) >= 16, sound).alias("codec_name"), u(f, 4).alias("__rate"), u(f, 2, 2).alias("__channels"),
                 F.when(wave == 1, bits).otherwise(0).alias("__bits"), seconds.alias("seconds"), F.abs(B.sint(f, 4, 4, "le")).alias("__w"), F.abs(B.sint(f, 8, 4, "le")).alias("__h"))
    s = s.where("codec_name is not null and (not video or __w is not null)")
    s = s.withColumn("index", F.row_number().over(W.partitionBy("path").orderBy("place")) - 1)
    return s.select(
        "path", "index", F.when(F.col("video"), "video").otherwise("audio").alias("codec_type"), "codec_name", F.expr("if(video, null, __rate)").alias("sample_rate"),
        F.expr("if(video, null, cast(__channels as int))").alias("channels"), F.expr("if(video, null, cast(__bits as int))").alias("bits_per_sample"),
        F.expr("case when video then seconds when index = 0 then coalesce(seconds, 0D) else 0D end").alias("duration_seconds"), F.expr("if(video, __w, null)").alias("width"),
        F.expr("if(video, __h, null)").alias("height"))


def ogg_streams(pieces: DataFrame, piece: int) -> DataFrame:
    """Opus and Vorbis streams of Ogg objects, by first appearance: the header is the start of a stream's first page, the duration its last known position."""
    nodes = checkpointed(boxes.walk_boxes(pieces, "ogg", piece=piece)[0])
    pages = checkpointed(C.ogg_pages(nodes))
    last = C.last_granule(pages)
    first = pages.groupBy("path", "serial").agg(F.min("page_no").alias("seq"))
    heads = _heads(nodes.join(first, ["path", "seq"], "left_semi"), pieces, piece, 64).join(first, ["path", "seq"])
    b = F.col("bytes")
    opus, vorbis = B.bytes_at(b, 0, b"OpusHead") & (B.size_of(b) >= 19), B.bytes_at(b, 0, b"\x01vorbis") & (B.size_of(b) >= 30)
    s = heads.join(last, ["path", "serial"]).select(
        "path", F.col("stream_index").alias("place"), F.coalesce(F.col("last_granule"), F.lit(0)).alias("granule"), F.when(opus, "opus").when(vorbis, "vorbis").alias("codec_name"),
        F.when(opus, 48000).otherwise(B.uint(b, 12, 4, "le")).cast("long").alias("sample_rate"), F.when(opus, B.uint(b, 9, 1)).otherwise(B.uint(b, 11, 1)).cast("int").alias("channels"))
    s = s.where("codec_name is not null and sample_rate > 0 and channels > 0")
    none = F.lit(None).cast("long")
    return s.select(
        "path", (F.row_number().over(W.partitionBy("path").orderBy("place")) - 1).alias("index"), F.lit("audio").alias("codec_type"), "codec_name", "sample_rate", "channels", F.lit(0).alias("bits_per_sample"),
        (F.col("granule") / F.col("sample_rate")).alias("duration_seconds"), none.alias("width"), none.alias("height"))


def mp3_streams(pieces: DataFrame, piece: int) -> DataFrame:
    """The one stream of MPEG audio objects; pieces have a halo."""
    none = F.lit(None).cast("long")
    return mpeg_audio.streams(pieces, piece).select(
        "path", F.lit(0).alias("index"), F.lit("audio").alias("codec_type"), "codec_name", "sample_rate", F.col("channels").cast("int").alias("channels"), F.lit(0).alias("bits_per_sample"), "duration_seconds",
        none.alias("width"), none.alias("height"))


def media_documents(pieces: DataFrame, formats: DataFrame, piece: int) -> DataFrame:
    """(path, doc) of the objects that formats(path, format) names; pieces of `piece` bytes and mpeg_audio.HALO more. Objects without a supported stream have no row."""
    plain = pieces.withColumn("content", B.slice_bytes("content", 0, piece))
    out = None
    for name, rows, streams in (("avi", plain, avi_streams), ("ogg", plain, ogg_streams), ("mp3", pieces, mp3_streams)):
        own = formats.where(F.col("format") == name).select("path")
        found = streams(checkpointed(rows.join(own, "path", "left_semi")), piece).select(*_STREAM)
        part = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in _STREAM[1:]], F.lit(None).cast("string").alias("frame_rate")))).alias("streams")).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("path", F.struct("format", "streams").alias("doc"))
