"""Probe a corpus: objects in, documents, streams and rejects out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cinelake import rules as R
from cinelake.functions import binary as B, rational
from cinelake.operators import containers as C, identify as I, mpeg_audio
from cinelake.plans import media
from cinelake.session import checkpointed
from cinelake.sources.pieces import cut


@dataclass(frozen=True)
class Probed:
    documents: DataFrame
    streams: DataFrame
    rejects: DataFrame


def _stream(kind: str, codec: Column, seconds: Column, rate=None, channels=None, bits=None, width=None, height=None) -> Column:
    as_ = lambda v, t: B.lit(v).cast(t)
    return F.struct(
        F.lit(0).alias("index"), F.lit(kind).alias("codec_type"), codec.alias("codec_name"), as_(rate, "long").alias("sample_rate"), as_(channels, "int").alias("channels"),
        as_(bits, "int").alias("bits_per_sample"), seconds.cast("double").alias("duration_seconds"), as_(width, "long").alias("width"), as_(height, "long").alias("height"),
        F.lit(None).cast("string").alias("frame_rate"))


def with_wav(objects: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Add `wav_streams` and `wav_error` of WAV objects from their chunk list: the format chunk's header, the data chunk clamped to the bytes present."""
    first = lambda ident: F.get(F.filter(chunks, lambda c: c["id"] == ident), F.lit(0))
    objects = objects.withColumn("__fmt", first("fmt ")["head"]).withColumn("__data", first("data")).withColumn("__fact", first("fact")["head"])
    u = lambda o, n: B.uint("__fmt", o, n, "le")
    tag = F.when(u(0, 2) == 0xFFFE, B.uint("__fmt", 24, 2, "le")).otherwise(u(0, 2))
    clamped = F.greatest(F.lit(0).cast("long"), F.least(F.col("__data.data_len"), F.col("length") - F.col("__data.data_off")))
    w = objects.withColumns({
        "tag": tag, "channels": u(2, 2), "sample_rate": u(4, 4), "byte_rate": u(8, 4), "block_align": u(12, 2), "bits": u(14, 2), "data_len": clamped,
        "samples": B.uint("__fact", 0, 4, "le"), "codec_type": F.lit("audio"), "width": F.lit(None).cast("long"), "height": F.lit(None).cast("long")})
    name = lambda table, key: F.try_element_at(B.literal_table({str(k): v for k, v in table.items()}, "map<string,string>"), key.cast("string"))
    w = I.validate_headers(w).withColumn("__other", name(R.WAV_TAGS, F.col("tag")))
    pcm, t = F.col("tag") == 1, F.col("tag")
    needs_rate = F.when(F.coalesce("channels", F.lit(0)) == 0, "unsupported: zero channels").when(F.coalesce("sample_rate", F.lit(0)) == 0, "unsupported: zero sample rate")
    by_fact = t.isin(0x22, 0x31, 0x125)
    error = (
        F.when(t.isNull(), "unexpected_eof: format chunk").when(F.col("data_len").isNull(), "invalid_data: no data chunk")
        .when(pcm, F.col("reason")).when(F.col("__other").isNull(), "unsupported: audio format")
        .when((t == 0x200) & ((F.col("channels") != 1) | (F.col("bits") != 4)), "unsupported: layout")
        .when(t.isin(0x161, 0x270) & (F.col("byte_rate") == 0), "unsupported: byte rate missing")
        .when(by_fact & F.col("samples").isNull(), "invalid_data: sample count missing").otherwise(needs_rate)
    )
    data, rate = F.col("data_len").cast("double"), F.col("sample_rate").cast("double")
    seconds = (
        F.when(t.isin(0x17, 0x200), F.try_divide(data * 2, rate)).when(by_fact, F.try_divide(F.col("samples").cast("double"), rate))
        .when(t.isin(0x161, 0x270), F.try_divide(data, F.col("byte_rate").cast("double"))).when(t == 0x28E, F.try_divide(data * 8, rate))
        .otherwise(F.coalesce(F.try_divide(data, (F.col("block_align") * F.col("sample_rate")).cast("double")), F.lit(0.0)))
    )
    other_bits = F.when(t.isin(*R.WAV_TAG_BITS), 4).otherwise(0)
    stream = _stream("audio", F.when(pcm, name(R.WAV_PCM_BITS, F.col("bits"))).otherwise(F.col("__other")), seconds, F.col("sample_rate"), F.col("channels"),
                     F.when(pcm, F.col("bits").cast("int")).otherwise(other_bits))
    w = w.withColumn("wav_error", F.when(F.col(chunks).isNotNull(), error))
    return w.withColumn("wav_streams", F.when(F.col("wav_error").isNull(), F.array(stream))).select(*objects.columns, "wav_streams", "wav_error").drop("__fmt", "__data", "__fact")


def gif_seconds(chunks: Column) -> Column:
    """Sum of the delays in a GIF's blocks, else a tenth per image; NULL when the file breaks off inside a block."""
    delays = F.transform(F.filter(chunks, lambda c: c["id"] == "XF9 "), lambda c: B.uint(c["head"], 2, 2, "le"))
    total = F.aggregate(delays, F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d, F.lit(0)))
    images = F.size(F.filter(chunks, lambda c: c["id"] == "IMG "))
    return F.when(~F.exists(chunks, lambda c: c["truncated"]), F.when(total > 0, total / 100.0).otherwise(images / 10.0))


def probe_table(objects: DataFrame) -> DataFrame:
    """One row per object of objects(path, length, content): doc or error, and the stage that decided.

    Precedence: exact observations for preferred extensions, then content (signature, then header), then the extension alone.
    All of it is one pass over the contents without a join or a shuffle.
    """
    c = F.col("content")
    o = I.with_extension(objects).withColumn("length", B.size_of("content")).withColumn("refused", I.is_denied(c))
    o = I.apply_overrides(o)
    o = I.header_streams(I.extract_fields(I.refine_format(I.match_signatures(o)))).drop("fields")
    # the same header rules for formats known by extension, kept apart as the last stage
    o = o.withColumnsRenamed({"format": "content_format", "streams": "content_streams", "error_kind": "content_kind"})
    o = I.header_streams(I.extract_fields(o.withColumn("format", I.extension_format(F.col("ext"), c)))).drop("fields", "error_kind").withColumnsRenamed(
        {"format": "ext_format", "streams": "ext_streams", "content_format": "format", "content_streams": "streams", "content_kind": "error_kind"})
    f = F.col("format")
    o = o.withColumn("chunks", C.chunk_list(c, F.when(f == "wav", "wave").when(f == "gif", "gif")))
    # from here on only small columns travel
    o = o.select(
        "path", "ext", "length", "format", "override_doc", "refused", "ext_format", "ext_streams", "error_kind", "streams", F.when(f == "gif", gif_seconds(F.col("chunks"))).alias("gif_seconds"),
        F.when(f == "wav", F.col("chunks")).alias("chunks"), F.when(f == "ac3", I.ac3_info(c)).alias("ac3"), F.when(f == "observed", I.observed_document(F.lit("*"), c)).alias("observed_doc"),
        F.when(f == "subtitle", I.text_format(F.make_valid_utf8(c.cast("string")))).alias("text_format"))
    o = with_wav(o)
    length = F.col("length")
    gif = F.when(F.col("gif_seconds").isNotNull(), F.transform("streams", lambda s: s.withField("duration_seconds", F.col("gif_seconds"))))
    ac3 = F.array(_stream("audio", F.col("ac3.codec"), F.try_divide(length * 8.0, F.col("ac3.bitrate").cast("double")), F.col("ac3.sample_rate"), F.col("ac3.channels"), 0))
    tty = F.array(_stream("video", F.lit("ansi"), rational.ceil_div(length, F.lit(240)) / 25.0, width=640, height=400))
    empty = F.array().cast(o.schema["streams"].dataType)
    streams = (
        F.when(f == "wav", F.col("wav_streams")).when(f == "gif", gif).when(f == "ac3", ac3).when(f == "tty", tty).when(f == "subtitle", empty).when(f == "observed", F.col("observed_doc.streams")).otherwise(F.col("streams")))
    reported = lambda name: F.coalesce(F.try_element_at(B.literal_table(R.REPORTED_FORMAT, "map<string,string>"), name), name)
    content_name = F.coalesce(F.when(f == "subtitle", F.col("text_format")), F.col("ac3.codec"), F.col("observed_doc.format"), reported(f))
    content_error = F.when(F.col("refused"), "invalid_data: refused observation").when(f.isNull(), "unsupported: unrecognized media format").otherwise(
        F.coalesce(F.col("wav_error"), F.concat(F.col("error_kind"), F.lit(": header")), F.lit("unsupported: no header rule")))
    packets = lambda s: s.withField("duration_seconds", F.when(F.col("ext_format") == "cdg", rational.int_div(length, F.lit(24)) / 300.0).otherwise(s["duration_seconds"]))
    by_header = F.when(F.col("ext_streams").isNotNull(), F.struct(reported(F.col("ext_format")).alias("format"), F.transform("ext_streams", packets).alias("streams")))
    o = o.withColumn("streams", streams)
    o = o.select(
        "path", F.when(F.col("ext").isin(*R.PREFERRED_EXTENSIONS), F.col("override_doc")).alias("preferred"),
        F.when(F.col("streams").isNotNull() & ~F.col("refused"), F.struct(content_name.alias("format"), F.col("streams").alias("streams"))).alias("by_content"),
        F.coalesce(F.when(F.col("ext").isin(*R.FALLBACK_EXTENSIONS), F.col("override_doc")), I.extension_streams(F.col("ext"), length), by_header).alias("by_extension"), content_error.alias("content_error"),
        F.when(~F.col("refused"), f).alias("format"))
    return I.resolve_probe(o, "preferred", "by_content", "by_extension", "content_error").select("path", "stage", "doc", "error", "format")


def probe_corpus(objects: DataFrame, piece: int = 1 << 20) -> Probed:
    """Documents, streams and rejects. The result of the one pass over the contents is written to the checkpoint folder, so the
    three tables do not read the corpus again.

    Objects whose answer lies in their structure (AVI, Ogg, MPEG audio) and that no observation has decided are then walked in pieces, and only these are read once more; what they
    give counts as content, before the extension.
    """
    t = checkpointed(probe_table(objects))
    late = t.where(F.col("format").isin(*media.FORMATS) & (F.coalesce("stage", F.lit("")) != "preferred")).select("path", "format")
    if late.limit(1).count():
        pieces = cut(objects.join(late, "path", "left_semi"), piece, halo=mpeg_audio.HALO)
        found = checkpointed(media.media_documents(pieces, late, piece))
        found = found.select("path", F.col("doc").cast(t.schema["doc"].dataType).alias("walked"))
        t = t.join(found, "path", "left").select(
            "path", F.when(F.col("walked").isNotNull(), "content").otherwise(F.col("stage")).alias("stage"), F.coalesce("walked", "doc").alias("doc"),
            F.when(F.col("walked").isNull(), F.when(F.col("format").isin(*media.FORMATS) & F.col("doc").isNull(), "invalid_data: no supported streams").otherwise(F.col("error"))).alias("error"))
    docs = t.where("doc is not null").select("path", "doc.format", "doc.streams")
    rejects = t.where("doc is null").select("path", F.substring_index("error", ":", 1).alias("error_kind"), F.col("error").alias("message"))
    return Probed(docs, I.explode_streams(docs), rejects)
