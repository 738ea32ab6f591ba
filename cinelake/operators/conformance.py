"""Differential testing as tables: normalised documents, diffs, outcomes, summaries, scores, gates and trends."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cinelake.functions import literal, ordered

# Tolerances in seconds, compressed audio codecs, status weights.
DEFAULT_TOLERANCE, COMPRESSED_TOLERANCE = 0.001, 0.05
COMPRESSED_CODECS = ("aac", "mp3", "opus", "vorbis")
WEIGHTS = {"passed": 10, "failed": -20, "error": -20, "skipped": -10}
MP4_NAMES = ("mov", "mp4", "m4a", "3gp", "3g2", "mj2")
IMAGE_CODECS = ("alias_pix", "bmp", "brender_pix", "dds", "dpx", "fits", "pbm", "pgm", "png", "ppm", "ptx", "sgi", "sunrast", "targa", "xbm")
IMAGE_EXTENSIONS = ("bmp", "dds", "dpx", "fit", "fits", "fts", "pbm", "pgm", "pnm", "png", "ppm", "ptx", "ras", "sgi", "sun", "tga", "xbm")

# Report areas (label, kind, name prefix).
AREAS = (
    ("WAV/PCM metadata", "probe-json", "probe wav"), ("WAV/PCM decode/hash", "framemd5", "decode/hash wav"),
    ("MP3 metadata", "probe-json", "probe mp3"), ("MP3 decode/hash", "framemd5", "decode/hash mp3"),
    ("FLAC metadata", "probe-json", "probe flac"), ("FLAC decode/hash", "framemd5", "decode/hash flac"),
    ("Ogg audio metadata", "probe-json", "probe ogg"), ("Ogg Vorbis decode/hash", "framemd5", "decode/hash ogg tone_vorbis"),
    ("Ogg Opus decode/hash", "framemd5", "decode/hash ogg tone_opus"), ("MP4/MOV metadata", "probe-json", "probe mp4"),
    ("H.264/AAC metadata", "probe-json", "probe mp4"), ("H.264/AAC decode/hash", "framemd5", "decode/hash mp4"),
    ("Video decode/hash", "framemd5", "decode/video"), ("Image decode/hash", "framemd5", "decode/image"),
    ("Audio filters", "filter", "filter audio"), ("Seeking", "seek", "seek audio"), ("Resampling", "resample", "resample audio"),
    ("Remuxing", "remux", "remux"),
)


# ---- text -------------------------------------------------------------------------------------------------------

def trim_text(text: Column, limit: int = 500) -> Column:
    """White space collapsed, first characters only."""
    return F.substring(F.trim(_collapsed(text)), 1, limit)


def _collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " ")


def float_text(x: Column) -> Column:
    """Shortest usual text of a number rounded to 6 decimals: 1.5, 2.0, 5e-05."""
    micro = F.round(F.abs(x) * 1000000).cast("long")
    small = F.when(micro < 10, F.format_string("%de-06", micro)).when(
        micro % 10 == 0, F.format_string("%de-05", (micro / 10).cast("long"))).otherwise(F.format_string("%.1fe-05", micro / 10.0))
    short = F.rtrim(x.cast("decimal(38,6)").cast("string"), F.lit("0"))
    plain = F.concat(short, F.when(F.endswith(short, F.lit(".")), "0").otherwise(""))
    # the first comparison spares most numbers the rounding
    return F.when((F.abs(x) < 0.001) & (micro > 0) & (micro < 100), F.concat(F.when(x < 0, "-").otherwise(""), small)).otherwise(plain)


# ---- documents --------------------------------------------------------------------------------------------------

def canonical_format(name: Column) -> Column:
    names = F.split(F.coalesce(name, F.lit("")), ",")
    out = None
    for n in ("wav", "mp3", "flac", "ogg"):
        test = F.array_contains(names, n)
        out = F.when(test, n) if out is None else out.when(test, n)
    mp4 = F.arrays_overlap(names, F.array(*[F.lit(n) for n in MP4_NAMES]))
    return out.when(mp4, "mp4").when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.get(names, F.lit(0)))


def fallback_bits(bits: Column, raw_bits: Column, codec: Column) -> Column:
    """First value that is neither missing nor zero: bits, raw bits, bits implied by the codec, else 0."""
    implied = F.when(codec == "pcm_s16le", 16).when(codec == "pcm_u8", 8)
    zero = lambda c: F.nullif(c.cast("int"), F.lit(0))
    return F.coalesce(zero(bits), zero(raw_bits), implied, F.lit(0))


def _normal_stream(s: Column, i: Column, oracle: bool) -> Column:
    audio = s["codec_type"] == "audio"
    shaped = s["codec_type"].isin("audio", "video")
    num = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    codec = F.coalesce(s["codec_name"], F.lit("unknown" if oracle else ""))
    bits = fallback_bits(s["bits_per_sample"], s["bits_per_raw_sample"], codec) if oracle else F.coalesce(s["bits_per_sample"].cast("int"), F.lit(0))
    seconds = s["duration"].cast("double") if oracle else s["duration_seconds"]
    return F.struct(
        i.cast("int").alias("index"), F.coalesce(s["codec_type"], F.lit("")).alias("codec_type"), codec.alias("codec_name"),
        F.when(audio, num(s["sample_rate"])).alias("sample_rate"), F.when(audio, num(s["channels"])).alias("channels"),
        F.when(audio, bits.cast("long")).alias("bits_per_sample"), F.when(s["codec_type"] == "video", num(s["width"])).alias("width"),
        F.when(s["codec_type"] == "video", num(s["height"])).alias("height"),
        F.when(shaped, F.round(F.coalesce(seconds, F.lit(0.0)), 6)).alias("duration_seconds"),
    )


def normalise_oracle(docs: DataFrame, doc: str = "doc", out: str = "expected") -> DataFrame:
    """Oracle documents: audio and video streams keep their position among all streams; missing values get defaults."""
    d = F.col(doc)
    placed = F.transform(d["streams"], lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = F.filter(placed, lambda p: p["s"]["codec_type"].isin("audio", "video"))
    streams = F.transform(kept, lambda p: _normal_stream(p["s"], p["i"], True))
    return docs.withColumn(out, F.struct(canonical_format(d["format_name"]).alias("format"), F.coalesce(streams, F.array()).alias("streams")))


def oracle_streams(docs: DataFrame, keys: Sequence[str], doc: str = "doc") -> DataFrame:
    """The streams of `normalise_oracle` as rows (keys, pos, fields of a stream). Streams are taken apart first and normalised as columns, in generated code and once each."""
    placed = F.transform(F.col(doc)["streams"], lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = F.filter(placed, lambda p: p["s"]["codec_type"].isin("audio", "video"))
    rows = docs.select(*keys, F.posexplode_outer(kept).alias("pos", "__p")).where("pos is not null")
    return rows.select(*keys, "pos", _normal_stream(F.col("__p.s"), F.col("__p.i"), True).alias("__s")).select(*keys, "pos", "__s.*")


def normalise_actual(docs: DataFrame, doc: str = "doc", out: str = "actual") -> DataFrame:
    """Our documents: streams numbered by position, missing values get defaults."""
    d = F.col(doc)
    streams = F.transform(d["streams"], lambda s, i: _normal_stream(s, i, False))
    return docs.withColumn(out, F.struct(canonical_format(d["format"]).alias("format"), F.coalesce(streams, F.array()).alias("streams")))


def duration_tolerance(codec_type: Column, codec_name: Column) -> Column:
    return F.when((codec_type == "audio") & codec_name.isin(*COMPRESSED_CODECS), COMPRESSED_TOLERANCE).otherwise(DEFAULT_TOLERANCE)


def diff_probe(pairs: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Add `differences`, the ordered texts, from two documents side by side. Row-local: documents are joined once by path and
    never taken apart into a shuffle."""
    e, a = F.col(expected), F.col(actual)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def note(label: Column, want: Column, got: Column, differs: Column) -> Column:
        return F.when(differs, F.concat(label, F.lit(": expected "), want, F.lit(", got "), got))

    n = F.least(F.size(e["streams"]), F.size(a["streams"]))
    pair = F.zip_with(F.slice(e["streams"], 1, n), F.slice(a["streams"], 1, n), lambda x, y: F.struct(x.alias("e"), y.alias("a")))

    def stream(p: Column, i: Column) -> Column:
        x, y = p["e"], p["a"]
        prefix = lambda f: F.concat(F.lit("stream "), i.cast("string"), F.lit("." + f))
        audio, video = x["codec_type"] == "audio", x["codec_type"] == "video"
        notes = []
        for f, applies in (("codec_type", F.lit(True)), ("codec_name", F.lit(True)), ("sample_rate", audio), ("channels", audio),
                           ("bits_per_sample", audio), ("width", video), ("height", video)):
            notes.append(note(prefix(f), text(x[f]), text(y[f]), applies & ~x[f].eqNullSafe(y[f])))
        far = y["duration_seconds"].isNull() | (F.abs(x["duration_seconds"] - y["duration_seconds"]) > duration_tolerance(x["codec_type"], x["codec_name"]))
        notes.append(note(prefix("duration_seconds"), float_text(x["duration_seconds"]), F.coalesce(float_text(y["duration_seconds"]), F.lit("None")), (audio | video) & far))
        return F.array(*notes)

    head = F.array(
        note(F.lit("format"), e["format"], a["format"], e["format"] != a["format"]),
        note(F.lit("stream count"), text(F.size(e["streams"])), text(F.size(a["streams"])), F.size(e["streams"]) != F.size(a["streams"])),
    )
    return pairs.withColumn("differences", F.filter(F.concat(head, F.flatten(F.transform(pair, stream))), lambda d: d.isNotNull()))


def within_tolerance(expected: DataFrame, actual: DataFrame, tolerances: DataFrame, keys: Sequence[str], codec: str = "codec_name", default: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Match of two measurements within the tolerance of the codec; a missing actual value never matches."""
    j = expected.join(actual, list(keys), "left").join(tolerances, codec, "left")
    close = F.abs(F.col("expected") - F.col("actual")) <= F.coalesce("tolerance", F.lit(default))
    return j.withColumn("matches", F.coalesce(close, F.lit(False))).drop("tolerance")


FRAME_FIELDS = ("stream_index", "dts", "pts", "duration", "size", "hash")


def diff_manifest(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Per object: passed, frame counts that differ, or the first differing frame. One full outer join on (keys, frame_no), then partial aggregates."""
    keys = list(keys)
    side = lambda df, n: df.select(*keys, "frame_no", F.struct(*FRAME_FIELDS).alias(n))
    j = side(expected, "e").join(side(actual, "a"), [*keys, "frame_no"], "full_outer")
    differs = ~F.col("e").eqNullSafe(F.col("a"))
    g = j.groupBy(*keys).agg(
        F.count("e").alias("n_e"), F.count("a").alias("n_a"), F.min(F.when(differs, F.col("frame_no"))).alias("first"),
        F.min_by(F.struct("e", "a"), F.when(differs, F.col("frame_no"))).alias("d"))

    def show(c: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *[
            F.concat(F.lit(f"'{f}': "), F.lit("'") if f == "hash" else F.lit(""), c[f].cast("string"), F.lit("'") if f == "hash" else F.lit("")) for f in FRAME_FIELDS]), F.lit("}"))

    details = F.when(F.col("first").isNull(), "").when(
        F.col("n_e") != F.col("n_a"), F.format_string("frame count differs: expected %d, got %d", "n_e", "n_a")).otherwise(
        F.concat(F.lit("frame "), F.col("first").cast("string"), F.lit(" differs: expected "), show(F.col("d.e")), F.lit(", got "), show(F.col("d.a"))))
    return g.select(*keys, F.when(F.col("first").isNull(), "passed").otherwise("failed").alias("status"), details.alias("details"))


def diff_blob(df: DataFrame, size: str = "size", md5: str = "hash", content: str = "content") -> DataFrame:
    """Size and MD5 of a blob against the golden ones."""
    n, h = F.octet_length(content).cast("long"), F.md5(content)
    same = n.eqNullSafe(F.col(size)) & h.eqNullSafe(F.col(md5))
    text = F.concat(F.lit("binary output differs: expected "), F.coalesce(F.col(size).cast("string"), F.lit("None")), F.lit(" bytes/"), F.coalesce(md5, F.lit("None")),
                    F.lit(", got "), n.cast("string"), F.lit(" bytes/"), h)
    return df.select("*", F.when(same, "passed").otherwise("failed").alias("status"), F.when(same, "").otherwise(text).alias("details"))


def attach_golden(actual: DataFrame, golden: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Join golden rows; a row without one becomes an error of its own."""
    j = actual.join(golden.withColumn("__golden", F.lit(True)), list(keys), "left")
    name = F.concat_ws("/", *keys)
    missing = F.col("__golden").isNull()
    return j.select("*", F.when(missing, "error").alias("status"), F.when(missing, F.concat(F.lit("missing reference "), name)).alias("details")).drop("__golden")


# ---- outcomes ---------------------------------------------------------------------------------------------------

def decide(df: DataFrame) -> DataFrame:
    """Status and message of one comparison. Columns: timed_out, exception, panic, oracle_returncode, our_returncode, stderr, differences (text)."""
    oracle_ok, ours_ok = F.col("oracle_returncode") == 0, F.col("our_returncode") == 0
    status = (
        F.when(F.col("timed_out") | F.col("exception").isNotNull() | F.col("panic"), "error")
        .when(~oracle_ok & ~ours_ok, "passed").when(~oracle_ok | ~ours_ok, "failed")
        .when(F.col("differences") == "", "passed").otherwise("failed")
    )
    details = (
        F.when(F.col("timed_out"), "probe command timed out").when(F.col("exception").isNotNull(), F.col("exception"))
        .when(F.col("panic"), F.concat(F.lit("probe panicked: "), F.col("stderr")))
        .when(~oracle_ok & ~ours_ok, "both oracle and probe rejected input")
        .when(~oracle_ok, "oracle rejected input but probe accepted it")
        .when(~ours_ok, F.concat(F.lit("oracle accepted input but probe rejected it: "), trim_text(F.col("stderr"))))
        .otherwise(F.col("differences"))
    )
    return df.withColumn("status", status).withColumn("details", trim_text(details))


def plan_surfaces(docs: DataFrame, streams: str = "streams", ext: str = "ext", format: str = "format") -> DataFrame:
    """Commands to try per object, in order: shaped audio, images and video, shapeless audio, stream copy."""
    s = F.col(streams)
    shaped = lambda x: (F.coalesce(x["sample_rate"], F.lit(0)) > 0) & (F.coalesce(x["channels"], F.lit(0)) > 0)
    audio = lambda want: F.transform(F.filter(s, lambda x: (x["codec_type"] == "audio") & (shaped(x) == F.lit(want))), lambda x: F.lit("audio"))
    image = lambda x: F.coalesce(x["codec_name"].isin(*IMAGE_CODECS), F.lit(False)) | F.col(ext).isin(*IMAGE_EXTENSIONS)
    visual = F.transform(F.filter(s, lambda x: x["codec_type"] == "video"), lambda x: F.when(image(x), "image").otherwise("video"))
    copy = F.when(F.coalesce(format, F.lit("")) != "", F.array(F.lit("stream-copy"))).otherwise(F.array().cast("array<string>"))
    return docs.select(*[c for c in docs.columns if c != streams], F.posexplode_outer(F.concat(audio(True), visual, audio(False), copy)).alias("ord", "surface")).where("ord is not null")


def _joined_prefix(rows: DataFrame, keys: Sequence[str], text: Column, limit: int, fan: int = 1024) -> DataFrame:
    """(keys, __all): the texts of a key in the order of `ord`, joined with ' | '; white space collapsed, and at least the first `limit` characters that trimming leaves. A cut
    text is longer than that, so nothing that follows it shows."""
    top = rows.agg(F.max(F.abs("ord"))).first()[0] or 0
    part = rows.select(*keys, F.col("ord").cast("long").alias("__at"), text.alias("__all"))
    while True:
        top //= fan
        at = F.floor(F.col("__at") / fan).cast("long") if top else F.when(F.col("__at") < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
        folded = F.expr("listagg(__all, ' | ') WITHIN GROUP (ORDER BY __at)")
        part = part.groupBy(*keys, at.alias("__to")).agg(F.substring(_collapsed(folded), 1, limit + 2).alias("__all")).withColumnRenamed("__to", "__at")
        if not top:
            return part.groupBy(*keys).agg(F.expr("listagg(__all, ' | ') WITHIN GROUP (ORDER BY __at)").alias("__all"))


def first_success(attempts: DataFrame, keys: Sequence[str] = ("path",), limit: int = 500) -> DataFrame:
    """Outcome of ordered attempts(keys, ord, surface, result ok|fail|error, stderr): the first success or error decides, else all failures are joined and cut at `limit`
    characters. Joined texts are folded by ranges of ordinals, level by level: a group joins the texts of at most 1,024 ranges and keeps their first `limit` characters, so that no task
    gathers the failures of a key."""
    keys = list(keys)
    decided = F.col("result").isin("ok", "error")
    first = attempts.groupBy(*keys).agg(
        F.min_by(F.struct("surface", "result", "stderr"), F.when(decided, F.col("ord"))).alias("hit"), F.max_by("surface", "ord").alias("last"))
    joined = _joined_prefix(attempts.where("result = 'fail'"), keys, F.concat(F.col("surface"), F.lit(": "), trim_text(F.col("stderr"))), limit)
    j = first.join(joined, keys, "left")
    status = F.when(F.col("hit").isNull(), "failed").when(F.col("hit.result") == "ok", "passed").otherwise("error")
    details = F.when(status == "failed", F.col("__all")).when(status == "passed", "decode command completed").otherwise(F.col("hit.stderr"))
    return j.select(*keys, F.coalesce(F.col("hit.surface"), F.col("last")).alias("command_surface"), status.alias("status"), trim_text(details, limit).alias("details"))


# ---- summaries --------------------------------------------------------------------------------------------------

def _status(s: str) -> Column:
    return F.count_if(F.col("status") == s)


def status_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    oracle, ours = F.col("oracle_returncode") == 0, F.col("our_returncode") == 0
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), _status("passed").alias("passed"), _status("failed").alias("failed"), _status("skipped").alias("skipped"), _status("error").alias("errors"),
        F.count_if(oracle).alias("oracle_accepted"), F.count_if(ours).alias("ours_accepted"), F.count_if(oracle & ~F.coalesce(ours, F.lit(False))).alias("rejected_by_us"))


def execution_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count("our_returncode").alias("attempted"), (_status("passed") + _status("failed")).alias("clean"), _status("passed").alias("passed"),
        _status("failed").alias("failed"), _status("error").alias("errors"), _status("skipped").alias("skipped"))


def score(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted score; a status without a weight fails the job."""
    weight = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0))
    checked = weight.otherwise(F.raise_error(F.concat(F.lit("unknown test status: "), F.coalesce("status", F.lit("null")))).cast("int"))
    return results.groupBy(*keys).agg(F.sum(checked).cast("long").alias("score"))


def strict_metrics(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    oracle, ours = F.col("oracle_returncode") == 0, F.col("our_returncode") == 0
    g = results.groupBy(*keys).agg(
        F.count_if(oracle & (F.col("status") == "passed")).alias("strict"), F.count_if(oracle).alias("accepted"), _status("passed").alias("total_passed"),
        _status("error").alias("errors"), F.count_if(~F.coalesce(oracle, F.lit(False)) & ours).alias("false_accepts"))
    return g.withColumn("percent", F.coalesce(F.try_divide(F.col("strict") * 100.0, F.col("accepted")), F.lit(0.0)))


def success_split(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    passed = F.col("status") == "passed"
    return results.groupBy(*keys).agg(
        F.count_if(passed & (F.col("our_returncode") == 0)).alias("command_successes"), F.count_if(passed & F.col("our_returncode").isNull()).alias("compatible_rejections"))


def gate(runs: DataFrame, min_strict: int, min_percent: float, keys: Sequence[str] = ()) -> DataFrame:
    """Keep or revert: runs(keys, phase base|after, strict, percent, false_accepts, errors, score), one row per phase."""
    at = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    g = runs.groupBy(*keys).agg(*[at(p, c).alias(f"{p}_{c}") for p in ("base", "after") for c in ("strict", "percent", "false_accepts", "errors", "score")])
    strict_gain, percent_gain = F.col("after_strict") - F.col("base_strict"), F.col("after_percent") - F.col("base_percent")
    reasons = F.concat_ws(
        "; ",
        F.when(strict_gain < min_strict, F.format_string(f"strict gain %d < {min_strict}", strict_gain)),
        F.when(percent_gain < min_percent, F.format_string(f"percent gain %.3f < {min_percent:.3f}", percent_gain)),
        F.when(F.col("after_false_accepts") > F.col("base_false_accepts"), F.format_string("false accepts increased %d -> %d", "base_false_accepts", "after_false_accepts")),
        F.when(F.col("after_errors") != 0, F.format_string("corpus errors = %d", "after_errors")),
        F.when(F.col("after_score") < F.col("base_score"), F.format_string("mirrored score decreased %d -> %d", "base_score", "after_score")),
    )
    return g.select(*keys, (reasons == "").alias("keep"), F.when(reasons == "", "guardrails passed").otherwise(reasons).alias("reason"))


def protected_paths(changed: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Changed paths that match a glob (a star also crosses directories); the globs become one pattern, so nothing is joined."""
    return changed.where(F.col(path).rlike("|".join(f"^(?:{_glob(p)})$" for p in patterns)))


def _glob(pattern: str) -> str:
    """fnmatch rules: `*`, `?`, `[seq]` and `[!seq]`; a bracket that isn't closed stands for itself."""
    special, out, at = {"*": ".*", "?": "."}, [], 0
    while at < len(pattern):
        close = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if pattern[at] == "[" else -1
        if close > 0:
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[at + 1 : close].removeprefix("!"))
            out.append(f"[{'^' if pattern[at + 1] == '!' else ''}{inside}]")
            at = close
        else:
            out.append(special.get(pattern[at]) or re.escape(pattern[at]))
        at += 1
    return re.sub(r"(\.\*)+", ".*", "".join(out))


def area_rollup(results: DataFrame, areas: Sequence[tuple] = AREAS) -> DataFrame:
    """Passing ratio and status per area; an area without tests has failed, a test may count in several areas."""
    spark = results.sparkSession
    dim = literal.small_table(spark, [(i, *a) for i, a in enumerate(areas)], "area_no int, area string, __kind string, prefix string")
    # areas are matched per result by kind and prefix, then counted; the dimension has a fixed handful of rows
    hits = results.join(dim, (F.col("kind") == F.col("__kind")) & F.startswith("name", "prefix"))
    g = hits.groupBy(F.col("area_no").alias("__no")).agg(F.count("*").alias("n"), _status("passed").alias("p"))
    j = dim.join(g, F.col("area_no") == F.col("__no"), "left")
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    return j.select("area_no", "area", F.format_string("%d/%d passing", p, n).alias("ratio"), F.when((n > 0) & (n == p), "passed").otherwise("failed").alias("status"))


def progress_stats(execution: DataFrame, mirrored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Execution figures when there are any, else those of the mirrored suite (both keyed; columns total, clean, passed, failed, errors, skipped)."""
    cols = ("total", "clean", "passed", "failed", "errors", "skipped")
    e = execution.select(*keys, *[F.col(c).alias(f"e_{c}") for c in cols])
    m = mirrored.select(*keys, *[F.col(c).alias(f"m_{c}") for c in cols])
    j = e.join(m, list(keys), "full_outer")
    upstream = F.coalesce(F.col("e_total"), F.lit(0)) > 0
    value = lambda c: F.when(upstream, F.coalesce(f"e_{c}", F.lit(0))).otherwise(F.coalesce(f"m_{c}", F.lit(0))).alias(c)
    out = j.select(*keys, F.when(upstream, "upstream").otherwise("mirrored").alias("source"), *[value(c) for c in cols])
    return out.withColumn("percent", F.coalesce(F.try_divide(F.col("clean") * 100.0, F.col("total")), F.lit(0.0)))


def known_failures(results: DataFrame, statuses: Sequence[str] = ("failed", "error"), limit: int | None = 25) -> DataFrame:
    """Failures in source order; the report shows the first 25."""
    bad = results.where(F.col("status").isin(*statuses)).orderBy("ord")
    return bad.limit(limit) if limit else bad


def latest_logs(logs: DataFrame, n: int = 5, name: str = "name", text: str = "text") -> DataFrame:
    """Last logs by name with their first line (the name when there is none)."""
    first = F.regexp_replace(F.get(F.split(text, "\n", 2), F.lit(0)), r"\r$", "")
    return logs.orderBy(F.desc(name)).limit(n).select(name, F.when(F.octet_length(text) == 0, F.col(name)).otherwise(first).alias("first_line"))


def failing_clusters(results: DataFrame, limit: int = 40) -> DataFrame:
    """Top-level folders of failures the oracle accepts, largest first."""
    bad = results.where((F.col("status") != "passed") & (F.col("oracle_returncode") == 0))
    g = bad.groupBy(F.substring_index("name", "/", 1).alias("folder")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.desc("folder")).limit(limit)


# ---- benchmarks and trends --------------------------------------------------------------------------------------

def pair_benchmarks(bench: DataFrame, tools: tuple[str, str], label: str = "label", mean: str = "mean") -> DataFrame:
    """Labels are '<tool> <task>'; one row per task with the mean of both tools. Later entries of one label win over earlier ones (`ord`)."""
    b = bench.select(F.regexp_extract(label, r"^(\S+)\s+(.*)$", 1).alias("tool"), F.regexp_extract(label, r"^(\S+)\s+(.*)$", 2).alias("task"), F.col(mean).alias("mean"), "ord")
    return b.where(F.col("tool").isin(*tools)).groupBy("task").agg(
        *[F.max_by(F.when(F.col("tool") == t, F.col("mean")), F.when(F.col("tool") == t, F.col("ord"))).alias(n) for t, n in zip(tools, ("oracle_mean", "our_mean"))])


def benchmark_ratio(pairs: DataFrame, subject: str = "ours") -> DataFrame:
    a, b = F.col("oracle_mean"), F.col("our_mean")
    missing = a.isNull() | b.isNull()
    ratio = F.try_divide(b, a)
    text = F.when(missing, "not measured").when((a <= 0) | (b <= 0), "not comparable").when(
        ratio >= 1, F.format_string(f"{subject} is %.2fx slower", ratio)).otherwise(F.format_string(f"{subject} is %.2fx faster", F.try_divide(F.lit(1.0), ratio)))
    return pairs.select(
        "task", F.when(missing, 0.0).otherwise(a).alias("oracle_mean"), F.when(missing, 0.0).otherwise(b).alias("our_mean"), text.alias("relative"),
        F.when(missing, "skipped").otherwise("measured").alias("status"))


def coverage_trend(runs: DataFrame, ordinal: str = "run_no", keys: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """Matches per run with the gain over the run before and the percentage."""
    r = ordered.previous_value(runs, list(keys), ordinal, F.col("strict"), "__before", block)
    return r.withColumn("gain", F.col("strict") - F.col("__before")).withColumn("percent", F.try_divide(F.col("strict") * 100.0, F.col("accepted"))).drop("__before")
