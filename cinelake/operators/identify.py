"""Identification: ordered signatures, header fields, overrides, text classes, durations and typed rejection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cinelake import rules as R
from cinelake.functions import binary as B, literal, rational
from cinelake.observations import OBSERVATIONS
from cinelake.schemas import PROBE_DOC

_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _all(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _any(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


# ---- paths ------------------------------------------------------------------------------------------------------

def extension(path: Column) -> Column:
    """Lower-case suffix of the base name; a leading dot alone starts no suffix."""
    return F.translate(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1), _ASCII_UP, _ASCII_LOW)


def with_extension(objects: DataFrame, path: str = "path") -> DataFrame:
    return objects.withColumn("ext", extension(F.col(path)))


def kind_flags(objects: DataFrame, path: str = "path") -> DataFrame:
    suffix = F.regexp_extract(F.col(path), r"[^/]\.([^./]*)$", 1)
    return objects.select(
        "*",
        suffix.isin(*R.AUDIO_SUFFIXES).alias("audio_ok"),
        suffix.isin(*R.IMAGE_SUFFIXES).alias("image_ok"),
        suffix.isin(*R.VIDEO_SUFFIXES).alias("video_ok"),
        F.when(suffix == "", "unknown").otherwise(suffix).alias("sample_format"),
    )


# ---- content tests ----------------------------------------------------------------------------------------------

def has_sync(content: Column, byte: int, stride: int, n: int) -> Column:
    """Every n-th record of `stride` bytes starts with the sync byte."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: B.slice_bytes(content, i * stride, 1))
    return (B.size_of(content) >= stride * n) & F.forall(starts, lambda b: b == F.lit(bytearray([byte])))


def mpeg_audio_header(raw: Column, layers: Sequence[int] = (1, 2)) -> Column:
    """Decode a 32-bit MPEG audio header to a struct, NULL when it is not one. Layer codes: 1 = III, 2 = II."""
    tables = B.literal_table(
        {"v1l2": R.MPEG1_LAYER2_KBPS, "v1l3": R.MPEG1_LAYER3_KBPS, "v2": R.MPEG2_LAYER23_KBPS, "rates": R.MPEG1_SAMPLE_RATES}, "map<string,array<int>>"
    )

    def parts(r: Column) -> Column:
        version, layer = B.bits(r, 19, 3), B.bits(r, 17, 3)
        which = F.when((version == 3) & (layer == 2), "v1l2").when(version == 3, "v1l3").otherwise("v2")
        base = F.get(F.try_element_at(tables, F.lit("rates")), B.bits(r, 10, 3).cast("int"))
        return F.struct(
            r.alias("raw"), version.alias("version"), layer.alias("layer"), B.bits(r, 12, 15).alias("index"),
            F.get(F.try_element_at(tables, which), B.bits(r, 12, 15).cast("int") - 1).alias("kbps"),
            F.when(version == 3, base).when(version == 2, F.floor(base / 2)).when(version == 0, F.floor(base / 4)).cast("long").alias("rate"),
            ((version == 3) | (layer == 2)).alias("full"),
        )

    def header(p: Column) -> Column:
        length = rational.int_div(F.when(p["full"], 144000).otherwise(72000) * p["kbps"], p["rate"]) + B.bits(p["raw"], 9, 1)
        ok = (
            (p["raw"].bitwiseAND(F.lit(0xFFE00000)) == 0xFFE00000)
            & (p["version"] != 1) & p["layer"].isin(*layers) & (p["index"] > 0) & (p["index"] < 15) & p["rate"].isNotNull()
        )
        return F.when(
            ok,
            F.struct(
                F.when(p["layer"] == 2, "mp2").otherwise("mp3").alias("codec_name"), length.cast("long").alias("frame_len"),
                p["rate"].alias("sample_rate"), F.when(B.bits(p["raw"], 6, 3) == 3, 1).otherwise(2).alias("channels"),
                F.when(p["full"], 1152).otherwise(576).cast("long").alias("samples_per_frame"),
            ),
        )

    return B.let(B.let(raw, parts), header)


def consecutive_headers(content: Column, limit: int = 1024) -> Column:
    """A layer III header within the first `limit` offsets is followed by another at its end."""
    last = F.least(B.size_of(content) - 4, F.lit(limit).cast("long"))

    def hit(o):
        length = mpeg_audio_header(B.uint(content, o, 4), (1,))["frame_len"]
        follows = B.let(length, lambda n: mpeg_audio_header(B.uint(content, o + n, 4), (1,)).isNotNull())
        # the first byte is tested on its own so that most offsets cost one comparison
        return F.when(B.slice_bytes(content, o, 1) == F.lit(bytearray(b"\xff")), follows).otherwise(False)

    worth = (last >= 0) & F.contains(F.substring(content, 1, limit + 1), F.lit(bytearray(b"\xff")))
    return F.when(worth, F.exists(F.sequence(F.lit(0).cast("long"), last), hit)).otherwise(False)


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _subtitle(content: Column) -> Column:
    return text_format(_text(content)).isNotNull()


def _u32(c: Column, o: int) -> Column:
    return B.uint(c, o, 4, "le")


CHECKS: dict[str, Callable[[Column], Column]] = {
    "kvag_rate": lambda c: _u32(c, 8).between(8000, 96000),
    "sgi_mv_tracks": lambda c: B.contains_bytes(c, b"__NUM_I_TRACKS"),
    "ac3_header": lambda c: ac3_info(c).isNotNull(),
    "mpeg_audio_pair": consecutive_headers,
    "truehd_sync": lambda c: B.contains_bytes(c, b"\xf8\x72\x6f\xba"),
    "bink_letter": lambda c: B.slice_bytes(c, 3, 1).cast("string").rlike("[A-Za-z]"),
    "idcin_header": lambda c: _u32(c, 0).isin(320, 640) & _u32(c, 4).isin(200, 240, 480) & _u32(c, 8).between(8000, 48000),
    "ts_sync": lambda c: has_sync(c, 0x47, 188, 3),
    "tga_footer": lambda c: B.slice_bytes(c, B.size_of(c) - 18, 18) == F.lit(bytearray(b"TRUEVISION-XFILE.\0")),
    "mpeg_sequence": lambda c: B.contains_bytes(B.slice_bytes(c, 0, 16), b"\0\0\x01\xb3"),
    "xbm_text": lambda c: _all([B.contains_bytes(B.slice_bytes(c, 0, 4096), n) for n in (b"#define", b"_width", b"_height", b"_bits")]),
    "pictor_size": lambda c: (B.uint(c, 2, 2, "le") != 0) & (B.uint(c, 4, 2, "le") != 0),
    "ptx_size": lambda c: (B.uint(c, 8, 2, "le") > 0) & (B.uint(c, 10, 2, "le") > 0)
    & (B.size_of(c) >= B.uint(c, 8, 2, "le") * B.uint(c, 10, 2, "le") * 2 + 44),
    "subtitle_text": _subtitle,
    "observed": lambda c: observed_document(F.lit("*"), c).isNotNull(),
    "tty_packet_pts": lambda c: B.contains_bytes(c, b"packet PTS: "),
}


def signature_test(content: Column, sig: R.Signature) -> Column:
    terms = []
    if sig.min_length:
        terms.append(B.size_of(content) >= sig.min_length)
    if sig.alternatives:
        terms.append(_any([_all([B.bytes_at(content, o, b) for o, b in alt]) for alt in sig.alternatives]))
    if sig.check:
        terms.append(CHECKS[sig.check](content))
    return _all(terms)


_TERM = "struct<at:int,n:int,hex:string>"
_GROUPS = f"array<struct<at:int,n:int,alts:map<string,array<struct<rank:int,min_length:bigint,terms:array<{_TERM}>>>>>>"


def _alternatives(ranked: Sequence[tuple[int, R.Signature]]) -> Column:
    """Byte terms of many signatures as one literal, keyed by the first term's position and bytes."""
    groups: dict[tuple[int, int], dict[str, list]] = {}
    for rank, sig in ranked:
        for alt in sig.alternatives:
            (o, b), *rest = alt
            entry = {"rank": rank, "min_length": sig.min_length, "terms": [{"at": ro + 1, "n": len(rb), "hex": rb.hex().upper()} for ro, rb in rest]}
            groups.setdefault((o + 1, len(b)), {}).setdefault(b.hex().upper(), []).append(entry)
    return B.literal_table([{"at": at, "n": n, "alts": alts} for (at, n), alts in groups.items()], _GROUPS)


def _hits(content: Column, ranked: Sequence[tuple[int, R.Signature]]) -> Column:
    """Ranks whose byte terms hold: one map lookup per distinct first position, then the few candidates' other terms."""
    at = lambda t: F.hex(F.substring(content, t["at"], t["n"]))
    found = F.flatten(F.filter(F.transform(_alternatives(ranked), lambda g: F.try_element_at(g["alts"], at(g))), lambda a: a.isNotNull()))
    held = F.filter(found, lambda r: (B.size_of(content) >= r["min_length"]) & F.forall(r["terms"], lambda t: at(t) == t["hex"]))
    return F.transform(held, lambda r: r["rank"])


def signature_format(content: Column, signatures: Sequence[R.Signature] = R.SIGNATURES) -> Column:
    """First matching signature. Byte terms are tested against one literal table; the costlier named checks run, in rank
    order, only when no earlier plain signature has matched. No join, no shuffle."""
    ranked = list(enumerate(signatures))
    plain = [(i, s) for i, s in ranked if not s.check]
    checked = [(i, s) for i, s in ranked if s.check]
    none = len(ranked)

    def decide(h: Column) -> Column:
        first, gates = h["first"], h["gates"]
        out = None
        for rank, sig in checked:
            terms = [F.lit(rank) < first]
            if sig.alternatives:
                terms.append(F.array_contains(gates, rank))
            elif sig.min_length:
                terms.append(B.size_of(content) >= sig.min_length)
            test = F.when(_all(terms), F.coalesce(CHECKS[sig.check](content), F.lit(False))).otherwise(False)
            out = F.when(test, rank) if out is None else out.when(test, rank)
        return first if out is None else out.otherwise(first)

    hits = F.struct(
        F.coalesce(F.array_min(_hits(content, plain)), F.lit(none)).alias("first"), _hits(content, checked).alias("gates")
    )
    names = B.literal_table([s.format for s in signatures], "array<string>")
    return F.get(names, B.let(hits, decide))


def match_signatures(objects: DataFrame, signatures: Sequence[R.Signature] = R.SIGNATURES, content: str = "content") -> DataFrame:
    return objects.withColumn("format", signature_format(F.col(content), signatures))


def refine_format(objects: DataFrame, content: str = "content") -> DataFrame:
    """Variants that need one more look: animated PNG, old and unknown BMP headers, IVF by codec, ALP by header size."""
    c, f = F.col(content), F.col("format")
    latin = F.decode(c, "ISO-8859-1")
    first = lambda tag: F.instr(latin, tag)
    animated = (first("acTL") > 0) & ((first("IDAT") == 0) | (first("acTL") < first("IDAT")))
    dib = B.uint(c, 14, 4, "le")
    fourcc = F.try_element_at(B.literal_table(R.IVF_CODECS, "map<string,string>"), F.decode(F.substring(c, 9, 4), "ISO-8859-1"))
    ivf_ok = (B.uint(c, 4, 2, "le") == 0) & (B.uint(c, 6, 2, "le") >= 32)
    alp = F.when(B.bytes_at(c, 8, b"ADPCM\0") & (B.uint(c, 4, 4, "le") >= 8), F.when(B.uint(c, 4, 4, "le") >= 12, "alp").when(B.uint(c, 15, 1) == 2, "alp_22050").otherwise("alp_11025"))
    return objects.withColumn(
        "format",
        F.when(f == "png_pipe", F.when(animated, "apng").otherwise(f))
        .when(f == "bmp_pipe", F.when(dib == 12, "bmp_core").when(dib.isin(*R.BMP_DIB_SIZES), f).otherwise("bmp_unknown"))
        .when(f == "ivf", F.coalesce(F.when(ivf_ok, F.concat(F.lit("ivf_"), fourcc)), F.lit("ivf_unknown")))
        .when(f == "alp", F.coalesce(alp, F.lit("alp_unknown"))).otherwise(f))


def extension_format(ext: Column, content: Column) -> Column:
    """Formats with a header but no signature of their own, known by extension and a plausibility test."""
    packets = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(content, i * 24 + 1, 1))
    cdg = (B.size_of(content) > 0) & (B.size_of(content) % 24 == 0) & F.forall(
        packets, lambda p: (F.octet_length(p) == 0) | (F.conv(F.hex(p), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)) == 9))
    return (
        F.when((ext == "pix") & (B.uint(content, 4, 4) == 0), "alias_pix").when((ext == "cam") & B.bytes_at(content, 12, b"ML20"), "mimic")
        .when((ext == "cdg") & cdg, "cdg"))


def ac3_info(content: Column) -> Column:
    """Struct of a raw AC-3 or E-AC-3 stream from its first header, NULL when it has none."""
    t = B.literal_table({"kbps": R.AC3_KBPS, "channels": R.AC3_CHANNELS, "rates": R.AC3_SAMPLE_RATES, "half": R.EAC3_HALF_RATES, "blocks": R.EAC3_BLOCKS}, "map<string,array<int>>")
    at = lambda name, i: F.get(F.try_element_at(t, F.lit(name)), i.cast("int"))

    def parse(p: Column) -> Column:
        b = lambda i: F.conv(F.hex(F.substring(p, i + 1, 1)), 16, 10).cast("int")
        bit = lambda v, shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask))
        mode = bit(b(6), 5, 7)
        # mix levels of 2 bits each come before the low-frequency flag
        mixes = F.when((mode.bitwiseAND(F.lit(1)) != 0) & (mode != 1), 2).otherwise(0) + F.when(mode.bitwiseAND(F.lit(4)) != 0, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
        word = b(6) * 256 + F.coalesce(b(7), F.lit(0))
        lfe = F.call_function("shiftright", word, F.lit(12) - mixes).bitwiseAND(F.lit(1))
        plain = F.struct(
            F.lit("ac3").alias("codec"), at("rates", bit(b(4), 6, 3)).alias("sample_rate"), (at("channels", mode) + lfe).alias("channels"),
            (at("kbps", F.shiftright(bit(b(4), 0, 63), 1)) * 1000).cast("long").alias("bitrate"))
        size = (bit(b(2), 0, 7) * 256 + b(3) + 1) * 2
        code, sub = bit(b(4), 6, 3), bit(b(4), 4, 3)
        rate = F.when(code == 3, at("half", sub)).otherwise(at("rates", code))
        blocks = F.when(code == 3, 6).otherwise(at("blocks", sub))
        enhanced = F.struct(
            F.lit("eac3").alias("codec"), rate.alias("sample_rate"), (at("channels", bit(b(4), 1, 7)) + bit(b(4), 0, 1)).alias("channels"),
            rational.int_div(size.cast("long") * 8 * rate, blocks * 256).alias("bitrate"))
        first = (bit(b(5), 3, 31) <= 10) & plain["sample_rate"].isNotNull() & plain["bitrate"].isNotNull()
        second = (bit(b(2), 6, 3) <= 2) & (size >= 6) & bit(b(5), 3, 31).between(11, 16) & rate.isNotNull()
        return F.when((F.octet_length(p) >= 7) & first, plain).when((F.octet_length(p) >= 8) & second, enhanced)

    return F.when(B.bytes_at(content, 0, b"\x0b\x77"), B.let(F.substring(content, 1, 8), parse))


def match_all_terms(objects: DataFrame, terms: dict[str, list[Column]], any_of: dict[str, list[Column]] | None = None) -> DataFrame:
    """One row per (object, rule) whose terms all hold (or, for `any_of` rules, at least one), with the count of terms met.

    The rules are compiled into the projection, so nothing is joined and a rule with many matches costs no shuffle.
    """
    hits = []
    for rule, tests in {**terms, **(any_of or {})}.items():
        n = reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests])
        need = 1 if any_of and rule in any_of else len(tests)
        hits.append(F.when(n >= need, F.struct(F.lit(rule).alias("rule"), n.alias("n_hit"))))
    return (
        objects.withColumn("__m", F.explode(F.array(*hits))).where("__m is not null")
        .select("*", "__m.rule", "__m.n_hit")
        .drop("__m")
    )


# ---- text -------------------------------------------------------------------------------------------------------

def text_format(text: Column) -> Column:
    """Class of a subtitle-like text, NULL when none of the ordered rules holds."""
    clock = r"^[0-9]:[0-9]{2}:[0-9]{2}[.:][0-9]"

    def rule(name, lead, other, raw, body, lines):
        head = lambda k: F.slice(lines, 1, k)
        if name == "vplayer":
            return F.exists(head(3), lambda l: l.rlike(clock) & ~F.contains(l, F.lit("-->")))
        if name == "lrc":
            return body.rlike(r"(?i)^\[(ti|ar):") | F.exists(
                head(8), lambda l: F.ltrim(l).rlike(r"^\[..:..[.:].") & (F.octet_length(F.ltrim(l)) >= 8))
        if name == "srt":
            return F.exists(head(16), lambda l: F.contains(l, F.lit("-->")) & F.contains(l, F.lit(":")) & l.rlike("[,.]"))
        if lead == "raw":
            return raw.rlike(other)
        if lead == "first_line":
            return F.get(lines, F.lit(0)).rlike(other)
        return _all([body.rlike(p) for p in (lead, other) if p])

    def classify(t):
        out = None
        for name, lead, other in R.TEXT_FORMATS:
            test = rule(name, lead, other, t["raw"], t["body"], t["lines"])
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    def with_lines(t):
        lines = F.transform(F.slice(F.split(t["body"], "\n", 17), 1, 16), lambda l: F.regexp_replace(l, r"\r$", ""))
        return F.struct(t["raw"].alias("raw"), t["body"].alias("body"), lines.alias("lines"))

    def with_body(raw):
        return F.struct(raw.alias("raw"), F.regexp_replace(raw, r"^[\t\n\x0c\r ]+", "").alias("body"))

    return B.let(B.let(B.let(F.regexp_replace(text, "^\ufeff", ""), with_body), with_lines), classify)


def classify_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("text_format", text_format(F.col(column)))


def text_report(objects: DataFrame, content: str = "content") -> DataFrame:
    """Terminal-capture reports: fixed lead-ins, and a duration from the size alone."""
    c = F.col(content)
    tests = [signature_test(c, s) for s in R.SIGNATURES if s.format == "tty"]
    frames = rational.ceil_div(B.size_of(c), F.lit(240))
    return objects.where(_any(tests)).select("*", F.lit("tty").alias("format"), (frames / F.lit(25.0)).alias("duration_seconds"))


def payload_start(content: Column) -> Column:
    """Offset after a leading tag: synchsafe-sized ID3v2, or a UTF-8 byte-order mark; NULL for a broken tag."""
    size_bytes = [B.uint(content, 6 + i, 1) for i in range(4)]
    valid = _all([b < 128 for b in size_bytes])
    size = sum((F.shiftleft(b, s) for b, s in zip(size_bytes[1:], (14, 7, 0))), F.shiftleft(size_bytes[0], 21))
    return (
        F.when(B.bytes_at(content, 0, b"ID3"), F.when(valid, size + 10))
        .when(B.bytes_at(content, 0, b"\xef\xbb\xbf"), F.lit(3).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )


# ---- headers ----------------------------------------------------------------------------------------------------

def _field_specs(headers: Sequence[R.Header]) -> Column:
    """Constant map of field layouts, looked up by format, so plan size does not grow with the rule table."""
    ddl = "map<string,array<struct<name:string,offset:int,width:int,little:boolean,signed:boolean,absolute:boolean,shift:int,mask:bigint,add:bigint,from_end:boolean>>>"

    def spec(n: str, f: R.Field) -> dict:
        mask = f.mask if f.mask is not None else (1 << 63) - 1
        return {"name": n, "offset": f.offset, "width": f.width, "little": f.endian == "le", "signed": f.signed, "absolute": f.absolute,
                "shift": f.shift, "mask": mask, "add": f.add, "from_end": f.from_end}

    return B.literal_table({h.format: [spec(n, f) for n, f in h.fields.items()] for h in headers}, ddl)


def extract_fields(objects: DataFrame, headers: Sequence[R.Header] = R.HEADERS, content: str = "content") -> DataFrame:
    """Add `fields`: the header integers of the object's format by name; NULL entries lie past the end of the object.

    Only the leading bytes that the rules can reach are decoded, so whole contents are not copied per field.
    """
    reach = max(f.offset + f.width for h in headers for f in h.fields.values())
    objects = objects.withColumn("__head", F.substring(F.col(content), 1, reach)).withColumn("__size", B.size_of(content))

    def decode(s: Column) -> Column:
        raw = B.uint_var(F.col("__head"), s["offset"], s["width"], s["little"])

        def finish(r: Column) -> Column:
            full = F.call_function("shiftleft", F.lit(1).cast("long"), s["width"] * 8)
            v = F.when(s["signed"] & (r >= rational.int_div(full, F.lit(2))), r - full).otherwise(r)
            v = F.when(s["absolute"], F.abs(v)).otherwise(v)
            v = F.call_function("shiftright", v, s["shift"])
            v = F.when(s["signed"], v).otherwise(v.bitwiseAND(s["mask"])) + s["add"]
            rest = F.col("__size") - v
            return F.when(s["from_end"], F.when(rest >= 0, rest)).otherwise(v)

        return F.struct(s["name"].alias("key"), B.let(raw, finish).alias("value"))

    specs = F.try_element_at(_field_specs(headers), F.col("format"))
    return objects.withColumn("fields", F.map_from_entries(F.transform(specs, decode))).drop("__head", "__size")


def _stream_specs(headers: Sequence[R.Header]) -> Column:
    attrs = ("sample_rate", "channels", "bits_per_sample", "width", "height")
    ddl = (
        "map<string,array<struct<kind:string,codec:string," + ",".join(f"{a}:struct<name:string,const:bigint>" for a in attrs)
        + ",num:array<string>,den:array<string>,mul:double,constant:double>>>"
    )

    def spec(s: R.Stream) -> dict:
        out = {"kind": s.kind, "codec": s.codec, "num": list(s.num) if s.num else None, "den": list(s.den), "mul": float(s.mul), "constant": s.constant}
        for a in attrs:
            v = s.attrs.get(a)
            out[a] = {"name": v if isinstance(v, str) else None, "const": v if isinstance(v, int) else None}
        return out

    return B.literal_table({h.format: [spec(s) for s in h.streams] for h in headers}, ddl)


def header_streams(objects: DataFrame, headers: Sequence[R.Header] = R.HEADERS, fields: str = "fields") -> DataFrame:
    """Add `streams` and `error_kind` for objects whose format has a fixed-offset header (run `extract_fields` first)."""
    f = F.col(fields)

    def attr(a: Column) -> Column:
        return F.when(a["name"].isNotNull(), F.try_element_at(f, a["name"])).otherwise(a["const"])

    def seconds(s: Column) -> Column:
        one = F.lit(1.0)
        top = F.aggregate(s["num"], one, lambda acc, n: acc * F.try_element_at(f, n).cast("double"))
        return F.when(
            s["num"].isNotNull(),
            F.aggregate(s["den"], top * s["mul"], lambda acc, d: F.try_divide(acc, F.try_element_at(f, d).cast("double"))),
        ).otherwise(s["constant"])

    def stream(s: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("index"), s["kind"].alias("codec_type"), s["codec"].alias("codec_name"),
            attr(s["sample_rate"]).alias("sample_rate"), attr(s["channels"]).cast("int").alias("channels"),
            attr(s["bits_per_sample"]).cast("int").alias("bits_per_sample"), seconds(s).alias("duration_seconds"),
            attr(s["width"]).alias("width"), attr(s["height"]).alias("height"), F.lit(None).cast("string").alias("frame_rate"),
        )

    key = F.col("format")
    needed = F.try_element_at(B.literal_table({h.format: list(h.nonzero) for h in headers}, "map<string,array<string>>"), key)
    eof = F.exists(F.map_values(f), lambda v: v.isNull())
    # channel counts and bit depths are 16-bit in the metadata; anything wider is a broken header
    wide = F.exists(F.array(*[F.try_element_at(f, F.lit(n)) for n in ("channels", "bits")]), lambda v: v > 65535)
    bad = F.exists(needed, lambda n: F.try_element_at(f, n) == 0) | F.coalesce(wide, F.lit(False))
    kind = F.when(f.isNull(), F.lit(None)).when(eof, "unexpected_eof").when(bad, "invalid_data")
    streams = F.transform(F.try_element_at(_stream_specs(headers), key), stream)
    return objects.withColumn("error_kind", kind).withColumn("streams", F.when(F.col("error_kind").isNull(), streams))


def validate_headers(df: DataFrame) -> DataFrame:
    """Sanity of PCM-like headers (channels, sample_rate, bits, block_align, width, height): the first failed check."""
    audio = F.col("codec_type") == "audio"
    video = F.col("codec_type") == "video"
    reason = (
        F.when(audio & (F.coalesce("channels", F.lit(0)) == 0), "unsupported: zero channels")
        .when(audio & (F.coalesce("sample_rate", F.lit(0)) == 0), "invalid_data: zero sample rate")
        .when(audio & ~F.coalesce("bits", F.lit(-1)).isin(8, 16, 24, 32), "unsupported: bits per sample")
        .when(audio & ~F.col("block_align").eqNullSafe(F.col("channels") * rational.int_div(F.col("bits"), F.lit(8))), "invalid_data: block align")
        .when(video & ((F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)), "invalid_data: zero dimension")
    )
    return df.withColumn("reason", reason)


def split_rejects(df: DataFrame, error: str = "error_kind", message: str = "message") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the `rejects` table of the others."""
    good = df.where(F.col(error).isNull())
    bad = df.where(F.col(error).isNotNull())
    return good, bad.select("path", F.col(error).alias("error_kind"), (F.col(message) if message in df.columns else F.col(error)).alias("message"))


# ---- lookups ----------------------------------------------------------------------------------------------------

def tag_dimension(spark, codecs: dict, bits: dict | None = None) -> DataFrame:
    rows = [(k, v, int((bits or {}).get(v, 0))) for k, v in codecs.items()]
    key = "long" if isinstance(next(iter(codecs)), int) else "string"
    return literal.small_table(spark, rows, f"tag {key}, codec_name string, codec_bits int")


def map_codec(df: DataFrame, tag_dim: DataFrame, tag: str = "tag", default: str = "unknown") -> DataFrame:
    """Codec name and bits by tag; a dimension of constants (`tag_dimension`) is broadcast."""
    dim = tag_dim.select(F.col("tag").alias("__tag"), F.col("codec_name").alias("__codec"), F.col("codec_bits").alias("__bits"))
    return (
        df.join(dim, F.col(tag) == F.col("__tag"), "left")
        .withColumn("codec_name", F.coalesce("__codec", F.lit(default)))
        .withColumn("codec_bits", F.coalesce("__bits", F.lit(0)))
        .drop("__tag", "__codec", "__bits")
    )


def observed_document(suffix: Column, content: Column, observations: Sequence[tuple] = OBSERVATIONS) -> Column:
    """Document of the first exact observation for a suffix ('*' for those without one), NULL when none matches.

    The observations are one literal keyed by suffix, so nothing is joined and contents stay where they are.
    """
    ddl = f"map<string,array<struct<length:bigint,terms:array<{_TERM}>,doc:{PROBE_DOC.simpleString()}>>>"
    names = ("codec_type", "codec_name", "sample_rate", "channels", "bits_per_sample", "width", "height", "duration_seconds")
    table: dict[str, list] = {}
    for ext, length, terms, fmt, streams in observations:
        docs = [{"index": i, **dict(zip(names, s))} for i, s in enumerate(streams)]
        table.setdefault("*" if ext is None else ext, []).append(
            {"length": length, "terms": [{"at": o + 1, "n": len(b), "hex": b.hex().upper()} for o, b in terms], "doc": {"format": fmt, "streams": docs}})
    at = lambda t: F.hex(F.substring(content, t["at"], t["n"]))
    hit = F.filter(
        F.try_element_at(B.literal_table(table, ddl), suffix),
        lambda r: (r["length"].isNull() | (r["length"] == B.size_of(content))) & F.forall(r["terms"], lambda t: at(t) == t["hex"]))
    return F.get(hit, F.lit(0))["doc"]


def apply_overrides(objects: DataFrame, observations: Sequence[tuple] = OBSERVATIONS, content: str = "content") -> DataFrame:
    """Add `override_doc` where an exact observation for the object's suffix matches."""
    return objects.withColumn("override_doc", observed_document(F.col("ext"), F.col(content), observations))


def is_denied(content: Column, deny_list: Sequence[tuple] = R.DENY_LIST) -> Column:
    """Looked up by length in one literal table, so that a long list costs a row no more than a short one."""
    table: dict[int, list] = {}
    for n, terms in deny_list:
        table.setdefault(n, []).append([{"at": o + 1, "n": len(b), "hex": b.hex().upper()} for o, b in terms])
    if not table:
        return F.lit(False)
    entries = F.try_element_at(B.literal_table(table, "map<string, array<array<struct<at: int, n: int, hex: string>>>>"), B.size_of(content).cast("string"))
    return F.coalesce(F.exists(entries, lambda terms: F.forall(terms, lambda t: F.hex(F.substring(content, t["at"], t["n"])) == t["hex"])), F.lit(False))


def deny(objects: DataFrame, deny_list: Sequence[tuple] = R.DENY_LIST, content: str = "content") -> DataFrame:
    """Drop exact observations that are refused."""
    return objects.where(~is_denied(F.col(content), deny_list))


def extension_streams(ext: Column, length: Column) -> Column:
    """Document of a format known by its extension only, NULL otherwise."""
    out = None
    for e, fmt, kind, codec, rate, ch, bits, w, h, bps, secs in R.EXTENSION_FORMATS:
        seconds = (length * 8).cast("double") / F.lit(bps) if bps else F.lit(secs).cast("double")
        stream = F.struct(
            F.lit(0).alias("index"), F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"),
            F.lit(rate).cast("long").alias("sample_rate"), F.lit(ch).cast("int").alias("channels"),
            F.lit(bits).cast("int").alias("bits_per_sample"), seconds.alias("duration_seconds"),
            F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"), F.lit(None).cast("string").alias("frame_rate"),
        )
        doc = F.struct(F.lit(fmt).alias("format"), F.array(stream).alias("streams"))
        test = ext == e
        out = F.when(test, doc) if out is None else out.when(test, doc)
    return out


def resolve_probe(df: DataFrame, preferred: str, content: str, raw: str, content_error: str) -> DataFrame:
    """Preferred-extension document, else the content's, else the raw-extension one; a failure reports the content error."""
    doc = F.coalesce(preferred, content, raw)
    stage = F.when(F.col(preferred).isNotNull(), "preferred").when(F.col(content).isNotNull(), "content").when(F.col(raw).isNotNull(), "extension")
    return df.select("*", doc.alias("doc"), stage.alias("stage"), F.when(doc.isNull(), F.col(content_error)).alias("error"))


# ---- durations --------------------------------------------------------------------------------------------------

def duration(df: DataFrame, rule: str = "rule") -> DataFrame:
    """Seconds by rule family from num, den and rate; zero denominators give 0.0 for byte rates and NULL otherwise."""
    num, den, rate = F.col("num").cast("double"), F.col("den").cast("double"), F.col("rate").cast("double")
    r = F.col(rule)
    seconds = (
        F.when(r == "samples", F.try_divide(num, rate))
        .when(r == "bits", F.try_divide(num * 8, rate))
        .when(r == "bytes", F.coalesce(F.try_divide(num, rate), F.lit(0.0)))
        .when(r == "frames", F.try_divide(num * den, rate))
        .when(r == "centiseconds", num / 100.0)
        .when(r == "zero", F.lit(0.0))
        .when(r == "still", F.lit(0.04))
    )
    return df.withColumn("duration_seconds", seconds)


# ---- streams ----------------------------------------------------------------------------------------------------

def explode_streams(docs: DataFrame, streams: str = "streams") -> DataFrame:
    """One row per stream; the index is its position in the document."""
    keep = [c for c in docs.columns if c != streams]
    # the outer form keeps the optimizer from computing the streams a second time for an emptiness filter
    out = docs.select(*keep, F.posexplode_outer(streams).alias("__pos", "__s")).where("__pos is not null")
    return out.select(*keep, F.col("__s").withField("index", F.col("__pos")).alias("__s")).select(*keep, "__s.*")


def first_stream(streams: DataFrame, codec_type: str, keys: Sequence[str] = ("path",)) -> DataFrame:
    """First stream of a type per object, by aggregation: partial minima travel, not the streams."""
    rest = [c for c in streams.columns if c not in keys]
    return (
        streams.where(F.col("codec_type") == codec_type)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "index").alias("__s"))
        .select(*keys, "__s.*")
    )
