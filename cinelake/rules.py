"""Identification rules as data. Magic numbers, offsets, codec tags and tolerances that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Signature:
    """One ordered content test: any alternative holds when all of its (offset, bytes) terms hold."""

    format: str
    alternatives: tuple[tuple[tuple[int, bytes], ...], ...] = ()
    min_length: int = 0
    check: str | None = None  # extra named predicate, see operators.identify.CHECKS


def _sig(fmt, *alts, n=0, check=None):
    packed = tuple(((0, a),) if isinstance(a, bytes) else tuple(a) for a in alts)
    return Signature(fmt, packed, n, check)


RIFF, FORM = (0, b"RIFF"), (0, b"FORM")

# Content signatures in the order in which they are tried.
SIGNATURES: tuple[Signature, ...] = (
    _sig("wav", [RIFF, (8, b"WAVE")], n=12),
    _sig("qcp", [RIFF, (8, b"QLCM")], n=12),
    _sig("w64", [(0, b"riff\x2e\x91\xcf\x11\xa5\xd6\x28\xdb\x04\xc1\x00\x00"), (24, b"wave\xf3\xac\xd3\x11\x8c\xd1\x00\xc0\x4f\x8e\xdb\x8a")], n=40),
    _sig("xwma", [RIFF, (8, b"XWMA")], n=12),
    _sig("avi", [RIFF, (8, b"AVI ")], n=12),
    _sig("4xm", [RIFF, (8, b"4XMV")], n=12),
    _sig("amv", [RIFF, (8, b"AMV ")], n=88),
    _sig("wsvqa", [FORM, (8, b"WVQA")], n=12),
    _sig("dsdiff", [(0, b"FRM8"), (12, b"DSD ")], n=16),
    _sig("iff", [FORM, (8, b"ILBM")], [FORM, (8, b"PBM ")], [FORM, (8, b"8SVX")], [FORM, (8, b"ANIM")], n=12),
    _sig("mxf", b"\x06\x0e\x2b\x34", [(0, b"\0" * 8), (8, b"\x06\x0e\x2b\x34")]),
    _sig("asf", b"\x30\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c"),
    _sig("argo_asf", b"ASF\0", n=32),
    _sig("rm", b".RMF", b".ra\xfd"),
    _sig("flv", b"FLV\x01", n=9),
    _sig("ea", b"MVhd", b"AVP6", b"MADk", b"MVIh", b"SCHl", b"XAJ\0", b"MPCh", b"SEAD", b"kVGT", b"1SNh"),
    _sig("siff", [(0, b"SIFF"), (8, b"VBV1"), (12, b"VBHD")], n=56),
    _sig("dxa", b"DEXA", n=15),
    _sig("film_cpk", [(0, b"FILM"), (16, b"FDSC")], n=48),
    _sig("ipmovie", b"Interplay MVE File\x1a", n=20),
    _sig("observed", check="observed"),
    _sig("gdv", b"\x94\x19\x11\x29", n=24),
    _sig("roq", b"\x84\x10\xff\xff\xff\xff", n=8),
    _sig("jv", b"JV00 Compression", n=94),
    _sig("dirac", b"BBCD", n=16),
    _sig("cine", b"CI,", n=56),
    _sig("mlv", b"MLVI", n=16),
    _sig("anm", [(0, b"LPF "), (16, b"ANIM")], n=24),
    _sig("kvag", [(0, b"KVAG"), (12, b"\0")], [(0, b"KVAG"), (12, b"\x01")], n=16, check="kvag_rate"),
    _sig("rpl", b"ARMovie\n"),
    _sig("mv", b"MOVI", n=32, check="sgi_mv_tracks"),
    _sig("apv", [(4, b"aPv1")], n=27),
    _sig("caf", b"caff"),
    _sig("ac3", b"\x0b\x77", n=8, check="ac3_header"),
    _sig("mp3", b"ID3"),
    _sig("mp3", check="mpeg_audio_pair"),
    _sig("flac", b"fLaC"),
    _sig("ape", b"MAC "),
    _sig("musepack", b"MP+", b"MPCK"),
    _sig("apc", b"CRYO_APC", n=20),
    _sig("dss", b"\x02dss", n=32),
    _sig("iamf", [(2, b"iamf")], n=6),
    _sig("ast", b"STRM", n=24),
    _sig("tta", b"TTA1"),
    _sig("osq", b"OSQ "),
    _sig("alp", b"ALP "),
    _sig("apm", [(20, b"vs12"), (14, b"\x04")], n=32),
    _sig("tak", b"tBaK"),
    _sig("mlp", [(4, b"\xf8\x72\x6f\xbb")]),
    _sig("truehd", check="truehd_sync"),
    _sig("amr", b"#!AMR\n"),
    _sig("voc", b"Creative Voice File\x1a"),
    _sig("wv", b"wvpk"),
    _sig("dtshd", b"DTSHDHDR"),
    _sig("dts", b"\x7f\xfe\x80\x01"),
    _sig("dnxhd", [(4, b"\x03\x01\x80\xa0")], n=28),
    _sig("bink", b"BIK", n=44, check="bink_letter"),
    _sig("bfi", b"BF&I", n=52),
    _sig("smk", b"SMK2", b"SMK4", n=20),
    _sig("idcin", n=20, check="idcin_header"),
    _sig("sol", b"\x0d\x0cSOL\0", n=16),
    _sig("smjpeg", [(2, b"SMJPEG")], n=8),
    _sig("bethsoftvid", b"VID\0"),
    _sig("rsd", [(0, b"RSD3"), (4, b"RADP")], [(0, b"RSD3"), (4, b"GADP")], [(0, b"RSD4"), (4, b"RADP")], [(0, b"RSD4"), (4, b"GADP")], n=12),
    _sig("bfstm", [(0, b"CSTM"), (4, b"\xff\xfe")], [(0, b"CSTM"), (4, b"\xfe\xff")], [(0, b"FSTM"), (4, b"\xff\xfe")],
         [(0, b"FSTM"), (4, b"\xfe\xff")], [(0, b"RSTM"), (4, b"\xff\xfe")], [(0, b"RSTM"), (4, b"\xfe\xff")], n=112),
    _sig("mpegts", n=564, check="ts_sync"),
    _sig("webp_pipe", [RIFF, (8, b"WEBP")], n=12),
    _sig("dds_pipe", b"DDS "),
    _sig("dfa", b"DFIA\0\0", n=14),
    _sig("exr_pipe", b"\x76\x2f\x31\x01"),
    _sig("dpx_pipe", b"SDPX", b"XPDS"),
    _sig("png_pipe", b"\x89PNG\r\n\x1a\n"),
    _sig("jpegxl_pipe", b"\xff\x0a", b"\0\0\0\x0cJXL \r\n\x87\n"),
    _sig("gif", b"GIF87a", b"GIF89a"),
    _sig("flic", [(4, b"\x11\xaf")], [(4, b"\x12\xaf")], n=6),
    _sig("qoa", b"qoaf"),
    _sig("bmp_pipe", b"BM"),
    _sig("brender_pix", b"\0\0\0\x12\0\0\0\x08\0\0\0\x02\0\0\0\x02", n=32),
    _sig("fits", b"SIMPLE "),
    _sig("nistsphere", b"NIST_1A\n"),
    _sig("sgi_pipe", b"\x01\xda"),
    _sig("sunrast_pipe", b"\x59\xa6\x6a\x95"),
    _sig("psd_pipe", b"8BPS"),
    _sig("jpeg_pipe", b"\xff\xd8"),
    _sig("j2k_pipe", b"\xff\x4f"),
    _sig("tiff_pipe", b"II\x2a\0", b"MM\0\x2a"),
    _sig("tga_pipe", n=26, check="tga_footer"),
    _sig("matroska", b"\x1a\x45\xdf\xa3"),
    _sig("ivf", b"DKIF"),
    _sig("mpegvideo", n=4, check="mpeg_sequence"),
    _sig("pnm", b"P4", b"P5", b"P6"),
    _sig("xbm", check="xbm_text"),
    _sig("pictor", b"\x34\x12", n=6, check="pictor_size"),
    _sig("ptx", b"\x2c\0\0\0", n=44, check="ptx_size"),
    _sig("ogg", b"OggS"),
    _sig("subtitle", check="subtitle_text"),
    _sig("tty", b"DecoderCheck Package", b"\r\nIRT MXF Analyzer (Cola).", b"\x1b[", check=None),
    _sig("tty", b"Stream ID: ", check="tty_packet_pts"),
    _sig("mp4", [(4, b"ftyp")], [(4, b"moov")], [(4, b"wide")], [(4, b"mdat")], [(4, b"free")], [(4, b"skip")], n=8),
)


@dataclass(frozen=True)
class Field:
    """Integer at a fixed offset: ((raw >> shift) & mask) + add; with `from_end` the bytes left after raw + add."""

    offset: int
    width: int
    endian: str = "le"
    signed: bool = False
    shift: int = 0
    mask: int | None = None
    add: int = 0
    absolute: bool = False
    from_end: bool = False


@dataclass(frozen=True)
class Stream:
    """One elementary stream: attributes name a field or give a constant; duration is mul * product(num) / product(den)."""

    kind: str
    codec: str
    attrs: dict = field(default_factory=dict)
    num: tuple[str, ...] | None = None
    den: tuple[str, ...] = ()
    mul: float = 1.0
    constant: float | None = None


@dataclass(frozen=True)
class Header:
    format: str
    fields: dict
    streams: tuple[Stream, ...]
    nonzero: tuple[str, ...] = ()


def _au(codec, num=None, den=(), mul=1.0, constant=None, **attrs):
    return Stream("audio", codec, attrs, num, den, mul, constant)


def _vi(codec, num=None, den=(), mul=1.0, constant=None, **attrs):
    return Stream("video", codec, {"width": "width", "height": "height", **attrs}, num, den, mul, constant)


def _wh(x, y, width=2, endian="le", **more):
    return {"width": Field(x, width, endian), "height": Field(y, width, endian), **more}


_AUDIO = {"sample_rate": "sample_rate", "channels": "channels"}
_RATED = ("sample_rate", "channels")

# Header field offsets and duration rules per format.
HEADERS: tuple[Header, ...] = (
    Header("flac", {"sample_rate": Field(18, 3, "be", shift=4), "channels": Field(20, 1, shift=1, mask=7, add=1),
                    "bits": Field(20, 2, "be", shift=4, mask=31, add=1), "total": Field(21, 5, "be", mask=(1 << 36) - 1)},
           (_au("flac", ("total",), ("sample_rate",), bits_per_sample="bits", **_AUDIO),), ("sample_rate",)),
    Header("qoa", {"total": Field(4, 4, "be"), "channels": Field(8, 1), "sample_rate": Field(9, 3, "be")},
           (_au("qoa", ("total",), ("sample_rate",), bits_per_sample=0, **_AUDIO),), ("total", *_RATED)),
    Header("tta", {"channels": Field(6, 2), "bits": Field(8, 2), "sample_rate": Field(10, 4), "total": Field(14, 4)},
           (_au("tta", ("total",), ("sample_rate",), bits_per_sample="bits", **_AUDIO),), _RATED),
    Header("osq", {"bits": Field(10, 1), "channels": Field(11, 1), "sample_rate": Field(12, 4), "total": Field(24, 8)},
           (_au("osq", ("total",), ("sample_rate",), bits_per_sample="bits", **_AUDIO),), _RATED),
    Header("ast", {"channels": Field(12, 2, "be"), "sample_rate": Field(16, 4, "be"), "total": Field(20, 4, "be")},
           (_au("adpcm_afc", ("total",), ("sample_rate",), bits_per_sample=0, **_AUDIO),), _RATED),
    Header("apm", {"channels": Field(2, 2), "sample_rate": Field(4, 4), "count": Field(28, 4)},
           (_au("adpcm_ima_apm", ("count",), ("channels", "sample_rate"), 2.0, bits_per_sample=4, **_AUDIO),), _RATED),
    Header("kvag", {"size": Field(4, 4), "sample_rate": Field(8, 4), "channels": Field(12, 1, add=1)},
           (_au("adpcm_ima_ssi", ("size",), ("channels", "sample_rate"), 2.0, bits_per_sample=4, **_AUDIO),), ("size", *_RATED)),
    Header("sol", {"sample_rate": Field(6, 2), "channels": Field(14, 1)},
           (_au("sol_dpcm", constant=0.0, bits_per_sample=0, **_AUDIO),), _RATED),
    Header("png_pipe", _wh(16, 20, 4, "be"), (_vi("png", constant=0.0),), ("width", "height")),
    Header("bmp_pipe", {"width": Field(18, 4, signed=True, absolute=True), "height": Field(22, 4, signed=True, absolute=True)},
           (_vi("bmp", constant=0.0),), ("width", "height")),
    Header("dds_pipe", _wh(16, 12, 4), (_vi("dds", constant=0.0),), ("width", "height")),
    Header("gif", _wh(6, 8), (_vi("gif", constant=0.0),), ("width", "height")),
    Header("sgi_pipe", _wh(6, 8, 2, "be"), (_vi("sgi", constant=0.0),), ("width", "height")),
    Header("sunrast_pipe", _wh(4, 8, 4, "be"), (_vi("sunrast", constant=0.0),), ("width", "height")),
    Header("psd_pipe", _wh(18, 14, 4, "be"), (_vi("psd", constant=0.0),), ("width", "height")),
    Header("dpx_pipe", _wh(772, 776, 4, "be"), (_vi("dpx", constant=0.0),), ("width", "height")),
    Header("ptx", _wh(8, 10), (_vi("ptx", constant=0.04),), ("width", "height")),
    Header("dnxhd", _wh(26, 24, 2, "be"), (_vi("dnxhd"),), ("width", "height")),
    Header("apv", _wh(20, 23, 2, "be"), (_vi("apv", constant=0.0),), ("width", "height")),
    Header("cine", _wh(48, 52, 4), (_vi("rawvideo", constant=1.0 / 31.0),), ("width", "height")),
    Header("anm", _wh(20, 22), (_vi("anm", constant=0.0),), ("width", "height")),
    Header("flic", _wh(8, 10), (_vi("flic", constant=0.0),), ("width", "height")),
    Header("dfa", _wh(8, 10, frames=Field(6, 2), ms=Field(12, 2)), (_vi("dfa", ("frames", "ms"), (), 0.001),), ("width", "height")),
    Header("smk", _wh(4, 8, 4, frames=Field(12, 4), ms=Field(16, 4)), (_vi("smackvideo", ("frames", "ms"), (), 0.001),), ("width", "height")),
    Header("bink", _wh(20, 24, 4, frames=Field(8, 4), rate_num=Field(28, 4), rate_den=Field(32, 4)),
           (_vi("binkvideo", ("frames", "rate_den"), ("rate_num",)),), ("width", "height", "rate_num", "rate_den")),
    Header("bfi", _wh(44, 48, 4, frames=Field(12, 4), fps=Field(28, 4)),
           (_vi("bfi", ("frames",), ("fps",)), _au("pcm_u8", constant=0.0, sample_rate=11025, channels=1, bits_per_sample=8)), ("width", "height")),
    Header("siff", _wh(22, 24, frames=Field(30, 2), bits=Field(32, 2), sample_rate=Field(34, 2)),
           (_vi("vb", ("frames",), (), 1 / 12.0), _au("pcm_u8", constant=0.0, sample_rate="sample_rate", channels=1, bits_per_sample="bits")),
           ("width", "height")),
    Header("jv", _wh(80, 82, frames=Field(84, 2), sample_rate=Field(92, 2)),
           (_au("pcm_u8", constant=0.0, sample_rate="sample_rate", channels=1, bits_per_sample=8), _vi("jv", ("frames",), (), 1 / 12.5)),
           ("width", "height")),
    Header("gdv", _wh(20, 22, frames=Field(6, 2), fps=Field(8, 2)), (_vi("gdv", ("frames",), ("fps",)),), ("width", "height", "fps")),
    Header("idcin", _wh(0, 4, 4, sample_rate=Field(8, 4), channels=Field(12, 4)),
           (_vi("idcin", constant=0.0), _au("pcm_s16le", constant=0.0, bits_per_sample=16, **_AUDIO)), ("width", "height", *_RATED)),
    Header("amv", _wh(64, 68, 4), (_vi("amv", constant=0.0), _au("adpcm_ima_amv", constant=0.0, sample_rate=22050, channels=1, bits_per_sample=4)),
           ("width", "height")),
    Header("bethsoftvid", _wh(7, 9),
           (_au("pcm_u8", constant=0.0, sample_rate=11111, channels=1, bits_per_sample=8), _vi("bethsoftvid", constant=0.0)), ("width", "height")),
    *[Header(f"ivf_{c}", _wh(12, 14, den=Field(16, 4), num=Field(20, 4), frames=Field(24, 4)), (_vi(c, ("frames", "num"), ("den",)),), ("width", "height", "den"))
      for c in ("vp8", "vp9", "av1")],
    Header("alp", {"channels": Field(15, 1), "sample_rate": Field(16, 4), "data": Field(4, 4, from_end=True, add=8)},
           (_au("adpcm_ima_alp", ("data",), ("sample_rate", "channels"), 2.0, bits_per_sample=4, **_AUDIO),), _RATED),
    *[Header(f"alp_{rate}", {"channels": Field(15, 1), "data": Field(4, 4, from_end=True, add=8)},
             (_au("adpcm_ima_alp", ("data",), ("channels",), 2.0 / rate, bits_per_sample=4, sample_rate=rate, channels="channels"),), ("channels",)) for rate in (22050, 11025)],
    Header("apng", _wh(16, 20, 4, "be"), (_vi("apng", constant=0.0),), ("width", "height")),
    Header("bmp_core", _wh(18, 20), (_vi("bmp", constant=0.0),), ("width", "height")),
    Header("alias_pix", _wh(0, 2, 2, "be"), (_vi("alias_pix", constant=0.0),), ("width", "height")),
    Header("mimic", _wh(2, 4), (_vi("mimic", constant=0.0),), ("width", "height")),
    Header("cdg", {"size": Field(0, 1, from_end=True)}, (_vi("cdgraphics", constant=0.0, width=300, height=216),)),
)

# Variants of a format that are told apart by one more look at the bytes (variant -> reported name).
BMP_DIB_SIZES = (40, 52, 56, 64, 108, 124)
AC3_KBPS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)
AC3_SAMPLE_RATES = (48000, 44100, 32000)
EAC3_HALF_RATES = (24000, 22050, 16000)
EAC3_BLOCKS = (1, 2, 3, 6)

# Name reported for a format when it differs from the rule name.
REPORTED_FORMAT = {"ptx": "image2", "amv": "avi", "bmp_core": "bmp_pipe", "ivf_vp8": "ivf", "ivf_vp9": "ivf", "ivf_av1": "ivf", "alp_22050": "alp",
                   "alp_11025": "alp", "mimic": "msnwctcp"}

# Formats known by extension only (ext -> format, kind, codec, rate, channels, bits, width, height, bits per second, constant seconds).
EXTENSION_FORMATS: tuple[tuple, ...] = (
    ("g722", "g722", "audio", "adpcm_g722", 16000, 1, 4, None, None, 64000.0, None),
    ("g728", "g728", "audio", "g728", 8000, 1, 2, None, None, 16000.0, None),
    ("tco", "g723_1", "audio", "g723_1", 8000, 1, 0, None, None, None, 0.0),
    ("adp", "adp", "audio", "adpcm_dtk", 48000, 2, 0, None, None, 54857.142857142855 * 8, None),
    ("bin", "bin", "video", "bintext", None, None, None, 1280, 640, None, None),
    ("xface", "image2", "video", "xface", None, None, None, 48, 48, None, 0.04),
)

# Extensions whose exact-observation rules are tried before the content.
PREFERRED_EXTENSIONS = ("", "264", "aac", "adts", "asf", "avi", "ape", "bit", "eac3", "flv", "hif", "ism", "ivf", "jpg", "m4a", "mkv",
                        "mov", "mp3", "mp4", "mpg", "mtv", "mxg", "ogg", "opus", "thd", "trec", "ts", "vp7", "wav", "wma", "wmv", "wv")

# Extensions whose exact-observation rules are tried last, when the content is not recognised.
FALLBACK_EXTENSIONS = ("asf", "avi", "bit", "divx", "f32", "flv", "m4v", "mkv", "mov", "mp4", "mpg", "mvi", "obu", "ogg", "pcm", "pva", "rmvb", "rsd",
                       "s16", "seq", "smv", "sw", "ts", "vob", "vvc", "webm", "xesc")

# Exact observations that are refused (length, ((offset, bytes), ...)).
DENY_LIST: tuple[tuple, ...] = (
    (33894, ((4, b"ftypmp42"), (468, b"esds\0\0\0\0\x03\x2c\0\x01\0\x04\x24\x40\x15\0\x06\0\0\x02\x19\x56"))),
)

# Codec tags. The four-character tags are those of the ISO/QuickTime sample entries.
MP4_CODECS = {
    "AVdh": "dnxhd", "AVdn": "dnxhd", "AVDJ": "mjpeg", "CFHD": "cfhd", "DXD3": "dxv", "DXDI": "dxv", "8BPS": "8bps", "SVQ1": "svq1",
    "SVQ3": "svq3", "VP6A": "vp6a", "Hap1": "hap", "Hap5": "hap", "HapA": "hap", "HapM": "hap", "HapY": "hap", "MAC3": "mace3",
    "MAC6": "mace6", "QDM2": "qdm2", "agsm": "gsm", "avc1": "h264", "avc3": "h264", "ap4h": "prores", "ap4x": "prores",
    "apch": "prores", "apcn": "prores", "apco": "prores", "apcs": "prores", "cvid": "cinepak", "dtPA": "media100", "dvc ": "dvvideo",
    "dvcp": "dvvideo", "dvh5": "dvvideo", "dvh6": "dvvideo", "dvhp": "dvvideo", "dvhq": "dvvideo", "dvh1": "dvvideo",
    "dvh2": "dvvideo", "mp4a": "aac", "mp4v": "mpeg4", "hvc1": "hevc", "hev1": "hevc", "icod": "aic", "ima4": "adpcm_ima_qt",
    "in24": "pcm_s24le", "mjpb": "mjpegb", "msVo": "vorbis", "mp3 ": "mp3", "pxlt": "pixlet", "qdrw": "qdraw", "raw ": "pcm_u8",
    "rpza": "rpza", "rle ": "qtrle", "samr": "amr_nb", "sawb": "amr_wb", "smc ": "smc", "sowt": "pcm_s16le", "twos": "pcm_s16be",
    "alaw": "pcm_alaw", "ulaw": "pcm_mulaw", "v410": "rawvideo",
}
CODEC_BITS = {"adpcm_ima_qt": 4, "adpcm_ima_wav": 4, "adpcm_ms": 4, "pcm_alaw": 8, "pcm_mulaw": 8, "pcm_u8": 8,
              "pcm_s16be": 16, "pcm_s16le": 16, "pcm_s24le": 24}
WAV_TAGS = {0x0017: "adpcm_ima_oki", 0x0022: "truespeech", 0x0031: "gsm_ms", 0x0125: "adpcm_sanyo", 0x0161: "wmav2",
            0x0200: "adpcm_ct", 0x0270: "atrac3", 0x028E: "msnsiren"}
WAV_PCM_BITS = {8: "pcm_u8", 16: "pcm_s16le", 24: "pcm_s24le", 32: "pcm_s32le"}
WAV_TAG_BITS = {0x0017: 4, 0x0200: 4}
MATROSKA_CODECS = {
    "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_PRORES": "prores",
    "V_UNCOMPRESSED": "rawvideo", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_AAC": "aac", "A_FLAC": "flac",
    "A_WAVPACK4": "wavpack", "A_WAVPACK": "wavpack", "A_MPEG/L3": "mp3", "A_PCM/INT/LIT": "pcm_s16le", "A_TTA1": "tta",
}
IVF_CODECS = {"VP80": "vp8", "VP90": "vp9", "AV01": "av1"}
AVI_CODECS = {
    "012V": "012v", "AASC": "aasc", "AURA": "aura", "AUR2": "aura2", "AVRN": "avrn", "CFHD": "cfhd", "CHQX": "hqx", "CLJR": "cljr",
    "CLLC": "cllc", "CRAM": "msvideo1", "MSVC": "msvideo1", "CSCD": "cscd", "CUVC": "hq_hqa", "CVID": "cinepak",
    "DUCK": "truemotion1", "FFVH": "ffvhuff", "FICV": "fic", "FMVC": "fmvc", "FPS1": "fraps", "FRWU": "frwu", "ISCC": "rscc",
    "IV32": "indeo3", "IV41": "indeo4", "IV50": "indeo5", "KGV1": "kgv1", "KMVC": "kmvc", "LAGS": "lagarith", "LEAD": "lead",
    "LOCO": "loco", "LSCR": "lscr", "MAGY": "magicyuv", "MJPG": "mjpeg", "MPG4": "msmpeg4v1", "MSZH": "mszh", "PNG1": "png",
    "Q1.0": "qpeg", "R210": "r210", "RSCC": "rscc", "RT21": "indeo2", "SMV2": "h264", "SP54": "sp5x", "SPV1": "screenpresso",
    "TM20": "truemotion2", "TR20": "truemotion2rt", "TSCC": "tscc", "TSC2": "tscc2", "ULTI": "ulti", "ULRG": "utvideo",
    "ULRA": "utvideo", "ULH0": "utvideo", "ULH2": "utvideo", "ULH4": "utvideo", "ULY0": "utvideo", "ULY2": "utvideo",
    "V210": "v210", "VBLE": "vble", "VCR1": "vcr1", "VCR2": "mpeg2video", "VIXL": "vixl", "VMNC": "vmnc", "VP31": "vp3",
    "VP40": "vp4", "VP50": "vp5", "VP60": "vp6", "VP70": "vp7", "VQC1": "vqc", "WNV1": "wnv1", "XVID": "mpeg4", "DIVX": "mpeg4",
    "MP4V": "mpeg4", "XXAN": "xan_wc4", "XTOR": "dxtory", "ZEC0": "zerocodec", "ZECO": "zerocodec", "ZLIB": "zlib", "ZMBV": "zmbv",
}

# Transport-stream codec rules (stream_type or None, registration or None, descriptor or None) -> codec, in order.
TS_CODEC_RULES = (
    (0x02, None, None, "mpeg2video"), (0x03, None, None, "mp2"), (0x04, None, None, "mp3"), (0x06, None, 0x6A, "ac3"),
    (0x1B, None, None, "h264"), (None, "H264", None, "h264"), (0x24, None, None, "hevc"), (None, "HEVC", None, "hevc"),
    (None, "HDMV", None, "hevc"), (None, "DOVI", None, "hevc"), (0x33, None, None, "vvc"), (None, "VVC-", None, "vvc"),
    (0x11, None, None, "aac_latm"), (0x06, "Opus", None, "opus"), (0x15, None, None, "ignored_data"),
)

# MPEG audio header tables (kbit/s by bitrate index 1..14; sample rates of MPEG-1).
MPEG1_LAYER3_KBPS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG1_LAYER2_KBPS = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
MPEG2_LAYER23_KBPS = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG1_SAMPLE_RATES = (44100, 48000, 32000)

# Text-format tests in order (format, pattern on the text without leading white space, pattern that must also occur).
TEXT_FORMATS: tuple[tuple, ...] = (
    ("ass", r"(?i)^\[Script Info\]", None),
    ("webvtt", r"(?i)^WEBVTT", None),
    ("scc", r"(?i)^Scenarist_SCC", None),
    ("vobsub", r"(?i)^# VobSub index file", None),
    ("sami", r"(?i)^<SAMI", None),
    ("realtext", r"(?i)^<window", r"(?i)<time"),
    ("aqtitle", r"^-->>", None),
    ("jacosub", None, r"(?i)#TIMERES"),
    ("mpl2", r"^\[[0-9]+\]\[[0-9]+\]", None),
    ("mpsub", r"(?i)^TITLE=", r"(?i)\n(FILE|FORMAT)="),
    ("microdvd", "raw", r"^\{[0-9A-Za-z]+\}\{[0-9A-Za-z]*\}"),
    ("pjs", "first_line", r'^\s*[0-9]+\s*,\s*[0-9]+\s*,\s*"'),
    ("stl", r"^//", r"(?i)\$FontName"),
    ("subviewer1", r"(?i)^\[TITLE\]", r"(?i)\[BEGIN\]"),
    ("subviewer", r"(?i)^\[INFORMATION\]", r"(?i)\[SUBTITLE\]"),
    ("vplayer", "lines", None),
    ("lrc", "lines", None),
    ("srt", "lines", None),
)

# Sample-kind gates by exact suffix.
AUDIO_SUFFIXES = ("wav", "mp3", "mp4", "flac", "ogg")
IMAGE_SUFFIXES = ("png",)
VIDEO_SUFFIXES = ("mp4",)
