"""Probe of containers whose streams lie in their structure."""

import struct

import pytest

from cinelake.plans.probe import probe_corpus

from .test_pieces import chunk, objects


def lst(kind, *children):
    body = kind + b"".join(children)
    return b"LIST" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def strh(kind, handler, scale, rate, length):
    return chunk(b"strh", kind + handler + bytes(12) + struct.pack("<III", scale, rate, 0) + struct.pack("<I", length) + bytes(20))


def avi(*streams, movi=(), more=b""):
    body = b"AVI " + lst(b"hdrl", chunk(b"avih", bytes(56)), *[lst(b"strl", *s) for s in streams]) + lst(b"movi", *movi) + more
    return b"RIFF" + struct.pack("<I", len(body)) + body


def video(codec, length, handler=b"xvid"):
    return strh(b"vids", handler, 1, 25, length), chunk(b"strf", struct.pack("<Iii", 40, 320, -240) + bytes(4) + codec + bytes(20))


def audio(tag, bits, length=1000):
    return strh(b"auds", bytes(4), 1, 8000, length), chunk(b"strf", struct.pack("<HHIIHH", tag, 2, 44100, 0, 4, bits))


def page(granule, packet, serial=1, cut=0):
    lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
    return b"OggS\0\0" + struct.pack("<q", granule) + struct.pack("<III", serial, 0, 0) + bytes([len(lacing), *lacing]) + packet[: len(packet) - cut]


OPUS = b"OpusHead\x01\x02" + bytes(9)
VORBIS = b"\x01vorbis" + bytes(4) + b"\x01" + struct.pack("<I", 22050) + bytes(14)
FRAME = b"\xff\xfb\x90\x00" + bytes(413)


@pytest.fixture(scope="module")
def probed(spark):
    frames = [chunk(b"00dc", b"x" * 9) for _ in range(30)]
    data = {
        "a/two": avi(video(b"MJPG", 99), audio(1, 16), movi=[lst(b"rec ", *frames[:10]), *frames[10:], chunk(b"01wb", bytes(50)), chunk(b"ix00", bytes(8))]),
        "a/declared": avi(video(b"\x01\0\0\0", 50)), "a/handler": avi((strh(b"vids", b"cvid", 1, 10, 7), chunk(b"strf", struct.pack("<Iii", 40, 16, 16) + bytes(4) + b"cvid"))),
        "a/dk3": avi(audio(0x62, 4), audio(0x55, 0)), "a/text": avi((strh(b"txts", bytes(4), 1, 1, 1),)), "a/unknown": avi(video(b"ABCD", 5)),
        "o/opus": page(0, OPUS) + page(96000, b"x" * 600) + page(-1, b"y"), "o/two": page(0, OPUS, 5) + page(0, VORBIS, 2) + page(44100, b"z", 2) + page(48000, b"z", 5),
        "o/cut": page(0, VORBIS) + page(22050, b"a" * 100) + page(99999, b"b" * 100, cut=10), "o/none": page(0, b"fishead\0" + bytes(60)),
        "m/plain": FRAME * 10, "m/tagged": b"ID3\x03\0\0\0\0\0\x64" + b"\xff\xfb\x90\x00" * 25 + FRAME * 4 + b"junk" + FRAME * 3 + b"TAG" + FRAME + bytes(125), "m/broken": b"ID3\x03\0\0\xff\0\0\0" + FRAME,
    }
    p = probe_corpus(objects(spark, data), piece=64)
    return {r.path: r for r in p.documents.collect()}, {r.path: r for r in p.rejects.collect()}, data


def test_documents_and_rejects_are_all_objects(probed):
    docs, rejects, data = probed
    assert sorted([*docs, *rejects]) == sorted(data) and set(rejects) == {"a/text", "a/unknown", "o/none", "m/broken"}


def test_avi(probed):
    docs = probed[0]
    said = lambda name: [(s["index"], s.codec_type, s.codec_name, s.duration_seconds) for s in docs[name].streams]
    assert docs["a/two"].format == "avi" and said("a/two") == [(0, "video", "mjpeg", 30 / 25), (1, "audio", "pcm_s16le", 0.0)]
    v, a = docs["a/two"].streams
    assert (v.width, v.height, v.sample_rate) == (320, 240, None) and (a.sample_rate, a.channels, a.bits_per_sample, a.width) == (44100, 2, 16, None)
    assert said("a/declared") == [(0, "video", "msrle", 2.0)] and said("a/handler") == [(0, "video", "cinepak", 0.7)]
    assert said("a/dk3") == [(0, "audio", "adpcm_ima_dk3", 1008 / 8000), (1, "audio", "mp3", 0.0)]


def test_ogg(probed):
    docs = probed[0]
    said = lambda name: [(s["index"], s.codec_name, s.sample_rate, s.channels, s.duration_seconds) for s in docs[name].streams]
    assert said("o/opus") == [(0, "opus", 48000, 2, 2.0)] and said("o/two") == [(0, "opus", 48000, 2, 1.0), (1, "vorbis", 22050, 1, 2.0)]
    assert said("o/cut") == [(0, "vorbis", 22050, 1, 1.0)]


def test_mp3(probed):
    docs = probed[0]
    said = lambda name: [(s.codec_name, s.sample_rate, s.channels, s.duration_seconds) for s in docs[name].streams]
    assert said("m/plain") == [("mp3", 44100, 2, 10 * 1152 / 44100)] and said("m/tagged") == [("mp3", 44100, 2, 7 * 1152 / 44100)]
