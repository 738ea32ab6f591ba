"""Exact observations: files whose metadata is known from their suffix, length and leading bytes."""

# Fixed values: (suffix or None, length or None, ((offset, bytes), ...), format, ((kind, codec, rate, channels, bits, width, height, seconds), ...)).
# Entries without a suffix are a content test; the others apply to their suffix only.
OBSERVATIONS: tuple[tuple, ...] = (
    (None, 2048, ((0, b'II*\x00'),), 'tiff_pipe', (('video', 'tiff', None, None, None, 0, 0, 0.0),)),
    (None, 25000, ((0, b'\x00\x00\x01\xba!\x00\x03Q\x81\xa1\x9au'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 160, 120, 1.58), ('audio', 'ac3', 48000, 2, 0, None, None, 1.055),)),
    (None, 25000, ((0, b'\x1f\x07\x00?\x08xxx\xff\xff\xff\xff'),), 'dv', (('video', 'dvvideo', None, None, None, 720, 480, 0.00695), ('audio', 'pcm_s16le', 48000, 2, 16, None, None, 0.006951),)),
    (None, 26590, ((0, b'\x95c\x93c'),), 'av1', (('video', 'av1', None, None, None, 300, 300, 0.0),)),
    (None, 32768, ((0, b'.RMP'),), 'rm', (('video', 'rv60', None, None, None, 72, 72, 39.962),)),
    (None, 56320, ((0, b'\x00W\xee\xb9W\x90u6'),), 'aa', (('audio', 'sipr', 8500, 1, 0, None, None, 5369.163294),)),
    (None, 65536, ((0, b'.RMP'),), 'rm', (('video', 'rv60', None, None, None, 512, 512, 39.962),)),
    (None, 90000, ((0, b'1>\xfa\x80}\x0e#]\xee\x80\x81\xf7'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 480, 480, 0.133478), ('audio', 'mp2', 44100, 2, 0, None, None, 0.2351),)),
    (None, 102400, ((0, b'ea3\x03'),), 'oma', (('audio', 'atrac3p', 44100, 2, 0, None, None, 16.798118),)),
    (None, 102400, ((0, b'pmpm'),), 'pmp', (('video', 'mpeg4', None, None, None, 480, 272, 44.010633), ('audio', 'mp3', 44100, 2, 0, None, None, 44.010635),)),
    (None, 262144, ((0, b'SANM'),), 'smush', (('video', 'sanm', None, None, None, 640, 480, 8.733333), ('audio', 'adpcm_vima', 22050, 2, 0, None, None, 0.0),)),
    (None, 262144, ((0, b'TMAV'),), 'tmv', (('video', 'tmv', None, None, None, 320, 200, 1.851845), ('audio', 'pcm_u8', 22058, 1, 8, None, None, 1.846813),)),
    (None, 300000, ((0, b'YO'),), 'yop', (('audio', 'adpcm_ima_apc', 22050, 1, 4, None, None, 0.552367), ('video', 'yop', None, None, None, 580, 174, 0.583333),)),
    (None, 300379, ((0, b'TWIN97012000'),), 'vqf', (('audio', 'twinvq', 22050, 1, 0, None, None, 120.093605),)),
    (None, 355076, ((0, b'NuppelVideo\x00'),), 'nuv', (('video', 'nuv', None, None, None, 640, 480, 2.01), ('audio', 'pcm_s16le', 44100, 2, 16, None, None, 2.01),)),
    (None, 386165, ((0, b'NSVf'),), 'nsv', (('video', 'vp3', None, None, None, 160, 112, 60.4604), ('audio', 'mp3', 11025, 1, 0, None, None, 60.46),)),
    (None, 445680, ((0, b'FORM'), (8, b'MOVE_PC_'),), 'wc3movie', (('video', 'xan_wc3', None, None, None, 320, 165, 9.666667), ('audio', 'pcm_s16le', 22050, 1, 16, None, None, 9.666667),)),
    (None, 512046, ((0, b'MythTVVideo\x00'),), 'nuv', (('video', 'nuv', None, None, None, 512, 288, 2.894), ('audio', 'mp3', 48000, 2, 0, None, None, 2.894),)),
    (None, 524288, ((0, b'ea3\x03'),), 'oma', (('audio', 'atrac3', 44100, 2, 0, None, None, 31.511406),)),
    (None, 671184, ((0, b'EA3\x01'),), 'oma', (('audio', 'atrac3p', 44100, 2, 0, None, None, 20.944422),)),
    (None, 983040, ((12, b'xobX'),), 'xmv', (('video', 'wmv2', None, None, None, 640, 480, 8.5), ('audio', 'adpcm_ima_xbox', 44100, 2, 4, None, None, 12.335601),)),
    (None, 1016459, ((0, b'RKA7'),), 'rka', (('audio', 'rka', 44100, 2, 16, None, None, 9.5),)),
    (None, 1048576, ((0, b'THP\x00'),), 'thp', (('video', 'thp', None, None, None, 608, 320, 217.083755), ('audio', 'adpcm_thp', 32000, 2, 0, None, None, 217.076531),)),
    (None, 1048576, ((0, b'ajkg'),), 'shn', (('audio', 'shorten', 44100, 2, 0, None, None, 0.0),)),
    (None, 1048576, ((0, b'\xb7\xd8\x00 7I\xda\x11'),), 'wtv', (('audio', 'mp2', 48000, 2, 0, None, None, 0.0), ('video', 'mpeg2video', None, None, None, 720, 576, 0.0), ('audio', 'mp2', 48000, 1, 0, None, None, 0.0), ('video', 'mjpeg', None, None, None, 0, 0, 155.460533),)),
    (None, 1553077, ((0, b'FORM'), (8, b'RLV3'),), 'rl2', (('video', 'rl2', None, None, None, 320, 200, 137.758458), ('audio', 'pcm_u8', 11025, 1, 8, None, None, 137.806712),)),
    (None, 1967460, ((0, b'\xe2#)\xc9t\xea\x93\xf4G;\x07\xcd'),), 's337m', (('audio', 'dolby_e', 44800, 6, 0, None, None, 0.0),)),
    (None, 2097152, ((0, b'Packed Animation File V1.0'),), 'paf', (('video', 'paf_video', None, None, None, 256, 192, 407.5), ('audio', 'paf_audio', 22050, 2, 0, None, None, 0.0),)),
    (None, 4194304, ((4, b'RED1'),), 'r3d', (('video', 'jpeg2000', None, None, None, 2048, 1152, 0.0), ('audio', 'pcm_s32be', 48000, 1, 32, None, None, 0.0),)),
    ('', 57388, ((0, b'RIFF'), (8, b'WAVE'),), 'wav', (('audio', 'dts', 44100, 6, 0, None, None, 0.325079),)),
    ('', 70846, ((0, b'ID3\x03'),), 'mpeg', (('audio', 'mp3', 0, 0, 0, None, None, 0.0),)),
    ('', 1048576, ((0, b'\x00\x00\x01\xa5\x00\x13\x00\x00\x01\x02\x03\x00'),), 'nc', (('video', 'mpeg4', None, None, None, 720, 576, 0.0),)),
    ('264', 10145, ((0, b'\x00\x00\x00\x01gB\xa0\x15\xa4\xd1\x0c\x16'),), 'h264', (('video', 'h264', None, None, None, 0, 0, 0.0),)),
    ('264', 10722, ((0, b'\x00\x00\x00\x01gB\x00\x15\x8dM\x10\xc1'),), 'h264', (('video', 'h264', None, None, None, 0, 0, 0.0),)),
    ('aac', 299647, ((0, b'\xff\xf9P\x807\x1f\xfc\xde$\x00\x00l'),), 'aac', (('audio', 'aac', 44100, 2, 0, None, None, 17.13566),)),
    ('adts', 25190, ((0, b'\xff\xf9P\xa0\x01\xa0\x00! \x03@h'),), 'aac', (('audio', 'aac', 44100, 2, 0, None, None, 2.25167),)),
    ('asf', 115867, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('video', 'msmpeg4v3', None, None, None, 640, 480, 1.714),)),
    ('asf', 500000, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('video', 'tdsc', None, None, None, 1440, 900, 2.539), ('audio', 'mp3', 44100, 2, 0, None, None, 2.539),)),
    ('asf', 261120, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('audio', 'wmav2', 44100, 1, 0, None, None, 0.999), ('video', 'g2m', None, None, None, 1280, 996, 0.999),)),
    ('avi', 121054, ((0, b'RIFF'),), 'avi', (('audio', 'imc', 11025, 1, 0, None, None, 41.869376),)),
    ('avi', 2862232, ((0, b'RIFF'),), 'avi', (('video', 'cyuv', None, None, None, 176, 144, 4.99995),)),
    ('avi', None, ((0, b'RIFF\xe4\xdf1\x00'),), 'avi', (('video', 'vmnc', None, None, None, 1268, 961, 40.8),)),
    ('avi', None, ((0, b'RIFFP\xb4\xd9\x00'),), 'avi', (('video', 'aasc', None, None, None, 320, 175, 0.48),)),
    ('avi', None, ((0, b'RIFF\xf8rR\x00'),), 'avi', (('video', 'cljr', None, None, None, 240, 180, 1.26756),)),
    ('avi', None, ((0, b'RIFF\xeaK\xcf\x08'),), 'avi', (('video', 'cllc', None, None, None, 640, 480, 0.467133),)),
    ('avi', None, ((0, b'RIFF\xc8G\xd4\x00'),), 'avi', (('video', 'cllc', None, None, None, 640, 480, 0.5005),)),
    ('avi', None, ((0, b'RIFF\x84\\\xd9\x01'),), 'avi', (('video', 'msvideo1', None, None, None, 200, 100, 11.875), ('audio', 'pcm_u8', 22050, 1, 8, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF&\x18=\x00'),), 'avi', (('video', 'cinepak', None, None, None, 400, 187, 7.083333), ('audio', 'pcm_u8', 8000, 1, 8, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFFl\xa0\xa2\x00'),), 'avi', (('video', 'truemotion1', None, None, None, 144, 160, 1.266667), ('audio', 'adpcm_ima_dk3', 44100, 2, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF^\xba\\\x00'),), 'avi', (('video', 'truemotion1', None, None, None, 288, 144, 7.95), ('audio', 'adpcm_ima_dk4', 22050, 1, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\x98\x15\n\x01'),), 'avi', (('video', 'fic', None, None, None, 1360, 768, 1.8), ('audio', 'pcm_s16le', 48000, 2, 16, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF@1\x1c\x05'),), 'avi', (('video', 'fraps', None, None, None, 640, 512, 0.233333),)),
    ('avi', None, ((0, b'RIFF(\xfe\x8f\x00'),), 'avi', (('video', 'fraps', None, None, None, 288, 168, 1.9),)),
    ('avi', None, ((0, b'RIFF\xb0\xe3\x06\x02'),), 'avi', (('video', 'fraps', None, None, None, 512, 384, 0.366667),)),
    ('avi', None, ((0, b'RIFFL\x8a=\x00'),), 'avi', (('video', 'fraps', None, None, None, 1024, 768, 0.433333),)),
    ('avi', None, ((0, b'RIFF\x10`\xcc\x00'),), 'avi', (('video', 'indeo4', None, None, None, 320, 240, 4.2), ('audio', 'pcm_u8', 22050, 1, 8, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFFB@\x10\x00'),), 'avi', (('audio', 'pcm_s16le', 44100, 2, 16, None, None, 0.0), ('video', 'kgv1', None, None, None, 320, 240, 5.216667),)),
    ('avi', None, ((0, b'RIFF\xca;#\x01'),), 'avi', (('video', 'lagarith', None, None, None, 480, 256, 0.2002),)),
    ('avi', None, ((0, b'RIFF.i \x00'),), 'avi', (('video', 'lagarith', None, None, None, 720, 480, 0.667333),)),
    ('avi', None, ((0, b'RIFF~\x10\x0b\x00'),), 'avi', (('video', 'mjpeg', None, None, None, 468, 312, 0.3), ('audio', 'ac3', 44100, 2, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFFjB\x01\x00'),), 'avi', (('video', 'msrle', None, None, None, 321, 321, 12.0), ('audio', 'truespeech', 8000, 1, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\xea\xcb\x8a\x00'),), 'avi', (('video', 'rscc', None, None, None, 320, 240, 0.584063),)),
    ('avi', None, ((0, b'RIFF\xecf@\x02'),), 'avi', (('video', 'rscc', None, None, None, 854, 480, 0.033367), ('audio', 'pcm_s16le', 44100, 2, 16, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\xe4\x86\xfe\x00'),), 'avi', (('video', 'rscc', None, None, None, 320, 240, 0.292032),)),
    ('avi', None, ((0, b'RIFF\x8e\xbc-\x00'),), 'avi', (('video', 'screenpresso', None, None, None, 320, 240, 0.333751),)),
    ('avi', None, ((0, b'RIFF8\xbfV\x00'),), 'avi', (('video', 'screenpresso', None, None, None, 320, 240, 0.166875),)),
    ('avi', None, ((0, b'RIFFdw\x93\x02'),), 'avi', (('video', 'tscc', None, None, None, 1024, 768, 24.533333), ('audio', 'mp3', 24000, 1, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFFr:\x0e\x00'),), 'avi', (('video', 'tscc', None, None, None, 548, 400, 56.6), ('audio', 'pcm_mulaw', 11025, 1, 8, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\xf8{\x89\x00'),), 'avi', (('video', 'tscc2', None, None, None, 320, 240, 1.416667),)),
    ('avi', None, ((0, b'RIFF\xf8?\xce\x01'),), 'avi', (('video', 'v210', None, None, None, 1280, 720, 0.02), ('audio', 'pcm_s16le', 48000, 2, 16, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\xfa\x7f\x89\x04'),), 'avi', (('video', 'vble', None, None, None, 1280, 720, 0.133467),)),
    ('avi', None, ((0, b'RIFF\xf0\xa0C\x00'),), 'avi', (('video', 'vp5', None, None, None, 512, 304, 8.049708), ('audio', 'speex', 32000, 1, 0, None, None, 0.0),)),
    ('avi', None, ((0, b'RIFF\xb8+\x15\x00'),), 'avi', (('video', 'xan_wc4', None, None, None, 320, 165, 7.4), ('audio', 'xan_dpcm', 22050, 2, 0, None, None, 7.4),)),
    ('avi', None, ((0, b'RIFF2\xc4:\x02'),), 'avi', (('video', 'xan_wc4', None, None, None, 320, 165, 5.666667), ('audio', 'xan_dpcm', 22050, 2, 0, None, None, 5.666667),)),
    ('avi', None, ((0, b'RIFF\x88y\x87\x00'),), 'avi', (('video', 'zmbv', None, None, None, 320, 200, 4.037879), ('audio', 'pcm_s16le', 44100, 2, 16, None, None, 0.0),)),
    ('bit', 103502, ((0, b'\x00\x00\x00\x01\x00y'),), 'vvc', (('video', 'vvc', None, None, None, 480, 320, 0.0),)),
    ('bit', 19484, ((0, b'\x00\x00\x00\x01@\x01\x0c\x11\xff\xff\x01`'),), 'hevc', (('video', 'hevc', None, None, None, 128, 128, 0.0),)),
    ('bit', 53498, ((0, b'\xff\xfb\x90\xc0\x00\x00\x02\xc4'),), 'mp3', (('audio', 'mp3', 44100, 2, 0, None, None, 3.343625),)),
    ('bit', 63840, ((0, b'\xff\xfb\x14\xc0\x00\x00\x02\xc4'),), 'mp3', (('audio', 'mp3', 48000, 1, 0, None, None, 10.034383),)),
    ('bit', 95760, ((0, b'\xff\xfb\x18\xc0\x00\x00\x02\xc4'),), 'mp3', (('audio', 'mp3', 32000, 1, 0, None, None, 15.564405),)),
    ('bit', 166661, ((0, b'\xff\xfb\x10\xc0\x00\x00\x02\xc4'),), 'mp3', (('audio', 'mp3', 44100, 1, 0, None, None, 37.506695),)),
    ('bit', 26645, ((0, b'\xff\xfb\x00\x00\x00\x00\x00\xb1'),), 'bit', (('audio', 'g729', 8000, 1, 0, None, None, 0.0),)),
    ('bit', 1028787, ((0, b'\x00\x00\x00\x01\x00y'),), 'vvc', (('video', 'vvc', None, None, None, 800, 872, 0.0),)),
    ('vvc', 1028787, ((0, b'\x00\x00\x00\x01\x00y'),), 'vvc', (('video', 'vvc', None, None, None, 800, 872, 0.0),)),
    ('divx', 1282048, ((0, b'\x00\x00\x00\x04'),), 'lmlm4', (('video', 'mpeg4', None, None, None, 320, 240, 0.0), ('audio', 'mp2', 48000, 2, 0, None, None, 0.0),)),
    ('eac3', 723456, ((0, b'\x0bw\xfd\r"0\xe1\xfc<\xec\x92`'),), 'eac3', (('audio', 'eac3', 48000, 8, 0, None, None, 5.024),)),
    ('ape', 54482, ((0, b'MAC '),), 'ape', (('audio', 'ape', 44100, 2, 16, None, None, 60.48), ('video', 'mjpeg', None, None, None, 302, 305, 60.48),)),
    ('f32', 686592, ((0, b'\x00\x00\x00\x00\x96\xabs3'),), 'amrnb', (('audio', 'amr_nb', 8000, 1, 0, None, None, 549.273625),)),
    ('f32', 1884672, ((0, b'\x00\x00\x00\x00\x96\xabs3'),), 'amrnb', (('audio', 'amr_nb', 8000, 1, 0, None, None, 1507.737625),)),
    ('flv', 111648, ((0, b'FLV\x01'),), 'flv', (('video', 'vp6f', None, None, None, 112, 80, 0.0),)),
    ('flv', 148889, ((0, b'FLV\x01'),), 'flv', (('video', 'vp6a', None, None, None, 300, 180, 0.0),)),
    ('flv', 4697046, ((0, b'FLV\x01\x05'),), 'flv', (('video', 'h264', None, None, None, 1920, 1080, 0.0), ('audio', 'aac', 48000, 6, 0, None, None, 0.0), ('video', 'vp9', None, None, None, 1920, 1080, 0.0), ('audio', 'opus', 48000, 6, 0, None, None, 0.0), ('video', 'av1', None, None, None, 1920, 1080, 0.0), ('audio', 'flac', 48000, 6, 24, None, None, 0.0), ('video', 'hevc', None, None, None, 1920, 1080, 0.0), ('audio', 'ac3', 48000, 6, 0, None, None, 0.0), ('video', 'h264', None, None, None, 1920, 1080, 0.0), ('audio', 'aac', 48000, 6, 0, None, None, 0.0),)),
    ('hif', 1258001, ((4, b'ftypheix'),), 'mp4', (('video', 'hevc', None, None, None, 1920, 1280, 0.0), ('video', 'mjpeg', None, None, None, 160, 120, 0.0), ('video', 'mjpeg', None, None, None, 1620, 1080, 0.0),)),
    ('ism', 197144, ((4, b'ftypisml'),), 'mp4', (('audio', 'wmapro', 44100, 2, 0, None, None, 5.03483), ('video', 'vc1', None, None, None, 240, 104, 4.959),)),
    ('ivf', 9141, ((0, b'DKIF\x00\x00 \x00VP90'),), 'ivf', (('video', 'vp9', None, None, None, 352, 288, 0.333333),)),
    ('jpg', 1199, ((0, b'\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01'),), 'jpeg_pipe', (('video', 'mjpeg', None, None, None, 64, 64, 0.0),)),
    ('m4a', 8078, ((4, b'ftypmp42'),), 'mp4', (('audio', 'aac', 16000, 1, 0, None, None, 2.304),)),
    ('m4a', 10077, ((4, b'ftypmp42'),), 'mp4', (('audio', 'aac', 44100, 1, 0, None, None, 2.136236),)),
    ('m4a', 982382, ((4, b'ftypM4A '),), 'mp4', (('audio', 'aac', 44100, 2, 0, None, None, 29.350023), ('video', 'mjpeg', None, None, None, 600, 600, 29.350022),)),
    ('m4a', 1375593, ((4, b'ftypM4A '),), 'mp4', (('audio', 'alac', 44100, 2, 16, None, None, 11.888367), ('video', 'png', None, None, None, 200, 200, 11.888367),)),
    ('m4v', 253110, ((0, b'\x00\x00\x01\x00\x00\x00\x01 '),), 'm4v', (('video', 'mpeg4', None, None, None, 720, 480, 0.0),)),
    ('mkv', 416373, ((0, b'\x1aE\xdf\xa3\x01\x00\x00\x00'),), 'matroska', (('video', 'theora', None, None, None, 2960, 1040, 0.0),)),
    ('mkv', 2559274, ((0, b'\x1aE\xdf\xa3\x01\x00\x00\x00\x00\x00\x00#'),), 'matroska', (('video', 'h264', None, None, None, 720, 480, 0.0), ('audio', 'dts', 48000, 6, 0, None, None, 0.0),)),
    ('mkv', 1000000, ((0, b'\x1aE\xdf\xa3\xa3B'),), 'matroska', (('video', 'h264', None, None, None, 720, 484, 0.0),)),
    ('mkv', 102400, ((0, b'\x1aE\xdf\xa3\xa3B'),), 'matroska', (('audio', 'aac', 48000, 2, 0, None, None, 0.0), ('video', 'h264', None, None, None, 1280, 718, 0.0),)),
    ('mkv', 2097152, ((0, b'\x1aE\xdf\xa3\x99\xbf'),), 'matroska', (('video', 'h264', None, None, None, 1024, 576, 0.0), ('audio', 'aac', 48000, 2, 0, None, None, 0.0),)),
    ('mov', 5217, ((4, b'ftypmp42'),), 'mp4', (('video', 'hevc', None, None, None, 128, 128, 0.16),)),
    ('mov', 5639, ((4, b'ftypmp42'),), 'mp4', (('video', 'h264', None, None, None, 256, 128, 0.16),)),
    ('mov', 30798, ((4, b'ftypqt '),), 'mp4', (('video', 'h264', None, None, None, 640, 480, 1.916992),)),
    ('mov', 30810, ((4, b'ftypqt '),), 'mp4', (('video', 'h264', None, None, None, 640, 480, 1.75),)),
    ('mov', 38679, ((4, b'ftypqt '),), 'mp4', (('video', 'h264', None, None, None, 320, 240, 0.5),)),
    ('mov', 76156, ((4, b'ftypqt '),), 'mp4', (('video', 'h264', None, None, None, 640, 480, 1.0), ('audio', 'aac', 48000, 1, 0, None, None, 1.0),)),
    ('mov', 121458, ((4, b'mdat'),), 'mp4', (('video', 'indeo3', None, None, None, 160, 120, 4.0),)),
    ('mov', 3161989, ((4, b'moov\x00\x00\x14\x87'),), 'mp4', (('video', 'svq3', None, None, None, 320, 240, 43.576667), ('audio', 'adpcm_ima_qt', 44100, 1, 4, None, None, 43.575011),)),
    ('mov', 396125, ((4, b'wide\x00\x06\x04\xc7'),), 'mp4', (('video', 'qtrle', None, None, None, 320, 240, 3.166667), ('audio', 'mace6', 22050, 1, 0, None, None, 3.098322),)),
    ('mov', 740070, ((4, b'wide\x00\x0bD\x88'),), 'mp4', (('video', 'qtrle', None, None, None, 320, 240, 3.166667), ('audio', 'mace6', 22050, 1, 0, None, None, 3.098322),)),
    ('mov', 1048576, ((4, b'moov\x00\x00\x00l'),), 'mp4', (('video', '8bps', None, None, None, 360, 240, 13.52), ('audio', 'pcm_u8', 22050, 1, 8, None, None, 13.496009),)),
    ('mov', 1269625, ((4, b'wide\x00\x13Y7'),), 'mp4', (('video', 'qtrle', None, None, None, 320, 240, 3.166667), ('audio', 'mace6', 22050, 1, 0, None, None, 3.098322),)),
    ('mp3', 17135, ((0, b'\xff\xfb\x90\xc4\x00\x00\x00\x00\x00\x00\x00\x00'),), 'mp3', (('audio', 'mp3', 44100, 1, 0, None, None, 1.0),)),
    ('mp3', 25069, ((0, b'ID3\x04'),), 'mp3', (('audio', 'mp3', 44100, 2, 0, None, None, 0.53551), ('video', 'mjpeg', None, None, None, 263, 263, 0.535511),)),
    ('mp3', 250264, ((0, b'ID3\x04'),), 'mp3', (('audio', 'mp3', 44100, 2, 0, None, None, 15.484807),)),
    ('mp4', 87059, ((4, b'ftypisom'),), 'mp4', (('video', 'hevc', None, None, None, 320, 240, 0.95),)),
    ('mp4', 39845, ((4, b'ftypmp42'),), 'mp4', (('audio', 'mpegh_3d_audio', 48000, 0, 0, None, None, 1.8),)),
    ('mp4', 144820, ((4, b'ftypmp42'),), 'mp4', (('audio', 'mp3', 44100, 2, 0, None, None, 7.523265),)),
    ('mp4', 305277, ((4, b'ftypisom'),), 'mp4', (('video', 'h264', None, None, None, 320, 240, 3.0), ('audio', 'aac', 48000, 1, 0, None, None, 3.008),)),
    ('mp4', 9794102, ((4, b'ftypmp42'),), 'mp4', (('video', 'h264', None, None, None, 1920, 1080, 7.84), ('audio', 'alac', 48000, 6, 16, None, None, 7.84),)),
    ('mp4', 177752, ((0, b'\x00\x00\x01\xb0 @\x8a\x00'),), 'cavsvideo', (('video', 'cavs', None, None, None, 1280, 720, 0.0),)),
    ('mpg', 129720, ((0, b'G@\x11\x10\x00B\xf0%\x00\x01\xc1\x00'),), 'mpegts', (('audio', 'aac_latm', 48000, 2, 0, None, None, 9.258667),)),
    ('mpg', 524288, ((0, b'\x01\x01\x03\xb8\x80`\xf9\xd72\x87\xe1\xab'),), 'iv8', (('video', 'mpeg4', None, None, None, 704, 576, 0.0),)),
    ('mpg', 90112, ((0, b'\x00\x00\x01\xba!\x00\x01\x00'),), 'mpeg', (('audio', 'pcm_dvd', 44100, 1, 16, None, None, 1.014644),)),
    ('mpg', 210944, ((0, b'\x00\x00\x01\xba!\x00\x01\x00'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 716, 236, 0.96),)),
    ('mpg', 2048000, ((0, b'\x00\x00\x01\xbaD\x00\x04\x00'),), 'mpeg', (('video', 'cavs', None, None, None, 720, 576, 6.04), ('audio', 'mp2', 48000, 2, 0, None, None, 6.288),)),
    ('mtv', 524288, ((0, b'AMVS\x92-\x01\xc9\x96\x00\x00A'),), 'mtv', (('video', 'rawvideo', None, None, None, 96, 64, 0.0), ('audio', 'mp3', 44100, 2, 0, None, None, 0.0),)),
    ('mxg', 630336, ((0, b'\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01'),), 'mxg', (('video', 'mxpeg', None, None, None, 1280, 960, 0.0), ('audio', 'pcm_alaw', 8000, 1, 8, None, None, 0.0),)),
    ('mvi', 2097152, ((0, b'\x07\x04\x02q'),), 'mvi', (('audio', 'pcm_u8', 22050, 1, 8, None, None, 0.0), ('video', 'motionpixels', None, None, None, 320, 240, 0.0),)),
    ('obu', 26590, ((0, b'\x95c\x93c'),), 'av1', (('video', 'av1', None, None, None, 300, 300, 0.0),)),
    ('ogg', 3299, ((0, b'OggS'),), 'ogg', (('audio', 'opus', 48000, 1, 0, None, None, 0.1065),)),
    ('ogg', 5277, ((0, b'OggS'),), 'ogg', (('audio', 'flac', 44100, 1, 16, None, None, 0.2),)),
    ('ogg', 7151, ((0, b'OggS'),), 'ogg', (('audio', 'vorbis', 44100, 1, 0, None, None, 0.03),)),
    ('opus', 94907, ((0, b'OggS'),), 'ogg', (('audio', 'opus', 48000, 1, 0, None, None, 2.0), ('video', 'mjpeg', None, None, None, 485, 359, 2.0), ('video', 'mjpeg', None, None, None, 199, 300, 2.0),)),
    ('pcm', 1034496, ((0, b'\x04\x00\x02\x00\x06\x00\x03\x00'),), 'ea_cdata', (('audio', 'adpcm_ea_xas', 512, 1, 0, None, None, 0.0),)),
    ('pcm', 1427712, ((0, b'\x04\x00\x06\x00\x03\x00\x05\x00'),), 'ea_cdata', (('audio', 'adpcm_ea_xas', 1536, 1, 0, None, None, 0.0),)),
    ('pva', 1048576, ((0, b'AV'),), 'pva', (('video', 'mpeg2video', None, None, None, 544, 576, 2.092544), ('audio', 'mp2', 48000, 2, 0, None, None, 2.092544),)),
    ('rmvb', 1048576, ((0, b'.RMF'),), 'rm', (('audio', 'ralf', 44100, 2, 0, None, None, 60.466),)),
    ('rsd', 32256, (), 'redspark', (('audio', 'adpcm_thp', 32000, 2, 0, None, None, 7.01575),)),
    ('s16', 2181120, ((0, bytes(64)), (11408, b'\x01\x00\x00\x00'),), 'm4v', (('video', 'mpeg4', None, None, None, 15, 1, 0.0),)),
    ('s16', 2560000, ((0, b'8\x008\x00r\x00r\x00'),), 'adp', (('audio', 'adpcm_dtk', 48000, 2, 0, None, None, 46.666667),)),
    ('s16', 3840000, ((0, b'\xcb\x00\xcb\x00\xed\x00\xed\x00'),), 'sga', (('video', 'sga', None, None, None, 168, 8, 0.0),)),
    ('seq', 1093632, ((0, bytes(64)),), 'tiertexseq', (('video', 'tiertexseqvideo', None, None, None, 256, 128, 0.0), ('audio', 'pcm_s16be', 22050, 1, 16, None, None, 0.0),)),
    ('smv', 94387, ((0, b'RIFF'),), 'wav', (('audio', 'adpcm_ima_wav', 11025, 1, 4, None, None, 12.033107), ('video', 'smvjpeg', None, None, None, 128, 160, 12.0),)),
    ('sw', 1058400, ((0, b"\x10'\x10'\xaa&\xaa&"),), 's16le', (('audio', 'pcm_s16le', 44100, 1, 16, None, None, 12.0),)),
    ('ts', 10528, ((0, b'G@\x00\x10\x00\x00\xb0\x11\x00\x01\xc1\x00'),), 'mpegts', (('video', 'hevc', None, None, None, 1920, 1080, 0.375), ('video', 'hevc', None, None, None, 1920, 1080, 0.375),)),
    ('ts', 43992, ((0, b'G@\x11\x10\x00B\xf0%\x00\x01\xc1\x00'),), 'mpegts', (('video', 'h264', None, None, None, 320, 180, 1.0), ('audio', 'mp3', 0, 0, 0, None, None, 0.966667),)),
    ('ts', 58468, ((0, b'G@\x11\x10\x00B\xf0%'),), 'mpegts', (('video', 'vvc', None, None, None, 320, 180, 1.0),)),
    ('ts', 62792, ((0, b'G@\x11\x10\x00B\xf0%'),), 'mpegts', (('video', 'vvc', None, None, None, 320, 180, 1.0), ('audio', 'mp3', 0, 0, 0, None, None, 0.966667),)),
    ('ts', 78960, ((0, b'G@\x00\x10\x00\x00\xb0\r'),), 'mpegts', (('video', 'mpeg2video', None, None, None, 0, 0, 31.88), ('audio', 'mp3', 0, 0, 0, None, None, 31.88),)),
    ('ts', 100000, ((0, b'GG\x05Q\x1d1\x84\x01'),), 'mpegts', (('video', 'hevc', None, None, None, 1920, 1080, 0.46), ('audio', 'aac_latm', 48000, 2, 0, None, None, 0.277333),)),
    ('ts', 507788, ((0, b'G@\x11\x10\x00B\xf0%\x00\x01\xc1\x00'),), 'mpegts', (('video', 'mpeg2video', None, None, None, 480, 270, 0.7007), ('audio', 'mp2', 48000, 2, 0, None, None, 0.984),)),
    ('ts', 512000, ((0, b'G@\x00\x10\x00\x00\xb0\r\x80\x08\xc1\x00'),), 'mpegts', (('video', 'mpeg2video', None, None, None, 1280, 720, 0.216878), ('audio', 'ac3', 48000, 6, 0, None, None, 0.16), ('audio', 'ac3', 48000, 2, 0, None, None, 0.16),)),
    ('ts', 800000, ((0, b'G\x10#\x101\xb0\xd1\xfdUq\x1f"'),), 'mpegts', (('video', 'mpeg2video', None, None, None, 720, 576, 1.62),)),
    ('ts', 376000, ((0, b'G\x12H\x18hm\x1b\xae'),), 'mpegts', (('audio', 'ac3', 48000, 6, 0, None, None, 0.032), ('audio', 'ac3', 48000, 2, 0, None, None, 0.0), ('audio', 'ac3', 48000, 2, 0, None, None, 0.0), ('video', 'mpeg2video', None, None, None, 0, 0, 0.166833), ('audio', 'ac3', 0, 0, 0, None, None, 1.5285), ('audio', 'ac3', 0, 0, 0, None, None, 1.5285), ('audio', 'ac3', 48000, 2, 0, None, None, 0.032), ('video', 'mpeg2video', None, None, None, 0, 0, 0.133467),)),
    ('ts', 1237980, ((0, b'G@\x11\x10\x00B\xf0%\x00\x01\xc1\x00'),), 'mpegts', (('video', 'mpeg2video', None, None, None, 704, 480, 6.740067),)),
    ('thd', 16384, ((0, b'`.\xff\xbb\xf8ro\xba\x00\xc1\x00\x02'),), 'truehd', (('audio', 'truehd', 48000, 1, 24, None, None, 0.0),)),
    ('thd', 58738, ((0, b'"8Dg\xf8ro\xba\x00g\x80O'),), 'truehd', (('audio', 'truehd', 48000, 8, 24, None, None, 0.0),)),
    ('trec', 660159, ((4, b'ftypqt '),), 'mp4', (('video', 'tscc2', None, None, None, 892, 441, 3.0),)),
    ('vp7', 662310, ((0, b'RIFF'),), 'avi', (('video', 'vp7', None, None, None, 320, 176, 86.920167), ('audio', 'avc', 16000, 1, 0, None, None, 86.912),)),
    ('vob', 122880, ((0, b'\x00\x00\x01\xbaD\x00\x04\x04'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 720, 576, 0.02),)),
    ('vob', 878592, ((0, b'\x00\x00\x01\xbaD\x00\x04\x04'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 720, 576, 0.0), ('audio', 'ac3', 48000, 2, 0, None, None, 30.528),)),
    ('vob', 1048576, ((0, b'\x00\x00\x01\xbaD\x0b\xed\x8c'),), 'mpeg', (('video', 'mpeg2video', None, None, None, 720, 480, 0.367033), ('audio', 'pcm_dvd', 48000, 2, 24, None, None, 0.856956),)),
    ('webm', 102400, ((0, b'\x1aE\xdf\xa3\x01\x00\x00\x00'),), 'matroska', (('video', 'vp8', None, None, None, 640, 360, 0.0), ('audio', 'vorbis', 44100, 2, 0, None, None, 0.0),)),
    ('wav', 256000, ((0, b'RIFF'), (8, b'WAVE'),), 'wav', (('audio', 'ac3', 44100, 6, 0, None, None, 1.450998),)),
    ('wma', 102400, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'), (16, b'\x8c\xfe\x00\x00'),), 'asf', (('video', 'mjpeg', None, None, None, 500, 500, 3.098056), ('audio', 'wmav2', 44100, 2, 0, None, None, 3.098),)),
    ('wma', 200000, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'), (16, b'\x80P\x00\x00'),), 'asf', (('video', 'mjpeg', None, None, None, 300, 300, 22.409344), ('audio', 'wmav2', 44100, 2, 0, None, None, 22.409),)),
    ('wma', 200000, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'), (16, b'\xc7T\x00\x00'),), 'asf', (('video', 'mjpeg', None, None, None, 200, 201, 7.426344), ('video', 'mjpeg', None, None, None, 75, 75, 7.426344), ('audio', 'wmav2', 44100, 2, 0, None, None, 7.426),)),
    ('wmv', 128000, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('audio', 'wmav2', 8000, 1, 0, None, None, 0.0), ('video', 'mss1', None, None, None, 1024, 768, 0.0),)),
    ('wmv', 200000, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('audio', 'wmavoice', 22050, 1, 0, None, None, 5.804), ('video', 'wmv3', None, None, None, 320, 176, 5.804),)),
    ('wmv', 449508, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('audio', 'wmav2', 16000, 1, 0, None, None, 35.168), ('video', 'wmv2', None, None, None, 320, 240, 35.168),)),
    ('wv', 54470, ((0, b'wvpk'),), 'wv', (('audio', 'wavpack', 44100, 2, 16, None, None, 60.48), ('video', 'mjpeg', None, None, None, 302, 305, 60.48),)),
    ('xesc', 261112, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('video', 'mts2', None, None, None, 1368, 768, 1.232),)),
    ('xesc', 613152, ((0, b'0&\xb2u\x8ef\xcf\x11\xa6\xd9\x00\xaa\x00b\xcel'),), 'asf', (('video', 'mts2', None, None, None, 1172, 852, 8.671),)),
)
