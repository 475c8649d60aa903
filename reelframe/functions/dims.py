"""Small fixed tables of the media formats, as values and as DataFrames for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of ID3 genres by number.
GENRES = (
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal",
    "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae", "Rock", "Techno", "Industrial",
    "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk",
    "Fusion", "Trance", "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise",
    "AlternRock", "Bass", "Soul", "Punk", "Space", "Meditative", "Instrumental Pop", "Instrumental Rock", "Ethnic", "Gothic",
    "Darkwave", "Techno-Industrial", "Electronic", "Pop-Folk", "Eurodance", "Dream", "Southern Rock", "Comedy", "Cult", "Gangsta",
    "Top 40", "Christian Rap", "Pop/Funk", "Jungle", "Native American", "Cabaret", "New Wave", "Psychadelic", "Rave", "Showtunes",
    "Trailer", "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock",
    "Folk", "Folk-Rock", "National Folk", "Swing", "Fast Fusion", "Bebob", "Latin", "Revival", "Celtic", "Bluegrass",
    "Avantgarde", "Gothic Rock", "Progressive Rock", "Psychedelic Rock", "Symphonic Rock", "Slow Rock", "Big Band", "Chorus", "Easy Listening", "Acoustic",
    "Humour", "Speech", "Chanson", "Opera", "Chamber Music", "Sonata", "Symphony", "Booty Bass", "Primus", "Porn Groove",
    "Satire", "Slow Jam", "Club", "Tango", "Samba", "Folklore", "Ballad", "Power Ballad", "Rhythmic Soul", "Freestyle",
    "Duet", "Punk Rock", "Drum Solo", "A capella", "Euro-House", "Dance Hall", "Goa", "Drum & Bass", "Club-House", "Hardcore",
    "Terror", "Indie", "BritPop", "Negerpunk", "Polsk Punk", "Beat", "Christian Gangsta", "Heavy Metal", "Black Metal", "Crossover",
    "Contemporary Christian", "Christian Rock", "Merengue", "Salsa", "Thrash Metal", "Anime", "JPop", "SynthPop",
)

# kbit/s of MPEG audio by (version 1 or not, layer), index 1 to 14.
MPEG_BITRATES = {
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
}
# Hz of MPEG-1 audio by index; MPEG-2 has half, MPEG-2.5 a quarter.
MPEG_RATES = (44100, 48000, 32000)

# Codecs by the start of a Matroska codec id; the first that fits counts.
MATROSKA_CODECS = (
    ("V_MPEG4/ISO/AVC", "h264"),
    ("V_MPEG4/ISO/ASP", "mpeg4"),
    ("V_MPEGH/ISO/HEVC", "hevc"),
    ("V_MPEG4/ISO/", "mpeg4"),
    ("V_VP8", "vp8"),
    ("V_VP9", "vp9"),
    ("V_MPEG4/MS/", "msmpeg4"),
    ("A_AAC", "aac"),
    ("A_AC3", "ac3"),
    ("A_DTS", "dts"),
    ("A_MPEG/L1", "mp3"),
    ("A_MPEG/L2", "mp3"),
    ("A_MPEG/L3", "mp3"),
)
# Codecs by MP4 sample entry.
MP4_CODECS = (("mp4a", "aac"), ("avc1", "h264"), ("avc2", "h264"), ("hvc1", "hevc"), ("hev1", "hevc"))

# Codecs by the object type of an elementary stream's descriptor.
OBJECT_TYPES = ((0x20, "mpeg4"), (0x21, "h264"), (0x23, "hevc"), (0x40, "aac"), (0x66, "aac"), (0x67, "aac"), (0x68, "aac"), (0x69, "mp3"), (0x6B, "mp3"))

# Hz and channels of AAC by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
AAC_CHANNELS = (0, 1, 2, 3, 4, 5, 6, 8)

# Pixel formats by name, with the planes' (bits per pixel, horizontal and vertical subsampling).
PIXEL_FORMATS = {
    "420p": ((8, 1, 1), (8, 2, 2), (8, 2, 2)),
    "yv12": ((8, 1, 1), (8, 2, 2), (8, 2, 2)),
    "422p": ((8, 1, 1), (8, 2, 1), (8, 2, 1)),
    "yv16": ((8, 1, 1), (8, 2, 1), (8, 2, 1)),
    "444p": ((8, 1, 1), (8, 1, 1), (8, 1, 1)),
    "yv24": ((8, 1, 1), (8, 1, 1), (8, 1, 1)),
    "nv12": ((8, 1, 1), (16, 2, 2)),
    "nv21": ((8, 1, 1), (16, 2, 2)),
    "yuyv": ((16, 1, 1),),
    "yvyu": ((16, 1, 1),),
    "uyvy": ((16, 1, 1),),
    "vyuy": ((16, 1, 1),),
    "yuv444": ((24, 1, 1),),
    "RGB565": ((16, 1, 1),),
    "BGR565": ((16, 1, 1),),
    "RGB888": ((24, 1, 1),),
    "BGR888": ((24, 1, 1),),
    "ARGB": ((32, 1, 1),),
    "BGRA": ((32, 1, 1),),
    "RGBA": ((32, 1, 1),),
    "ABGR": ((32, 1, 1),),
}

# YCbCr to RGB as (luma offset, luma gain, R from V, G from U, G from V, B from U).
COLOR_MATRICES = {
    "jpeg": (0, 1.0, 1.402, 0.34414, 0.71414, 1.772),
    "601": (16, 1.164, 1.596, 0.391, 0.813, 2.018),
    "709": (16, 1.164, 1.793, 0.213, 0.533, 2.112),
    "2020": (16, 1.164384, 1.67867, 0.187326, 0.65042, 2.14177),
}


def dimension(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed table for a join; it never has more rows than are written above."""
    return spark.createDataFrame(list(rows), schema)
