"""Tables of media files: formats, tracks, samples, packets, frames and tags, from files (path, content)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import configs
from reelframe.functions.bits import mpeg_header, synchsafe
from reelframe.functions.dims import MATROSKA_CODECS, MP4_CODECS
from reelframe.functions.text import genre
from reelframe.plans import sample_table
from reelframe.sources.containers import EBML_NAMES, EBML_PARENTS, elements, number, parsed, walk_ebml, walk_mp4, walk_riff
from reelframe.sources.tags import directories
from reelframe.stored import materialize

PROBE_BYTES = 32 * 1024
WAV_SAMPLES = 2048
#: What headers of one MPEG audio stream agree in: sync, version, layer, rate and mode.
SAME_STREAM = 0xFFE00000 | 3 << 19 | 3 << 17 | 3 << 10 | 3 << 6

# What MP4 boxes at the start of a file add to its score, and which of them are opened.
BOX_SCORES = {"ftyp": 50, "mdat": 50, "moov": 20, "trak": 20, "mdia": 20, **dict.fromkeys(("meta", "mvhd", "tkhd", "tref", "edts", "mdhd", "hdlr", "minf"), 10)}
BOX_OPENED = ("moov", "trak", "mdia")


def id3_size(data: bytes) -> int:
    """Bytes of the ID3v2 tag that a file starts with, 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 10 + sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    return size + (10 if data[5] & 0x10 else 0)


def _wave_score(head: bytes) -> int:
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0
    score, at = 60, 12
    while len(head) - at > 8 and score < 100:
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        score += 20 * (name in (b"fmt ", b"data", b"fact"))
        at += 8 + size
        if name == b"data" or at > len(head):
            break
    return min(score, 100)


def _mp4_score(head: bytes) -> int:
    score, at = 0, 0
    while at + 8 <= len(head) and score < 100:
        size, name, body = struct.unpack_from(">I", head, at)[0], head[at + 4 : at + 8].decode("latin-1"), at + 8
        if size == 1 and at + 16 <= len(head):
            size, body = struct.unpack_from(">Q", head, at + 8)[0], at + 16
        if name not in BOX_SCORES:
            break
        score += BOX_SCORES[name]
        at = body if name in BOX_OPENED else at + max(size, 8)
    return min(score, 100)


def _matroska_score(head: bytes) -> int:
    """Ten for each known element. The first one has to be the EBML header: two letters can be another element's name."""
    if head[:4] != b"\x1a\x45\xdf\xa3":
        return 0
    score, at = 0, 0
    while score < 100 and at < len(head) and head[at]:
        n = 9 - head[at].bit_length()
        name, at = EBML_NAMES.get(int.from_bytes(head[at : at + n], "big")), at + n
        if name is None or at >= len(head) or not head[at]:
            break
        n = 9 - head[at].bit_length()
        size, at = int.from_bytes(head[at : at + n], "big") & (1 << 7 * n) - 1, at + n
        if not size:
            break
        score += 10
        if name not in EBML_PARENTS and not (n == 1 and size == 127):
            at += size
            if at > len(head):
                break
    return score


def _mp3_score(head: bytes) -> int:
    for at, word in _mpeg_frames(head):
        frame = configs.mpeg_frame(word)
        if frame and at + frame["length"] + 4 <= len(head):
            other = struct.unpack_from(">I", head, at + frame["length"])[0]
            if configs.mpeg_frame(other) and not (word ^ other) & SAME_STREAM:
                return 100
    return 0


#: In this order; a later one has to score more.
SCORERS = {"wave": _wave_score, "mp4": _mp4_score, "matroska": _matroska_score, "mp3": _mp3_score}


def _best(content: bytes) -> tuple[str, int]:
    found, best = "----", 0
    for name, score in SCORERS.items():
        if best < 100 and (own := score(content[:PROBE_BYTES])) > best:
            found, best = name, own
    return found, best


def probe_scores(files: DataFrame) -> DataFrame:
    """path, format, score (to 100) of each file, from its first 32 KiB behind an ID3v2 tag; "----" and 0 if none knows it."""
    c = F.col("content")
    tag = 10 + synchsafe(number(c, F.lit(6), 4)) + F.when(number(c, F.lit(5), 1).bitwiseAND(F.lit(0x10)) > 0, 10).otherwise(0)
    start = F.when(F.call_function("substring", c, F.lit(1), F.lit(3)) == F.lit(b"ID3"), F.coalesce(tag, F.lit(0))).otherwise(0)
    window = F.call_function("substring", c, (start + 1).cast("int"), F.lit(PROBE_BYTES))
    return parsed(files.select("path", window.alias("content")), lambda b: iter([_best(b)]), "format string, score int")


def probe(files: DataFrame) -> DataFrame:
    """path, format of each file: FLAC, AVI and JPEG by their first bytes, others by score, or MP3 by an ID3v2 tag or a lone
    header; "----" if it is none of these."""
    head = F.call_function("substring", F.col("content"), F.lit(1), F.lit(12))
    at = lambda first, n: F.call_function("substring", F.col("head"), F.lit(first), F.lit(n))
    is_ = lambda first, text: at(first, len(text)) == F.lit(text)
    known = F.when(is_(1, b"fLaC"), "flac").when(is_(1, b"RIFF") & (is_(9, b"AVI ") | is_(9, b"AVIX") | is_(9, b"AMV ")), "avi").when(is_(1, b"\xff\xd8"), "jpeg")
    tagged = F.when(is_(1, b"ID3") | (is_(1, b"\xff") & (at(2, 1) >= F.lit(b"\xe0"))), "mp3")
    scored = probe_scores(files).withColumn("best", F.when(F.col("score") > 0, F.col("format")))
    both = files.select("path", head.alias("head")).join(scored, "path", "left")
    return both.select("path", F.coalesce(known, "best", tagged, F.lit("----")).alias("format"))


def _wave(content: bytes) -> Iterator[tuple]:
    fmt = data = None
    facts = 0
    for _, _, name, at, size in walk_riff(content):
        if name == "fmt " and fmt is None:
            fmt = configs.wave_format(content[at : at + size])
        elif name == "fact" and size >= 4:
            facts = struct.unpack_from("<I", content, at)[0]
        elif name == "data":
            data = (at, size)
            break
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return
    if not fmt or not data:
        yield (*[None] * 10, "no data chunk" if fmt else "no valid fmt chunk")
        return
    tag, rate, per_second = fmt["tag"], fmt["rate"], fmt["bytes_per_second"]
    duration = 1_000_000 * facts // rate if tag != configs.WAVE_PCM and facts and rate else 1_000_000 * data[1] // per_second if per_second else None
    bitrate = rate * fmt["channels"] * fmt["bits"] if fmt["bits"] else 8 * per_second
    yield tag, configs.PCM_FORMATS.get((tag, fmt["bits"])), fmt["channels"], rate, fmt["bits"], fmt["mask"], duration, bitrate, *data, None


def wav_files(files: DataFrame) -> DataFrame:
    """path, tag, format (u8, s16, s24, s32, f32; null if not PCM), channels, rate, bits, mask, duration_us, bitrate, and the
    offset and size of the data of WAVE files; error says why a file has no more than that."""
    return parsed(files, _wave, "tag int, format string, channels int, rate long, bits int, mask long, duration_us long, bitrate long, offset long, size long, error string")


def wav_packets(files: DataFrame) -> DataFrame:
    """path, sample_idx, offset, size, pts, timescale, channels, bits: packets of 2048 samples of PCM WAV files.

    The data chunk bounds them, so what comes after it is no audio (B13). Files with a compressed or unknown format have
    no packets; wav_files() tells what they hold.
    """
    both = wav_files(files).filter("format IS NOT NULL").withColumn("frame", F.expr("CAST(channels * bits div 8 AS bigint)")).withColumn("n", F.expr("IF(frame > 0, size div frame, 0)")).filter("n > 0")
    step = both.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {WAV_SAMPLES})")))
    taken = F.least(F.lit(WAV_SAMPLES), F.col("n") - F.col("k") * WAV_SAMPLES)
    return step.select("path", F.col("k").alias("sample_idx"), (F.col("offset") + F.col("k") * WAV_SAMPLES * F.col("frame")).alias("offset"), (taken * F.col("frame")).alias("size"), (F.col("k") * WAV_SAMPLES).alias("pts"), F.col("rate").alias("timescale"), F.col("channels").cast("long").alias("channels"), F.col("bits").cast("long").alias("bits"))


def _mpeg_frames(data: bytes) -> list[tuple[int, int]]:
    """(offset, header) of places that may start a frame: eleven bits of sync."""
    out, at = [], data.find(b"\xff")
    while 0 <= at < len(data) - 3:
        if data[at + 1] >= 0xE0:
            out.append((at, struct.unpack_from(">I", data, at)[0]))
        at = data.find(b"\xff", at + 1)
    return out


def mp3_frames(files: DataFrame) -> DataFrame:
    """path, frame_idx, offset, frame_length, bitrate, sample_rate, channels, samples, pts of MPEG audio files.

    A header counts if it is valid and one that agrees with it in version, layer, rate and mode follows at its end, or
    it follows such a one.
    """

    @F.pandas_udf("array<struct<offset:long,head:long>>")
    def places(content: pd.Series) -> pd.Series:
        return content.map(lambda b: [{"offset": o, "head": h} for o, h in _mpeg_frames(b or b"")])

    heads = files.select("path", F.inline(places("content")))
    heads = heads.select("path", "offset", "head", *(c.alias(n) for n, c in mpeg_header(F.col("head")).items())).filter("version IS NOT NULL")
    alike = F.col("head").bitwiseAND(F.lit(SAME_STREAM))
    heads = heads.withColumn("kind", alike).withColumn("until", F.col("offset") + F.col("frame_length"))
    nxt = heads.select("path", F.col("offset").alias("until"), "kind", F.lit(True).alias("has_next"))
    prev = heads.select("path", F.col("until").alias("offset"), "kind", F.lit(True).alias("has_prev")).distinct()
    real = heads.join(nxt, ["path", "until", "kind"], "left").join(prev, ["path", "offset", "kind"], "left").filter("has_next OR has_prev")
    w = Window.partitionBy("path").orderBy("offset")
    n = F.coalesce(F.sum("samples").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return real.select("path", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), "offset", "frame_length", "bitrate", "sample_rate", "channels", "samples", n.alias("pts"))


def _mp3(content: bytes) -> Iterator[tuple]:
    start = id3_size(content)
    end = len(content) - (128 if content[-128:-125] == b"TAG" else 0)
    for at, word in _mpeg_frames(content[start : start + PROBE_BYTES]):
        frame, at = configs.mpeg_frame(word), at + start
        if not frame or at + frame["length"] > end:
            continue
        if at + frame["length"] + 4 <= end:
            other = struct.unpack_from(">I", content, at + frame["length"])[0]
            if not configs.mpeg_frame(other) or (word ^ other) & SAME_STREAM:
                continue
        first = content[at : at + frame["length"]]
        info = configs.xing(first) or configs.vbri(first) or {"kind": "cbr", "frames": 0, "bytes": 0, "toc": [], "encoder": "", "delay": 0, "padding": 0}
        size = info["bytes"] or end - at
        if info["frames"]:
            duration = 1_000_000 * info["frames"] * frame["samples"] // frame["rate"]
        else:
            duration = 8_000_000 * size // frame["bitrate"]
        toc = info["toc"] if info["kind"] == "vbri" else [size * x // 256 for x in info["toc"]]
        yield info["kind"], at, size, frame["rate"], frame["channels"], frame["bitrate"], info["frames"], duration, [at + x for x in toc], info["encoder"], info["delay"], info["padding"]
        return


def mp3_files(files: DataFrame) -> DataFrame:
    """path, kind (xing, vbri or cbr), first_frame, size, rate, channels, bitrate, frames, duration_us, toc (places in the
    file of equal parts of it), encoder, delay, padding of MPEG audio files, from their first frame."""
    return parsed(files, _mp3, "kind string, first_frame long, size long, rate long, channels int, bitrate long, frames long, duration_us long, toc array<bigint>, encoder string, delay int, padding int")


def mp3_seek(info: DataFrame, at_us: Column) -> DataFrame:
    """info (of mp3_files) with pos: where to read on from for a time, between two entries of the table of contents by share."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at_us / F.col("duration_us")))
    place = share * (F.size("toc") - 1)
    low = F.floor(place)
    a, b = F.get("toc", low.cast("int")), F.coalesce(F.get("toc", (low + 1).cast("int")), F.get("toc", low.cast("int")))
    by_toc = F.floor(a + (b - a) * (place - low))
    return info.withColumn("pos", F.when(F.size("toc") > 0, by_toc).otherwise(F.floor(F.col("size") * share) + F.col("first_frame")).cast("long"))


# What ID3v2 frames are called.
ID3_KEYS = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TALB": "album", "TAL": "album", "TCON": "genre", "TCO": "genre", "TYER": "year", "TYE": "year", "TRCK": "track", "TRK": "track", "TCOM": "composer", "TCM": "composer", "TBPM": "bpm", "TBP": "bpm", "TPE2": "album_artist", "TP2": "album_artist", "TCOP": "copyright", "TENC": "encoder"}


_CHARSETS = {0: ("latin-1", 1), 1: ("utf-16", 2), 2: ("utf-16-be", 2), 3: ("utf-8", 1)}


def _strings(data: bytes, charset: int, most: int) -> list[str]:
    """Up to `most` strings of a charset with zeros between them; the last one takes what is left."""
    name, width = _CHARSETS.get(charset, _CHARSETS[0])
    out = []
    while len(out) < most - 1:
        at = next((k for k in range(0, len(data) - width + 1, width) if not any(data[k : k + width])), len(data)) if width == 2 else data.find(b"\0") if b"\0" in data else len(data)
        out.append(data[:at].decode(name, "replace"))
        data = data[at + width :]
    return [*out, data.decode(name, "replace").rstrip("\0")]


def _id3_frames(data: bytes) -> dict[str, str]:
    """An ID3v2.2, 2.3 or 2.4 tag: texts by ID3_KEYS, comment, and by the frame's name user texts (TXXX:description), links
    (WOAR and so on) and pictures (APIC: type and size)."""
    size = id3_size(data)
    if not size:
        return {}
    version, flags = data[3], data[5]
    body = data[10:size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    head, tag = (6, 3) if version == 2 else (10, 4)
    safe = lambda raw: sum((x & 127) << 7 * (len(raw) - 1 - k) for k, x in enumerate(raw))
    at, out = 0, {}
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = int.from_bytes(body[:4], "big") + 4 if version == 3 else safe(body[:4])
    while at + head <= len(body) and body[at]:
        raw = body[at + tag : at + (6 if version == 2 else 8)]
        n = safe(raw) if version == 4 else int.from_bytes(raw, "big")
        name, value = body[at : at + tag].decode("latin-1"), body[at + head : at + head + n]
        if version == 4 and value and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        at += head + n
        if not value:
            continue
        if name in ID3_KEYS:
            out[ID3_KEYS[name]] = _strings(value[1:], value[0], 1)[0]
        elif name in ("TXXX", "TXX", "WXXX", "WXX"):
            described, text = _strings(value[1:], value[0], 2)
            out[f"{name}:{described}"] = text
        elif name in ("COMM", "COM", "USLT", "ULT"):
            key, text = "comment" if name[0] == "C" else "lyrics", _strings(value[4:], value[0], 2)[1]
            out[key] = f"{out[key]}\n{text}" if key in out else text
        elif name[0] == "W":
            out[name] = value.split(b"\0")[0].decode("latin-1")
        elif name in ("APIC", "PIC"):
            kind, rest = (value[1:4].decode("latin-1"), value[4:]) if name == "PIC" else (value[1:].split(b"\0")[0].decode("latin-1"), value[1:].partition(b"\0")[2])
            name_, width = _CHARSETS.get(value[0], _CHARSETS[0])
            described = _strings(rest[1:], value[0], 2)[0]
            start = 1 + len(described.encode(name_)) + width if name_ != "utf-16" else 1 + 2 * len(described.encode("utf-16-le")) // 2 + 4
            out[name] = f"{kind} {max(len(rest) - start, 0)}"
    return out


def _id3v1(data: bytes) -> dict[str, str]:
    """The ID3v1 tag at the end of a file; of ID3v1.1 with the track. Fields are trimmed, empty ones left out."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    text = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").strip()
    out = {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93), "year": text(93, 97), "comment": text(97, 127)}
    if not tag[125] and tag[126]:
        out["track"] = str(tag[126])
    if tag[127] < 80:
        out["genre"] = f"({tag[127]})"
    return {k: v for k, v in out.items() if v}


def id3_tags(files: DataFrame) -> DataFrame:
    """path, tags (map) of files that start with an ID3v2 tag or end with an ID3v1 tag, which gives what the first has not;
    genres by name (B14, B16: as the format has it)."""

    def rows(content: bytes) -> Iterator[tuple]:
        if tags := _id3v1(content) | _id3_frames(content):
            yield (list(tags.items()),)

    named = parsed(files, rows, "tags map<string,string>")
    return named.withColumn("tags", F.transform_values("tags", lambda k, v: F.when(k == "genre", genre(v)).otherwise(v)))


def _numbers(body: bytes, at: int, kind: str, count: int, width: int = 1) -> list[tuple[int, ...]]:
    """Up to `count` rows of `width` numbers, fewer where the box is cut off."""
    size = np.dtype(kind).itemsize * width
    count = max(0, min(count, (len(body) - at) // size))
    return list(map(tuple, np.frombuffer(body, kind, count * width, at).reshape(count, width).tolist()))


def _mp4_rows(content: bytes) -> Iterator[tuple]:
    """(track, name, entry, a, b, text, body) of the boxes that describe samples; one row for each of a table's entries."""
    tracks: list[int] = []
    names: list[str] = []
    for k, (parent, _, name, at, size) in enumerate(walk_mp4(content)):
        track = k if name == "trak" else tracks[parent] if parent >= 0 else -1
        tracks.append(track)
        names.append(name)
        if track < 0 or name == "trak":
            continue
        above = names[parent] if parent >= 0 else ""
        if above == "stsd":
            yield track, "entry", k, None, None, name, None
        if above not in ("stbl", "mdia") and name not in ("avcC", "esds"):
            continue
        body = content[at : at + size]
        count = int.from_bytes(body[4:8], "big")
        rows: list[tuple] = []
        if name in ("stts", "ctts"):
            rows = _numbers(body, 8, ">i4" if name == "ctts" else ">u4", count, 2)
            rows = [(n & 0xFFFFFFFF, x) for n, x in rows]
        elif name == "stsc":
            rows = [r[:2] for r in _numbers(body, 8, ">u4", count, 3)]
        elif name in ("stco", "co64"):
            rows = [(x, None) for (x,) in _numbers(body, 8, ">u4" if name == "stco" else ">u8", count)]
            name = "chunk"
        elif name == "stss":
            rows = [(x - 1, None) for (x,) in _numbers(body, 8, ">u4", count)]
        elif name == "stsz":
            n = int.from_bytes(body[8:12], "big")
            if count:  # one size for all: a run of as many as the file can hold
                yield track, "stsz run", 0, count, min(n, len(content) // count), None, None
            else:
                rows = [(x, None) for (x,) in _numbers(body, 12, ">u4", n)]
        elif name == "stz2":
            n, width, name = int.from_bytes(body[8:12], "big"), body[7] if len(body) > 7 else 0, "stsz"
            if width == 4:
                rows = [(x, None) for b in body[12:] for x in (b >> 4, b & 15)][:n]
            elif width in (8, 16):
                rows = [(x, None) for (x,) in _numbers(body, 12, f">u{width // 8}", n)]
        elif name == "sdtp":
            rows = [(x, None) for x in body[4:]]
        elif name == "mdhd" and len(body) >= 20:
            wide = body[0] == 1
            scale, length = (int.from_bytes(body[20:24], "big"), int.from_bytes(body[24:32], "big")) if wide else (int.from_bytes(body[12:16], "big"), int.from_bytes(body[16:20], "big"))
            rows = [(scale, length)]
        elif name in ("avcC", "esds"):
            yield track, name, 0, None, None, None, body
        for entry, (x, y) in enumerate(rows):
            yield track, name, entry, x, y, None, None


def mp4_tables(files: DataFrame) -> DataFrame:
    """path, track (the trak's node), name, entry, a, b, text, body: the tables of samples of MP4 files, written once.

    One walk reads a file; its payload goes no further.
    """
    return materialize(parsed(files, _mp4_rows, "track long, name string, entry long, a long, b long, text string, body binary"), "mp4-tables")


def mp4_tracks(files: DataFrame) -> DataFrame:
    """path, track, timescale, duration, entry, codec, nal_length (of H.264), sample_rate and channels (of AAC), and csd, the
    decoder's configuration, of MP4 files."""
    t = parsed(files, _mp4_rows, "track long, name string, entry long, a long, b long, text string, body binary").filter("name IN ('mdhd', 'entry', 'avcC', 'esds')")
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    first = F.min(F.when(F.col("name") == "entry", F.struct("entry", "text")))["text"]
    got = t.groupBy("path", "track").agg(of("mdhd", "a").alias("timescale"), of("mdhd", "b").alias("duration"), first.alias("entry"), of("avcC", "body").alias("avcc"), of("esds", "body").alias("esds"))

    @F.pandas_udf("nal_length int, sample_rate long, channels int, csd binary")
    def config(avcc: pd.Series, esds: pd.Series) -> pd.DataFrame:
        out = []
        for a, e in zip(avcc, esds, strict=True):
            video, audio = configs.avcc(a) if a else None, configs.esds(e) if e else None
            aac = configs.audio_specific_config(audio["csd"]) if audio else None
            out.append((video["nal_length"] if video else None, aac["rate"] if aac else None, aac["channels"] if aac else None, a if video else audio["csd"] if audio else None))
        return pd.DataFrame(out, columns=["nal_length", "sample_rate", "channels", "csd"], dtype=object)

    codec = F.create_map(*(F.lit(x) for pair in MP4_CODECS for x in pair))
    got = got.withColumn("config", config("avcc", "esds"))
    return got.select("path", "track", "timescale", "duration", "entry", F.coalesce(F.element_at(codec, F.col("entry")), F.lit("----")).alias("codec"), "config.*")


def mp4_samples(files: DataFrame) -> DataFrame:
    """The sample table of each track of MP4 files: path, track, sample_idx, chunk, offset, size, dts, pts, flags."""
    return samples_of(mp4_tables(files))


def samples_of(t: DataFrame) -> DataFrame:
    """mp4_samples() of mp4_tables()."""
    keys = ["path", "track"]
    own = lambda name, **cols: t.filter(F.col("name") == name).select(*keys, *(F.col(c).alias(n) for n, c in cols.items()))
    runs = own("stsz run", entry="entry", count="b", size="a")
    sizes = own("stsz", sample_idx="entry", size="a").unionByName(sample_table.expand_runs(runs, keys, ["entry"], "count").select(*keys, "sample_idx", "size"))
    stco = own("chunk", entry="entry", chunk_offset="a").select(*keys, (F.col("entry") + 1).alias("chunk"), "chunk_offset")
    return sample_table.build(
        own("stts", entry="entry", count="a", delta="b"),
        own("ctts", entry="entry", count="a", shift="b"),
        own("stsc", first_chunk="a", per_chunk="b"),
        stco,
        sizes,
        own("stss", sample_idx="a"),
        keys,
        own("sdtp", sample_idx="entry", depends="a"),
    )


def packets(samples: DataFrame, files: DataFrame) -> DataFrame:
    """samples with data, their bytes behind their prefix, if they have one; only here the payload is read."""
    data = F.call_function("substring", F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    both = samples.join(files.select("path", "content").hint("merge"), "path")  # neither side is small
    if "prefix" in samples.columns:
        data = F.concat(F.coalesce("prefix", F.lit(b"")), data)
    return both.withColumn("data", data).drop("content", "prefix")


def _vint(data: bytes, at: int) -> tuple[int, int]:
    """(an EBML number, where it ends)."""
    n = 9 - data[at].bit_length()
    if n > 8:
        raise IndexError("no EBML number")
    return int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1, at + n


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, time, flags, [(offset, size)]) of a block: its frames, taken out of their lace. No frames if it is cut off."""
    try:
        track, at = _vint(data, at)
        (time,), flags, at = struct.unpack_from(">h", data, at), data[at + 2], at + 3
        lace, sizes = flags >> 1 & 3, []
        if lace:
            count, at = data[at] + 1, at + 1
            if lace == 1:
                for _ in range(count - 1):
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    sizes.append(size + data[at])
                    at += 1
            elif lace == 3:
                size, at = _vint(data, at)
                sizes.append(size)
                for _ in range(count - 2):
                    raw, after = _vint(data, at)
                    size += raw - ((1 << 7 * (after - at) - 1) - 1)
                    sizes.append(size)
                    at = after
                sizes = sizes[: count - 1]
            else:
                sizes = [(end - at) // count] * (count - 1)
        sizes.append(end - at - sum(sizes))
    except (IndexError, struct.error):
        return 0, 0, 0, []
    if min(sizes) < 0 or end > len(data):
        return track, time, flags, []
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return track, time, flags, list(zip(starts, sizes, strict=True))


def _mkv_parts(content: bytes) -> tuple[int, dict[int, dict], list[tuple]] | None:
    """(timecode scale in ns, tracks by number, nodes), None if it isn't a Matroska file."""
    nodes = list(walk_ebml(content))
    number = lambda at, size: int.from_bytes(content[at : at + size], "big")
    scale, owner, entries = 1_000_000, {}, {}
    kind = None
    for k, (parent, _, name, at, size) in enumerate(nodes):
        owner[k] = k if name == "TrackEntry" else owner.get(parent, -1)
        if name == "DocType":
            kind = content[at : at + size].rstrip(b"\0")
        elif name == "TimecodeScale":
            scale = number(at, size) or scale
        elif name == "TrackEntry":
            entries[k] = {"number": None, "codec": None, "ns": 0, "scale": 1.0, "algo": None, "prefix": None}
        elif owner[k] >= 0:
            e = entries[owner[k]]
            if name == "TrackNumber":
                e["number"] = number(at, size)
            elif name == "CodecID":
                e["codec"] = content[at : at + size].rstrip(b"\0").decode("utf-8", "replace")
            elif name == "DefaultDuration":
                e["ns"] = number(at, size)
            elif name == "TrackTimecodeScale" and size in (4, 8):
                e["scale"] = struct.unpack_from(">f" if size == 4 else ">d", content, at)[0] or 1.0
            elif name == "ContentCompAlgo":
                e["algo"] = number(at, size)
            elif name == "ContentCompSettings":
                e["prefix"] = content[at : at + size]
    if kind != b"matroska":
        return None
    return scale, {e["number"]: e for e in entries.values() if e["number"] is not None}, nodes


def _mkv_tracks(content: bytes) -> Iterator[tuple]:
    if found := _mkv_parts(content):
        for number, e in found[1].items():
            yield number, e["codec"], e["ns"], e["algo"], e["prefix"]


def mkv_tracks(files: DataFrame) -> DataFrame:
    """path, track (its number), codec_id, frame_ns, compression (3: a stripped prefix), prefix and codec of Matroska files;
    "----" if the codec id is not known."""
    codec: Column = F.lit("----")
    for prefix, name in reversed(MATROSKA_CODECS):
        codec = F.when(F.col("codec_id").startswith(prefix), name).otherwise(codec)
    return parsed(files, _mkv_tracks, "track long, codec_id string, frame_ns long, compression int, prefix binary").withColumn("codec", codec)


def _mkv_packets(content: bytes) -> Iterator[tuple]:
    if not (found := _mkv_parts(content)):
        return
    scale, tracks, nodes = found
    times = {parent: int.from_bytes(content[at : at + size], "big") for parent, _, name, at, size in nodes if name == "Timecode"}
    for parent, _, name, at, size in nodes:
        if name == "Block":
            parent = nodes[parent][0]
        elif name != "SimpleBlock":
            continue
        track, time, flags, frames = block_frames(content, at, at + size)
        if parent not in times or track not in tracks:
            continue
        own = tracks[track]
        kind = sample_table.SYNC * (flags >> 7) + sample_table.DISPOSAL * (flags & 1) + sample_table.REFERENCE * (flags >> 3 & 1)
        for k, (start, n) in enumerate(frames):
            pts = times[parent] + time + k * (own["ns"] // scale)
            yield track, int(pts / own["scale"]), 1_000_000_000 // scale, kind, start, n, own["prefix"] if own["algo"] == 3 else None


def mkv_packets(files: DataFrame) -> DataFrame:
    """path, track, pts, timescale, flags, offset, size, prefix: packets of the known tracks of Matroska files.

    A lace's frames follow each other by the track's frame time. Blocks of groups have no key flag, as the format has it.
    packets() puts a prefix that was stripped before the data.
    """
    return parsed(files, _mkv_packets, "track long, pts long, timescale long, flags int, offset long, size long, prefix binary")


def _mkv_cues(content: bytes) -> Iterator[tuple]:
    found = _mkv_parts(content)
    times, positions = {}, {}
    for k, (parent, _, name, at, size) in enumerate(found[2] if found else []):
        value = int.from_bytes(content[at : at + size], "big") if name.startswith("Cue") and size <= 8 else 0
        if name == "CueTime":
            times[parent] = value
        elif name == "CueTrackPositions":
            positions[k] = [parent, None, None]
        elif name in ("CueTrack", "CueClusterPosition") and parent in positions:
            positions[parent][1 if name == "CueTrack" else 2] = value
    for point, track, pos in positions.values():
        yield track, times.get(point), pos


def mkv_cues(files: DataFrame) -> DataFrame:
    """path, track, time, pos: the cue points of Matroska files, one row for each of their tracks."""
    return parsed(files, _mkv_cues, "track long, time long, pos long")


# Names of some TIFF and Exif tags.
TIFF_NAMES = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime", 0x8769: "ExifIFD", 0x8825: "GPSIFD", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"}


def _exif(tiff: bytes) -> dict[str, str]:
    """Tags of the first directory of a TIFF body and of those it points to, by TIFF_NAMES."""
    return {TIFF_NAMES.get(tag, f"0x{tag:04X}"): value for directory, tag, _, _, value in directories(tiff) if directory in ("IFD0", "Exif", "GPS") and tag not in (0x8769, 0x8825)}


def exif(files: DataFrame) -> DataFrame:
    """path, tags (map) of JPEG files with an Exif segment; tags.tags() has all of them by directory, with their types."""

    @F.pandas_udf("map<string,string>")
    def tags(body: pd.Series) -> pd.Series:
        return body.map(lambda b: _exif(b[6:]) if b[:6] == b"Exif\0\0" else {})

    segment = F.call_function("substring", F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    found = elements(files, "jpeg").filter("name = 'APP1'").join(files, "path").select("path", tags(segment).alias("tags"))
    return found.filter(F.size("tags") > 0)
