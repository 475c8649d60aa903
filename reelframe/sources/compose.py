"""Small media files made from payloads, for queries and tests that need some."""

from __future__ import annotations

import struct

from reelframe.functions.configs import compose_avcc


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def wav(payload: bytes, rate: int = 8000, channels: int = 2, bits: int = 16) -> bytes:
    frame = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * frame, frame, bits)
    return _chunk(b"RIFF", b"WAVE" + _chunk(b"fmt ", fmt) + _chunk(b"data", payload))


def mp3(payload: bytes, least: int = 2) -> bytes:
    """MPEG-1 layer III frames of 128 kbit/s at 44100 Hz that carry 413 bytes of a payload each, every third one padded."""
    frames = max(least, -(-len(payload) // 413))
    own = lambda k: payload[413 * k : 413 * k + 413].ljust(413 + (k % 3 == 2), b"\0")
    return b"".join(struct.pack(">I", 0xFFFB9000 | (k % 3 == 2) << 9) + own(k) for k in range(frames))


def xing(frames: int, size: int, toc: list[int], encoder: bytes = b"") -> bytes:
    """A frame of mp3()'s kind that holds a Xing header; size counts it."""
    head = b"Xing" + struct.pack(">III", 7, frames, size) + bytes(toc) + encoder
    return (struct.pack(">I", 0xFFFB9000) + bytes(32) + head).ljust(417, b"\0")


def id3(title: str, artist: str, genre: str, comment: str = "") -> bytes:
    """An ID3v2.3 tag with UTF-8 and UTF-16 texts."""
    frame = lambda tag, body: tag + struct.pack(">IH", len(body), 0) + body
    body = frame(b"TIT2", b"\x03" + title.encode()) + frame(b"TPE1", b"\x01\xff\xfe" + artist.encode("utf-16-le")) + frame(b"TCON", b"\0" + genre.encode("latin-1", "replace"))
    body += frame(b"COMM", b"\x03engshort\0" + comment.encode())
    size = len(body)
    return b"ID3\x03\0\0" + bytes(size >> s & 127 for s in (21, 14, 7, 0)) + body


def box(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + tag + body


def mp4(samples: list[bytes], per_chunk: int = 3, timescale: int = 1000) -> bytes:
    """One video track: 40 ticks a sample, every fifth one a sync sample, shifts of 80 and 40 in turn; no other sample depends
    on every third one."""
    n = len(samples)
    full = lambda tag, *numbers: box(tag, b"\0\0\0\0" + struct.pack(f">{len(numbers)}I", *numbers))
    chunks = [samples[i : i + per_chunk] for i in range(0, n, per_chunk)]
    ftyp = box(b"ftyp", b"isom\0\0\0\0isom")
    at, offsets = len(ftyp) + 8, []
    for c in chunks:
        offsets.append(at)
        at += sum(map(len, c))
    rest = n % per_chunk
    runs = [(1, per_chunk, 1)] * (n >= per_chunk) + [(len(chunks), rest, 1)] * (rest > 0)
    syncs = range(1, n + 1, 5)
    stbl = b"".join([
        box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", b"\0" * 78 + box(b"avcC", compose_avcc([b"\x67\x42\x00\x1e"], [b"\x68\xce"])))),
        full(b"stts", 1, n, 40),
        full(b"ctts", n, *(x for k in range(n) for x in (1, 80 if k % 2 else 40))),
        full(b"stsc", len(runs), *(x for r in runs for x in r)),
        full(b"stsz", 0, n, *map(len, samples)),
        full(b"stco", len(offsets), *offsets),
        full(b"stss", len(syncs), *syncs),
        box(b"sdtp", bytes(4) + bytes(2 << 2 if k % 3 == 2 else 0 for k in range(n))),
    ])
    mdhd = full(b"mdhd", 0, 0, timescale, 40 * n, 0)
    trak = box(b"trak", box(b"mdia", mdhd + full(b"hdlr", 0, 0x76696465, 0, 0, 0) + box(b"minf", box(b"stbl", stbl))))
    return ftyp + box(b"mdat", b"".join(samples)) + box(b"moov", full(b"mvhd", 0, 0, timescale, 40 * n) + trak)


def vint(n: int, length: int = 8) -> bytes:
    return (n | 1 << 7 * length).to_bytes(length, "big")


def ebml(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames as a Xiph (1), fixed (2) or EBML (3) lace."""
    sizes, head = list(map(len, frames[:-1])), bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == 3:
        steps = [b - a for a, b in zip(sizes, sizes[1:])]
        head += vint(sizes[0], 2) + b"".join(vint(d + (1 << 13) - 1, 2) for d in steps)
    return head + b"".join(frames)


def mkv(clusters: list[list[bytes]]) -> bytes:
    """Track 1 and, with a number of two bytes, track 300; a cluster a second, of frames 40 ms apart.

    A cluster's first frame is a key frame in a simple block, the second one in a block group, the third to fifth a Xiph lace,
    the sixth to eighth an EBML lace, the ninth and tenth a fixed lace if they are equally long. The others are simple
    blocks of track 300, of whose packets a "!" is stripped, and can be discarded. Each cluster has a cue.
    """
    number = lambda code, n: ebml(code, n.to_bytes(4, "big"))
    head = ebml(0x1A45DFA3, ebml(0x4282, b"matroska"))
    entry = lambda n, codec, more: ebml(0xAE, number(0xD7, n) + number(0x83, 1) + number(0x23E383, 40_000_000) + ebml(0x86, codec) + more)
    strip = ebml(0x6D80, ebml(0x6240, ebml(0x5034, number(0x4254, 3) + ebml(0x4255, b"!"))))
    tracks = ebml(0x1654AE6B, entry(1, b"V_VP9", b"") + entry(300, b"A_AAC", strip))
    body = [ebml(0x1549A966, number(0x2AD7B1, 1_000_000)), tracks]
    at, cues = sum(map(len, body)), []
    for t, frames in enumerate(clusters):
        block = lambda k, flags, data, track=vint(1, 1): track + struct.pack(">hB", 40 * k, flags) + data
        own = [ebml(0xA3, block(0, 0x80, frames[0]))]
        if len(frames) > 1:
            own.append(ebml(0xA0, ebml(0xA1, block(1, 0, frames[1]))))
        for first, stop, kind in ((2, 5, 1), (5, 8, 3), (8, 10, 2)):
            some = frames[first:stop]
            if len(some) == 1 or kind == 2 and len(set(map(len, some))) > 1:
                own += [ebml(0xA3, block(first + k, 0, f)) for k, f in enumerate(some)]
            elif some:
                own.append(ebml(0xA3, block(first, kind << 1, lace(some, kind))))
        own += [ebml(0xA3, block(10 + k, 1, f, vint(300, 2))) for k, f in enumerate(frames[10:])]
        cues.append((1000 * t, at))
        body.append(ebml(0x1F43B675, number(0xE7, 1000 * t) + b"".join(own)))
        at += len(body[-1])
    body.append(ebml(0x1C53BB6B, b"".join(ebml(0xBB, number(0xB3, t) + ebml(0xB7, number(0xF7, 1) + number(0xF1, pos))) for t, pos in cues)))
    return head + ebml(0x18538067, b"".join(body))


def jpeg(comment: bytes, make: bytes, orientation: int, endian: str = "<") -> bytes:
    """Segments of a JPEG file with an Exif directory; the picture itself is a stub."""
    make = (make + b"\0").ljust(5, b"\0")  # longer than the four bytes that would stand in the entry itself
    entries = struct.pack(endian + "H", 2) + struct.pack(endian + "HHII", 0x010F, 2, len(make), 38) + struct.pack(endian + "HHIHH", 0x0112, 3, 1, orientation, 0)
    tiff = (b"II*\0" if endian == "<" else b"MM\0*") + struct.pack(endian + "I", 8) + entries + struct.pack(endian + "I", 0) + make
    segment = lambda code, body: struct.pack(">BBH", 0xFF, code, len(body) + 2) + body
    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x02\0\0\x01\0\x01\0\0"), segment(0xE1, b"Exif\0\0" + tiff), *(segment(0xFE, comment[i : i + 60000]) for i in range(0, max(len(comment), 1), 60000)), segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + b"\x01\x11\0"), segment(0xDA, b"\x01\x01\0\0\x3f\0")]
    return b"".join(parts) + b"\x12\x34\xff\xd9"


def tiff(order: str, ifd0: list[tuple], exif: list[tuple], gps: list[tuple], thumbnail: bytes = b"") -> bytes:
    """A TIFF body of directories with entries (tag, type, count, bytes), and one after the first that names a thumbnail."""
    number = lambda tag, n: (tag, 4, 1, struct.pack(order + "I", n))
    sizes = [2 + 12 * n + 4 for n in (len(ifd0) + 2, len(exif), len(gps), 2)]
    starts = [8 + sum(sizes[:k]) for k in range(5)]
    values = starts[4]
    after = values + sum(len(e[3]) for part in (ifd0, exif, gps) for e in part if len(e[3]) > 4)
    parts = [[*ifd0, number(0x8769, starts[1]), number(0x8825, starts[2])], exif, gps, [number(0x0201, after), number(0x0202, len(thumbnail))]]
    out, apart = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), b""
    for k, part in enumerate(parts):
        out += struct.pack(order + "H", len(part))
        for tag, kind, n, raw in part:
            place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", values + len(apart))
            apart += raw if len(raw) > 4 else b""
            out += struct.pack(order + "HHI", tag, kind, n) + place
        out += struct.pack(order + "I", starts[3] if k == 0 and thumbnail else 0)
    return out + apart + thumbnail


def jpeg_of(*segments: tuple[int, bytes]) -> bytes:
    """A JPEG file of segments (code, body) whose picture is a stub."""
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, code, len(body) + 2) + body for code, body in segments) + b"\xff\xda\0\2\x12\xff\xd9"
