"""Media columns: payloads as motion JPEG in AVI, read back through the index, with shots found in the frames.

A payload byte is one 8 x 8 block of a grey frame, all of one level. Such a block has only a DC coefficient, and with a
quantizer of 8 that coefficient is the level itself (less 128), so baseline JPEG keeps it exactly. A row of 64 blocks is
one restart interval; restart intervals can be coded and decoded side by side. Files of other writers are read as well:
their frames are decoded block by block, with all coefficients.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import by_bytes, read_table

ROW = 64
MOST_ROWS = 16
FPS = 25
BINS = 16
WINDOW = 8
BATCH_BYTES = 1 << 20
#: Bits of numbers from 0 to 255.
_SIZE = np.array([int(i).bit_length() for i in range(256)], np.int64)


@lru_cache(64)
def jpeg_header(rows: int) -> bytes:
    """All of a frame before its coded data: 64 blocks wide, so many rows of blocks high."""
    segment = lambda code, body: struct.pack(">BBH", 0xFF, code, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8",
        segment(0xDB, b"\0" + bytes([8]) * 64),
        segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + b"\x01\x11\x00"),
        segment(0xC4, b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))),  # DC: sizes 0 to 8, four bits each
        segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"),  # AC: end of block, one bit
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def encode_rows(levels: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coded bytes of all rows, where each row starts). levels: rows x 64; a row is followed by its restart marker,
    which its number in the frame gives, or by the end of the image if it is the frame's last."""
    v = levels.astype(np.int64)
    d = np.diff(v, axis=1, prepend=128)
    size = _SIZE[np.abs(d)]
    code = ((size << size) | (np.where(d < 0, d + (1 << size) - 1, d))) << 1
    length = size + 5
    ends = np.cumsum(length, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (ends - length + 8 * base[:-1, None]).ravel()
    word = code.ravel() << (24 - length.ravel() - (at & 7))
    at >>= 3
    total = int(base[-1])
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount(at + k, (word >> (16 - 8 * k)) & 255, total + 3)
    out = out[:total].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (8 * n_bytes - ends[:, -1])) - 1).astype(np.uint8)
    # a zero follows each 255, then each row gets its marker
    reps = 1 + (out == 255)
    row_of = np.repeat(np.arange(len(v)), n_bytes)
    stuffed = np.repeat(out, reps)
    place = np.cumsum(reps)
    stuffed[place[reps == 2] - 1] = 0
    starts = np.concatenate([[0], place[base[1:] - 1]]) + 2 * np.arange(len(v) + 1)
    final = np.empty(len(stuffed) + 2 * len(v), np.uint8)
    final[np.arange(len(stuffed)) + 2 * np.repeat(row_of, reps)] = stuffed
    final[starts[1:] - 2] = 255
    final[starts[1:] - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return final, starts


def avi(frames: list[bytes], rows: int, payload_bytes: int) -> bytes:
    """An AVI file of motion-JPEG frames with its index; the length of the payload is the stream's driver data."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, 8 * ROW, 8 * rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, 8 * ROW, 8 * rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * ROW, 8 * rows, 1, 8, b"MJPG", 64 * ROW * rows, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + chunk(b"strd", struct.pack("<Q", payload_bytes)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, each of a positive multiple of 64 bytes. The last frame is filled up with zeros."""
    shapes = []  # (rows of a frame, frames)
    blocks = []
    for p in payloads:
        n = len(p) // ROW
        rows = min(n, MOST_ROWS)
        frames = -(-n // rows)
        shapes.append((rows, frames))
        blocks.append(p.ljust(rows * frames * ROW, b"\0"))
    number = np.concatenate([np.tile(np.arange(r), f) for r, f in shapes])
    height = np.concatenate([np.full(r * f, r) for r, f in shapes])
    coded, starts = encode_rows(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, ROW), number == height - 1, number)
    data, out, at = coded.tobytes(), [], 0
    for (rows, frames), p in zip(shapes, payloads, strict=True):
        edges = starts[at : at + rows * frames + 1 : rows].tolist()
        at += rows * frames
        head = jpeg_header(rows)
        out.append(avi([head + data[a:b] for a, b in zip(edges, edges[1:])], rows, len(p)))
    return out


def riff(data: bytes, first: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, size) of the chunks of a RIFF file's part; lists are named by their type and opened after themselves."""
    at, end = first, len(data) if end is None else end
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag in (b"RIFF", b"LIST"):
            yield data[at + 8 : at + 12], at + 12, size - 4
            if data[at + 8 : at + 12] != b"movi":  # its frames are found through the index
                yield from riff(data, at + 12, min(end, at + 8 + size))
        else:
            yield tag, at + 8, size
        at += 8 + size + (size & 1)


def read_index(data: bytes) -> tuple[int | None, list[tuple[int, int]], float]:
    """(payload length, [(start, size) of each frame], frames a second) of an AVI file, from its headers and index.

    Index entries count from the list of frames or, as some write them, from the file's start. Files of other writers have
    no payload length.
    """
    parts = {tag: (at, size) for tag, at, size in reversed(list(riff(data)))}
    if b"AVI " not in parts or b"idx1" not in parts or b"movi" not in parts:
        raise ValueError("not an AVI file with an index")
    at, size = parts[b"idx1"]
    entries = [struct.unpack_from("<4sIII", data, at + 16 * k) for k in range(size // 16)]
    entries = [(o, n) for tag, _, o, n in entries if tag[2:] in (b"dc", b"db") and n]
    base = parts[b"movi"][0] - 4
    if entries and data[base + entries[0][0] + 2 : base + entries[0][0] + 4] not in (b"dc", b"db"):
        base = 0
    micros = struct.unpack_from("<I", data, parts[b"avih"][0])[0] if b"avih" in parts else 0
    own = struct.unpack_from("<Q", data, parts[b"strd"][0])[0] if b"strd" in parts and parts[b"strd"][1] == 8 else None
    return own, [(base + 8 + o, n) for o, n in entries], 1_000_000 / micros if micros else float(FPS)


#: Where a coefficient's place in the coded order lies in its block: along the block's diagonals, in turn up and down.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _codes(body: bytes) -> np.ndarray:
    """A Huffman table as size | length << 8 of the code that 16 bits start with."""
    table, next_code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            table[next_code << (16 - length) : (next_code + 1) << (16 - length)] = body[k] | length << 8
            next_code, k = next_code + 1, k + 1
        next_code <<= 1
    return table


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes of a baseline JPEG image, each component in its own resolution: all blocks with all coefficients,
    dequantized and transformed back. Progressive and arithmetic ones are refused."""
    at, quant, codes, shape, parts, interval = 2, {}, {}, None, [], 0
    while True:
        code, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif code == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                codes[body[0]] = _codes(body[1:end])
                body = body[end:]
        elif code in (0xC0, 0xC1):
            shape = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= code <= 0xCF and code != 0xC8:
            raise ValueError("not a baseline image")
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        at += 2 + size
        if code == 0xDA:
            break
    if shape is None or body[0] != len(parts):
        raise ValueError("not one scan of all components")
    tables = {body[1 + 2 * k]: (codes[body[2 + 2 * k] >> 4], codes[16 | body[2 + 2 * k] & 15]) for k in range(body[0])}
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-shape[1] // (8 * wide)), -(-shape[0] // (8 * high))
    found = {p[0]: np.zeros((down * p[2], across * p[1], 64), np.int64) for p in parts}
    stop = data.rindex(b"\xff\xd9") if b"\xff\xd9" in data[at:] else len(data)
    runs = [r.replace(b"\xff\0", b"\xff") + bytes(8) for r in re.split(rb"\xff[\xd0-\xd7]", data[at:stop])]
    place, run, level = 0, -1, {}

    def take(table: np.ndarray | None, n: int = 0) -> int:
        """The next code of a table, or the next n bits."""
        nonlocal place
        bits = int.from_bytes(runs[run][place >> 3 : (place >> 3) + 4], "big") << (place & 7) & 0xFFFFFFFF
        if table is None:
            place += n
            return bits >> (32 - n)
        got = int(table[bits >> 16])
        if not got:
            raise ValueError("no such code")
        place += got >> 8
        return got & 255

    def amount(n: int) -> int:
        v = take(None, n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for unit in range(across * down):
        if unit % interval == 0 if interval else not unit:
            run, place, level = run + 1, 0, dict.fromkeys(found, 0)
            if run == len(runs):
                raise ValueError("restart intervals are missing")
        for name, h, v, _ in parts:
            dc, ac = tables[name]
            for k in range(h * v):
                block = found[name][unit // across * v + k // h, unit % across * h + k % h]
                level[name] += amount(take(dc))
                block[0], at = level[name], 1
                while at < 64:
                    both = take(ac)
                    if not both:
                        break
                    at += both >> 4
                    if both & 15:
                        block[_ZIGZAG[at]] = amount(both & 15)
                    at += 1
    planes = []
    for name, h, v, q in parts:
        steps = np.empty(64, np.int64)
        steps[_ZIGZAG] = quant[q]
        blocks = (found[name] * steps).reshape(*found[name].shape[:2], 8, 8)
        pixels = np.clip(np.rint(_COSINES @ blocks @ _COSINES.T) + 128, 0, 255).astype(np.uint8)
        plane = pixels.swapaxes(1, 2).reshape(8 * pixels.shape[0], 8 * pixels.shape[1])
        planes.append(plane[: -(-shape[0] * v // high), : -(-shape[1] * h // wide)])
    return planes


def read_levels(files: list[bytes]) -> list[np.ndarray]:
    """Levels of the frames of AVI files, frames first: of own files of their blocks, of others of the first plane's pixels."""
    out = []
    for data in files:
        own, frames, _ = read_index(data)
        try:
            out.append(decode([data])[0][1] if own is not None else np.stack([decode_jpeg(data[at : at + n])[0] for at, n in frames]))
        except (IndexError, KeyError, struct.error) as e:
            raise ValueError("a frame is damaged") from e
    return out


@lru_cache(256)
def _frame_format(head: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(rows, columns, quantizer of DC, DC table, AC table) of a frame's header, for grey frames with a restart interval
    of one row."""
    at, tables, shape, quantizer = 2, {}, None, None
    while at < len(head):
        code, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if code == 0xDB:
            quantizer = body[1]
        elif code == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or body[5] != 1:
                raise ValueError("not a grey baseline frame")
        elif code == 0xC4:
            tables[body[0]] = _codes(body[1:])
        elif code == 0xDD and struct.unpack(">H", body)[0] * 8 != shape[1]:
            raise ValueError("a restart interval has to be one row")
        at += 2 + size
    return shape[0] // 8, shape[1] // 8, quantizer, tables[0x00], tables[0x10]


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, levels of the frames' blocks as frames x rows x 64) of AVI files; their rows are decoded side by side."""
    scans, heads, shapes, lengths = [], [], [], []
    for data in files:
        n, frames, _ = read_index(data)
        for at, size in frames:
            head = at + 2
            while data[head + 1] != 0xDA:
                head += 2 + struct.unpack_from(">H", data, head + 2)[0]
            head += 2 + struct.unpack_from(">H", data, head + 2)[0]
            heads.append(data[at:head])
            scans.append(data[head : at + size])
        shapes.append((_frame_format(heads[-1])[0], len(frames)))
        lengths.append(n)
    rows_of = [_frame_format(h) for h in heads]
    if len({(f[1], f[2], f[3].tobytes(), f[4].tobytes()) for f in {id(f): f for f in rows_of}.values()}) != 1:
        raise ValueError("the frames' tables differ")
    _, columns, quantizer, dc, ac = rows_of[0]
    raw = np.frombuffer(b"".join(scans), np.uint8)
    follows = np.empty_like(raw)
    follows[:-1], follows[-1] = raw[1:], 0
    marker = (raw == 255) & (follows >= 0xD0) & (follows <= 0xD9)
    keep = ~marker
    keep[1:] &= ~((raw[:-1] == 255) & (raw[1:] == 0) | marker[:-1])
    before = np.cumsum(keep)
    ends = before[marker]
    if len(ends) != sum(r * f for r, f in shapes):
        raise ValueError("rows are missing")
    buf = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(buf) - 5, np.uint64)
    for k in range(5):
        window = (window << np.uint64(8)) | buf[k : len(buf) - 5 + k]
    window = window.astype(np.int64)
    at = 8 * np.concatenate([[0], ends[:-1]])
    level = np.zeros(len(ends), np.int64)
    out = np.empty((len(ends), columns), np.uint8)
    for k in range(columns):
        bits = window[at >> 3] << (at & 7)  # the next bits are the 16 below bit 40
        found = dc[(bits >> 24) & 0xFFFF]
        size, used = found & 255, found >> 8
        amount = (bits >> (40 - used - size)) & ((1 << size) - 1)
        level += np.where(amount < (1 << size) >> 1, amount - (1 << size) + 1, amount)
        at = at + used + size
        end = ac[((window[at >> 3] << (at & 7)) >> 24) & 0xFFFF]
        if (end & 255).any():
            raise ValueError("a block isn't of one level")
        at = at + (end >> 8)
        out[:, k] = level * quantizer // 8 + 128
    got, first = [], 0
    for (rows, frames), n in zip(shapes, lengths, strict=True):
        own = out[first : first + rows * frames]
        first += rows * frames
        got.append((own.tobytes()[:n], own.reshape(frames, rows, columns)))
    return got


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) frame of each shot. A cut is where two frames' histograms differ by more than twice the mean
    difference of the frames before, and by an eighth of a frame at least."""
    frames = levels.shape[0]
    flat = (levels.reshape(frames, -1) >> 4).astype(np.int64)
    hist = np.bincount((flat + BINS * np.arange(frames)[:, None]).ravel(), minlength=BINS * frames).reshape(frames, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    starts = [0]
    for k, d in enumerate(diff.tolist()):
        past = diff[max(0, k - WINDOW) : k]
        if 4 * d > flat.shape[1] and (not len(past) or d * len(past) > 2 * int(past.sum())):
            starts.append(k + 1)
    return list(zip(starts, [*starts[1:], frames], strict=True))


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % ROW or (ROW if not raw else 0))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): every whole text as an AVI file; null texts are empty. Equal texts, equal files.

    Texts are taken whole, however long, a megabyte or one text at a time; repeated rows are each stored; an empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in by_bytes(texts, BATCH_BYTES):
                media = encode([payload(t.decode()) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(stored: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, n_frames, mean_level: the shots of motion-JPEG files (doc_id, media), of store() or of
    other writers. Null files have none; an empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            media = [m or b"" for m in batch.column("media").to_pylist()]
            for a, b in by_bytes(media, BATCH_BYTES):
                rows = []
                for doc, file in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), media[a:b], strict=True):
                    for levels, fps in [(read_levels([file])[0], read_index(file)[2])] if file else []:
                        rows += [(doc, k, f / fps, e / fps, e - f, float(levels[f:e].mean())) for k, (f, e) in enumerate(shots(levels))]
                if rows:
                    names = ["doc_id", "clip", "start_s", "end_s", "n_frames", "mean_level"]
                    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, n_frames long, mean_level double")


def digest(stored: DataFrame) -> DataFrame:
    """What reading the files of store() back gives: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (frames, shots, the longest shot and the histogram's fullest bin) and clips, the start
    and end of each shot in seconds."""

    def run(batches):
        for batch in batches:
            media = batch.column("media").to_pylist()
            for a, b in by_bytes(media, BATCH_BYTES):
                rows = []
                for file, (p, levels) in zip(media[a:b], decode(media[a:b]), strict=True):
                    found = shots(levels)
                    feature = f"frames={len(levels)};shots={len(found)};longest={max(e - f for f, e in found)};bin={np.bincount(levels.ravel() >> 4, minlength=BINS).argmax()}"
                    timed = [{"start_s": f / FPS, "end_s": e / FPS} for f, e in found]
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(file), hashlib.sha256(file).hexdigest(), feature, timed))
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *cols], names=["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double>>")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
