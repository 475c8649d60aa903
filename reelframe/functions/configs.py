"""Small binary headers of codecs and containers: what a few bytes say, as plain values. None where they are not valid."""

from __future__ import annotations

import struct

from reelframe.functions.dims import AAC_CHANNELS, AAC_RATES, MPEG_BITRATES, MPEG_RATES

# WAVE format tags, the end of the GUIDs that stand for them, and which sample formats PCM widths are.
WAVE_PCM, WAVE_FLOAT, WAVE_EXTENSIBLE = 1, 3, 0xFFFE
WAVE_GUID = bytes.fromhex("00001000800000aa00389b71")
PCM_FORMATS = {(1, 8): "u8", (1, 16): "s16", (1, 24): "s24", (1, 32): "s32", (3, 32): "f32"}


class Bits:
    """Numbers from a byte string, most significant bit first; IndexError beyond its end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise IndexError("no bits left")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def golomb(self) -> int:
        """An unsigned Exp-Golomb number."""
        zeros = 0
        while not self.read(1):
            zeros += 1
        return (1 << zeros) - 1 + self.read(zeros)


def wave_format(fmt: bytes) -> dict | None:
    """tag (of the sub-format, if extensible), channels, rate, bytes_per_second, align, bits, mask and extra of a WAVEFORMATEX.

    A channel mask that names another number of channels is dropped; the byte rate of PCM is set right.
    """
    if len(fmt) < 16:
        return None
    tag, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", fmt)
    mask, extra = 0, fmt[18 : 18 + struct.unpack_from("<H", fmt, 16)[0]] if len(fmt) >= 18 else b""
    if tag == WAVE_EXTENSIBLE:
        if len(fmt) < 40 or fmt[28:40] != WAVE_GUID:
            return None
        mask, tag = struct.unpack_from("<II", fmt, 20)
        mask = mask if mask.bit_count() == channels else 0
    if tag in (WAVE_PCM, WAVE_FLOAT):
        frame = channels * bits // 8
        if bits % 8 or not frame or not rate or align % frame:
            return None
        per_second = rate * frame
    return {"tag": tag, "channels": channels, "rate": rate, "bytes_per_second": per_second, "align": align, "bits": 0 if bits == 1 else bits, "mask": mask, "extra": extra}


def compose_wave_format(fmt: dict) -> bytes:
    """A WAVEFORMATEX of what wave_format() gives: 18 bytes and what is extra, or, with a mask or more than two channels of PCM, the extensible form."""
    tag, frame = fmt["tag"], fmt["channels"] * fmt["bits"] // 8
    wide = tag in (WAVE_PCM, WAVE_FLOAT) and (fmt["mask"] or fmt["channels"] > 2)
    head = struct.pack("<HHIIHH", WAVE_EXTENSIBLE if wide else tag, fmt["channels"], fmt["rate"], fmt["bytes_per_second"], fmt["align"] or frame, fmt["bits"])
    extra = struct.pack("<HII", fmt["bits"], fmt["mask"], tag) + WAVE_GUID if wide else fmt["extra"]
    return head + struct.pack("<H", len(extra)) + extra


def bitmap_info(data: bytes) -> dict | None:
    """width, height (negative: from the top), planes, bits, compression, image_size, x_density, y_density, colors, important and extra
    (up to the size it names) of a BITMAPINFOHEADER."""
    if len(data) < 40:
        return None
    size, *numbers = struct.unpack_from("<IiiHH4sIiiII", data)
    names = ("width", "height", "planes", "bits", "compression", "image_size", "x_density", "y_density", "colors", "important")
    out = dict(zip(names, numbers))
    out["compression"] = out["compression"].decode("latin-1") if any(out["compression"]) else "----"
    return out | {"extra": data[40:size]} if size >= 40 else None


def mpeg_frame(head: int) -> dict | None:
    """version (1, 2, 25), layer, bitrate, rate, channels, samples, length of an MPEG audio header, as mpeg_header() has it."""
    v, lay, br, sr = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 2047 or v == 1 or not lay or br in (0, 15) or sr == 3:
        return None
    layer, kind = 4 - lay, 1 if v == 3 else 2
    bitrate, rate = 1000 * MPEG_BITRATES[kind, layer][br - 1], MPEG_RATES[sr] // {3: 1, 2: 2, 0: 4}[v]
    samples = 384 if layer == 1 else 576 if layer == 3 and kind == 2 else 1152
    unit = 4 if layer == 1 else 1
    length = (samples * bitrate // (rate * 8 * unit) + (head >> 9 & 1)) * unit
    return {"version": {3: 1, 2: 2, 0: 25}[v], "layer": layer, "bitrate": bitrate, "rate": rate, "channels": 1 if head >> 6 & 3 == 3 else 2, "samples": samples, "length": length}


def xing(frame: bytes) -> dict | None:
    """What a Xing or Info header in the first frame says: frames, bytes, toc (percents of the file in 256ths), quality,
    encoder, delay and padding (of encoders that write them)."""
    head = mpeg_frame(int.from_bytes(frame[:4], "big"))
    if not head:
        return None
    at = 4 + ((17 if head["channels"] == 1 else 32) if head["version"] == 1 else 9 if head["channels"] == 1 else 17)
    if frame[at : at + 4] not in (b"Xing", b"XING", b"Info") or len(frame) < at + 8:
        return None
    flags, at = struct.unpack_from(">I", frame, at + 4)[0], at + 8
    out = {"kind": "xing", "frames": 0, "bytes": 0, "toc": [], "quality": 0, "encoder": "", "delay": 0, "padding": 0}
    for bit, name in ((1, "frames"), (2, "bytes"), (4, "toc"), (8, "quality")):
        if flags & bit:
            size = 100 if name == "toc" else 4
            out[name] = list(frame[at : at + size]) if name == "toc" else int.from_bytes(frame[at : at + size], "big")
            at += size
    out["encoder"] = frame[at : at + 9].split(b"\0")[0].decode("latin-1")
    if out["encoder"][:4] in ("LAME", "Lavf", "Lavc") and len(frame) >= at + 24:
        both = int.from_bytes(frame[at + 21 : at + 24], "big")
        out["delay"], out["padding"] = both >> 12, both & 0xFFF
    return out


def vbri(frame: bytes) -> dict | None:
    """What a VBRI header, always 32 bytes after the frame's header, says; toc holds the place of each entry in the file."""
    if frame[36:40] != b"VBRI" or len(frame) < 62:
        return None
    _, delay, quality, size, frames, entries, scale, width, _ = struct.unpack_from(">HHHIIHHHH", frame, 40)
    if width not in (1, 2, 3, 4) or len(frame) < 62 + entries * width:
        return None
    toc, at = [], 0
    for k in range(entries):
        toc.append(at)
        at += scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big")
    return {"kind": "vbri", "frames": frames, "bytes": size, "toc": toc, "quality": quality, "encoder": "", "delay": delay, "padding": 0}


def audio_specific_config(data: bytes) -> dict | None:
    """object_type, rate, channels, sbr, ps, extension_rate and frame_samples of an AAC configuration, with its escapes."""
    b = Bits(data)
    try:
        def kind() -> int:
            n = b.read(5)
            return 32 + b.read(6) if n == 31 else n

        def rate() -> int | None:
            n = b.read(4)
            return b.read(24) if n == 15 else AAC_RATES[n] if n < len(AAC_RATES) else None

        out = {"object_type": kind(), "rate": rate(), "sbr": False, "ps": False, "extension_rate": None, "frame_samples": None}
        channels = b.read(4)
        out["channels"] = AAC_CHANNELS[channels] if channels < len(AAC_CHANNELS) else None
        if out["object_type"] in (5, 29):
            out["ps"], out["sbr"] = out["object_type"] == 29, True
            out["extension_rate"] = rate()
            out["object_type"] = kind()
        if out["object_type"] in (1, 2, 3, 4, 6, 7, 17, 19, 20, 21, 22, 23):
            out["frame_samples"] = 960 if b.read(1) else 1024
            if b.read(1):
                b.read(14)
            b.read(1)
        if not out["sbr"] and b.left >= 16 and b.read(11) == 0x2B7 and kind() == 5 and b.read(1):
            out["sbr"], out["extension_rate"] = True, rate()
            if b.left >= 12 and b.read(11) == 0x548:
                out["ps"] = bool(b.read(1))
        return out
    except IndexError:
        return None


def descriptor_size(size: int, least: int = 1) -> bytes:
    """The length of a descriptor, seven bits a byte."""
    out = [size & 127]
    while size >> 7 or len(out) < least:
        size >>= 7
        out.insert(0, size & 127 | 128)
    return bytes(out)


def esds(body: bytes) -> dict | None:
    """object_type, stream_type, buffer_size, max_bitrate, avg_bitrate and csd (the decoder's configuration) of an elementary
    stream descriptor, from the body of its box."""
    out: dict = {}

    def walk(at: int, end: int) -> None:
        while at < end:
            tag, size, at = body[at], 0, at + 1
            while True:
                size, more, at = size << 7 | body[at] & 127, body[at] & 128, at + 1
                if not more:
                    break
            stop = min(at + size, end)
            if tag == 3:
                flags, inner = body[at + 2], at + 3
                inner += 2 * bool(flags & 128)
                inner += 1 + body[inner] if flags & 64 else 0
                walk(inner + 2 * bool(flags & 32), stop)
            elif tag == 4:
                out.update(object_type=body[at], stream_type=body[at + 1] >> 2, buffer_size=int.from_bytes(body[at + 2 : at + 5], "big"), max_bitrate=int.from_bytes(body[at + 5 : at + 9], "big"), avg_bitrate=int.from_bytes(body[at + 9 : at + 13], "big"), csd=b"")
                walk(at + 13, stop)
            elif tag == 5:
                out["csd"] = body[at:stop]
            at = stop

    try:
        walk(4, len(body))
    except IndexError:
        return None
    return out if "object_type" in out else None


def compose_esds(object_type: int, csd: bytes, avg_bitrate: int = 0, es_id: int = 1) -> bytes:
    """The body of an esds box of an audio stream."""
    one = lambda tag, body: bytes([tag]) + descriptor_size(len(body)) + body
    config = bytes([object_type, 5 << 2 | 1]) + bytes(3) + struct.pack(">II", avg_bitrate, avg_bitrate) + one(5, csd)
    return bytes(4) + one(3, struct.pack(">HB", es_id, 0) + one(4, config) + one(6, b"\x02"))


def avcc(body: bytes) -> dict | None:
    """profile, level, nal_length, sps and pps (lists) of an AVC decoder configuration."""
    if len(body) < 7 or body[0] != 1:
        return None
    out, at = {"profile": body[1], "level": body[3], "nal_length": (body[4] & 3) + 1, "sps": [], "pps": []}, 5
    for name, mask in (("sps", 31), ("pps", 255)):
        if at >= len(body):
            return None
        count, at = body[at] & mask, at + 1
        for _ in range(count):
            size = int.from_bytes(body[at : at + 2], "big")
            out[name].append(body[at + 2 : at + 2 + size])
            at += 2 + size
    return out if at <= len(body) else None


def compose_avcc(sps: list[bytes], pps: list[bytes], nal_length: int = 4) -> bytes:
    sized = lambda units: b"".join(struct.pack(">H", len(u)) + u for u in units)
    return bytes([1, *sps[0][1:4], 0xFC | nal_length - 1, 0xE0 | len(sps)]) + sized(sps) + bytes([len(pps)]) + sized(pps)


def h264_kind(data: bytes) -> str | None:
    """avcC, annexB (start codes) or None, by the first bytes of a stream or configuration."""
    if data[:4] == b"\0\0\0\1" or data[:3] == b"\0\0\1":
        return "annexB"
    return "avcC" if avcc(data) else None


def nal_unit(unit: bytes) -> dict | None:
    """ref_idc, type, and of slices first_mb and slice_type."""
    if not unit or unit[0] & 128:
        return None
    out = {"ref_idc": unit[0] >> 5 & 3, "type": unit[0] & 31, "first_mb": None, "slice_type": None}
    if out["type"] in (1, 2, 5):
        try:
            b = Bits(unit[1:])
            out["first_mb"], out["slice_type"] = b.golomb(), b.golomb()
        except IndexError:
            return None
    return out
