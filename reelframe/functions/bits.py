"""Bit-level fields of media headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.dims import AAC_CHANNELS, AAC_RATES, MPEG_BITRATES, MPEG_RATES


def field(value: Column, shift: int, width: int) -> Column:
    """`width` bits of value, `shift` bits above the lowest."""
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def fourcc(text: Column) -> Column:
    """The number that a four-character code reads as, first character lowest."""
    code = lambda i: F.ascii(F.substring(text, i, 1)).cast("long")
    return code(1) + code(2) * 256 + code(3) * 65536 + code(4) * 16777216


def fourcc_text(value: Column) -> Column:
    return F.concat(*(F.chr(field(value, 8 * i, 8)) for i in range(4)))


def synchsafe(value: Column) -> Column:
    """The number in a 32-bit field of which each byte holds seven bits."""
    return sum((field(value, 8 * i, 7) * (1 << (7 * i)) for i in range(4)), F.lit(0).cast("long"))


def vint_length(first: Column) -> Column:
    """Bytes of an EBML variable-length number, from its first byte; 0 where that is 0."""
    out = F.lit(0)
    for n in range(8, 0, -1):
        out = F.when(first >= 1 << (8 - n), n).otherwise(out)
    return out


def vint_value(first: Column, rest: Column, length: Column) -> Column:
    """The number itself: the first byte without its marker bit, then the other bytes as one number."""
    marker = F.pow(F.lit(2), 8 - length).cast("long")
    return (first.cast("long") - marker) * F.pow(F.lit(256), length - 1).cast("long") + rest


def exp_golomb(bits: Column) -> Column:
    """The unsigned Exp-Golomb number at the start of a string of 0 and 1; null if it is cut off."""
    zeros = F.instr(bits, "1") - 1
    body = F.substring(bits, zeros + 1, zeros + 1)
    return F.when((zeros >= 0) & (F.length(body) == zeros + 1), F.conv(body, 2, 10).cast("long") - 1)


def swap16(value: Column) -> Column:
    return field(value, 0, 8) * 256 + field(value, 8, 8)


def swap32(value: Column) -> Column:
    return sum((field(value, 8 * i, 8) * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))


def swap24(value: Column) -> Column:
    return sum((field(value, 8 * i, 8) * (1 << (8 * (2 - i))) for i in range(3)), F.lit(0).cast("long"))


def ebml_id(value: Column) -> Column:
    """Whether a number can be an element's id: of one to four bytes, neither all ones nor longer than it need be."""
    return value.between(0x81, 0xFE) | value.between(0x407F, 0x7FFE) | value.between(0x203FFF, 0x3FFFFE) | value.between(0x101FFFFF, 0x1FFFFFFE)


def descriptor_length(size: Column) -> Column:
    """Bytes of a descriptor of so many bytes: its tag, its length at seven bits a byte, and its body."""
    return 1 + F.when(size < 1 << 7, 1).when(size < 1 << 14, 2).when(size < 1 << 21, 3).otherwise(4) + size


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), value))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def mpeg_header(head: Column) -> dict[str, Column]:
    """version (1, 2 or 25), layer, bitrate, sample_rate, channels, samples and frame_length of an MPEG audio header.

    All are null where the header is not valid. The rate of version 2.5 is 11025 Hz and not 11050, and padding of layer I
    counts four bytes with the rest, as the format has it.
    """
    v, lay, br, sr = field(head, 19, 2), field(head, 17, 2), field(head, 12, 4), field(head, 10, 2)
    valid = (field(head, 21, 11) == 2047) & (v != 1) & (lay != 0) & (br != 15) & (br != 0) & (sr != 3)
    layer = 4 - lay
    kind = F.when(v == 3, 1).otherwise(2)
    rates = F.array(*(F.lit(x) for key in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)) for x in MPEG_BITRATES[key]))
    bitrate = 1000 * F.element_at(rates, ((kind - 1) * 42 + (layer - 1) * 14 + br).cast("int")).cast("long")
    rate = _pick(MPEG_RATES, F.least(sr, F.lit(2))).cast("long")
    rate = F.when(v == 3, rate).when(v == 2, F.floor(rate / 2)).otherwise(F.floor(rate / 4))
    samples = F.when(layer == 1, 384).when((layer == 3) & (kind == 2), 576).otherwise(1152).cast("long")
    unit = F.when(layer == 1, 4).otherwise(1)
    length = (F.floor(samples * bitrate / (rate * 8 * unit)) + field(head, 9, 1)) * unit
    ok = lambda c: F.when(valid, c.cast("long"))
    return {
        "version": ok(F.when(v == 3, 1).when(v == 2, 2).otherwise(25)),
        "layer": ok(layer),
        "bitrate": ok(bitrate),
        "sample_rate": ok(rate),
        "channels": ok(F.when(field(head, 6, 2) == 3, 1).otherwise(2)),
        "samples": ok(samples),
        "frame_length": ok(length),
    }


def audio_config(value: Column) -> dict[str, Column]:
    """object_type, sample_rate and channels of a 16-bit AAC audio configuration."""
    rate, chan = field(value, 7, 4), field(value, 3, 4)
    return {
        "object_type": field(value, 11, 5).cast("long"),
        "sample_rate": F.when(rate < len(AAC_RATES), _pick(AAC_RATES, F.least(rate, F.lit(len(AAC_RATES) - 1)))).cast("long"),
        "channels": F.when(chan < len(AAC_CHANNELS), _pick(AAC_CHANNELS, F.least(chan, F.lit(len(AAC_CHANNELS) - 1)))).cast("long"),
    }
