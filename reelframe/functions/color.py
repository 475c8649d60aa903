"""Pixels: plane sizes, YCbCr to RGB, crop and rotation, over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.bits import clamp
from reelframe.functions.dims import COLOR_MATRICES, PIXEL_FORMATS


def plane_bytes(width: Column, height: Column, bpp: Column, hss: Column, vss: Column) -> Column:
    return F.floor(width * height * bpp / (8 * hss * vss)).cast("long")


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: str) -> tuple[Column, Column, Column]:
    """R, G and B of a matrix of COLOR_MATRICES, rounded half away from zero and kept in 0 to 255."""
    offset, gain, rv, gu, gv, bu = COLOR_MATRICES[matrix]
    luma = (y - offset) * F.lit(gain)
    out = lambda x: clamp(F.round(x).cast("long"), 0, 255)
    return out(luma + (v - 128) * F.lit(rv)), out(luma - (u - 128) * F.lit(gu) - (v - 128) * F.lit(gv)), out(luma + (u - 128) * F.lit(bu))


def crop(pixels: Column, stride: int, x: int, y: int, width: int, height: int) -> Column:
    """The rows of a rectangle of a one-plane image, one after the other."""
    return F.flatten(F.array(*(F.slice(pixels, (y + r) * stride + x + 1, width) for r in range(height))))


def rotate90(pixels: Column, width: int, height: int) -> Column:
    """The image turned right by a quarter."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: pixels[((height - 1 - k % height) * width + F.floor(k / height)).cast("int")])


def rotate180(pixels: Column) -> Column:
    return F.reverse(pixels)


def rotate270(pixels: Column, width: int, height: int) -> Column:
    """The image turned left by a quarter."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: pixels[(k % height * width + width - 1 - F.floor(k / height)).cast("int")])


def interleaved(planes: list[Column]) -> Column:
    """Planes of equal size as one, pixel by pixel: planar to packed, or U and V to a semi-planar plane."""
    return F.flatten(F.transform(F.arrays_zip(*(p.alias(f"p{k}") for k, p in enumerate(planes))), lambda z: F.array(*(z[f"p{k}"] for k in range(len(planes))))))


def plane_of(packed: Column, first: int, step: int) -> Column:
    """Every step-th number of packed ones from the first (from 0) on: a component of packed pixels as a plane."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(packed) - 1 - first) / step).cast("int")), lambda k: packed[k * step + first])


def yuyv_planes(packed: Column, first: str = "YUYV") -> tuple[Column, Column, Column]:
    """Y, U and V of packed 4:2:2 pixels, whose order of four bytes is named (YUYV, YVYU, UYVY or VYUY)."""
    return plane_of(packed, first.index("Y"), 2), plane_of(packed, first.index("U"), 4), plane_of(packed, first.index("V"), 4)


def half_rows(chroma: Column, width: int, height: int) -> Column:
    """4:2:2 chroma as 4:2:0: of two rows the first."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit((height - 1) // 2)), lambda r: F.slice(chroma, 2 * r * width + 1, F.lit(width))))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    """Levels of 8 bits as a 16-bit number, red highest."""
    return F.shiftright(r, 3) * 2048 + F.shiftright(g, 2) * 32 + F.shiftright(b, 3)


def from_rgb565(x: Column) -> tuple[Column, Column, Column]:
    """Levels of 8 bits again; the highest bits fill up the lowest, so that white stays white."""
    r, g, b = F.shiftright(x, 11).bitwiseAND(F.lit(31)), F.shiftright(x, 5).bitwiseAND(F.lit(63)), x.bitwiseAND(F.lit(31))
    return r * 8 + F.shiftright(r, 2), g * 4 + F.shiftright(g, 4), b * 8 + F.shiftright(b, 2)


def reordered(pixel: Column, given: str, wanted: str) -> Column:
    """A pixel of four bytes as a number, first component lowest, with its components in another order (RGBA to BGRA)."""
    byte = lambda c: F.shiftright(pixel, 8 * given.index(c)).bitwiseAND(F.lit(255))
    return sum((byte(c) * (1 << 8 * k) for k, c in enumerate(wanted)), F.lit(0).cast("long"))


def is_planar(name: Column) -> Column:
    """Whether a pixel format of PIXEL_FORMATS has a plane for each component."""
    return name.isin(*(n for n, planes in PIXEL_FORMATS.items() if len(planes) == 3))


def is_semi_planar(name: Column) -> Column:
    """Whether its chroma components share a plane."""
    return name.isin(*(n for n, planes in PIXEL_FORMATS.items() if len(planes) == 2))
