"""Whole images in other pixel formats: planes of bytes in, planes of bytes out, by array operations over each image.

Formats are those of PIXEL_FORMATS. The letters of a packed format's name are its bytes in order; of a 565 format, the
parts of its 16-bit number (little-endian) from the lowest bits on. Chroma is spread to the pixels that it covers, and
taken together as the rounded mean of those. Levels are rounded to the nearest, half up, and kept in 0 to 255.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, StructType

from reelframe.functions.dims import COLOR_MATRICES

PLANAR = {"420p": (2, 2, "UV"), "yv12": (2, 2, "VU"), "422p": (2, 1, "UV"), "yv16": (2, 1, "VU"), "444p": (1, 1, "UV"), "yv24": (1, 1, "VU")}
SEMI_PLANAR = {"nv12": "UV", "nv21": "VU"}
PACKED_422 = ("yuyv", "yvyu", "uyvy", "vyuy")
PACKED_RGB = ("RGB888", "BGR888", "ARGB", "BGRA", "RGBA", "ABGR")
SIXTEEN = ("RGB565", "BGR565")
TARGETS = ("420p", "BGRA", "RGBA", "BGR888", "BGR565")
#: The matrix of images that name none.
MATRIX = "601"
#: Bytes of converted images that are handed on at a time.
MOST = 16 << 20


def forward(matrix: str) -> list[list[float]]:
    """What Y (without its offset), U and V (without 128) are made of: rows of factors of R, G and B, the inverse of a matrix
    of COLOR_MATRICES."""
    _, gain, rv, gu, gv, bu = COLOR_MATRICES[matrix]
    return np.linalg.inv(np.array([[gain, 0, rv], [gain, -gu, -gv], [gain, bu, 0]])).tolist()


def _level(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _mean(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Rounded means of cells of so many pixels."""
    h, w = plane.shape
    cells = plane.reshape(h // down, down, w // across, across).astype(np.int64).sum(axis=(1, 3))
    n = across * down
    return (cells + n // 2) // n


class Image:
    """Y, U and V, each chroma plane at its own size, or R, G, B and perhaps A."""

    def __init__(self, planes: dict[str, np.ndarray]):
        self.planes = planes

    def yuv_420(self, matrix: str) -> list[np.ndarray]:
        p = self.planes
        if "Y" in p:
            h, w = p["Y"].shape
            fit = lambda c: _mean(c, 2 * c.shape[1] // w, 2 * c.shape[0] // h).astype(np.uint8)
            return [p["Y"], fit(p["U"]), fit(p["V"])]
        cy, cu, cv = forward(matrix)
        mix = lambda c, r, g, b, offset: _level(c[0] * r + c[1] * g + c[2] * b + offset)
        small = [_mean(p[x], 2, 2) for x in "RGB"]
        return [mix(cy, p["R"], p["G"], p["B"], COLOR_MATRICES[matrix][0]), mix(cu, *small, 128), mix(cv, *small, 128)]

    def rgb(self, matrix: str) -> dict[str, np.ndarray]:
        p = self.planes
        if "R" in p:
            return p
        h, w = p["Y"].shape
        wide = lambda c: np.repeat(np.repeat(c, h // c.shape[0], 0), w // c.shape[1], 1).astype(np.float64) - 128
        offset, gain, rv, gu, gv, bu = COLOR_MATRICES[matrix]
        luma, u, v = (p["Y"].astype(np.float64) - offset) * gain, wide(p["U"]), wide(p["V"])
        return {"R": _level(luma + v * rv), "G": _level(luma - u * gu - v * gv), "B": _level(luma + u * bu)}


def loaded(name: str, width: int, height: int, planes: list[bytes]) -> Image | None:
    """None if the format is not known, its planes aren't there in whole, or its chroma doesn't divide the image."""

    def plane(k: int, w: int, h: int, bytes_: int = 1) -> np.ndarray:
        return np.frombuffer(planes[k], np.uint8, w * h * bytes_).reshape(h, w * bytes_)

    try:
        if width <= 0 or height <= 0:
            return None
        if name in PLANAR or name in SEMI_PLANAR:
            across, down, order = PLANAR.get(name) or (2, 2, SEMI_PLANAR[name])
            w, h = width // across, height // down
            if w * across != width or h * down != height:
                return None
            both = plane(1, w, h, 2) if name in SEMI_PLANAR else None
            chroma = [both[:, k::2] if both is not None else plane(1 + k, w, h) for k in range(2)]
            return Image({"Y": plane(0, width, height), order[0]: chroma[0], order[1]: chroma[1]})
        if name in PACKED_422:
            if width % 2:
                return None
            row, at = plane(0, width, height, 2), name.upper().index
            return Image({"Y": row[:, at("Y") :: 2], "U": row[:, at("U") :: 4], "V": row[:, at("V") :: 4]})
        if name == "yuv444" or name in PACKED_RGB:
            letters = "YUV" if name == "yuv444" else name.rstrip("8")
            row = plane(0, width, height, len(letters))
            return Image({c: row[:, k :: len(letters)] for k, c in enumerate(letters)})
        if name in SIXTEEN:
            x = np.frombuffer(planes[0], "<u2", width * height).reshape(height, width)
            low, mid, high = x & 31, x >> 5 & 63, x >> 11
            full = [(low << 3 | low >> 2).astype(np.uint8), (mid << 2 | mid >> 4).astype(np.uint8), (high << 3 | high >> 2).astype(np.uint8)]
            return Image(dict(zip(name[:3], full)))
    except (ValueError, IndexError, TypeError):
        pass
    return None


def stored(image: Image, to: str, matrix: str) -> list[bytes] | None:
    if to == "420p":
        h, w = (image.planes.get("Y") if "Y" in image.planes else image.planes["R"]).shape
        return [p.tobytes() for p in image.yuv_420(matrix)] if w % 2 == 0 and h % 2 == 0 else None
    rgb = image.rgb(matrix)
    if to == "BGR565":
        return [(rgb["B"].astype("<u2") >> 3 | rgb["G"].astype("<u2") >> 2 << 5 | rgb["R"].astype("<u2") >> 3 << 11).astype("<u2").tobytes()]
    alpha = rgb.get("A", np.full(rgb["R"].shape, 255, np.uint8))
    return [np.stack([alpha if c == "A" else rgb[c] for c in to.rstrip("8")], axis=-1).tobytes()]


def convert(images: DataFrame, to: str) -> DataFrame:
    """images (format, width, height, planes, and perhaps matrix, with other columns) with converted: their planes in a format of
    TARGETS.

    Null where an image can't be read as its format says, where its chroma doesn't divide it, or where its matrix is not
    known; a null matrix is MATRIX. Images go one by one, each whole, so a task holds one and about MOST bytes of results.
    """
    if to not in TARGETS:
        raise ValueError(f"no target: {to}")
    has_matrix = "matrix" in images.columns

    def run(batches):
        for batch in batches:
            names, widths, heights = (batch.column(c).to_pylist() for c in ("format", "width", "height"))
            matrices = batch.column("matrix").to_pylist() if has_matrix else [None] * len(names)
            out, first, held = [], 0, 0
            for k, (name, w, h, m) in enumerate(zip(names, widths, heights, matrices)):
                m = MATRIX if m is None else m
                planes = batch.column("planes")[k].as_py()
                image = loaded(name, w or 0, h or 0, planes or []) if m in COLOR_MATRICES else None
                out.append(stored(image, to, m) if image else None)
                held += sum(map(len, out[-1] or ()))
                if held > MOST or k + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in batch.columns), pa.array(out, pa.list_(pa.binary()))], names=[*batch.schema.names, "converted"])
                    out, first, held = [], k + 1, 0

    return images.mapInArrow(run, StructType([*images.schema.fields]).add("converted", ArrayType(BinaryType())))
