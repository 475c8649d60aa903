"""Queries on PCM and pixels: an embedding is a frame of 64 samples, or an image of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import bits, color, pcm
from reelframe.functions.dims import COLOR_MATRICES, PIXEL_FORMATS, dimension
from reelframe.operators import audio, images
from reelframe.queries.registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_S16_SQL = "list_transform(embedding, lambda x : CAST(greatest(-32768, least(32767, round_even(CAST(x AS DOUBLE) * 32768, 0))) AS BIGINT))"
_U8_SQL = "list_transform(embedding, lambda x : CAST(floor((CAST(x AS DOUBLE) + 0.5) * 255) AS BIGINT))"


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _s16(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", pcm.float_to_s16(F.col("embedding")).alias("s"))


def _levels(spark, sf_dir):
    """Samples as numbers from 0 to 255."""
    return _frames(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 0.5) * 255).cast("long")).alias("p"))


def _text(array):
    return F.concat_ws(",", F.transform(array, lambda x: x.cast("string")))


@_r.query(f"SELECT vec_id, array_to_string({_S16_SQL}, ',') AS samples FROM embeddings")
def clamp16(spark, sf_dir):
    """P3."""
    return _s16(spark, sf_dir).select("vec_id", _text(F.col("s")).alias("samples"))


@_r.query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x : CAST(greatest(-2147483648, least(2147483647, round(CAST(x AS DOUBLE) * 2147483648))) AS BIGINT)), ',') AS samples FROM embeddings")
def clamp32(spark, sf_dir):
    """P4."""
    return _frames(spark, sf_dir).select("vec_id", _text(pcm.float_to_s32(F.col("embedding"))).alias("samples"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform({_S16_SQL}, lambda x : greatest(-8000, least(8000, x))), ',') AS samples FROM embeddings")
def clamp(spark, sf_dir):
    """P2."""
    return _s16(spark, sf_dir).select("vec_id", _text(F.transform("s", lambda x: bits.clamp(x, -8000, 8000))).alias("samples"))


@_r.query(f"""
SELECT vec_id, array_to_string(list_transform(u, lambda v : (v - 128) * 256), ',') AS u8_s16, array_to_string(list_transform(u, lambda v : (v - 128) * 16777216), ',') AS u8_s32,
  array_to_string(list_transform(s, lambda v : v * 65536), ',') AS s16_s32, array_to_string(list_transform(s, lambda v : greatest(-32768, least(32767, (v * 77777 + 32768) >> 16))), ',') AS s32_s16
FROM (SELECT vec_id, {_U8_SQL} AS u, {_S16_SQL} AS s FROM embeddings)
""")
def pcm_cast(spark, sf_dir):
    """P1."""
    s = _s16(spark, sf_dir).join(_levels(spark, sf_dir), "vec_id")
    wide = F.transform("s", lambda v: v * 77777)
    return s.select("vec_id", _text(pcm.u8_to_s16(F.col("p"))).alias("u8_s16"), _text(pcm.u8_to_s32(F.col("p"))).alias("u8_s32"), _text(pcm.s16_to_s32(F.col("s"))).alias("s16_s32"), _text(pcm.s32_to_s16(wide)).alias("s32_s16"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform(range(32), lambda j : s[2 * j + 1]), ',') AS ch0, array_to_string(list_transform(range(32), lambda j : s[2 * j + 2]), ',') AS ch1 FROM (SELECT vec_id, {_S16_SQL} AS s FROM embeddings)")
def planarize(spark, sf_dir):
    """P5, as 32 frames of two channels."""
    p = _s16(spark, sf_dir).select("vec_id", pcm.planarize(F.col("s"), 2, 32).alias("p"))
    return p.select("vec_id", _text(F.col("p")[0]).alias("ch0"), _text(F.col("p")[1]).alias("ch1"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform(range(64), lambda k : s[(k % 8) * 8 + k // 8 + 1]), ',') AS samples FROM (SELECT vec_id, {_S16_SQL} AS s FROM embeddings)")
def interleave(spark, sf_dir):
    """P6, from eight planes of eight samples."""
    planes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("s", c * 8 + 1, 8))
    return _s16(spark, sf_dir).select("vec_id", planes.alias("p")).select("vec_id", _text(pcm.interleave(F.col("p"))).alias("samples"))


@_r.query(f"""
SELECT vec_id, CAST(round(list_sum(list_transform(range(10), lambda j : s[j + 1] + 0.707::DOUBLE * s[j + 21] + 0.707::DOUBLE * s[j + 41] + s[j + 31]))) AS BIGINT) AS left_sum,
  CAST(round(list_sum(list_transform(range(10), lambda j : s[j + 11] + 0.707::DOUBLE * s[j + 21] + 0.707::DOUBLE * s[j + 51] + s[j + 31]))) AS BIGINT) AS right_sum FROM (SELECT vec_id, {_S16_SQL} AS s FROM embeddings)
""")
def downmix51(spark, sf_dir):
    """P7 (B1, B2: the mix as it is meant), from six planes of ten samples; the sums are rounded."""
    p = _s16(spark, sf_dir).select("vec_id", *(F.slice("s", c * 10 + 1, 10).alias(f"c{c}") for c in range(6)))
    left, right = pcm.downmix([F.col(f"c{c}") for c in range(6)])
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).cast("long")
    return p.select("vec_id", total(left).alias("left_sum"), total(right).alias("right_sum"))


@_r.query(f"""
SELECT vec_id, array_to_string(list_transform(range(96), lambda k : CAST(round(1000 * ((1 - (k * 64 / 96.0::DOUBLE - floor(k * 64 / 96.0::DOUBLE))) * s[CAST(floor(k * 64 / 96.0::DOUBLE) AS BIGINT) + 1]
  + (k * 64 / 96.0::DOUBLE - floor(k * 64 / 96.0::DOUBLE)) * s[least(CAST(floor(k * 64 / 96.0::DOUBLE) AS BIGINT) + 2, 64)])) AS BIGINT)), ',') AS samples FROM (SELECT vec_id, {_S16_SQL} AS s FROM embeddings)
""")
def resample_linear(spark, sf_dir):
    """P8, W10 (B3, B4: reachable here): 64 samples to 96, in thousandths."""
    out = F.transform(pcm.resample(F.col("s"), 64, 96), lambda x: F.round(x * 1000).cast("long"))
    return _s16(spark, sf_dir).select("vec_id", _text(out).alias("samples"))


def _yuv(name: str):
    offset, gain, rv, gu, gv, bu = COLOR_MATRICES[name]
    luma, u, v = f"(y - {offset}) * {gain}::DOUBLE", "(u - 128)", "(v - 128)"
    level = lambda e: f"greatest(0, least(255, CAST(round({e}) AS BIGINT)))"
    sql = f"""
WITH p AS (SELECT vec_id, {_U8_SQL} AS p FROM embeddings), x AS (SELECT vec_id, i, p[i + 1] AS y, p[i + 22] AS u, p[i + 43] AS v FROM (SELECT vec_id, p, unnest(range(21)) AS i FROM p))
SELECT vec_id, i, {level(f"{luma} + {v} * {rv}::DOUBLE")} AS r, {level(f"{luma} - {u} * {gu}::DOUBLE - {v} * {gv}::DOUBLE")} AS g, {level(f"{luma} + {u} * {bu}::DOUBLE")} AS b FROM x
"""

    def query(spark, sf_dir):
        """C2, C3 (B23: the documented formula), for 21 pixels of each frame."""
        px = _levels(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(F.slice("p", 1, 21).alias("y"), F.slice("p", 22, 21).alias("u"), F.slice("p", 43, 21).alias("v"))).alias("i", "x"))
        r, g, b = color.yuv_to_rgb(F.col("x.y"), F.col("x.u"), F.col("x.v"), name)
        return px.select("vec_id", F.col("i").cast("long").alias("i"), r.alias("r"), g.alias("g"), b.alias("b"))

    query.__name__ = f"yuv_to_rgb_{name}"
    return _r.query(sql)(query)


for _name in COLOR_MATRICES:
    _yuv(_name)

_PLANES = [(name, k, *plane) for name, planes in PIXEL_FORMATS.items() for k, plane in enumerate(planes)]


@_r.query("SELECT p_partkey, name, plane, ((p_size + 1) * 2) * (p_partkey % 100 * 2 + 2) * bpp // (8 * hss * vss) AS bytes FROM part, (VALUES " + ", ".join(f"('{n}', {k}, {b}, {h}, {v})" for n, k, b, h, v in _PLANES) + ") f (name, plane, bpp, hss, vss)")
def plane_bytes(spark, sf_dir):
    """Bytes of each plane of images as large as the parts say, in every pixel format."""
    formats = dimension(spark, _PLANES, "name string, plane int, bpp int, hss int, vss int").groupBy().agg(F.collect_list(F.struct("name", "plane", "bpp", "hss", "vss")).alias("f"))
    part = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") + 1) * 2).alias("w"), (F.col("p_partkey") % 100 * 2 + 2).alias("h"))
    each = part.join(F.broadcast(formats)).select("p_partkey", "w", "h", F.inline("f"))
    size = F.expr("w * h * bpp div (8 * hss * vss)")
    return each.select("p_partkey", "name", "plane", size.alias("bytes"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform(range(12), lambda k : p[(k // 4 + 2) * 8 + k % 4 + 4]), ',') AS pixels FROM (SELECT vec_id, {_U8_SQL} AS p FROM embeddings)")
def crop(spark, sf_dir):
    """4 x 3 pixels at (3, 2)."""
    return _levels(spark, sf_dir).select("vec_id", _text(color.crop(F.col("p"), 8, 3, 2, 4, 3)).alias("pixels"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform(range(64), lambda k : p[(7 - k % 8) * 8 + k // 8 + 1]), ',') AS pixels FROM (SELECT vec_id, {_U8_SQL} AS p FROM embeddings)")
def rotate(spark, sf_dir):
    """A quarter to the right."""
    return _levels(spark, sf_dir).select("vec_id", _text(color.rotate90(F.col("p"), 8, 8)).alias("pixels"))


@_r.query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (x & 255) * 256 + (x >> 8 & 255) AS swap16, (x & 255) * 16777216 + (x >> 8 & 255) * 65536 + (x >> 16 & 255) * 256 + (x >> 24 & 255) AS swap32 FROM (SELECT *, l_partkey * 7919 + l_orderkey AS x FROM lineitem)")
def bswap(spark, sf_dir):
    """C4."""
    x = F.col("l_partkey") * 7919 + F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bits.swap16(x).alias("swap16"), bits.swap32(x).alias("swap32"))


@_r.query(f"SELECT vec_id, array_to_string(list_transform(range(64), lambda k : p[64 - k]), ',') AS half, array_to_string(list_transform(range(64), lambda k : p[k % 8 * 8 + 8 - k // 8]), ',') AS left_turn FROM (SELECT vec_id, {_U8_SQL} AS p FROM embeddings)")
def rotate_more(spark, sf_dir):
    """By a half, and a quarter to the left."""
    p = _levels(spark, sf_dir)
    return p.select("vec_id", _text(color.rotate180(F.col("p"))).alias("half"), _text(color.rotate270(F.col("p"), 8, 8)).alias("left_turn"))


@_r.query(f"""
SELECT vec_id, array_to_string(list_transform(range(32), lambda k : p[k // 2 + 1 + 16 * (k % 2)]), ',') AS semi_planar, array_to_string(p[1:16], ',') AS first, array_to_string(p[17:32], ',') AS second FROM (SELECT vec_id, {_U8_SQL} AS p FROM embeddings)
""")
def semi_planar(spark, sf_dir):
    """Two planes of 16 into one and back."""
    p = _levels(spark, sf_dir).select("vec_id", color.interleaved([F.slice("p", 1, 16), F.slice("p", 17, 16)]).alias("both"))
    return p.select("vec_id", _text(F.col("both")).alias("semi_planar"), *(_text(color.plane_of(F.col("both"), k, 2)).alias(n) for k, n in enumerate(("first", "second"))))


@_r.query(f"""
SELECT vec_id, array_to_string(list_transform(range(32), lambda k : p[2 * k + 1]), ',') AS y, array_to_string(list_transform(range(8), lambda k : p[4 * (k % 4) + 32 * (k // 4) + 2]), ',') AS u, array_to_string(list_transform(range(16), lambda k : p[4 * k + 4]), ',') AS v
FROM (SELECT vec_id, {_U8_SQL} AS p FROM embeddings)
""")
def packed_422(spark, sf_dir):
    """8 x 4 pixels of YUYV as planes, U at half of the rows."""
    y, u, v = color.yuyv_planes(F.col("p"))
    return _levels(spark, sf_dir).select("vec_id", _text(y).alias("y"), _text(color.half_rows(u, 4, 4)).alias("u"), _text(v).alias("v"))


_PIXEL_SQL = "(l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 65537) % 4294967296"


@_r.query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PIXEL_SQL} AS x FROM lineitem),
c AS (SELECT *, x & 255 AS r, x >> 8 & 255 AS g, x >> 16 & 255 AS b, x >> 24 & 255 AS a, (x & 255) // 8 * 2048 + (x >> 8 & 255) // 4 * 32 + (x >> 16 & 255) // 8 AS p FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b + g * 256 + r * 65536 + a * 16777216 AS bgra, p AS rgb565, (p >> 11) * 8 + (p >> 11) // 4 AS r, (p >> 5 & 63) * 4 + (p >> 5 & 63) // 16 AS g, (p & 31) * 8 + (p & 31) // 4 AS b, r * 65536 + g * 256 + b AS swap24 FROM c
""")
def pixel_words(spark, sf_dir):
    """RGBA as BGRA and as 5, 6 and 5 bits, and back."""
    x = F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31 + F.col("l_linenumber") * 65537
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (x % 4294967296).alias("x"))
    p = color.rgb565(*(bits.field(F.col("x"), 8 * k, 8) for k in range(3)))
    r, g, b = color.from_rgb565(p)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", color.reordered(F.col("x"), "RGBA", "BGRA").alias("bgra"), p.alias("rgb565"), r.alias("r"), g.alias("g"), b.alias("b"), bits.swap24(F.col("x")).alias("swap24"))


#: Images of 4 x 4 pixels: format, and the bytes of its planes, which are the first levels of a frame.
_IMAGES = {"420p": (16, 4, 4), "yv12": (16, 4, 4), "422p": (16, 8, 8), "yv16": (16, 8, 8), "444p": (16, 16, 16), "nv12": (16, 8), "nv21": (16, 8), "yuyv": (32,), "vyuy": (32,), "yuv444": (48,), "RGB888": (48,), "BGRA": (64,), "ARGB": (64,), "BGR565": (32,), "RGB565": (32,)}


def _images(spark, sf_dir):
    bytes_ = lambda first, n: F.unhex(F.array_join(F.transform(F.slice("p", first, n), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x))), 2, "0")), ""))
    each = []
    for name, sizes in _IMAGES.items():
        starts = [1 + sum(sizes[:k]) for k in range(len(sizes))]
        each.append(F.struct(F.lit(name).alias("format"), F.array(*map(bytes_, starts, sizes)).alias("planes")))
    return _levels(spark, sf_dir).select("vec_id", F.inline(F.array(*each)), F.lit(4).alias("width"), F.lit(4).alias("height"))


def _places() -> list[tuple]:
    """For each format of _IMAGES where (from 1) the three levels of each pixel are, or of a 565 pixel's lower byte, and
    where the chroma levels of each 2 x 2 cell are."""
    pixels = [(x, y) for y in range(4) for x in range(4)]
    cells = [[(x, y) for y in (r, r + 1) for x in (c, c + 1)] for r in (0, 2) for c in (0, 2)]
    planar = {"420p": (2, 2, 17, 21), "yv12": (2, 2, 21, 17), "422p": (2, 1, 17, 25), "yv16": (2, 1, 25, 17), "444p": (1, 1, 17, 33)}
    out = []
    for name in _IMAGES:
        if name in planar:
            across, down, u, v = planar[name]
            at = [lambda x, y: 1 + 4 * y + x, *(lambda x, y, f=f, a=across, d=down: f + y // d * (4 // a) + x // a for f in (u, v))]
        elif name in ("nv12", "nv21"):
            at = [lambda x, y: 1 + 4 * y + x, *(lambda x, y, f=f: 17 + f + y // 2 * 4 + x // 2 * 2 for f in ((0, 1) if name == "nv12" else (1, 0)))]
        elif name in ("yuyv", "vyuy"):
            y0, u, v = (0, 1, 3) if name == "yuyv" else (1, 2, 0)
            at = [lambda x, y, f=y0: 1 + f + 8 * y + 2 * x, *(lambda x, y, f=f: 1 + f + 8 * y + x // 2 * 4 for f in (u, v))]
        elif name.endswith("565"):
            at = [lambda x, y: 1 + 2 * (4 * y + x)] * 3
        else:
            letters = {"yuv444": "YUV", "RGB888": "RGB"}.get(name, name)
            at = [lambda x, y, f=letters.index(c), n=len(letters): 1 + f + n * (4 * y + x) for c in ("YUV" if name == "yuv444" else "RGB")]
        kind = name if name.endswith("565") else "rgb" if "B" in name else "yuv"
        alpha = [1 + 4 * k + name.index("A") for k in range(16)] if "A" in name else []
        chroma = [[sorted({f(x, y) for x, y in cell}) for cell in cells] for f in at[1:]]
        out.append((name, kind, *([f(x, y) for x, y in pixels] for f in at), alpha, *chroma))
    return out


def _images_sql() -> str:
    """vec_id, format, kind, r, g, b, a (lists of levels), y, and u and v of 2 x 2 cells, of yuv and rgb images."""
    rows = ", ".join(f"('{n}', '{k}', {a}, {b}, {c}, {alpha} :: INT[], {cu}, {cv})" for n, k, a, b, c, alpha, cu, cv in _places())
    offset, gain, rv, gu, gv, bu = COLOR_MATRICES["601"]
    cy, cu, cv = images.forward("601")
    level = lambda x: f"CAST(greatest(0, least(255, floor({x} + 0.5))) AS BIGINT)"
    each = lambda x: f"list_transform(range(1, 17), lambda k : {x})"
    five = lambda shift: f"list_transform(a, lambda i : (p[i] + 256 * p[i + 1]) // {1 << shift} % 32)"
    grow = lambda x: f"list_transform({x}, lambda q : (q << 3) | (q >> 2))"
    green = "list_transform(list_transform(a, lambda i : (p[i] + 256 * p[i + 1]) // 32 % 64), lambda q : (q << 2) | (q >> 4))"
    mean = lambda c: f"list_transform({c}, lambda l : (list_sum(list_transform(l, lambda i : p[i])) + len(l) // 2) // len(l))"
    cell = lambda c: f"list_transform([1, 3, 9, 11], lambda k : ({c}[k] + {c}[k + 1] + {c}[k + 4] + {c}[k + 5] + 2) // 4)"
    dot = lambda c, x, o: f"{c[0]!r} :: DOUBLE * r{x} + {c[1]!r} :: DOUBLE * g{x} + {c[2]!r} :: DOUBLE * b{x} + {o}"
    return f"""
WITH f(format, kind, a, b, c, alpha, cu, cv) AS (VALUES {rows}),
l AS (SELECT vec_id, list_transform({_U8_SQL}, lambda q : greatest(0, least(255, q))) AS p FROM embeddings),
x AS (SELECT vec_id, format, kind, p, alpha, cu, cv, a AS at, list_transform(a, lambda i : p[i]) AS c1, list_transform(b, lambda i : p[i]) AS c2, list_transform(c, lambda i : p[i]) AS c3,
  {grow(five(0))} AS low, {green} AS mid, {grow(five(11))} AS high FROM l, f),
z AS (SELECT vec_id, format, kind, p, alpha, cu, cv, c1,
  CASE kind WHEN 'yuv' THEN {each(level(f"(c1[k] - {offset}) * {gain!r} :: DOUBLE + (c3[k] - 128) * {rv!r} :: DOUBLE"))} WHEN 'rgb' THEN c1 WHEN 'BGR565' THEN high ELSE low END AS r,
  CASE kind WHEN 'yuv' THEN {each(level(f"(c1[k] - {offset}) * {gain!r} :: DOUBLE - (c2[k] - 128) * {gu!r} :: DOUBLE - (c3[k] - 128) * {gv!r} :: DOUBLE"))} WHEN 'rgb' THEN c2 ELSE mid END AS g,
  CASE kind WHEN 'yuv' THEN {each(level(f"(c1[k] - {offset}) * {gain!r} :: DOUBLE + (c2[k] - 128) * {bu!r} :: DOUBLE"))} WHEN 'rgb' THEN c3 WHEN 'BGR565' THEN low ELSE high END AS b FROM x),
s AS (SELECT *, {cell("r")} AS rs, {cell("g")} AS gs, {cell("b")} AS bs FROM z)
SELECT vec_id, format, {each("b[k]")} AS b, g, r, CASE WHEN len(alpha) > 0 THEN list_transform(alpha, lambda i : p[i]) ELSE {each("255")} END AS a,
  CASE kind WHEN 'yuv' THEN c1 ELSE {each(level(dot(cy, "[k]", offset)))} END AS y,
  CASE kind WHEN 'yuv' THEN {mean("cu")} ELSE list_transform(range(1, 5), lambda k : {level(dot(cu, "s[k]", 128))}) END AS u,
  CASE kind WHEN 'yuv' THEN {mean("cv")} ELSE list_transform(range(1, 5), lambda k : {level(dot(cv, "s[k]", 128))}) END AS v FROM s
"""


_HEX = "array_to_string(list_transform({}, lambda q : printf('%02X', CAST(q AS BIGINT))), '')"


@_r.query(f"SELECT vec_id, format, {_HEX.format('y')} AS y, {_HEX.format('u')} AS u, {_HEX.format('v')} AS v FROM ({_images_sql()})")
def image_to_420p(spark, sf_dir):
    """Whole images of 15 formats as planes of 4:2:0."""
    c = images.convert(_images(spark, sf_dir), "420p")
    return c.select("vec_id", "format", *(F.hex(F.col("converted")[k]).alias(n) for k, n in enumerate("yuv")))


@_r.query(f"SELECT vec_id, format, {_HEX.format('flatten(list_transform(range(1, 17), lambda k : [b[k], g[k], r[k], a[k]]))')} AS pixels FROM ({_images_sql()})")
def image_to_bgra(spark, sf_dir):
    """Whole images of 15 formats as BGRA, by the matrix that stands for none."""
    return images.convert(_images(spark, sf_dir), "BGRA").select("vec_id", "format", F.hex(F.col("converted")[0]).alias("pixels"))


@_r.query(f"""
WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, j) - 1 AS i, CAST(s[j] AS DOUBLE) AS x FROM (SELECT label, vec_id, {_S16_SQL} AS s, unnest(range(1, 65)) AS j FROM embeddings)),
n AS (SELECT label, unnest(range((max(i) * 44100) // 48000 + 1)) AS k FROM s GROUP BY label),
o AS (SELECT label, k, k * 48000 // 44100 AS i, CAST(k * 48000 % 44100 AS DOUBLE) / 44100.0 :: DOUBLE AS t FROM n)
SELECT o.label, o.k, CAST(floor(CASE WHEN t = 0 THEN a.x ELSE (1 - t) * a.x + t * b.x END) AS BIGINT) AS level
FROM o JOIN s a USING (label, i) LEFT JOIN s b ON b.label = o.label AND b.i = o.i + 1
""")
def resample_track(spark, sf_dir):
    """Each label's frames as the packets of one track, from 48000 to 44100 a second."""
    p = _s16(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    p = audio.resample_packets(p, ["label"], ["vec_id"], "s", 48000, 44100)
    each = p.select("label", "first", F.posexplode("resampled").alias("k", "x"))
    return each.select("label", (F.col("first") + F.col("k")).alias("k"), F.floor("x").cast("long").alias("level"))
