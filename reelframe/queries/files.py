"""Queries on media files, made from documents: each text is the payload of a small file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.functions.dims import GENRES
from reelframe.queries.registry import Registry, made, table
from reelframe.sources import boxes as typed_boxes
from reelframe.sources import compose, containers, media, ranged, tags
from reelframe.stored import materialize, new_path

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _files(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """path, content: a file for each document; make gets a text."""
    return made(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda doc, text: [(f"doc/{doc}", make(text or ""))])


def _parts(text: str, size: int = 200) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b" "]


def _clusters(text: str) -> list[list[bytes]]:
    """All parts of a text, 20 a cluster, whose times fit 16 bits."""
    parts = _parts(text)
    return [*(parts[i : i + 20] for i in range(0, len(parts), 20)), [b"end"]]


@_r.query("""
WITH d AS (SELECT 'doc/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) // 4 AS n FROM documents),
k AS (SELECT path, n, unnest(range((n + 2047) // 2048)) AS k FROM d)
SELECT path, k AS sample_idx, 44 + k * 2048 * 4 AS "offset", least(2048, n - k * 2048) * 4 AS size, k * 2048 AS pts, 8000 AS timescale, 2 AS channels, 16 AS bits FROM k
""")
def wav_packets(spark, sf_dir):
    """S9, with each text as 16-bit stereo at 8000 Hz."""
    return media.wav_packets(_files(spark, sf_dir, lambda t: compose.wav(t.encode())))


_BYTES = "octet_length(encode(coalesce(text, '')))"
#: Parts of 200 bytes that a text makes, one at least.
_PARTS_SQL = f"SELECT 'doc/' || doc_id AS path, hex(encode(CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE text END)) AS h, greatest({_BYTES}, 1) AS bytes, (greatest({_BYTES}, 1) + 199) // 200 AS n FROM documents"


@_r.query(f"""
WITH d AS (SELECT 'doc/' || doc_id AS path, greatest(2, ({_BYTES} + 412) // 413) AS n FROM documents),
k AS (SELECT path, unnest(range(n)) AS k FROM d)
SELECT path, k AS frame_idx, 417 * k + k // 3 AS "offset", CAST(417 + CAST(k % 3 = 2 AS INT) AS BIGINT) AS frame_length, 128000 AS bitrate, 44100 AS sample_rate, 2 AS channels, 1152 AS samples, 1152 * k AS pts FROM k
""")
def mp3_frames(spark, sf_dir):
    """S14, S16, S19, with each text as the frames' payload."""
    return media.mp3_frames(_files(spark, sf_dir, lambda t: compose.mp3(t.encode())))


_GENRES_SQL = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in GENRES) + "]"


@_r.query(f"""
SELECT 'doc/' || doc_id AS path, md5(rtrim(t, chr(0))) AS title, md5(rtrim(t, chr(0))) AS artist, md5(rtrim(t, chr(0))) AS "comment", {_GENRES_SQL}[length(t) % 148 + 1] AS genre
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def id3_tags(spark, sf_dir):
    """S20, with each text as title, artist (in UTF-16) and comment."""
    found = media.id3_tags(_files(spark, sf_dir, lambda t: compose.id3(t, t, f"({len(t) % 148})", t)))
    return found.select("path", *(F.md5(F.element_at("tags", k)).alias(k) for k in ("title", "artist", "comment")), F.element_at("tags", "genre").alias("genre"))


def _tree_sql(tree: list[tuple], start: str = "0", parent: int = -1, depth: int = 0, above: str = "", rows: list[str] | None = None) -> tuple[list[str], str]:
    """(rows, end) of SQL for boxes [(name, bytes before its children, children)] that follow each other from a place."""
    rows = [] if rows is None else rows
    for name, own, children in tree:
        k, at = len(rows), f"{start} + 8"
        rows.append("")
        _, end = _tree_sql(children, f"{at} + {own}", k, depth + 1, above + name + "/", rows)
        rows[k] = f"{{'node_id': {k}, 'parent_id': {parent}, 'depth': {depth}, 'name': '{name}', 'path_expr': '{above}{name}', 'offset': {at}, 'size': ({end}) - ({at})}}"
        start = end
    return rows, start


_STBL = [
    ("stsd", "8", [("avc1", "78", [("avcC", "17", [])])]),
    *((name, size, []) for name, size in (("stts", "16"), ("ctts", "8 + 8 * n"), ("stsc", "8 + 12 * (CAST(n >= 3 AS BIGINT) + CAST(n % 3 > 0 AS BIGINT))"), ("stsz", "12 + 4 * n"), ("stco", "8 + 4 * ((n + 2) // 3)"), ("stss", "8 + 4 * ((n + 4) // 5)"), ("sdtp", "4 + n"))),
]
_MP4 = [("ftyp", "12", []), ("mdat", "bytes", []), ("moov", "0", [("mvhd", "20", []), ("trak", "0", [("mdia", "0", [("mdhd", "24", []), ("hdlr", "24", []), ("minf", "0", [("stbl", "0", _STBL)])])])])]


def _stored(files: DataFrame) -> str:
    """The folder in which files lie, each written once to its path."""
    folder = new_path(files.sparkSession, "media-files")
    ranged.write(files, folder)
    return folder


def _in_folder(found: DataFrame, folder: str) -> DataFrame:
    return found.withColumn("path", F.substring("path", len(folder) + 2, 1 << 20))


@_r.query(f"""
WITH d AS (SELECT 'doc/' || doc_id AS path, {_BYTES} AS n FROM documents)
SELECT path, 44 + n + n % 2 AS length, 'wave' AS format, CASE WHEN n = 0 THEN 80 ELSE 100 END AS score, 10 + least(32768, 44 + n + n % 2) AS bytes_read FROM d
""")
def probe_by_range(spark, sf_dir):
    """The format of files that lie in a store, by their first bytes."""
    folder = _stored(_files(spark, sf_dir, lambda t: compose.wav(t.encode())))
    return _in_folder(ranged.read(spark, folder), folder)


@_r.query(f"WITH d AS ({_PARTS_SQL}), b AS (SELECT path, unnest([{', '.join(_tree_sql(_MP4)[0])}]) AS b FROM d) SELECT path, b.node_id, b.parent_id, b.depth, b.name, b.path_expr, b.offset, b.size FROM b")
def boxes(spark, sf_dir):
    """S23, K7."""
    return containers.elements(_files(spark, sf_dir, lambda t: compose.mp4(_parts(t))), "mp4")


@_r.query(f"""
SELECT path, 'isom' AS brand, 1000 AS timescale, 40 * n AS duration, 'vide' AS handler, 66 AS profile, 40 * n AS delta, 40 * ((n + 1) // 2) + 80 * (n // 2) AS shift, bytes AS size, (n + 4) // 5 AS syncs,
       5 * ((n + 4) // 5) * ((n + 4) // 5 - 1) // 2 + (n + 4) // 5 AS sync_sum, (n + 2) // 3 AS chunks, 28 + 600 * ((n + 2) // 3 - 1) AS last_chunk, 8 * ((n + 0) // 3) AS dependencies FROM ({_PARTS_SQL})
""")
def typed_mp4(spark, sf_dir):
    """Values of boxes by their paths, and the entries of tables."""
    folder = _stored(_files(spark, sf_dir, lambda t: compose.mp4(_parts(t))))
    found = materialize(typed_boxes.typed_by_range(spark, folder), "typed-boxes")
    stbl, pairs = "moov/trak/mdia/minf/stbl/", "struct<sample_count:bigint,{}:bigint>"
    plain = {"brand": ("ftyp", "$.major_brand", "string"), "timescale": ("moov/mvhd", "$.timescale", "long"), "duration": ("moov/trak/mdia/mdhd", "$.duration", "long"), "handler": ("moov/trak/mdia/hdlr", "$.handler_type", "string"), "profile": (stbl + "stsd/avc1/avcC", "$.profile", "long")}
    out = found.groupBy("path").agg(*(F.max(F.when(F.col("path_expr") == p, typed_boxes.value(v, kind))).alias(name) for name, (p, v, kind) in plain.items()))
    tables = {
        "stts": (pairs.format("sample_delta"), {"delta": F.sum(F.col("entry.sample_count") * F.col("entry.sample_delta"))}),
        "ctts": (pairs.format("sample_offset"), {"shift": F.sum(F.col("entry.sample_count") * F.col("entry.sample_offset"))}),
        "stsz": ("bigint", {"size": F.sum("entry")}),
        "stss": ("bigint", {"syncs": F.count("*"), "sync_sum": F.sum("entry")}),
        "stco": ("bigint", {"chunks": F.count("*"), "last_chunk": F.max_by("entry", "idx")}),
        "sdtp": ("bigint", {"dependencies": F.sum("entry")}),
    }
    for name, (kind, sums) in tables.items():
        rows = typed_boxes.entries(typed_boxes.find(found, stbl + name), "entries", kind)
        out = out.join(rows.groupBy("path").agg(*(c.alias(n) for n, c in sums.items())), "path", "left")
    return _in_folder(out, folder)


@_r.query(f"""
WITH d AS ({_PARTS_SQL}), k AS (SELECT path, bytes, unnest(range(n)) AS k FROM d)
SELECT path, 4 AS track, k AS sample_idx, k // 3 + 1 AS chunk, 28 + 200 * k AS "offset", least(200, bytes - 200 * k) AS size, 40 * k AS dts,
       40 * k + CASE WHEN k % 2 = 1 THEN 80 ELSE 40 END AS pts, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 2 THEN 4 ELSE 0 END AS flags FROM k
""")
def mp4_samples(spark, sf_dir):
    """S25 from the bytes of files."""
    return media.mp4_samples(_files(spark, sf_dir, lambda t: compose.mp4(_parts(t))))


@_r.query(f"""
WITH d AS ({_PARTS_SQL}), k AS (SELECT path, bytes, h, unnest(range(n)) AS k FROM d)
SELECT path, k AS sample_idx, 28 + 200 * k AS "offset", least(200, bytes - 200 * k) AS size, md5(unhex(substr(h, CAST(400 * k + 1 AS INT), 400))) AS data FROM k
""")
def mp4_packets_by_range(spark, sf_dir):
    """Samples by the tables of files that lie in a store, and then their bytes alone."""
    folder = _stored(_files(spark, sf_dir, lambda t: compose.mp4(_parts(t))))
    found = ranged.fetch(ranged.mp4_samples(spark, folder))
    return _in_folder(found, folder).select("path", "sample_idx", "offset", "size", F.md5("data").alias("data"))


@_r.query(f"""
SELECT path, 4 AS track, 1000 AS timescale, 40 * n AS duration, 'avc1' AS entry, 'h264' AS codec, 4 AS nal_length, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS INT) AS channels, '0142001EFFE1000467420' || '01E01000268CE' AS csd FROM ({_PARTS_SQL})
""")
def mp4_tracks(spark, sf_dir):
    """Tracks with their decoder's configuration."""
    return media.mp4_tracks(_files(spark, sf_dir, lambda t: compose.mp4(_parts(t)))).withColumn("csd", F.hex("csd"))


@_r.query()
def ebml(spark, sf_dir):
    """S27."""
    return containers.elements(_files(spark, sf_dir, lambda t: compose.mkv(_clusters(t))), "ebml")


@_r.query(f"""
WITH d AS ({_PARTS_SQL}), k AS (SELECT *, unnest(range(n)) AS i FROM d),
p AS (SELECT path, i // 20 AS c, i % 20 AS k, substr(h, 400 * i + 1, 400) AS h FROM k UNION ALL SELECT path, (n + 19) // 20, 0, '656E64' FROM d)
SELECT path, CASE WHEN k < 10 THEN 1 ELSE 300 END AS track, 1000 * c + 40 * k AS pts, 1000 AS timescale, CASE WHEN k = 0 THEN 1 WHEN k < 10 THEN 0 ELSE 4 END AS flags,
       length(h) // 2 AS size, md5(unhex(CASE WHEN k < 10 THEN h ELSE '21' || h END)) AS data FROM p
""")
def mkv_packets(spark, sf_dir):
    """Simple blocks, groups, the three laces and a stripped prefix, with the bytes that they lead to."""
    files = _files(spark, sf_dir, lambda t: compose.mkv(_clusters(t)))
    return media.packets(media.mkv_packets(files), files).select("path", "track", "pts", "timescale", "flags", "size", F.md5("data").alias("data"))


@_r.query(f"SELECT path, 1 AS track, 1000 * c AS time, c AS cue FROM (SELECT path, unnest(range((n + 19) // 20 + 1)) AS c FROM ({_PARTS_SQL}))")
def mkv_cues(spark, sf_dir):
    """Cue points in order of their place."""
    found = media.mkv_cues(_files(spark, sf_dir, lambda t: compose.mkv(_clusters(t))))
    order = Window.partitionBy("path").orderBy("pos")
    return found.select("path", "track", "time", (F.row_number().over(order) - 1).cast("long").alias("cue"))


def _jpeg(t: str) -> bytes:
    return compose.jpeg(t.encode(), t[:10].encode("ascii", "replace"), len(t) % 8 + 1, "<>"[len(t) % 2])


@_r.query(f"""
WITH d AS (SELECT 'doc/' || doc_id AS path, {_BYTES} AS bytes, 44 + greatest(least(10, length(coalesce(text, ''))) + 1, 5) AS app1, greatest(1, ({_BYTES} + 59999) // 60000) AS q FROM documents),
e AS (SELECT *, 24 + app1 AS a, 24 + app1 + 4 * q + bytes AS z FROM d),
s AS (
  SELECT path, unnest([{{'k': 0, 'name': 'SOI', 'o': 2, 's': 0}}, {{'k': 1, 'name': 'APP0', 'o': 6, 's': 14}}, {{'k': 2, 'name': 'APP1', 'o': 24, 's': app1}},
    {{'k': q + 3, 'name': 'SOF0', 'o': z + 4, 's': 9}}, {{'k': q + 4, 'name': 'SOS', 'o': z + 17, 's': 6}}, {{'k': q + 5, 'name': 'EOI', 'o': z + 27, 's': 0}}]) AS r FROM e
  UNION ALL
  SELECT path, {{'k': j + 3, 'name': 'COM', 'o': a + 60004 * j + 4, 's': least(60000, bytes - 60000 * j)}} FROM (SELECT *, unnest(range(q)) AS j FROM e)
)
SELECT path, CAST(r.k AS BIGINT) AS node_id, -1 AS parent_id, 0 AS depth, r.name AS name, r.name AS path_expr, CAST(r.o AS BIGINT) AS "offset", CAST(r.s AS BIGINT) AS size FROM s
""")
def jpeg_segments(spark, sf_dir):
    """S32, with each text as comments."""
    return containers.elements(_files(spark, sf_dir, _jpeg), "jpeg")


@_r.query("SELECT 'doc/' || doc_id AS path, regexp_replace(substr(t, 1, 10), '[^\\x00-\\x7F]', '?', 'g') AS make, CAST(length(t) % 8 + 1 AS VARCHAR) AS orientation FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def exif(spark, sf_dir):
    """S35."""
    found = media.exif(_files(spark, sf_dir, _jpeg))
    return found.select("path", F.element_at("tags", "Make").alias("make"), F.element_at("tags", "Orientation").alias("orientation"))


#: Letters of a text that a picture's segments take.
_SEGMENT = 10_000
_PICTURES_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, t, unnest(range(greatest(1, (length(t) + {_SEGMENT - 1}) // {_SEGMENT}))) AS k FROM d),
p AS (SELECT 'doc/' || doc_id || '/' || k AS path, k, substr(t, {_SEGMENT} * k + 1, {_SEGMENT}) AS part FROM k), q AS (SELECT *, length(part) AS n FROM p)"""


def _picture(part: str, k: int, order: str) -> bytes:
    n = len(part)
    pack = lambda kind, *numbers: struct.pack(order + kind, *numbers)
    body = compose.tiff(
        order,
        [(0x010E, 2, n + 1, part.encode("ascii", "replace") + b"\0"), (0x0112, 3, 1, pack("H", n % 8 + 1))],
        [(0x829A, 5, 1, pack("II", 1, n + 1)), (0x0131, 2, 4, b"pen\0"), (0xC0DE, 9, 1, pack("i", -n))],
        [(1, 2, 2, b"NS"[n % 2 : n % 2 + 1] + b"\0"), (2, 5, 3, pack("6I", n, 1, k, 1, 59, 10))],
        part.encode() or b" ",
    )
    w = n % 3 + 1
    head = b"JFIF\0\1\2\1\0\x48\0\x48" + bytes([w, 2]) + bytes([n % 256]) * (6 * w)
    more = b"JFXX\0\x11\x10\x10" + b"".join(bytes((p, 255 - p, p // 2)) for p in range(256)) + bytes((n + i) % 256 for i in range(256))
    return compose.jpeg_of((0xE0, head), (0xE0, more), (0xE1, b"Exif\0\0" + body))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a picture for each part of each text, in both byte orders by turns."""

    def pictures(doc: int, text: str | None) -> Iterator[tuple[str, bytes]]:
        for k, at in enumerate(range(0, max(len(text or ""), 1), _SEGMENT)):
            yield f"doc/{doc}/{k}", _picture((text or "")[at : at + _SEGMENT], k, "<>"[k % 2])

    return made(table(spark, sf_dir, "documents").select("doc_id", "text"), pictures)


@_r.query(rf"""{_PICTURES_SQL},
r AS (SELECT path, unnest([
  {{'directory': 'IFD0', 'tag': 270, 'type': 'ASCII', 'count': n + 1, 'name': 'ImageDescription', 'value': regexp_replace(part, '[^\x00-\x7F]', '?', 'g')}},
  {{'directory': 'IFD0', 'tag': 274, 'type': 'SHORT', 'count': 1, 'name': 'Orientation', 'value': CAST(n % 8 + 1 AS VARCHAR)}},
  {{'directory': 'IFD0', 'tag': 34665, 'type': 'LONG', 'count': 1, 'name': 'ExifIFD', 'value': '62'}},
  {{'directory': 'IFD0', 'tag': 34853, 'type': 'LONG', 'count': 1, 'name': 'ExifGPSIFD', 'value': '104'}},
  {{'directory': 'Exif', 'tag': 33434, 'type': 'RATIONAL', 'count': 1, 'name': 'ExifExposureTime', 'value': '1/' || (n + 1)}},
  {{'directory': 'Exif', 'tag': 305, 'type': 'ASCII', 'count': 4, 'name': 'Software', 'value': 'pen'}},
  {{'directory': 'Exif', 'tag': 49374, 'type': 'SLONG', 'count': 1, 'name': '0xC0DE', 'value': CAST(-n AS VARCHAR)}},
  {{'directory': 'GPS', 'tag': 1, 'type': 'ASCII', 'count': 2, 'name': 'gps.LatitudeRef', 'value': CASE WHEN n % 2 = 0 THEN 'N' ELSE 'S' END}},
  {{'directory': 'GPS', 'tag': 2, 'type': 'RATIONAL', 'count': 3, 'name': 'gps.Latitude', 'value': n || '/1 ' || k || '/1 59/10'}},
  {{'directory': 'IFD1', 'tag': 513, 'type': 'LONG', 'count': 1, 'name': 'JPEGInterchangeFormat', 'value': CAST(196 + CASE WHEN n > 3 THEN n + 1 ELSE 0 END AS VARCHAR)}},
  {{'directory': 'IFD1', 'tag': 514, 'type': 'LONG', 'count': 1, 'name': 'JPEGInterchangeFormatLength', 'value': CAST(greatest(octet_length(encode(part)), 1) AS VARCHAR)}}]) AS r FROM q)
SELECT path, r.directory AS directory, r.tag AS tag, r.type AS type, r.count AS "count", r.name AS name, md5(r.value) AS value FROM r
""")
def exif_tags(spark, sf_dir):
    """Tags of four directories, with names by a chain of dictionaries."""
    return tags.tags(_pictures(spark, sf_dir)).drop("segment").withColumn("value", F.md5("value"))


@_r.query(f"""{_PICTURES_SQL}
SELECT path, 'JFIF' AS source, 'rgb' AS kind, n % 3 + 1 AS width, 2 AS height, md5(unhex(repeat(printf('%02X', n % 256), 6 * (n % 3 + 1)))) AS data FROM q
UNION ALL SELECT path, 'JFXX', 'palette', 16, 16, md5(unhex(string_agg(printf('%02X%02X%02X', c, 255 - c, c // 2), '' ORDER BY i))) FROM (SELECT path, i, (n + i) % 256 AS c FROM (SELECT path, n, unnest(range(256)) AS i FROM q)) GROUP BY path
UNION ALL SELECT path, 'Exif', 'jpeg', NULL, NULL, md5(encode(CASE WHEN part = '' THEN ' ' ELSE part END)) FROM q
""")
def thumbnails(spark, sf_dir):
    """Thumbnails of JFIF, of a palette and of the second directory."""
    return tags.thumbnails(_pictures(spark, sf_dir)).withColumn("data", F.md5("data"))


@_r.query("""
SELECT 'doc/' || doc_id AS path, ['wave', 'mp4', 'matroska', 'mp3', '----'][doc_id % 5 + 1] AS format, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 100 END AS score FROM documents
""")
def probe_files(spark, sf_dir):
    """The kind of a file by its score, behind an ID3v2 tag in half of them."""

    kinds = (lambda t: compose.wav(t.encode()), lambda t: compose.mp4(_parts(t)), lambda t: compose.mkv(_clusters(t)), lambda t: compose.mp3(t.encode()), lambda t: t.encode())

    def content(doc: int, text: str | None) -> list[tuple[str, bytes]]:
        text = text or ""
        return [(f"doc/{doc}", (compose.id3(text[:50], "a", "(1)") if doc % 2 else b"") + kinds[doc % 5](text))]

    return media.probe_scores(made(table(spark, sf_dir, "documents").select("doc_id", "text"), content))
