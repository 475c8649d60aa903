"""Queries on header fields: bit patterns from order lines, texts from documents and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import bits, rational, text
from reelframe.functions.dims import AAC_CHANNELS, AAC_RATES, GENRES, MATROSKA_CODECS, MP4_CODECS, MPEG_BITRATES, MPEG_RATES, dimension
from reelframe.queries.registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_KEY)
_NUMBER_SQL = "(l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber) % 4294967296"


def _numbers(spark, sf_dir):
    """Order lines with x, an unsigned 32-bit number."""
    x = (F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503 + F.col("l_linenumber")) % 4294967296
    return table(spark, sf_dir, "lineitem").select(*_KEY, x.alias("x"))


@_r.query("SELECT doc_id, unicode(substr(t, 1, 1))::BIGINT + unicode(substr(t, 2, 1)) * 256 + unicode(substr(t, 3, 1)) * 65536 + unicode(substr(t, 4, 1))::BIGINT * 16777216 AS code, substr(t, 1, 4) AS back FROM (SELECT doc_id, rpad(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 4, ' ') AS t FROM documents)")
def fourcc(spark, sf_dir):
    t = F.rpad(F.regexp_replace("text", "[^a-zA-Z]", ""), 4, " ")
    d = table(spark, sf_dir, "documents").select("doc_id", bits.fourcc(t).alias("code"))
    return d.select("doc_id", "code", bits.fourcc_text(F.col("code")).alias("back"))


@_r.query(f"SELECT {_KEYS}, (x & 127) + (x >> 8 & 127) * 128 + (x >> 16 & 127) * 16384 + (x >> 24 & 127) * 2097152 AS size FROM (SELECT *, {_NUMBER_SQL} AS x FROM lineitem)")
def synchsafe(spark, sf_dir):
    return _numbers(spark, sf_dir).select(*_KEY, bits.synchsafe(F.col("x")).alias("size"))


@_r.query(f"""
WITH v AS (SELECT {_KEYS}, {_NUMBER_SQL} >> 24 AS a, {_NUMBER_SQL} & 16777215 AS b FROM lineitem),
n AS (SELECT *, CASE WHEN a >= 128 THEN 1 WHEN a >= 64 THEN 2 WHEN a >= 32 THEN 3 WHEN a >= 16 THEN 4 ELSE 0 END AS length FROM v)
SELECT {_KEYS}, CAST(length AS BIGINT) AS length, CASE length WHEN 1 THEN a - 128 WHEN 2 THEN (a - 64) * 256 + (b >> 16) WHEN 3 THEN (a - 32) * 65536 + (b >> 8) WHEN 4 THEN (a - 16) * 16777216 + b END AS value FROM n
""")
def ebml_vint(spark, sf_dir):
    """Variable-length numbers of up to four bytes; longer ones are null here."""
    first, rest = bits.field(F.col("x"), 24, 8), F.col("x").bitwiseAND(F.lit(0xFFFFFF))
    n = bits.vint_length(first)
    n = F.when(n <= 4, n).otherwise(0)
    d = _numbers(spark, sf_dir).select(*_KEY, first.alias("a"), rest.alias("b"), n.cast("long").alias("length"))
    tail = F.when(F.col("length") == 1, 0).when(F.col("length") == 2, F.shiftright("b", 16)).when(F.col("length") == 3, F.shiftright("b", 8)).otherwise(F.col("b"))
    return d.select(*_KEY, "length", F.when(F.col("length") > 0, bits.vint_value(F.col("a"), tail, F.col("length"))).alias("value"))


@_r.query(f"""
WITH b AS (SELECT {_KEYS}, lpad(bin({_NUMBER_SQL} >> (l_linenumber * 2)::INTEGER), 32, '0') AS s FROM lineitem), z AS (SELECT *, instr(s, '1') - 1 AS z FROM b)
SELECT {_KEYS}, CASE WHEN z >= 0 AND 2 * z + 1 <= 32 THEN list_sum(list_transform(range(z + 1), lambda i : CAST(substr(s, CAST(z + 1 + i AS BIGINT), 1) AS BIGINT) << CAST(z - i AS INTEGER)))::BIGINT - 1 END AS value FROM z
""")
def exp_golomb(spark, sf_dir):
    s = F.lpad(F.bin(F.expr("shiftright(x, CAST(l_linenumber * 2 AS int))")), 32, "0")
    return _numbers(spark, sf_dir).select(*_KEY, bits.exp_golomb(s).alias("value"))


_HEAD_SQL = f"SELECT {_KEYS}, 4292870144 + {_NUMBER_SQL} % 2097152 AS h FROM lineitem"
_RATES_SQL = "[" + ", ".join(str(x) for key in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)) for x in MPEG_BITRATES[key]) + "]"


@_r.query(f"""
WITH h AS ({_HEAD_SQL}),
f AS (SELECT *, h >> 19 & 3 AS v, 4 - (h >> 17 & 3) AS layer, h >> 12 & 15 AS br, h >> 10 & 3 AS sr, h >> 9 & 1 AS pad FROM h),
g AS (SELECT *, CASE WHEN v = 3 THEN 1 ELSE 2 END AS kind FROM f WHERE v <> 1 AND layer <> 4 AND br NOT IN (0, 15) AND sr <> 3),
k AS (SELECT *, 1000 * CAST({_RATES_SQL}[(kind - 1) * 42 + (layer - 1) * 14 + br] AS BIGINT) AS bitrate, {list(MPEG_RATES)}[sr + 1] // CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS rate,
  CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND kind = 2 THEN 576 ELSE 1152 END AS n, CASE WHEN layer = 1 THEN 4 ELSE 1 END AS unit FROM g)
SELECT {_KEYS}, CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 25 END AS version, layer, bitrate, CAST(rate AS BIGINT) AS sample_rate, CASE WHEN (h >> 6 & 3) = 3 THEN 1 ELSE 2 END AS channels, CAST(n AS BIGINT) AS samples, (n * bitrate // (rate * 8 * unit) + pad) * unit AS frame_length FROM k
""")
def mpa_header(spark, sf_dir):
    """S15 (B11: rates and lengths as the format has them); valid headers only."""
    h = _numbers(spark, sf_dir).withColumn("h", F.col("x") % 2097152 + 0xFFE00000)
    return h.select(*_KEY, *(c.alias(n) for n, c in bits.mpeg_header(F.col("h")).items())).filter("version IS NOT NULL")


@_r.query(f"""
WITH a AS (SELECT {_KEYS}, {_NUMBER_SQL} % 65536 AS a FROM lineitem)
SELECT {_KEYS}, a >> 11 AS object_type, CAST({list(AAC_RATES)}[(a >> 7 & 15) + 1] AS BIGINT) AS sample_rate, CASE WHEN (a >> 3 & 15) < 8 THEN CAST({list(AAC_CHANNELS)}[(a >> 3 & 15) + 1] AS BIGINT) END AS channels FROM a
""")
def asc(spark, sf_dir):
    """S36."""
    return _numbers(spark, sf_dir).select(*_KEY, *(c.alias(n) for n, c in bits.audio_config(F.col("x") % 65536).items()))


_GENRE_LIST = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in GENRES) + "]"


@_r.query(f"""
WITH g AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(' || o_custkey % 160 || ')' WHEN 1 THEN '' || o_custkey % 160 ELSE o_orderpriority END AS tag FROM orders)
SELECT o_orderkey, tag, CASE WHEN regexp_matches(tag, '^\\(?\\d+\\)?$') THEN coalesce({_GENRE_LIST}[CAST(regexp_extract(tag, '\\d+') AS INTEGER) + 1], tag) ELSE tag END AS genre FROM g
""")
def genre_decode(spark, sf_dir):
    """Genres as tags write them (B15: the last one counts)."""
    n = F.col("o_custkey") % 160
    tag = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), n, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, n.cast("string")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag")).select("o_orderkey", "tag", text.genre(F.col("tag")).alias("genre"))


@_r.query(r"SELECT event_id, t, regexp_matches(t, '^\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2})?)?)?)?)?$') AS valid FROM (SELECT event_id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, CAST(event_id % 20 AS BIGINT)) AS t FROM events)")
def id3_time_valid(spark, sf_dir):
    """F11."""
    t = F.expr("substring(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 1, CAST(event_id % 20 AS int))")
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t", F.col("t").rlike(text.ID3_TIME).alias("valid"))


@_r.query("""
WITH t AS (SELECT doc_id, rpad(regexp_replace(text, '[^ -~]', ' ', 'g'), 128, ' ') AS t FROM documents)
SELECT doc_id, trim(substr(t, 4, 30), ' ') AS title, trim(substr(t, 34, 30), ' ') AS artist, trim(substr(t, 64, 30), ' ') AS album, trim(substr(t, 94, 4), ' ') AS year FROM t
""")
def id3v1(spark, sf_dir):
    """The fields of a 128-byte tag."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.rpad(F.regexp_replace("text", "[^ -~]", " "), 128, " ").alias("t"))
    at = {"title": (4, 30), "artist": (34, 30), "album": (64, 30), "year": (94, 4)}
    return t.select("doc_id", *(text.id3v1_field(F.col("t"), *p).alias(n) for n, p in at.items()))


@_r.query(f"SELECT {_KEYS}, chr(((x >> 10 & 31) + 96)::INTEGER) || chr(((x >> 5 & 31) + 96)::INTEGER) || chr(((x & 31) + 96)::INTEGER) AS lang FROM (SELECT *, {_NUMBER_SQL} % 32768 AS x FROM lineitem)")
def lang_unpack(spark, sf_dir):
    return _numbers(spark, sf_dir).select(*_KEY, text.packed_language(F.col("x") % 32768).alias("lang"))


@_r.query("SELECT event_id, printf('%d_%d_%s@%d', user_id, epoch_us(ts), event_type, event_id % 4096) AS name FROM events")
def format_strings(spark, sf_dir):
    """K1: what a packet's file is called."""
    from reelframe.operators.timeline import micros

    return table(spark, sf_dir, "events").select("event_id", F.format_string("%d_%d_%s@%d", "user_id", micros(F.col("ts")), "event_type", F.col("event_id") % 4096).alias("name"))


@_r.query(f"""
WITH q AS (SELECT {_KEYS}, CAST(l_quantity AS BIGINT) AS a, l_linenumber::BIGINT AS b, l_partkey AS c, l_suppkey AS d FROM lineitem),
s AS (SELECT *, a * d + c * b AS n, b * d AS m FROM q)
SELECT {_KEYS}, n // gcd(n, m) AS value, m // gcd(n, m) AS scale, CAST(trunc(CAST(n AS DECIMAL(30, 0)) * 1000000 // m) AS BIGINT) AS us FROM s WHERE m <> 0
""")
def rational_add(spark, sf_dir):
    """Times as rationals (B27: a scale of 0 is no time)."""
    li = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_quantity").cast("long"))
    s = rational.add(F.col("a"), F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey"))
    li = li.select(*_KEY, s.alias("s")).filter("s IS NOT NULL")
    return li.select(*_KEY, "s.value", "s.scale", rational.microseconds(F.col("s.value"), F.col("s.scale")).alias("us"))


@_r.query(f"""
WITH p AS (SELECT event_id, event_id * 37 % 10000 AS p, event_id % 65536 * 100 AS size FROM events),
q AS (SELECT *, p // 100 AS i FROM p), r AS (SELECT *, i * i * 256 // 10000 AS a, CASE WHEN i = 99 THEN 256 ELSE (i + 1) * (i + 1) * 256 // 10000 END AS b FROM q)
SELECT event_id, (a * 100 + (b - a) * (p - i * 100)) * size // 25600 AS pos FROM r
""")
def toc_interp(spark, sf_dir):
    """A place in a table of 100 entries by linear interpolation (B12: fractions of a percent count, and the last entry has
    an end)."""
    p = table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 37 % 10000 AS p", "event_id % 65536 * 100 AS size").withColumn("i", F.expr("p div 100"))
    toc = lambda i: F.expr(f"({i}) * ({i}) * 256 div 10000")
    p = p.withColumns({"a": toc("i"), "b": F.when(F.col("i") == 99, 256).otherwise(toc("i + 1"))})
    return p.select("event_id", F.expr("(a * 100 + (b - a) * (p - i * 100)) * size div 25600").alias("pos"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@_r.query(f"""
WITH n AS (SELECT n_nationkey, ['mp4a', 'avc1', 'avc2', 'hvc1', 'hev1', 'jpeg'][n_nationkey % 6 + 1] AS entry FROM nation)
SELECT n_nationkey, n.entry, coalesce(codec, '----') AS codec FROM n LEFT JOIN (VALUES {_values(MP4_CODECS)}) d (entry, codec) ON n.entry = d.entry
""")
def codec_lookup(spark, sf_dir):
    """J1, S40 (B9: hev1 is known)."""
    entry = F.element_at(F.array(*map(F.lit, ("mp4a", "avc1", "avc2", "hvc1", "hev1", "jpeg"))), F.col("n_nationkey") % 6 + 1)
    n = table(spark, sf_dir, "nation").select("n_nationkey", entry.alias("entry"))
    return n.join(F.broadcast(dimension(spark, MP4_CODECS, "entry string, codec string")), "entry", "left").select("n_nationkey", "entry", F.coalesce("codec", F.lit("----")).alias("codec"))


_IDS = ("V_MPEG4/ISO/AVC", "V_MPEG4/ISO/SP", "A_AAC/MPEG4/LC", "A_MPEG/L3", "V_VP9", "S_TEXT/UTF8", "A_DTS")
_RANKED = [(k, p, c) for k, (p, c) in enumerate(MATROSKA_CODECS)]


@_r.query(f"""
WITH o AS (SELECT o_orderkey, {list(_IDS)}[o_orderkey % 7 + 1] AS id FROM orders)
SELECT o_orderkey, id, coalesce(min_by(codec, rank), '----') AS codec FROM o LEFT JOIN (VALUES {_values(_RANKED)}) d (rank, prefix, codec) ON starts_with(id, prefix) GROUP BY o_orderkey, id
""")
def codec_prefix(spark, sf_dir):
    """Of the prefixes that fit the first counts. The distinct ids are looked up, not the rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _IDS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("id"))
    out = F.lit("----")
    for prefix, codec in reversed(MATROSKA_CODECS):
        out = F.when(F.col("id").startswith(prefix), codec).otherwise(out)
    return o.select("o_orderkey", "id", out.alias("codec"))


_MAGIC = ("fLaC", "RIFF....WAVE", "RIFF....AVI ", "RIFF....AMV ", "OggS", "")


@_r.query(f"""
WITH d AS (SELECT doc_id, {list(_MAGIC)}[doc_id % 6 + 1] || text AS c FROM documents)
SELECT doc_id, CASE WHEN substr(c, 1, 4) = 'fLaC' THEN 'flac' WHEN substr(c, 1, 4) = 'RIFF' AND substr(c, 9, 4) = 'WAVE' THEN 'wave' WHEN substr(c, 1, 4) = 'RIFF' AND substr(c, 9, 4) IN ('AVI ', 'AVIX', 'AMV ') THEN 'avi' ELSE '----' END AS format FROM d
""")
def probe_fourcc(spark, sf_dir):
    """S1."""
    c = F.concat(F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("doc_id") % 6 + 1).cast("int")), "text")
    head, kind = F.substring(c, 1, 4), F.substring(c, 9, 4)
    riff = head == "RIFF"
    fmt = F.when(head == "fLaC", "flac").when(riff & (kind == "WAVE"), "wave").when(riff & kind.isin("AVI ", "AVIX", "AMV "), "avi").otherwise("----")
    return table(spark, sf_dir, "documents").select("doc_id", fmt.alias("format"))


@_r.query("""
WITH s AS (SELECT doc_id, least(100, 60 * contains(text, 'the')::INT + 20 * contains(text, 'and')::INT + 20 * contains(text, 'of')::INT) AS wave, least(100, 50 * contains(text, 'der')::INT + 20 * contains(text, 'die')::INT) AS mp4, least(100, 10 * (length(text) - length(replace(text, 'e', '')))) AS mkv FROM documents),
r AS (SELECT doc_id, unnest([{'f': 'wave', 's': wave, 'k': 1}, {'f': 'mp4', 's': mp4, 'k': 2}, {'f': 'mkv', 's': mkv, 'k': 3}]) AS x FROM s)
SELECT doc_id, CASE WHEN max(x.s) > 0 THEN max_by(x.f, x.s * 10 - x.k) ELSE '----' END AS format, CAST(max(x.s) AS BIGINT) AS score FROM r GROUP BY doc_id
""")
def probe_score(spark, sf_dir):
    """The highest score, of equal ones the format that is tried first."""
    has = lambda w: F.col("text").contains(w).cast("int")
    wave = F.least(F.lit(100), 60 * has("the") + 20 * has("and") + 20 * has("of"))
    mp4 = F.least(F.lit(100), 50 * has("der") + 20 * has("die"))
    mkv = F.least(F.lit(100), 10 * (F.length("text") - F.length(F.replace(F.col("text"), F.lit("e"), F.lit("")))))
    rows = F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("format")) for k, (n, s) in enumerate((("wave", wave), ("mp4", mp4), ("mkv", mkv)))))
    best = table(spark, sf_dir, "documents").select("doc_id", F.array_max(rows).alias("b"))
    return best.select("doc_id", F.when(F.col("b.score") > 0, F.col("b.format")).otherwise("----").alias("format"), F.col("b.score").cast("long").alias("score"))


@_r.query("SELECT node, repeat('  ', depth) || name AS line FROM (SELECT r_regionkey * 100 AS node, 0 AS depth, r_name AS name FROM region UNION ALL SELECT n_regionkey * 100 + n_nationkey + 1, 1, n_name FROM nation)")
def tree_dump(spark, sf_dir):
    """K7: an indented tree, with regions over nations."""
    top = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 100).alias("node"), F.lit(0).alias("depth"), F.col("r_name").alias("name"))
    below = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).alias("node"), F.lit(1).alias("depth"), F.col("n_name").alias("name"))
    return top.unionByName(below).select("node", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("line"))


@_r.query(f"""
SELECT {_KEYS}, x BETWEEN 129 AND 254 OR x BETWEEN 16511 AND 32766 OR x BETWEEN 2113535 AND 4194302 OR x BETWEEN 270532607 AND 536870910 AS valid, x % 300000 + CASE WHEN x % 300000 < 128 THEN 2 WHEN x % 300000 < 16384 THEN 3 ELSE 4 END AS descriptor, lcm(l_partkey, l_suppkey) AS common
FROM (SELECT *, {_NUMBER_SQL} >> (l_linenumber * 3) AS x FROM lineitem)
""")
def ids_and_lengths(spark, sf_dir):
    """Valid ids of EBML elements, sizes of descriptors, and common scales of times."""
    li = _numbers(spark, sf_dir).withColumn("x", F.call_function("shiftright", F.col("x"), (F.col("l_linenumber") * 3).cast("int")))
    return li.select(*_KEY, bits.ebml_id(F.col("x")).alias("valid"), bits.descriptor_length(F.col("x") % 300000).alias("descriptor"), rational.lcm(F.col("l_partkey"), F.col("l_suppkey")).alias("common"))
