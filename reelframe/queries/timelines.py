"""Queries on timelines: events are packets (track: user_id), orders and lineitem are chunks and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.operators import timeline as tl
from reelframe.plans import sample_table as st
from reelframe.queries.registry import Registry, table
from reelframe.stored import materialize

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, kind, us, arrival: arrival is a shuffled order, since events come in order of time."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", F.col("event_type").alias("kind"), tl.micros(F.col("ts")).alias("us"), (F.col("event_id") * 7919 % 10007 * 1000000 + F.col("event_id")).alias("arrival"))


_EV = "SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS us, event_id * 7919 % 10007 * 1000000 + event_id AS arrival FROM events"
_SOUGHT = f"""
WITH e AS ({_EV}),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx,
  (min(us) OVER (PARTITION BY user_id) + max(us) OVER (PARTITION BY user_id)) // 2 AS target FROM e),
s AS (SELECT *, max(CASE WHEN us <= target THEN idx END) OVER (PARTITION BY user_id) AS cur,
  coalesce(max(CASE WHEN us <= target AND kind = 'signup' THEN idx END) OVER (PARTITION BY user_id), 0) AS start FROM p)
"""


def _sought(spark, sf_dir):
    return tl.seek(packets(spark, sf_dir), "user_id", "us", ["event_id"], F.col("kind") == "signup")


@_r.query(_SOUGHT + "SELECT user_id, max(target) AS target, max(cur) AS cur, max(start) AS start, max(cur) - max(start) AS preroll FROM s GROUP BY user_id")
def seek_sync(spark, sf_dir):
    """J4, W4 (B6: a seek past the end lands on the last packet)."""
    return _sought(spark, sf_dir).groupBy("user_id").agg(F.max("target").alias("target"), F.max("cur").alias("cur"), F.max("start").alias("start"), (F.max("cur") - F.max("start")).alias("preroll"))


@_r.query(_SOUGHT + "SELECT user_id, event_id, idx, CASE WHEN kind IN ('click', 'view') THEN 'drop' ELSE 'reference' END AS action FROM s WHERE idx >= start AND idx < cur")
def seek_preroll(spark, sf_dir):
    """F4, with clicks and views as slices that nothing refers to."""
    return tl.preroll(_sought(spark, sf_dir), F.col("kind").isin("click", "view")).select("user_id", "event_id", "idx", "action")


@_r.query(f"""
WITH e AS ({_EV}), q AS (SELECT * FROM e WHERE kind = 'purchase'),
c AS (SELECT user_id, us, max(event_id) AS event_id FROM e WHERE kind = 'click' GROUP BY user_id, us)
SELECT q.user_id, q.event_id, q.us, c.event_id AS last_click FROM q ASOF LEFT JOIN c ON q.user_id = c.user_id AND q.us >= c.us
""")
def asof_backward(spark, sf_dir):
    """The last click before each purchase."""
    p = packets(spark, sf_dir)
    q = p.filter("kind = 'purchase'").select("user_id", "event_id", "us")
    return tl.as_of(q, p.filter("kind = 'click'").select("user_id", "us", F.col("event_id").alias("click")), ["user_id"], "us", "click", "last_click")


@_r.query("""
WITH c AS (SELECT o_custkey, epoch_us(o_orderdate) AS us, max(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
q AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us FROM orders)
SELECT q.o_orderkey, q.o_custkey, q.us, c.pos FROM q ASOF LEFT JOIN c ON q.o_custkey = c.o_custkey AND q.us >= c.us
""")
def cue_asof(spark, sf_dir):
    """From each time of a track to the cue before it; finished orders are cues."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", tl.micros(F.col("o_orderdate")).alias("us"))
    cues = o.filter("o_orderstatus = 'F'").select("o_custkey", "us", F.col("o_orderkey").alias("cue"))
    return tl.as_of(o.drop("o_orderstatus"), cues, ["o_custkey"], "us", "cue", "pos").select("o_orderkey", "o_custkey", "us", "pos")


@_r.query(f"""
WITH e AS ({_EV}), a AS (SELECT user_id, us, event_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS until FROM e WHERE kind = 'view')
SELECT v.user_id, v.event_id AS video, a.event_id AS audio FROM e v JOIN a ON v.kind = 'click' AND v.user_id = a.user_id AND v.us >= a.us AND (a.until IS NULL OR v.us < a.until)
""")
def av_sync_interval(spark, sf_dir):
    """The audio frame (view) that sounds while a video frame (click) is shown."""
    p = packets(spark, sf_dir)
    a = p.filter("kind = 'view'").withColumn("until", F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    a = a.filter(F.col("until").isNull() | (F.col("until") > F.col("us"))).select("user_id", "us", F.col("event_id").alias("a"))
    v = p.filter("kind = 'click'").select("user_id", "us", F.col("event_id").alias("video"))
    return tl.as_of(v, a, ["user_id"], "us", "a", "audio").filter("audio IS NOT NULL").select("user_id", "video", "audio")


@_r.query("""
WITH s AS (SELECT conv_id, role, turn, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS track, (turn * 7919 + length(text)) % 1000 AS place FROM conversations),
d AS (SELECT *, max(place) OVER (PARTITION BY conv_id, track ORDER BY turn) AS due FROM s)
SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY due, track DESC, turn) - 1 AS position FROM d
""")
def interleave_merge(spark, sf_dir):
    """U1, with a track for each role."""
    s = table(spark, sf_dir, "conversations")
    s = s.select("conv_id", "role", "turn", F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2).alias("track"), ((F.col("turn") * 7919 + F.length("text")) % 1000).alias("place"))
    return tl.interleave(s, "conv_id", "track", "turn", "place").select("conv_id", "role", "turn", "position")


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY arrival) - 1 AS decode_pos, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS show_pos FROM e")
def pts_reorder(spark, sf_dir):
    """Decoding order to presentation order."""
    pos = lambda *by: F.row_number().over(Window.partitionBy("user_id").orderBy(*by)).cast("long") - 1
    return packets(spark, sf_dir).select("user_id", "event_id", pos("arrival").alias("decode_pos"), pos("us", "event_id").alias("show_pos"))


_ARRIVALS = f"""WITH e AS ({_EV}), a AS (SELECT *, lag(us) OVER w AS last_pts, max(us) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM e WINDOW w AS (PARTITION BY user_id ORDER BY arrival))"""


@_r.query(_ARRIVALS + "SELECT user_id, event_id, us, last_pts, coalesce(us <= last_pts, false) AS unordered FROM a")
def unordered_flag(spark, sf_dir):
    """F8, W5."""
    return tl.arrivals(packets(spark, sf_dir), "user_id", "arrival", "us").select("user_id", "event_id", "us", "last_pts", "unordered")


@_r.query(_ARRIVALS + "SELECT user_id, event_id, us, clock, coalesce(us < clock, false) AS late FROM a")
def late_drop(spark, sf_dir):
    """Strictly before the clock is late."""
    return tl.arrivals(packets(spark, sf_dir), "user_id", "arrival", "us").select("user_id", "event_id", "us", "clock", "late")


@_r.query(f"""
WITH e AS ({_EV}), c AS (SELECT *, us + event_id * 7919 % 20011 - 10000 AS clock, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt FROM e)
SELECT user_id, event_id, CASE WHEN us - clock > 5000 THEN 'wait' WHEN us - clock < -5000 THEN 'late' ELSE 'play' END AS action, greatest(nxt - clock, 0) AS next_us FROM c WHERE nxt IS NOT NULL
""")
def pacing_class(spark, sf_dir):
    """The decision, not the waiting."""
    p = packets(spark, sf_dir).withColumn("clock", F.col("us") + F.col("event_id") * 7919 % 20011 - 10000)
    p = p.withColumn("nxt", F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).filter("nxt IS NOT NULL")
    action, wait = tl.pacing(F.col("us"), F.col("clock"), F.col("nxt"))
    return p.select("user_id", "event_id", action.alias("action"), wait.alias("next_us"))


@_r.query(f"""
WITH e AS ({_EV}), c AS (SELECT user_id, us, max(event_id) AS event_id FROM e WHERE kind = 'signup' GROUP BY user_id, us), q AS (SELECT * FROM e WHERE kind = 'purchase')
SELECT q.user_id, q.event_id, CASE WHEN c.us IS NULL THEN 0 ELSE c.event_id * 1000 + q.us - c.us END AS media_us FROM q ASOF LEFT JOIN c ON q.user_id = c.user_id AND q.us >= c.us
""")
def clock_at(spark, sf_dir):
    """A clock set at each signup runs on from there; purchases read it."""
    p = packets(spark, sf_dir)
    sets = p.filter("kind = 'signup'").select("user_id", "us", F.struct(F.col("us").alias("at"), (F.col("event_id") * 1000).alias("media")).alias("set"))
    got = tl.as_of(p.filter("kind = 'purchase'").select("user_id", "event_id", "us"), sets, ["user_id"], "us", "set", "last")
    return got.select("user_id", "event_id", F.when(F.col("last").isNull(), 0).otherwise(F.col("last.media") + F.col("us") - F.col("last.at")).alias("media_us"))


@_r.query(f"""
WITH e AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS clock FROM ({_EV}))
SELECT user_id, event_id, abs(us // 1000 - clock // 1000) >= 200000 AS seeks FROM e WHERE clock IS NOT NULL AND event_id % 5 > 0
""")
def seek_or_stay(spark, sf_dir):
    """seeks of less than 200 ms are ignored, and packets that are marked as damaged are passed over."""
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    p = packets(spark, sf_dir).withColumn("clock", before).filter("clock IS NOT NULL").filter(F.col("event_id") % 5 > 0)
    return p.select("user_id", "event_id", tl.worth_seeking(F.expr("us div 1000"), F.expr("clock div 1000")).alias("seeks"))


@_r.query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k, (event_id * 2654435761 // 1024) % 7 AS c FROM ({_EV})),
s AS (
  SELECT user_id, event_id, k, us, CASE WHEN c IN (0, 5) THEN event_id * 1000 ELSE 0 END AS media, CASE WHEN c = 3 THEN event_id % 4 / 2.0 ELSE 1.0 END AS speed, c = 1 AS started, c = 4 AS master, c <> 1 AND c = 5 AS fresh FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.k, e.us,
    CASE e.c WHEN 0 THEN e.event_id * 1000 WHEN 5 THEN greatest(e.event_id * 1000, s.media + CAST(CASE WHEN s.started AND (NOT s.master OR s.fresh) THEN floor((e.us - s.us) * s.speed) ELSE 0 END AS BIGINT))
      ELSE s.media + CAST(CASE WHEN s.started AND (NOT s.master OR s.fresh) THEN floor((e.us - s.us) * s.speed) ELSE 0 END AS BIGINT) END,
    CASE WHEN e.c = 3 THEN e.event_id % 4 / 2.0 ELSE s.speed END, CASE e.c WHEN 1 THEN true WHEN 2 THEN false ELSE s.started END,
    CASE e.c WHEN 4 THEN true WHEN 6 THEN false ELSE s.master END, CASE e.c WHEN 1 THEN false WHEN 5 THEN true ELSE s.fresh END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1
)
SELECT user_id, event_id, media AS media_us, speed, started, started AND (NOT master OR fresh) AS ticking FROM s
""")
def clock_log(spark, sf_dir):
    """Start, pause, speed, a master that ticks first, and updates that only move forward."""
    c = F.expr("(event_id * 2654435761 div 1024) % 7")
    names = F.array(*map(F.lit, ("set", "start", "pause", "speed", "register", "update", "unregister")))
    p = packets(spark, sf_dir).withColumn("cmd", F.get(names, c.cast("int")))
    arg = F.when(F.col("cmd").isin("set", "update"), F.col("event_id") * 1000.0).when(F.col("cmd") == "speed", F.col("event_id") % 4 / 2)
    log = p.select("user_id", "event_id", F.col("us").alias("at_us"), "cmd", arg.alias("arg"))
    return tl.clock_states(log, "user_id", ["at_us", "event_id"]).select("user_id", "event_id", "media_us", "speed", "started", "ticking")


@_r.query(f"""
WITH e AS ({_EV}), g AS (SELECT *, CAST(sum(CAST(kind = 'signup' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM e)
SELECT user_id, event_id, generation FROM g QUALIFY generation = max(generation) OVER (PARTITION BY user_id)
""")
def generation_filter(spark, sf_dir):
    """A signup is a seek, after which older packets are void."""
    return tl.newest_generation(packets(spark, sf_dir), "user_id", ["us", "event_id"], F.col("kind") == "signup").select("user_id", "event_id", "generation")


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, us // 3600000000 AS hour, min(event_id) AS first_event FROM e GROUP BY ALL")
def seek_dedup(spark, sf_dir):
    """Of the requests of one time only the first seeks."""
    return packets(spark, sf_dir).groupBy("user_id", F.expr("us div 3600000000").alias("hour")).agg(F.min("event_id").alias("first_event"))


@_r.query(f"WITH e AS ({_EV}) SELECT kind, min(user_id) AS track FROM e GROUP BY kind")
def first_per_type(spark, sf_dir):
    """F2."""
    return packets(spark, sf_dir).groupBy("kind").agg(F.min("user_id").alias("track"))


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, event_id FROM e WHERE (1431655765 >> CAST(user_id % 31 AS INTEGER)) & 1 = 1")
def track_mask(spark, sf_dir):
    """F1, over file indexes."""
    return packets(spark, sf_dir).filter(tl.track_mask(F.col("user_id") % 31, 0x55555555)).select("user_id", "event_id")


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, event_id, us FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) <= 3")
def first_n(spark, sf_dir):
    """U4: the first three packets of each track, which is what the tool reads by default."""
    p = packets(spark, sf_dir)
    return p.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))).filter("n <= 3").select("user_id", "event_id", "us")


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, count(*) AS samples, count(*) FILTER (kind = 'signup') AS syncs, count(*) // nullif(count(*) FILTER (kind = 'signup'), 0) AS distance FROM e GROUP BY user_id")
def gop_len(spark, sf_dir):
    """A5: the mean distance of sync samples."""
    n, s = F.count("*"), F.count_if(F.col("kind") == "signup")
    return packets(spark, sf_dir).groupBy("user_id").agg(n.alias("samples"), s.alias("syncs")).withColumn("distance", F.expr("samples div nullif(syncs, 0)"))


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, kind, count(*) AS packets, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY user_id, kind")
def track_stats(spark, sf_dir):
    """A1."""
    return packets(spark, sf_dir).groupBy("user_id", "kind").agg(F.count("*").alias("packets"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, bool_and(kind <> 'error') AS all_ready, bit_or(1 << CAST(event_id % 16 AS INTEGER)) AS seen, bit_or(1 << CAST(event_id % 16 AS INTEGER)) = 65535 AS all_seen FROM e GROUP BY user_id")
def all_ready(spark, sf_dir):
    """All parts ready, and a mask of those that have reported."""
    bit = F.pow(F.lit(2), F.col("event_id") % 16).cast("long")
    return packets(spark, sf_dir).groupBy("user_id").agg(F.bool_and(F.col("kind") != "error").alias("all_ready"), F.bit_or(bit).alias("seen")).withColumn("all_seen", F.col("seen") == 65535)


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) * 1152 * 1000000 // 44100 AS pts_us FROM e")
def packetize_pts(spark, sf_dir):
    """Frame n of 1152 samples at 44100 Hz."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long") - 1
    return packets(spark, sf_dir).select("user_id", "event_id", n.alias("n")).select("user_id", "event_id", F.expr("n * 1152 * 1000000 div 44100").alias("pts_us"))


@_r.query(f"WITH e AS ({_EV}) SELECT user_id, count(*) * 2048 AS bytes, max(us) - min(us) AS duration_us, count(*) * 2048 * 8 * 1000000 // nullif(max(us) - min(us), 0) AS bitrate FROM e GROUP BY user_id")
def bitrate(spark, sf_dir):
    """A6, with 2048 bytes a packet."""
    p = packets(spark, sf_dir).groupBy("user_id").agg((F.count("*") * 2048).alias("bytes"), (F.max("us") - F.min("us")).alias("duration_us"))
    return p.withColumn("bitrate", F.expr("bytes * 8 * 1000000 div nullif(duration_us, 0)"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@_r.query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS delta, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS entry FROM lineitem),
x AS (SELECT l_orderkey, entry, delta, unnest(range(n)) AS i FROM r)
SELECT l_orderkey, row_number() OVER w - 1 AS sample_idx, coalesce(CAST(sum(delta) OVER (PARTITION BY l_orderkey ORDER BY entry, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS dts FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY entry, i)
""")
def dts_prefix(spark, sf_dir):
    """Decoding times from run-length deltas; each line is a run of l_linenumber samples."""
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, F.col("l_quantity").cast("long").alias("delta"))
    return st.expand_runs(runs, ["l_orderkey"], _ORDER, "l_linenumber", sums={"dts": "delta"}).select("l_orderkey", "sample_idx", "dts")


@_r.query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS size, o_orderkey * 1000 + coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_LINES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS place
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def sample_offsets(spark, sf_dir):
    """Offsets in chunks (orders) from the sizes before."""
    s = table(spark, sf_dir, "lineitem").select(*_ORDER, "l_orderkey", F.col("l_quantity").cast("long").alias("size"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    s = st.prefix_sum(s.join(o, s["l_orderkey"] == o["o_orderkey"]), ["l_orderkey"], _ORDER, "size", "inside")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size", (F.col("o_orderkey") * 1000 + F.col("inside")).alias("place"))


@_r.query("""
WITH r AS (SELECT s_nationkey AS track, s_suppkey AS first_chunk, s_suppkey % 7 + 1 AS per_chunk, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt FROM supplier)
SELECT c_custkey AS chunk, c_nationkey AS track, first_chunk, per_chunk FROM customer JOIN r ON c_nationkey = track AND c_custkey >= first_chunk AND (nxt IS NULL OR c_custkey < nxt)
""")
def stsc_range(spark, sf_dir):
    """Chunks (customers) in runs (suppliers) of the same nation."""
    runs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("track"), F.col("s_suppkey").alias("first_chunk"), (F.col("s_suppkey") % 7 + 1).alias("per_chunk"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk"), F.col("c_nationkey").alias("track"))
    # as-of by chunk number: the run that starts last before a chunk
    runs = runs.select("track", F.col("first_chunk").alias("at"), F.struct("first_chunk", "per_chunk").alias("run"))
    got = tl.as_of(chunks.withColumn("at", F.col("chunk")), runs, ["track"], "at", "run", "own").filter("own IS NOT NULL")
    return got.select("chunk", "track", "own.first_chunk", "own.per_chunk")


_SAMPLES = f"""
WITH l AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {_LINES}) - 1 AS sample_idx, CAST(l_quantity AS BIGINT) AS delta, CAST(l_quantity AS BIGINT) * 10 AS size, l_linenumber - 4 AS shift, l_returnflag = 'R' AS sync FROM lineitem)
"""


@_r.query(_SAMPLES + """
, d AS (SELECT *, sample_idx // 5 + 1 AS chunk, coalesce(CAST(sum(delta) OVER (PARTITION BY track ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS dts,
  coalesce(CAST(sum(size) OVER (PARTITION BY track, sample_idx // 5 ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS inside, bool_or(sync) OVER (PARTITION BY track) AS any_sync FROM l)
SELECT track, sample_idx, chunk, chunk * 100000 + inside AS place, size, dts, CASE WHEN dts + shift < 0 THEN dts ELSE dts + shift END AS pts, CASE WHEN sync OR NOT any_sync THEN 1 ELSE 0 END AS flags FROM d
""")
def sample_table(spark, sf_dir):
    """The whole table of each track (supplier) from its run-length tables, in chunks of five samples."""
    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", *_ORDER)).cast("long") - 1
    size = F.col("l_quantity").cast("long")
    s = li.select(F.col("l_suppkey").alias("track"), n.alias("sample_idx"), size.alias("delta"), (size * 10).alias("size"), (F.col("l_linenumber") - 4).alias("shift"), (F.col("l_returnflag") == "R").alias("sync"))
    s = materialize(s, "samples")  # read for each of the tables; else lines would be dealt out and numbered for each
    one = s.select("track", F.col("sample_idx").alias("entry"), F.lit(1).alias("count"), "delta", "shift")
    last = s.groupBy("track").agg(F.count("*").alias("n"))
    chunks = last.select("track", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("(n + 4) div 5"))).alias("chunk"))
    stco = chunks.select("track", "chunk", (F.col("chunk") * 100000).alias("chunk_offset"))
    full = F.expr("n div 5")
    runs = last.select("track", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("first_chunk"), F.lit(5).cast("long").alias("per_chunk")), F.struct((full + 1).alias("first_chunk"), (F.col("n") % 5).alias("per_chunk")))).alias("r")).select("track", "r.*")
    # a track of fewer than five samples has its short run only
    runs = runs.groupBy("track", "first_chunk").agg(F.min("per_chunk").alias("per_chunk"))
    got = st.build(one.drop("shift"), one.drop("delta"), runs, stco, s.select("track", "sample_idx", "size"), s.filter("sync").select("track", "sample_idx"), ["track"])
    return got.withColumnRenamed("offset", "place")


@_r.query(f"WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS nxt FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (nxt & 3) = (l_partkey & 3) AS follows FROM l WHERE nxt IS NOT NULL")
def lead_match(spark, sf_dir):
    """Whether the next header agrees under a mask."""
    li = table(spark, sf_dir, "lineitem").withColumn("nxt", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))).filter("nxt IS NOT NULL")
    low = lambda c: F.col(c).bitwiseAND(F.lit(3))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (low("nxt") == low("l_partkey")).alias("follows"))


@_r.query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS toc FROM lineitem")
def vbri_toc(spark, sf_dir):
    """A table of contents as a running sum of entries."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum(F.col("l_quantity").cast("long")).over(w).alias("toc"))


@_r.query(f"""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS n, l_linenumber * 3 - 9 AS delta FROM lineitem)
SELECT l_orderkey, n, 1000 + CAST(sum(CASE WHEN n = 1 THEN 0 ELSE delta END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS size FROM l
""")
def ebml_lacing_delta(spark, sf_dir):
    """Sizes of laced frames, the first given and the others as differences."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("n"), (F.col("l_linenumber") * 3 - 9).alias("delta"))
    step = F.when(F.col("n") == 1, 0).otherwise(F.col("delta"))
    return li.select("l_orderkey", "n", (F.lit(1000) + F.sum(step).over(Window.partitionBy("l_orderkey").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).alias("size"))


@_r.query(f"SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_LINES}) = 2")
def nth_child(spark, sf_dir):
    """The second child of a type."""
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*_ORDER))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).filter("n = 2").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


@_r.query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N') AS complete FROM lineitem GROUP BY l_orderkey")
def box_complete(spark, sf_dir):
    """All required children are there."""
    has = lambda f: F.bool_or(F.col("l_returnflag") == f)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((has("R") & has("A") & has("N")).alias("complete"))


@_r.query("SELECT conv_id, turn, c.role, track, kind FROM conversations c JOIN (VALUES ('user', 1, 'text'), ('assistant', 2, 'text'), ('tool', 3, 'data')) t (role, track, kind) ON c.role = t.role")
def block_track(spark, sf_dir):
    """Blocks (turns) of tracks (roles) that the header names; others are discarded."""
    tracks = spark.createDataFrame([("user", 1, "text"), ("assistant", 2, "text"), ("tool", 3, "data")], "role string, track int, kind string")
    return table(spark, sf_dir, "conversations").join(F.broadcast(tracks), "role").select("conv_id", "turn", "role", "track", "kind")
