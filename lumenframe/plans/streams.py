"""Queries that run a stream over a whole table, batch by batch, to its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered, place_in_groups
from ..streaming import events as E
from .registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """Tumbling windows over a stream."""
    s = E.replayed(_events(spark, sf_dir).select("ts", "event_type", "value"), ["ts"])
    out = E.finished(E.tumbling(s, ["event_type"], "ts", "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS f FROM events),
       s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '8 hours' AS stop, count(*) AS n FROM s GROUP BY user_id, s"""
)
def stream_sessions(spark, sf_dir):
    """Sessions over a stream."""
    s = E.replayed(_events(spark, sf_dir).select("ts", "user_id"), ["ts"])
    out = E.finished(E.sessions(s, ["user_id"], "ts", "8 hours"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first(spark, sf_dir):
    """One row per key of a stream, whatever repeats within the lateness bound."""
    e = _events(spark, sf_dir).select("ts", "user_id", "event_type")
    return E.finished(E.first_of_each(E.replayed(e, ["ts"]), ["user_id", "event_type"], "ts", E.span_of(e, "ts"))).select("user_id", "event_type")


@query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL '1 hour'")
def stream_join(spark, sf_dir):
    """Two streams joined by key and nearness in time."""
    e = _events(spark, sf_dir)
    views = E.replayed(e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id")), ["view_ts"])
    purchases = E.replayed(e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("ts"), F.col("event_id").alias("purchase_id")), ["ts"])
    return E.finished(E.joined_streams(views, purchases, "user_id", "view_ts", "ts", "1 HOUR", "1 HOUR").select("view_id", "purchase_id"))


@query("SELECT event_type AS kind, token FROM (SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS token, lag(CAST(user_id % 3 AS VARCHAR)) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE token IS DISTINCT FROM p")
def stream_tokens(spark, sf_dir):
    """Requests whose token is new to their kind; the last tokens are kept from batch to batch."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("token"), "event_id")
    return E.finished(E.changed_tokens(E.replayed(e, ["event_id"]), "kind", "token", "event_id"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS generated, count(*) FILTER (event_id % 3 = 0) AS consumed, coalesce(list(event_id ORDER BY event_id) FILTER (event_id % 3 <> 0), []) AS outstanding FROM events GROUP BY user_id")
def stream_cursor(spark, sf_dir):
    """Indices issued, consumed and outstanding of every consumer, kept apart over the batches."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("who"), F.col("event_id").alias("index_no"), F.explode(F.array(F.lit("issued"), F.when(F.col("event_id") % 3 == 0, "consumed"))).alias("action"))
    e = e.where("action is not null").withColumn("at", F.col("index_no") * 2 + F.when(F.col("action") == "consumed", 1).otherwise(0))
    root = E.new_root(spark)
    counts = E.finished(E.consumption(E.replayed(e, ["at"]), "who", "at"), "update", ["key"], root)
    out = E.outstanding(spark, f"{root}/state").groupBy(F.col("who").cast("string").alias("key")).agg(F.array_sort(F.collect_list("index_no")).alias("outstanding"))
    return counts.join(out, "key", "left").select("key", "generated", "consumed", F.coalesce("outstanding", F.array().cast("array<bigint>")).alias("outstanding"))


@query(
    """WITH e AS (SELECT user_id, event_id, ntile(2) OVER (ORDER BY event_id) AS stage FROM events)
       SELECT CAST(user_id AS VARCHAR) AS key, event_id AS index_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place,
              count(*) OVER (PARTITION BY user_id) AS held FROM e WHERE stage = 1 AND event_id % 3 <> 0"""
)
def stream_restart(spark, sf_dir):
    """A stream stopped in the middle of its table: a second one, of another source, starts with its state and hands out
    what was outstanding, in order, before it takes anything new. One row per index handed out again."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("index_no"), F.explode(F.array(F.lit("issued"), F.when(F.col("event_id") % 3 == 0, "consumed"))).alias("action"))
    e = e.where("action is not null").withColumn("at", F.col("index_no") * 2 + F.when(F.col("action") == "consumed", 1).otherwise(0))
    half = _first_half(table(spark, sf_dir, "events"), "event_id")
    first, second = E.new_root(spark), E.new_root(spark)
    E.finished(E.consumption(E.replayed(e.where(F.col("index_no") <= half), ["at"]), "who", "at"), "update", ["key"], first)
    carried = E.carried_over(spark, f"{first}/state", "who")
    # the next stage has rows for every consumer, which are consumed at once: what waits then is what was carried over
    later = e.where((F.col("index_no") > half) & (F.col("index_no") % 3 == 0))
    E.finished(E.consumption(E.replayed(later, ["at"]), "who", "at", carried), "update", ["key"], second)
    waiting = E.outstanding(spark, f"{second}/state")
    w = Window.partitionBy("who")
    return waiting.select(F.col("who").cast("string").alias("key"), "index_no", (F.row_number().over(w.orderBy("at")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("held"))


def _first_half(df, key):
    """The greatest key of the first half of the rows, as ntile(2) cuts them."""
    rows = numbered(df.select(key), [key], "n")
    return rows.where(F.col("n") < F.lit((rows.count() + 1) // 2)).agg(F.max(key)).first()[0]


@query(
    """WITH RECURSIVE e AS (SELECT user_id, value < 40 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
       u AS (SELECT user_id, r, CAST(ok AS BIGINT) AS uses, ok AS again FROM e WHERE r = 1
             UNION ALL SELECT e.user_id, e.r, CASE WHEN e.ok AND u.uses < 2 THEN u.uses + 1 ELSE 0 END, e.ok AND u.uses < 2 FROM u JOIN e ON e.user_id = u.user_id AND e.r = u.r + 1)
       SELECT CAST(user_id AS VARCHAR) AS key, max_by(uses, r) AS uses, max_by(again, r) AS again FROM u GROUP BY user_id"""
)
def stream_reuse(spark, sf_dir):
    """How often each consumer's sample was used again in a row, at most twice."""
    e = _events(spark, sf_dir).select("user_id", "event_id", (F.col("value") < 40).alias("ok"))
    return E.finished(E.reuse_limited(E.replayed(e, ["event_id"]), "user_id", "event_id", "ok", 2), "update", ["key"])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round, coalesce(value < 40, false) AND event_id % 5 <> 0 AS ok FROM events),
       held AS (SELECT user_id, min(round) AS h FROM e WHERE event_id % 40 = 0 GROUP BY user_id),
       s AS (SELECT e.* FROM e LEFT JOIN held USING (user_id) WHERE h IS NULL OR round < h),
       u AS (SELECT user_id, round, ok AS again, CAST(ok AS BIGINT) AS uses FROM s WHERE round = 0
             UNION ALL SELECT s.user_id, s.round, s.ok AND u.uses < 2, CASE WHEN s.ok AND u.uses < 2 THEN u.uses + 1 ELSE 0 END FROM u JOIN s ON s.user_id = u.user_id AND s.round = u.round + 1)
       SELECT CAST(user_id AS VARCHAR) AS key, CAST(round AS BIGINT) AS round, again, uses FROM u"""
)
def stream_agreement(spark, sf_dir):
    """A user's sample is used again, at most twice, only if three replicas agree, event by event. They come one after
    another, so rounds stay open over the batches; the last one is silent on every fortieth event, and so holds its sample from there on."""
    e = place_in_groups(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "round")
    said = F.array(F.col("value") < 40, F.col("event_id") % 5 != 0, F.lit(True))
    rows = e.select("user_id", "event_id", "round", F.posexplode(said).alias("replica", "ok")).where("replica < 2 OR event_id % 40 <> 0")
    rows = rows.withColumn("replica", F.col("replica").cast("long"))
    return E.finished(E.agreed_reuse(E.replayed(rows, ["replica", "event_id"]), "user_id", 3, 2))


@query(
    """WITH i AS (SELECT o_custkey AS c, o_orderkey AS item, o_orderkey % 3 AS parts FROM orders),
       d AS (SELECT c, item, unnest(range(0, parts)) AS part FROM i),
       q AS (SELECT c, item, part, row_number() OVER (PARTITION BY c ORDER BY item, part) - 1 AS place FROM d),
       asked AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey)
       SELECT CAST(c AS VARCHAR) AS key, place, item, part FROM q JOIN asked USING (c) WHERE place < n"""
)
def stream_queue(spark, sf_dir):
    """Orders bring no, one or two documents to their customer's queue, and each asks for one before that: what is there is handed out first in, first out."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 3).alias("parts"), F.explode(F.array(F.lit("next"), F.lit("item"))).alias("action"))
    rows = rows.withColumn("at", F.col("item") * 2 + F.when(F.col("action") == "item", 1).otherwise(0))
    return E.finished(E.queued_documents(E.replayed(rows, ["at"]), "o_custkey", "at"))


@query(
    """WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS chunk FROM events)
       SELECT CAST(user_id AS VARCHAR) AS key, chunk, event_id AS row FROM (SELECT *, max(chunk) OVER (PARTITION BY user_id) AS newest FROM e) WHERE chunk < 1 OR chunk > newest - 3"""
)
def stream_history(spark, sf_dir):
    """The events that a sliding history of each user holds at the end of a stream: the first chunk and the last three."""
    e = place_in_groups(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "place")
    rows = e.select("user_id", "event_id", F.floor(F.col("place") / 5).cast("long").alias("chunk"))
    root = E.new_root(spark)
    E.finished(E.sliding_history(E.replayed(rows, ["event_id"]), "user_id", "chunk", "event_id", 1, 3), "update", ["key"], root)
    return E.held_rows(spark, f"{root}/state").select(F.col("user_id").cast("string").alias("key"), "chunk", "row")
