"""Queries that show Spark's own operator families over the same tables: joins, cubes, windows, dates, JSON, arrays, event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import small
from ..streaming import events as E
from .registry import query, table


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 6))) AS DOUBLE), 2) AS revenue, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(spark, sf_dir):
    """Filter, two-phase aggregation; sums as decimals."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,6)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.round(F.sum(revenue).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query(
    """SELECT n_name, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28, 6))) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2 GROUP BY n_name"""
)
def regional_revenue(spark, sf_dir):
    """A chain of equality joins; the join order is the optimizer's."""
    li, o, c, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    j = j.join(small(n), F.col("s_nationkey") == F.col("n_nationkey")).join(small(r), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey <= 2")
    return j.groupBy("n_name").agg(F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,6)")).cast("double"), 2).alias("revenue"))


@query(
    """SELECT kind, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS s FROM (
         SELECT 'left' AS kind, o_orderkey AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL
         SELECT 'right', c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F' UNION ALL
         SELECT 'full', coalesce(p_partkey, l_partkey) FROM part FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) ON p_partkey = l_partkey UNION ALL
         SELECT 'semi', c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL
         SELECT 'anti', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') UNION ALL
         SELECT 'theta', r_regionkey FROM region JOIN nation ON n_nationkey < r_regionkey) GROUP BY kind"""
)
def join_kinds(spark, sf_dir):
    """Every kind of join, by count and sum of a key."""
    c, o, p, li, r, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "part", "lineitem", "region", "nation"))
    on = F.col("c_custkey") == F.col("o_custkey")
    few = li.where("l_quantity > 48").select("l_partkey").distinct()
    parts = {
        "left": c.join(o, on, "left").select(F.col("o_orderkey").alias("k")),
        "right": o.join(c, on & (F.col("o_orderstatus") == "F"), "right").select(F.col("c_custkey").alias("k")),
        "full": p.join(few, F.col("p_partkey") == F.col("l_partkey"), "full").select(F.coalesce("p_partkey", "l_partkey").alias("k")),
        "semi": c.join(o, on, "left_semi").select(F.col("c_custkey").alias("k")),
        "anti": c.join(o.where("o_orderstatus = 'F'"), on, "left_anti").select(F.col("c_custkey").alias("k")),
        "theta": r.join(small(n), F.col("n_nationkey") < F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("k")),
    }
    out = None
    for kind, df in parts.items():
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS g, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28, 6))) AS DOUBLE), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_report(spark, sf_dir):
    """A cube with its grouping ids."""
    o = table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (year(o_orderdate)), ())")
def grouping_sets(spark, sf_dir):
    """Grouping sets, through the SQL entry point over a view."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("lumenframe_orders")
    return spark.sql(
        "SELECT o_orderstatus, o_orderpriority, y, count(*) AS n FROM (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS y FROM lumenframe_orders) GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (y), ())"
    )


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS f, round(cume_dist() OVER p, 9) AS cd FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
)
def rank_report(spark, sf_dir):
    """Ranking and analytic functions."""
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("nt"),
        F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after"), F.first("o_orderkey").over(w).alias("f"), F.round(F.cume_dist().over(p), 9).alias("cd"),
    )


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark, sf_dir):
    """The three largest orders of each customer; the limit is pushed below the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top(spark, sf_dir):
    """A global top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props IS NOT NULL AS has FROM events")
def json_props(spark, sf_dir):
    """Fields of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.col("props").isNotNull().alias("has"))


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders"""
)
def date_functions(spark, sf_dir):
    """Parts, truncation, arithmetic and formats of dates."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.trunc(d, "month").cast("string").alias("m"), F.date_add(d, 30).cast("string").alias("due"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.date_format(d, "yyyy/MM/dd").alias("shown"))


@query("SELECT vec_id, CAST(len(list_filter(e, lambda x: x > 0)) AS INTEGER) AS positive, round(list_max(e), 6) AS top, round(e[1], 6) AS head, round(list_sum(list_transform(e[1:8], lambda x: x * x)), 6) AS square FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def array_functions(spark, sf_dir):
    """Higher-order functions on arrays."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    square = F.aggregate(F.slice("e", 1, 8), F.lit(0.0), lambda a, x: a + x * x)
    return e.select("vec_id", F.size(F.filter("e", lambda x: x > 0)).alias("positive"), F.round(F.array_max("e"), 6).alias("top"), F.round(F.col("e")[0], 6).alias("head"), F.round(square, 6).alias("square"))


@query("SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS users, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS assistants FROM conversations GROUP BY conv_id")
def map_functions(spark, sf_dir):
    """Maps built from groups, merged with defaults and read."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    at = lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("long"))
    return m.select("conv_id", at("user").alias("users"), at("assistant").alias("assistants"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def pivot_report(spark, sf_dir):
    """A pivot over stated values."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query()
def approximate(spark, sf_dir):
    """Sketches: approximate distinct counts and quantiles (held to error bounds in tests)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS stop, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    """Hourly windows by type."""
    e = table(spark, sf_dir, "events")
    return E.tumbling(e, ["event_type"], "ts", "1 hour").withColumn("total", F.round("total", 4))


@query(
    """SELECT s AS start, s + INTERVAL '2 hours' AS stop, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE), 4) AS total
       FROM (SELECT value, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY s"""
)
def hopping(spark, sf_dir):
    """Two-hour windows every hour."""
    return E.tumbling(table(spark, sf_dir, "events"), [], "ts", "2 hours", slide="1 hour").withColumn("total", F.round("total", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS f FROM events),
       s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '8 hours' AS stop, count(*) AS n FROM s GROUP BY user_id, s"""
)
def sessionize(spark, sf_dir):
    """Sessions of users that end after eight hours."""
    return E.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "8 hours")


@query(
    """WITH k AS (SELECT user_id, max(ts) AS now FROM events GROUP BY user_id), v AS (SELECT user_id, max(ts) AS seen, max_by(value, ts) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id)
       SELECT user_id, CASE WHEN epoch_us(now) - epoch_us(seen) <= 3 * 86400 * 1000000::BIGINT THEN value END AS value, now FROM k LEFT JOIN v USING (user_id)"""
)
def fresh_values(spark, sf_dir):
    """Latest values, null when they are stale."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return E.fresh_values(e, "user_id", "ts", "value", "ts", 86400.0)
