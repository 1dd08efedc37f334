"""Queries on draws by key: attempts, fallbacks, selections and shared walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import integer_draw
from ..operators import partitioning as D
from ..operators import sampling as S
from .registry import query, table, unit_sql

SHAPES = [(1, 17), (2, 11), (5, 7)]


@query(
    f"""WITH o AS (SELECT o_orderkey, o_custkey % 6 + 1 AS cams, o_orderkey % 5 + 1 AS views, o_custkey % 3 AS attempt FROM orders),
        f AS (SELECT *, list_filter([(1, 17), (2, 11), (5, 7)], lambda s: s[1] <= cams) AS fit FROM o)
        SELECT o_orderkey, CAST(CASE WHEN views <= cams THEN views ELSE fit[1 + CAST(floor({unit_sql("shape_pool", "o_orderkey", "attempt")} * len(fit)) AS BIGINT)][1] END AS BIGINT) AS views,
               CAST(CASE WHEN views <= cams THEN 3 ELSE fit[1 + CAST(floor({unit_sql("shape_pool", "o_orderkey", "attempt")} * len(fit)) AS BIGINT)][2] END AS BIGINT) AS latents FROM f"""
)
def shape_redirect(spark, sf_dir):
    """Shapes that the cameras do not allow, drawn anew by attempt."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 6 + 1).alias("cams"), (F.col("o_orderkey") % 5 + 1).alias("views"), (F.col("o_custkey") % 3).alias("attempt"))
    s = S.redirected_shape("views", F.lit(3), ["o_orderkey"], SHAPES, "cams", "attempt")
    return o.select("o_orderkey", s["views"].alias("views"), s["latents"].alias("latents"))


@query(
    f"""WITH t AS (SELECT doc_id, n_chars, a, CAST(floor({unit_sql("try", "doc_id", "a")} * n_chars) AS BIGINT) AS place FROM documents, range(20) r(a)),
        f AS (SELECT doc_id, min(a) AS attempt, min_by(place, a) AS place FROM t WHERE place % 100 < 12 AND n_chars > 0 GROUP BY doc_id)
        SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, place FROM documents LEFT JOIN f USING (doc_id)"""
)
def bounded_attempts(spark, sf_dir):
    """The first of twenty drawn places that fits."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    t = S.first_attempt(lambda a: integer_draw("n_chars", "doc_id", a, salt="try"), lambda p: (p % 100 < 12) & (F.col("n_chars") > 0))
    return d.withColumn("t", t).select("doc_id", "t.attempt", "t.place")


@query(
    f"""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(concat_ws('|', 'pick', CAST(s_suppkey AS VARCHAR))), s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
        n AS (SELECT s_nationkey, max(n) AS n FROM r GROUP BY s_nationkey),
        d AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS draw FROM customer),
        a AS (SELECT d.*, CASE WHEN draw < n THEN draw ELSE CAST(floor({unit_sql("pick/again", "c_nationkey", "draw")} * n) AS BIGINT) END AS at_ FROM d LEFT JOIN n ON c_nationkey = s_nationkey)
        SELECT c_custkey, draw, s_suppkey FROM a LEFT JOIN r ON c_nationkey = s_nationkey AND at_ = place"""
)
def drawn_rows(spark, sf_dir):
    """Suppliers drawn for the customers of their nation: each once, then with replacement."""
    d = S.place_in_groups(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey"), ["nation"], ["c_custkey"], "draw")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return S.drawn_rows(d, s, ["nation"], "draw", "s_suppkey", "pick").select("c_custkey", "draw", "s_suppkey")


@query(
    f"""SELECT doc_id, CASE WHEN {unit_sql("no views", "doc_id")} < 0.1 THEN [] ELSE list_filter(range(n_chars % 5 + 1), lambda v: v = 0 OR ({unit_sql("other views", "doc_id")} < 0.6 AND {unit_sql("view", "doc_id", "v")} < 0.5)) END::INTEGER[] AS views,
               CAST(CASE WHEN {unit_sql("high", "doc_id % 10")} < 0.5 THEN floor({unit_sql("level", "doc_id % 10", "doc_id")} * 300) ELSE 300 + floor({unit_sql("level", "doc_id % 10", "doc_id")} * 700) END AS BIGINT) AS level FROM documents"""
)
def view_selection(spark, sf_dir):
    """Conditioning views, and noise levels from one of two ranges."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.conditioning_views(F.col("n_chars") % 5 + 1, ["doc_id"], 0.1, 0.6, 0.5).alias("views"), S.two_range_level(1000, 300, F.col("doc_id") % 10, "doc_id").alias("level"))


@query(
    f"""WITH v AS (SELECT p_partkey, unnest(range(0, 4)) AS place FROM part),
        o AS (SELECT *, CASE WHEN place = 0 THEN 0 ELSE CAST(floor((place / 4.0 + sqrt(-2 * ln(1 - {unit_sql("ring/u", "p_partkey", "place")})) * cos(2 * pi() * {unit_sql("ring/v", "p_partkey", "place")}) * 0.05) * 12 + 0.5) AS BIGINT) END AS turn FROM v)
        SELECT p_partkey, place, (turn % 12 + 12) % 12 AS offset FROM o"""
)
def ring_offsets(spark, sf_dir):
    """Views spread over a ring of cameras, with jitter."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(S.ring_offsets(F.lit(4), F.lit(12), 0.05, "p_partkey")).alias("place", "offset"))
    return p.select("p_partkey", F.col("place").cast("long").alias("place"), "offset")


def _walk_sql(name: str, rows: str, keys: str, salt: str, speed: float) -> str:
    """A recursive table (keys, n, step, view) of walks over a ring of twelve views, each with its keys."""
    names = keys.split(", ")
    push = f'sqrt(-2 * ln(1 - {unit_sql(f"{salt}/u", *names, "step // 20")})) * cos(2 * pi() * {unit_sql(f"{salt}/v", *names, "step // 20")}) * (2.0 / 6)'
    return f"""{name} AS (
        SELECT {keys}, n, CAST(0 AS BIGINT) AS step, CAST(floor({unit_sql(f"{salt}/view", *names)} * 12) AS BIGINT) AS view, 0.0::DOUBLE AS v FROM {rows} UNION ALL
        SELECT {keys}, n, step + 1, ((view + CAST(round_even(least(greatest(nv, -{speed}), {speed}), 0) AS BIGINT)) % 12 + 12) % 12, nv
        FROM (SELECT *, least(greatest((v + {push}) * 0.8, -3.0), 3.0) AS nv FROM {name} WHERE step + 1 < n))"""


def _turns_sql(views: int) -> str:
    """Offsets of the views on the ring: (p_partkey, n, place, turn)."""
    jitter = f'sqrt(-2 * ln(1 - {unit_sql("ring/u", "p_partkey", "place")})) * cos(2 * pi() * {unit_sql("ring/v", "p_partkey", "place")}) * 0.05'
    return f"turns AS (SELECT *, CASE WHEN place = 0 THEN 0 ELSE CAST(floor((place / {views}.0 + {jitter}) * 12 + 0.5) AS BIGINT) END AS turn FROM (SELECT *, unnest(range(0, {views})) AS place FROM p))"


_PARTS = "p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part)"


def _parts(spark, sf_dir, views):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return p.withColumn("o", S.ring_offsets(F.lit(views), F.lit(12), 0.05, "p_partkey"))


@query(
    f"""WITH RECURSIVE {_PARTS}, {_walk_sql("w", "p", "p_partkey", "walk", 3.0)}, {_turns_sql(3)}
        SELECT p_partkey, step, place, ((view + turn) % 12 + 12) % 12 AS camera, step AS frame FROM w JOIN turns USING (p_partkey)"""
)
def walked_views(spark, sf_dir):
    """Several views of each part along one shared walk."""
    p = _parts(spark, sf_dir, 3)
    return S.shared_walk(D.momentum_walk(p.drop("o"), ["p_partkey"], "n", 12, "n"), p, ["p_partkey"], 12, "o")


@query(
    f"""WITH RECURSIVE {_PARTS}, {_turns_sql(3)}, {_walk_sql("w", "p", "p_partkey", "walk", 3.0)}, {_walk_sql("own", "turns", "p_partkey, place", "walk/own", 0.75)},
        first AS (SELECT p_partkey, place, view AS begin FROM own WHERE step = 0)
        SELECT p_partkey, place, step, ((w.view + own.view - begin + turn) % 12 + 12) % 12 AS camera, step AS frame
        FROM w JOIN own USING (p_partkey, step) JOIN first USING (p_partkey, place) JOIN turns USING (p_partkey, place)"""
)
def view_chaos(spark, sf_dir):
    """Several views of each part, each with a small walk of its own around the shared one."""
    return D.chaotic_walks(_parts(spark, sf_dir, 3), ["p_partkey"], "n", 12, "n", "o", 0.25)
