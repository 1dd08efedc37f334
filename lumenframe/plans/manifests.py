"""Queries on scans, filters, sampling, sharding and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import filters as P
from ..operators import joins as J
from ..operators import sampling as S
from ..operators import sets as U
from ..operators import stats as A
from .registry import query, table, unit_sql

#: A small recipe for the test tables.
SHAPES = {"2x46": "2x41", "5x44": "4x40", "7x49": "5x47", "6x50": "6x33"}
POOL = [(1, 21), (2, 13), (4, 9), (6, 5)]
TIERS = [(0, "primary", 2, 4000.0), (1, "native", 2, 2000.0), (2, "fewer views", 1, 2000.0), (3, "long single", 1, 500.0), (4, "any", 1, 0.0)]
PRESETS = [("src0", 24.0, "a"), ("src1", 30.0, "b"), ("src5", 60.0, "c"), ("src9", 25.0, "a")]
_PRESET_SQL = "(VALUES ('src0', 24.0, 'a'), ('src1', 30.0, 'b'), ('src5', 60.0, 'c'), ('src9', 25.0, 'a')) AS p(source, fps, kind)"


@query(
    """WITH e AS (SELECT source, greatest(1, CAST(floor(sum(CAST(n_chars / 16.0 AS DECIMAL(28, 9))) * 16.0 / 81 / 8) AS BIGINT)) AS eff, count(*) AS n
                 FROM documents WHERE n_chars >= 81 GROUP BY source)
       SELECT source, n, eff, round(pow(eff, 0.8) / sum(pow(eff, 0.8)) OVER (), 9) AS weight FROM e"""
)
def mixture_weights(spark, sf_dir):
    """Sampling weights of sources from their viable clips."""
    docs = table(spark, sf_dir, "documents").select("source", "n_chars").where(P.viable("n_chars", F.lit(16.0), [21]))
    eff = S.effective_samples(docs, "source", "n_chars", F.lit(16.0), 16.0, 21)
    return S.mixture_weights(eff).select("source", "n", "eff", F.round("weight", 9).alias("weight"))


@query(
    """SELECT source, count(*) AS clips, count(*) FILTER (n_chars >= 197) AS viable,
              CASE WHEN count(*) FILTER (n_chars >= 197) = 0 THEN 'EMPTY' WHEN count(*) FILTER (n_chars >= 197) < 45 THEN 'TOO FEW' ELSE 'OK' END AS status
       FROM documents GROUP BY source"""
)
def viable_clips(spark, sf_dir):
    """Clips long enough for the shortest enabled length, and each source's status."""
    good = P.viable("n_chars", F.lit(24.0), [50, 81])
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("clips"), F.count_if(good).alias("viable"))
    return out.withColumn("status", P.status("viable", 45))


@query(
    """SELECT o_orderkey, frames, CAST(round_even(49 * greatest(1.0, fps / 16.0), 0) AS BIGINT) AS need,
              (fps >= 12) AND frames > 0 AND frames >= round_even(49 * greatest(1.0, fps / 16.0), 0) AS ok
       FROM (SELECT o_orderkey, o_custkey % 200 AS frames, CAST(8 + o_orderkey % 40 AS DOUBLE) AS fps FROM orders)"""
)
def viable_at_rate(spark, sf_dir):
    """Viability with fixed rate targets: the length is scaled by the stride."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("frames"), (8 + F.col("o_orderkey") % 40).cast("double").alias("fps"))
    ratio = F.greatest(F.lit(1.0), F.col("fps") / 16.0)
    return o.select("o_orderkey", "frames", X.half_even(49 * ratio).alias("need"), P.viable("frames", "fps", [13], ratio, [12.0, 16.0]).alias("ok"))


@query(
    """WITH s AS (SELECT l_orderkey, count(*) AS mv, CAST(max(l_quantity) AS BIGINT) AS gen, l_orderkey % 3 = 0 AS iso FROM lineitem GROUP BY l_orderkey),
       r AS (SELECT s.*, coalesce(t.a, mv) AS tv, coalesce(t.b, gen) AS tl FROM s LEFT JOIN (VALUES (2, 46, 2, 41), (5, 44, 4, 40), (7, 49, 5, 47), (6, 50, 6, 33)) AS t(v, g, a, b) ON t.v = mv AND t.g = gen)
       SELECT l_orderkey, mv, gen, greatest(1, least(CASE WHEN iso THEN tv ELSE least(tv, 6) END, mv)) AS rt_views, greatest(1, least(least(tl, 48), gen)) AS rt_latents FROM r"""
)
def shape_remap(spark, sf_dir):
    """Stored shapes remapped and capped; isolated ones keep their views."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("mv"), F.max("l_quantity").cast("long").alias("gen"))
    s = s.withColumn("iso", F.col("l_orderkey") % 3 == 0)
    return P.runtime_shape(s, "mv", "gen", SHAPES, "iso", 6, 48).select("l_orderkey", "mv", "gen", "rt_views", "rt_latents")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 3")
def stride_shard(spark, sf_dir):
    """The rows of one of seven shards."""
    return S.strided_shard(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 3, 7)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, (row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1) % 8 AS shard FROM orders")
def shape_shard(spark, sf_dir):
    """Shards dealt in turn inside each shape."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.shape_shard(o, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 8)


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) WHERE n >= 10 AND n < 1500 AND (n - 10) % 3 = 0")
def slice_rows(spark, sf_dir):
    """A start:stop:step slice of an ordered table."""
    return P.slice_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 10, 1500, 3)


@query("SELECT doc_id, n_chars, md5(text) AS digest FROM documents WHERE n_chars BETWEEN 1000 AND 1500")
def late_materialize(spark, sf_dir):
    """A light scan filters; the heavy column is fetched for what is left."""
    light = table(spark, sf_dir, "documents").where("n_chars BETWEEN 1000 AND 1500").select("doc_id", "n_chars")
    return J.late_columns(light, f"{sf_dir}/documents.parquet", "doc_id", ["text"]).select("doc_id", "n_chars", F.md5("text").alias("digest"))


@query("SELECT doc_id, CAST(file_row_number AS BIGINT) AS row_id FROM (SELECT doc_id, row_number() OVER () - 1 AS file_row_number FROM documents)")
def physical_rows(spark, sf_dir):
    """Physical row numbers of a scan, over all files of the table."""
    from ..sources.manifests import numbered_scan

    return numbered_scan(spark, f"{sf_dir}/documents.parquet", ["doc_id"])


@query(f"SELECT doc_id, d.source, coalesce(p.fps, 16.0)::DOUBLE AS fps, coalesce(p.kind, 'default') AS kind FROM documents d LEFT JOIN {_PRESET_SQL} ON d.source = p.source")
def source_preset(spark, sf_dir):
    """Preset columns of each row's source, with defaults."""
    presets = spark.createDataFrame(PRESETS, "source string, fps double, kind string")
    return J.with_presets(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", presets, "source", {"fps": 16.0, "kind": "default"})


@query(
    """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'aug' ELSE 'window' END AS mode, c_custkey % 4 AS mv,
                  CASE c_custkey % 6 WHEN 0 THEN ['/data/a', ' '] WHEN 1 THEN ['/data/a.mp4'] WHEN 2 THEN ['/data/root/', '/data/b.mp4'] WHEN 3 THEN ['/data//root', 'x.mp4']
                                     WHEN 4 THEN ['a.mp4', 'b.mp4'] ELSE ['a.mp4', 'b.mp4', 'c.mp4'] END AS p,
                  CASE c_custkey % 6 WHEN 1 THEN ['/data/root'] WHEN 5 THEN ['/data/root', '/data/root', ''] ELSE ['/data/root', '/data/root'] END AS r FROM customer)
       SELECT c_custkey, CASE WHEN mv <= 0 OR len(p) <> mv OR len(r) <> mv THEN true
                              WHEN len(list_filter(p, lambda x: trim(x) = '')) > 0 THEN true WHEN mode = 'aug' THEN false
                              ELSE len(list_filter(p, lambda x: x LIKE '%/' OR x = '/data//root')) > 0 END AS malformed FROM m"""
)
def malformed_paths(spark, sf_dir):
    """Rows whose baked paths cannot name their views."""
    k = F.col("c_custkey") % 6
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    paths = F.when(k == 0, arr("/data/a", " ")).when(k == 1, arr("/data/a.mp4")).when(k == 2, arr("/data/root/", "/data/b.mp4")).when(k == 3, arr("/data//root", "x.mp4")).when(k == 4, arr("a.mp4", "b.mp4")).otherwise(arr("a.mp4", "b.mp4", "c.mp4"))
    roots = F.when(k == 1, arr("/data/root")).when(k == 5, arr("/data/root", "/data/root", "")).otherwise(arr("/data/root", "/data/root"))
    mode = F.when(F.col("c_custkey") % 5 == 0, "aug").otherwise("window")
    return table(spark, sf_dir, "customer").select("c_custkey", P.malformed_paths(mode, F.col("c_custkey") % 4, paths, roots).alias("malformed"))


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey % 120 AS fs, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0 ELSE o_custkey % 300 END AS fe, o_orderkey % 250 AS nv, o_orderkey % 250 + o_custkey % 4 - 1 AS nc FROM orders)
       SELECT o_orderkey, greatest(0, least(coalesce(CASE WHEN fe > 0 THEN fe END, f), f) - fs) AS length
       FROM (SELECT *, CASE WHEN abs(nc - nv) <= 1 THEN least(nc, nv) ELSE nv END AS f FROM c)"""
)
def window_length(spark, sf_dir):
    """Frames that a manifest window really has."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    end = F.when(k % 4 == 0, F.lit(None).cast("long")).when(k % 4 == 1, F.lit(0)).otherwise(c % 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.effective_length(c % 120, end, k % 250, k % 250 + c % 4 - 1).alias("length"))


@query("SELECT doc_id, clip, clip * 77 AS start, least((clip + 1) * 77, n_chars) AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, greatest((n_chars + 76) // 77, 1))) AS clip FROM documents)")
def short_clips(spark, sf_dir):
    """Documents cut into windows of 77 units."""
    return P.short_clips(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").drop("n_chars")


@query(
    f"""WITH w AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, sum(n) OVER (ORDER BY source) AS hi, sum(n) OVER () AS total FROM w)
        SELECT o_orderkey, min_by(source, hi) AS choice FROM (SELECT o_orderkey, {unit_sql("mix", "o_orderkey")} AS u FROM orders) JOIN b ON hi > u * total GROUP BY o_orderkey"""
)
def source_choice(spark, sf_dir):
    """One source per index, drawn with the sources' weights."""
    weights = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return S.choose_weighted(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], weights, "source", "n", "mix")


@query(
    f"""WITH p AS (SELECT o_orderkey, o_custkey % 7 AS cams, list_filter([(1, 21), (2, 13), (4, 9), (6, 5)], lambda s: s[1] <= o_custkey % 7) AS fit FROM orders),
        c AS (SELECT o_orderkey, cams, fit[CAST(floor({unit_sql("shape_pool", "o_orderkey")} * len(fit)) AS BIGINT) + 1] AS s FROM p)
        SELECT o_orderkey, cams, CAST(s[1] AS BIGINT) AS views, CAST(s[2] AS BIGINT) AS latents FROM c"""
)
def shape_pick(spark, sf_dir):
    """A shape per row, drawn from those that its cameras allow."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("cams"))
    s = S.choose_shape(["o_orderkey"], POOL, "cams")
    return o.select("o_orderkey", "cams", s["views"].alias("views"), s["latents"].alias("latents"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'epoch 1', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS place FROM embeddings")
def seeded_shuffle(spark, sf_dir):
    """A shuffle of each group that depends on a seed alone."""
    return S.shuffled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], "vec_id", "epoch 1")


@query(
    f"""WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier),
        d AS (SELECT i AS draw, i // 32 AS block, i % 32 AS pos, CAST(floor({unit_sql('seed 734', 'i')} * (SELECT count(*) FROM supplier)) AS BIGINT) AS row FROM range((SELECT count(*) FROM orders)) t(i))
        SELECT draw, block, pos, row, s_suppkey, s_nationkey FROM d JOIN s USING (row)"""
)
def replacement_draws(spark, sf_dir):
    """Suppliers drawn with replacement, as many as there are orders, with the cursor of the blocks of draws and the rows drawn."""
    suppliers = S.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"], "row")
    draws = S.replacement_sample(spark, suppliers.count(), table(spark, sf_dir, "orders").count(), "seed 734")
    return draws.join(suppliers, "row").select("draw", "block", "pos", "row", "s_suppkey", "s_nationkey")


@query(
    """WITH t AS (SELECT * FROM (VALUES (0, 'primary', 2, 4000.0), (1, 'native', 2, 2000.0), (2, 'fewer views', 1, 2000.0), (3, 'long single', 1, 500.0), (4, 'any', 1, 0.0)) AS t(ord, tier, views, least)),
       f AS (SELECT doc_id, min_by(tier, ord) AS tier, min_by(views, ord) AS views FROM documents, t WHERE n_chars >= views * least AND n_chars >= 50 GROUP BY doc_id)
       SELECT doc_id, tier, CAST(views AS BIGINT) AS views FROM documents LEFT JOIN f USING (doc_id)"""
)
def tier_fallback(spark, sf_dir):
    """The first tier of a priority list that a clip fits."""
    tiers = spark.createDataFrame(TIERS, "ord long, tier string, views long, least double")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    fits = lambda t: (F.col("n_chars") >= t["views"] * t["least"]) & (F.col("n_chars") >= 50)
    return S.first_fit(docs, tiers, fits, "ord", ["tier", "views"]).drop("n_chars")


@query(f"SELECT doc_id, CASE WHEN n_chars >= 500 THEN CAST(floor({unit_sql('start', 'doc_id')} * (n_chars - 500 + 1)) AS BIGINT) END AS start FROM documents")
def window_starts(spark, sf_dir):
    """A random window start by key; null where the window does not fit."""
    return table(spark, sf_dir, "documents").select("doc_id", S.window_start("n_chars", F.lit(500), "doc_id").alias("start"))


@query(
    f"""SELECT o_orderkey, CASE WHEN {unit_sql("text", "o_orderkey")} >= 0.1 THEN o_orderpriority END AS text,
               round(3.0 * {unit_sql("sigma", "o_orderkey")} / (1.0 + 2.0 * {unit_sql("sigma", "o_orderkey")}), 9) AS sigma FROM orders"""
)
def text_dropout(spark, sf_dir):
    """Dropped texts and shifted noise levels, by key."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.text_dropped("o_orderpriority", 0.1, "o_orderkey").alias("text"), F.round(S.noise_level(3.0, "o_orderkey"), 9).alias("sigma"))


@query(f"SELECT c_custkey, i, j, {unit_sql('history', 'c_custkey', 'i', 'j')} < 0.3 AS dropped FROM (SELECT c_custkey, unnest(range(1, c_custkey % 5)) AS i FROM customer) t, unnest(range(0, i)) u(j)")
def history_dropout(spark, sf_dir):
    """Which earlier blocks each block does not see."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("blocks")).where("blocks > 1")
    out = S.dropout_pairs(c, ["c_custkey"], "blocks", 0.3)
    return out.select("c_custkey", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "dropped")


@query(
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS origin, 0::BIGINT AS origin_rank FROM customer
       UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier', 1 FROM supplier"""
)
def ragged_union(spark, sf_dir):
    """Sources of different columns as one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return U.union_sources({"customer": c, "supplier": s})


@query("SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY text_md5")
def first_dedup(spark, sf_dir):
    """The first document of each text, in order of id."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return A.first_occurrences(d, ["text_md5"], ["doc_id"])


@query(
    """WITH a AS (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN -l_partkey - 1 ELSE l_partkey END AS key FROM lineitem WHERE l_quantity > 20)
       SELECT p_partkey AS key, 'missing' AS status FROM part WHERE p_partkey NOT IN (SELECT key FROM a) UNION ALL SELECT key, 'extra' FROM a WHERE key NOT IN (SELECT p_partkey FROM part)"""
)
def key_plan_diff(spark, sf_dir):
    """Keys planned (all parts) but absent, and present but not planned."""
    planned = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    return J.key_diff(planned, table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(key.alias("key")), "key")


@query("SELECT l_suppkey AS key, min(l_linenumber)::BIGINT AS owner FROM lineitem GROUP BY l_suppkey")
def first_publisher(spark, sf_dir):
    """One publisher per key: the least rank."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("long").alias("rank"))
    return J.first_owner(li, ["key"], "rank")


@query(
    """SELECT 'distinct' AS op, count(*) AS n FROM (SELECT p_brand FROM part INTERSECT SELECT p_brand FROM part WHERE p_size > 25)
       UNION ALL SELECT 'common', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
       UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
       UNION ALL SELECT 'copies', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""
)
def set_ops(spark, sf_dir):
    """Intersections and differences, with and without copies."""
    p, o, c, li = (table(spark, sf_dir, t) for t in ("part", "orders", "customer", "lineitem"))
    one = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    keys = c.select(F.col("c_custkey").alias("k"))
    parts = [
        one("distinct", U.common(p.select("p_brand"), p.where("p_size > 25").select("p_brand"))),
        one("common", U.common(o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))),
        one("without", U.difference(keys, o.select(F.col("o_custkey").alias("k")))),
        one("copies", U.difference(li.select("l_orderkey", "l_linenumber"), li.select("l_orderkey", "l_linenumber").distinct(), keep_copies=True)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT i AS place, p_partkey, p_name FROM part JOIN (SELECT * FROM (VALUES (0, 17), (1, 3), (2, 99), (3, 17)) v(i, k)) ON p_partkey = k")
def requested_order(spark, sf_dir):
    """Rows in the order of a list of keys, one of them asked for twice."""
    return U.in_requested_order(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", [17, 3, 99, 17])


@query("SELECT p_partkey, p_brand = 'Brand#11' OR NOT (p_retailprice > 0 AND p_size > 0) AS rejected FROM part")
def quarantine(spark, sf_dir):
    """Valid and rejected rows, both kept."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    good, bad = P.split_valid(df, (F.col("p_brand") == "Brand#11") | ~(P.finite_positive("p_retailprice") & P.finite_positive("p_size")))
    return good.select("p_partkey", F.lit(False).alias("rejected")).unionByName(bad.select("p_partkey", F.lit(True).alias("rejected")))
