"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat_format, decontaminate, exact_dedup, fill_middle, hard_negatives, jaccard_join, language_id, quality, secrets, sentencepiece_bpe, suffix_dedup, toxicity, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary file that the contract names; any merge-type file can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary_path() -> str:
    """The public vocabulary file with word ends; any file of its kind can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(more)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(word_bpe.encode_decode(table(spark, sf_dir, "documents"), word_vocabulary_path()))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_quality, op4_toxicity, op5_sentencepiece, op6_jaccard_join, op7_suffix_dedup, op8_decontamination, op9_chat_format, op10_secret_scan, op11_word_bpe, op12_hard_negatives, op13_fill_middle)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_LIST = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * shared >= 8 * (x.n + y.n - shared)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(set_size, 0) + 1 AS set_size, coalesce(n, 0) AS n_shingles
        FROM classes LEFT JOIN n USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS set_size FROM link GROUP BY a) USING (doc_id)""",
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d)),
        later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 100)) AS b FROM later),
        bytes AS (SELECT doc_id, b, substr(x, 2 * b + 1, 2) AS c FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2)) AS b FROM d)),
        kept AS (SELECT doc_id, string_agg(c, '' ORDER BY b) AS x FROM bytes ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id),
        removed AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (start) AS n_spans
                    FROM (SELECT doc_id, lag(b) OVER (PARTITION BY doc_id ORDER BY b) IS DISTINCT FROM b - 1 AS start FROM gone) GROUP BY doc_id)
        SELECT doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
        FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_decontamination": rf"""
        WITH item_words AS (SELECT item_id, {_WORD_LIST} AS w FROM benchmark),
        patterns AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
        doc_words AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
        doc_windows AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM doc_words, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, i, d.n FROM doc_windows d JOIN patterns q ON d.p = q.p AND d.n = q.n),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM found GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS x FROM documents),
        h AS (SELECT *, len(u) AS n, [CAST(concat('0x', substr(x, 8 * i - 7, 8)) AS BIGINT) FOR i IN [1, 2, 3, 4]] AS h FROM d),
        c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain FROM h),
        p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS pre, coalesce(array_to_string(u[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(u[b + 1 :], ''), '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE WHEN plain THEN text WHEN h[4] % 100 < 50 THEN concat('<S>', suf, '<P>', pre, '<M>', mid) ELSE concat('<P>', pre, '<S>', suf, '<M>', mid) END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
