"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New documents are reduced to one
row per digest, anti-joined with the index by sort-merge (the index side is read in
bucket order, so it is not shuffled again) and the survivors are appended in the same
layout. Texts are read and hashed once, into a table of ids and digests. Verdicts go back
to the rows by a sort-merge join, but for digests that more than one in ``HOT_SHARE`` rows
have: of those there are fewer than ``HOT_SHARE``, so their verdicts are broadcast and their
rows are not shuffled. Everything here is DataFrame and SQL work.

A load has an id, given by the caller. A load that is repeated under its id, say by a job
that failed after the append, has the same verdicts as before: the rows it owns are kept.
Loads are meant to come one after another. Where two read the index before either appends, both append
a digest, and both may keep its text; whoever reads it later has one row for it, owned by the lesser load id.

Defined results: a null text counts as empty; empty texts are equal to each other and
form a group; of equal texts in one load the largest id stays (a null id only if there
is no other); a digest that the index held before the load keeps its first owner; rows
that repeat an id and a text count as members of the group each and share one verdict;
an empty input gives an empty result and leaves the index unchanged; columns besides id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, unused

BUCKETS = 64
HOT_SHARE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each text; the text itself goes no further than this projection."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


class DigestIndex:
    """A digest index stored as a bucketed, sorted table of (text_sha256, keep_id, load_id)."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], "text_sha256 string, keep_id long, load_id string"))

    def _append(self, rows: DataFrame) -> None:
        rows.select("text_sha256", "keep_id", "load_id").write.format("parquet").mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", load_id: str | None = None) -> DataFrame:
        """Append the digests of ``docs`` that the index lacks; return one row per document with its verdict.

        Columns: doc_id, keep_id, group_size (documents of this load with that text), kept, text_sha256.
        """
        load, rows = load_id or uuid.uuid4().hex, saved(digests(docs, id_col, text_col))
        groups = saved(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        fresh = groups.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # one task per bucket writes one sorted file of that bucket
        self._append(fresh.withColumn("load_id", F.lit(load)).repartition(self.buckets, "text_sha256"))
        owners = groups.select("text_sha256", "group_size").join(self.read().hint("merge"), "text_sha256")
        # a digest that two loads appended at once has one owner; the join has dealt rows by digest, so nothing moves
        one = owners.groupBy("text_sha256", "group_size").agg(F.min(F.struct("load_id", "keep_id")).alias("o"))
        verdict = saved(one.select("text_sha256", "group_size", "o.keep_id", (F.col("o.load_id") == load).alias("fresh")))
        n = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first().n
        hot = F.col("group_size") * HOT_SHARE > n
        few = F.broadcast(verdict.where(hot))
        many = rows.join(few.select("text_sha256"), "text_sha256", "left_anti").join(verdict.where(~hot).hint("merge"), "text_sha256")
        return (
            rows.join(few, "text_sha256")
            .unionByName(many)
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                "text_sha256",
            )
        )


def exact_dedup(docs: DataFrame, table: str | None = None, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", load_id: str | None = None) -> DataFrame:
    """Verdict per document, through a digest index: the named one, or one for this call alone, which is dropped."""
    spark = docs.sparkSession
    name = table or f"digest_index_{uuid.uuid4().hex}"
    out = DigestIndex(spark, name, buckets).ingest(docs, id_col, text_col, load_id)
    if table is None:  # the verdicts are in a table of their own
        spark.sql(f"DROP TABLE {name}")
    return out


def deduplicated(docs: DataFrame, table: str | None = None, buckets: int = BUCKETS, load_id: str | None = None) -> DataFrame:
    """The documents that stay, with the columns they came with. A document is its id and text: of rows that repeat
    both, one stays; rows that share an id but not the text are judged each on its own."""
    id_, sha = unused(docs, "kept_id", "kept_sha")
    lowest = F.lit(-(1 << 63))  # stands for a null id, which loses to every other id
    keep = exact_dedup(docs, table, buckets, load_id=load_id).where("kept").select(F.coalesce("doc_id", lowest).alias(id_), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumns({sha: F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), id_: F.coalesce(F.col("doc_id").cast("long"), lowest)})
    return rows.join(keep, [sha, id_], "left_semi").dropDuplicates([sha, id_]).select(*docs.columns)
