"""Bounded samples of labelled rows, for fitting classifiers. Counts and statistics never use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled (or unlabelled) rows that a classifier is fitted on.
MAX_ROWS = 20_000


def fold(parts: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def pick(rows: DataFrame, columns: list[str], key: str = "doc_id", most: int = MAX_ROWS, seed: int = 17) -> DataFrame:
    """At most ``most`` rows of the columns, in the order of a hash of the key: the same rows every time, spread evenly."""
    return rows.select(*columns).orderBy(F.xxhash64(F.col(key), F.lit(seed)), *columns).limit(most)


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of the sampled ids, one for each sampled row: of rows that share an id, the one with the least hash of its text.

    The sample has at most MAX_ROWS rows of a few numbers, so it can be broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = sample.columns
    found = rows.join(F.broadcast(sample), "doc_id").groupBy(*own).agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t"))
    return found.select(*own, F.col("t.text").alias("text"))
