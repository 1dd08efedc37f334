"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``WINDOW`` consecutive words of a benchmark item is a pattern (an item of
fewer words is one pattern). A block is two neighbouring words. The shift table says how
far a search position may move before any pattern could end there, so most words are never
examined; where the shift is 0, the hash of the last block together with that of the first
block selects a bucket of patterns to test, and the words themselves are compared before an
occurrence counts. The cursors of many stretches of text advance side by side in one array.

The work is dealt so that no task and not the driver holds the benchmark. The patterns are
a table. The shift table, and a table that says which buckets have a pattern at all, have a
fixed number of slots; they are summed up on the executors, and only they are broadcast (at
most 2 ** ``MAX_BITS`` bytes each for each length of patterns). A task searches its documents with
them; places whose bucket is not empty go out with their bucket's hash and their words, and
a join with the patterns of that bucket compares the words. A large benchmark fills the
tables and lets more places through to the join; the result is the same.

Defined results: null, empty and wordless texts have no words and no hits; a wordless
item has no window; windows that several items share count for each of them; repeated
rows are judged each on its own; an empty benchmark leaves every document clean; a null
item_id is called ``null``; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved, unused
from .textbuf import batch, chunks, mix, words

WINDOW = 13
MIN_BITS, MAX_BITS = 12, 22
STRETCH = 256
_C = np.uint64(0xD6E8FEB86659FD93)
_SHIFT, _BUCKET = 0, 1

HITS = "array<struct<first_word: long, end_word: long>>"
SCHEMA = f"doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits {HITS}"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
    + [("items", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())])))]
)
_FOUND = pa.list_(pa.struct([("n", pa.int32()), ("key", pa.int64()), ("first", pa.int64()), ("words", pa.binary())]))
_SCANNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("found", _FOUND)])


def blocks(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the block that ends at each word (of the word alone where patterns have one word); the first word of a
    text has no left neighbour and is never asked for."""
    if length == 1:
        return h
    out = h.copy()
    out[1:] += h[:-1] * _C
    return mix(out)


def bucket(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a pattern's first and last block."""
    return mix(last + first * _C)


def table_rows(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, slot, value) that patterns of one length, a row of word hashes each, put into the tables."""
    n = h.shape[1]
    block, mask = min(2, n), np.uint64((1 << bits) - 1)
    b = blocks(h.ravel(), n).reshape(h.shape)
    ends = b[:, block - 1 :]
    slot = np.concatenate([(ends & mask).ravel(), bucket(b[:, block - 1], b[:, -1]) & mask]).astype(np.int64)
    value = np.concatenate([np.tile(np.arange(n - block, -1, -1), len(h)), np.zeros(len(h), np.int64)])
    return np.repeat([_SHIFT, _BUCKET], [ends.size, len(h)]), slot, value


class WuManber:
    """The tables for patterns of one length."""

    def __init__(self, length: int, bits: int):
        self.length, self.block, self.mask = length, min(2, length), np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8)
        self.some = np.zeros(1 << bits, bool)

    def fill(self, table: np.ndarray, slot: np.ndarray, value: np.ndarray) -> WuManber:
        own = table == _SHIFT
        np.minimum.at(self.shift, slot[own], value[own].astype(np.uint8))
        self.some[slot[~own]] = True
        return self

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, bucket hash) of every place whose bucket has a pattern."""
        n, none = self.length, (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        lo, hi = first[:-1] + n - 1, first[1:]
        fit = hi > lo
        if not fit.any():
            return none
        lo, hi = lo[fit], hi[fit]
        parts = -(-(hi - lo) // STRETCH)
        base = np.repeat(lo, parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(base + STRETCH, np.repeat(hi, parts))
        block = blocks(h, n)
        at, cursor, found = (block & self.mask).astype(np.int64), base, []
        while len(cursor):
            step = self.shift[at[cursor]]
            zero = step == 0
            if zero.any():
                found.append(cursor[zero])
            cursor = cursor + np.maximum(step, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        if not found:
            return none
        end = np.sort(np.concatenate(found))
        start = end - n + 1
        key = bucket(block[start + self.block - 1], block[end])
        some = self.some[(key & self.mask).astype(np.int64)]
        return start[some], key[some]


def _joined(norm: np.ndarray, ws: np.ndarray, we: np.ndarray, start: np.ndarray, n: int) -> list[bytes]:
    """The words of each window, with a space between."""
    return [b" ".join(filter(None, norm[a:b].tobytes().split(b"\0"))) for a, b in zip(ws[start].tolist(), we[start + n - 1].tolist(), strict=True)]


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches):
            norm, ws, we, h, first = words(buf, off)
            count = np.diff(first)
            size = np.minimum(count, width)
            item = np.array(rows.column("item").to_pylist(), object)
            for n in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == n)
                many = count[own] - n + 1
                start = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                block = blocks(h, n)
                key = bucket(block[start + min(2, n) - 1], block[start + n - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(item[own], many).tolist(), pa.string()), pa.array(np.full(len(start), n, np.int32)), pa.array(key.view(np.int64)), pa.array(_joined(norm, ws, we, start, n), pa.binary())],
                    names=["item", "n", "key", "words"],
                )

    return run


def _table_rows(bits: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches, "words"):
            *_, h, first = words(buf, off)
            size = np.diff(first)
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                table, slot, value = table_rows(h[first[own][:, None] + np.arange(n)], bits[n])
                columns = (np.full(len(slot), n), table, slot, value)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["n", "tab", "slot", "value"])

    return run


def search_tables(patterns: DataFrame) -> list[WuManber]:
    """The tables for each length of patterns. The driver gets at most one row for each of their slots."""
    counts = {r.n: r["count"] for r in patterns.select("n", "words").distinct().groupBy("n").count().collect()}
    bits = {n: int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(16 * n * k))))) for n, k in counts.items()}
    rows = patterns.select("words").mapInArrow(_table_rows(bits), "n int, tab int, slot int, value int").groupBy("n", "tab", "slot").agg(F.min("value").alias("value")).toArrow()
    number, tab, slot, value = (rows.column(c).to_numpy() for c in ("n", "tab", "slot", "value"))
    return [WuManber(n, b).fill(tab[number == n], slot[number == n], value[number == n]) for n, b in sorted(bits.items())]


def _scanner(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches):
            norm, ws, we, h, first = words(buf, off)
            found: list[list] = [[] for _ in range(rows.num_rows)]
            for t in tables.value:
                start, key = t.search(h, first)
                doc = np.searchsorted(first, start, "right") - 1
                own = (start - first[doc]).tolist()
                for d, k, at, w in zip(doc.tolist(), key.view(np.int64).tolist(), own, _joined(norm, ws, we, start, t.length), strict=True):
                    found[d].append({"n": t.length, "key": k, "first": at, "words": w})
            yield batch(_SCANNED, doc_id=rows.column("doc_id"), text_key=rows.column("text_key"), n_words=np.diff(first), found=found)

    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from its occurrences: the union of the covered words."""
    for b in batches:
        n_hit, items, runs = [], [], []
        for spans, found in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            merged: list[dict] = []
            for s in sorted((s["a"], s["b"]) for s in spans or []):
                if merged and s[0] <= merged[-1]["end_word"]:
                    merged[-1]["end_word"] = max(s[1], merged[-1]["end_word"])
                else:
                    merged.append({"first_word": s[0], "end_word": s[1]})
            runs.append(merged)
            items.append(sorted(found or []))
            n_hit.append(sum(m["end_word"] - m["first_word"] for m in merged))
        n_words, hit = b.column("n_words").to_numpy(), np.array(n_hit, np.int64)
        yield batch(
            _ARROW, doc_id=b.column("doc_id"), text_key=b.column("text_key"), n_words=n_words, n_hit=hit, n_items=[len(x) for x in items],
            items_sha256=[hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], contaminated=(hit > 0) & (20 * hit >= n_words), items=items, hits=runs,
        )


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The result with text_key, which with the id names the document."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    patterns = saved(items.mapInArrow(_windows(width), "item string, n int, key long, words binary").distinct())
    tables = docs.sparkSession.sparkContext.broadcast(search_tables(patterns))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_scanner(tables), "doc_id long, text_key long, n_words long, found array<struct<n: int, key: long, first: long, words: binary>>")
    scanned = saved(scanned.withColumn("row", F.monotonically_increasing_id()))
    some = scanned.where(F.size("found") > 0)
    places = some.select("row", F.explode("found").alias("f")).select("row", "f.n", "f.key", "f.words", "f.first")
    hits = places.join(patterns, ["n", "key", "words"]).groupBy("row").agg(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))).alias("spans"), F.collect_set("item").alias("items"))
    with_places = some.select("row", "doc_id", "text_key", "n_words").join(hits, "row", "left").mapInArrow(_verdicts, SCHEMA)
    clean = scanned.where(F.size("found") == 0).select(
        "doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"),
        F.lit(False).alias("contaminated"), F.array().cast("array<string>").alias("items"), F.array().cast(HITS).alias("hits"),
    )
    return with_places.unionByName(clean)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: words, words hit, items found, the covered word spans, and the verdict (a twentieth of the words)."""
    return _judged(docs, benchmark, width, id_col, text_col, item_col, item_text_col).drop("text_key")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, with the columns they came with. A document is its id and text:
    rows that share an id are judged each by its own text."""
    id_, key = unused(docs, "bad_id", "bad_key")
    lowest = F.lit(-(1 << 63))
    bad = _judged(docs, benchmark, WINDOW, "doc_id", "text", "item_id", "text").where("contaminated")
    bad = bad.select(F.coalesce("doc_id", lowest).alias(id_), F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), lowest), key: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return keyed.join(bad, [id_, key], "left_anti").select(*docs.columns)
