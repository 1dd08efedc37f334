"""Suffix-array dedup: bytes that lie in a string of ``LENGTH`` bytes which also starts earlier.

The suffix array is built by the difference-cover algorithm (``suffix_array``: sort the
triples at positions 1 and 2 modulo 3, recurse on their names, sort the remaining suffixes
by first symbol and following rank, merge), and neighbours in it are compared over their
first ``LENGTH`` bytes. To distribute it, texts are cut so that suffixes which agree for
``LENGTH`` bytes always meet in one place:

1. Every window of ``LENGTH`` bytes has an anchor, the first of its grams of ``GRAM`` bytes
   with the least hash. The anchor depends on the window's bytes alone, so equal windows
   have equal grams at equal places. Windows that follow each other mostly share an
   anchor: a run. One row per run goes out: the hash of its gram (the key), 128 bits of the
   BLAKE2b digest of all its bytes (its content), and its place.
   Of equal runs that one task finds, only the first is keyed so; the others are known to
   repeat, so a passage that many documents share reaches its partition a few times only.
2. Rows arrive sorted by key, content and place, and a task streams over them. All but the
   first run of equal key and content repeat throughout. A key with one
   content has nothing else to compare and is dropped, as most keys are.
3. The bytes of the remaining runs, one for each content, go to the partition of their key.
   They form the text whose suffix array a task builds, a bounded number of bytes at a
   time; equal windows among them are neighbours there, and all but the earliest repeat.
4. A key with more than ``HOT_BYTES`` of distinct strings is not held in one task: its
   windows go out as rows of their own, keyed by 128 bits of the digest of their bytes, and
   are grouped by Spark with partial aggregation.

Repeats go back to their documents as runs; the bytes they cover are removed.

Result, one row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

Defined results: null counts as empty; texts of under ``LENGTH`` bytes lose nothing; a null
id counts as the least id; different texts that share an id are documents of their own, in
the order of a hash of the text; rows that repeat an id and a text are one document and
share its result; an empty input gives an empty result; columns besides id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved
from .textbuf import BYTE_VALUES, batch, chunks, mix, spans_of

LENGTH, GRAM = 100, 20
TEXT_BYTES, HOT_BYTES, GATHER_BYTES = 1 << 20, 8 << 20, 24 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_MARKS = pa.schema([("h", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])


# ---- the suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of an array of positive integers in order (a suffix that ends counts as smaller)."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, [0, 0, 0, 0]])
    top = int(s.max()) + 1
    # sample: positions 1 and 2 modulo 3; one more where needed, so that every position 0 has a sampled successor
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # names: numbers of the distinct triples, in order
    if top < 1 << 20:
        _, name = np.unique((t[sample] * top + t[sample + 1]) * top + t[sample + 2], return_inverse=True)
    else:
        _, pair = np.unique(t[sample] * top + t[sample + 1], return_inverse=True)
        _, name = np.unique(pair.astype(np.int64) * top + t[sample + 2], return_inverse=True)
    name = name.astype(np.int64) + 1
    if name.max() < len(sample):
        order = suffix_array(name)
    else:
        order = np.argsort(name)
    sample_sorted = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sample_sorted] = np.arange(1, len(sample) + 1)
    sample_sorted = sample_sorted[sample_sorted < n]
    # the remaining suffixes, by first symbol and rank of the next
    zero = np.arange(0, n, 3)
    base = len(sample) + 2
    zero = zero[np.argsort(t[zero] * base + rank[zero + 1], kind="stable")]
    # merge: how many sampled suffixes stand before each of them
    ones, twos = sample_sorted[sample_sorted % 3 == 1], sample_sorted[sample_sorted % 3 == 2]
    before = np.searchsorted(t[ones] * base + rank[ones + 1], t[zero] * base + rank[zero + 1])
    if top * top < (1 << 62) // base:
        key = lambda i: (t[i] * top + t[i + 1]) * base + rank[i + 2]
        before = before + np.searchsorted(key(twos), key(zero))
    else:
        first, both = np.unique(np.concatenate([t[twos] * top + t[twos + 1], t[zero] * top + t[zero + 1]]), return_inverse=True)
        a, b = both[: len(twos)] * base + rank[twos + 2], both[len(twos) :] * base + rank[zero + 2]
        before = before + np.searchsorted(a, b)
    out = np.full(n, -1, np.int64)
    out[before + np.arange(len(zero))] = zero
    out[out < 0] = sample_sorted
    return out


def repeats(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class number for each of ``starts`` (windows that lie inside the text): equal windows, equal numbers."""
    order = suffix_array(text)
    place = np.full(len(text), -1, np.int64)
    place[starts] = np.arange(len(starts))
    order = order[place[order] >= 0]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    word = np.zeros(len(text) + 8, np.uint64)  # the eight symbols from each position, as one number
    small = text.astype(np.uint64)
    for k in range(8):
        word[: len(text) - k] |= small[k:] << np.uint64(8 * k)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        eq = word[a[live] + k] == word[b[live] + k]
        same[live[~eq]] = False
        live = live[eq]
    out = np.zeros(len(starts), np.int64)
    out[place[order]] = np.concatenate([[0], np.cumsum(~same)])
    return out


# ---- anchors and runs


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position where so many follow."""
    h = BYTE_VALUES[buf]
    sized = {1: h}
    for k in (1, 2, 4, 8):
        x = sized[k]
        sized[2 * k] = mix(x[: len(x) - k] * np.uint64(0xC6BC279692B5C323 + 2 * k) + x[k:])
    n = len(buf) - GRAM + 1
    return mix(sized[16][:n] * np.uint64(0xD6E8FEB86659FD93) + sized[4][16 : 16 + n])


def anchor_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, first window, number of windows) of every run."""
    none = np.zeros(0, np.int64)
    if not (np.diff(off) >= LENGTH).any():
        return none, none, none, none
    h = gram_hashes(buf)
    wide = LENGTH - GRAM + 1
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # least hash, then first place
    k = 1
    while 2 * k <= wide:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    low = np.minimum(low[: len(low) - (wide - k)], low[wide - k :])
    inside = np.zeros(len(low), np.int8)
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    mark = np.zeros(len(low) + 1, np.int32)
    np.add.at(mark, off[long], 1)
    np.add.at(mark, off[long + 1] - LENGTH + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    p = np.flatnonzero(inside)
    anchor = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(off, p, "right") - 1
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    # 48 bits are enough to bring equal grams together; others that meet them do no harm
    return (h[anchor[first]] >> np.uint64(16)).view(np.int64), doc[first], p[first] - off[doc[first]], np.diff(np.append(first, len(p)))


RUN_SCHEMA = "key long, content long, content2 long, h long, start int, n int"
SHARED_SCHEMA = "key long, h long, start int, n int"


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of the BLAKE2b digest of every stretch of bytes, as two columns of numbers."""
    data = buf.tobytes()
    raw = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all runs. Of runs that a task finds equal among ``GATHER_BYTES`` of text, only the first goes to the
    partition of its key; the others are repeats for certain (``n`` negative) and are spread by document."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        key, content, h, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, h, content[:, 1], content[:, 0], key))
        key, content, h, start, n = key[order], content[order], h[order], start[order], n[order]
        like = np.zeros(len(key), bool)
        like[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1]).all(axis=1)
        like[1:] &= (h[1:] != h[:-1]) | (start[1:] != start[:-1])  # a row that stands twice is one run
        key = np.where(like, mix(h.view(np.uint64)).view(np.int64), key)
        columns = (pa.array(key), pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(h), pa.array(start.astype(np.int32)), pa.array(np.where(like, -n, n).astype(np.int32)))
        return pa.RecordBatch.from_arrays(list(columns), names=["key", "content", "content2", "h", "start", "n"])

    for rows, buf, off in chunks(batches):
        key, doc, start, n = anchor_runs(buf, off)
        at = off[doc] + start
        content = digests(buf, at, at + n + LENGTH - 1)
        held.append((key, content, rows.column("h").to_numpy()[doc].astype(np.int64), start, n))
        size += len(buf)
        if size >= GATHER_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, content and place: repeats as a whole (key null), and the first run of each
    content of keys with several. One row is held back between batches."""

    def out(key, h, start, n):
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()) if key is None else pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["key", "h", "start", "n"])

    last = held = None
    twin = False
    for b in batches:
        if not b.num_rows:
            continue
        row = np.array([b.column(c).to_numpy().astype(np.int64) for c in ("key", "content", "content2", "h", "start", "n")])
        if (known := row[5] < 0).any():  # repeats that the sending task has found
            yield out(None, row[3, known], row[4, known], -row[5, known])
            row = row[:, ~known]
            if not row.shape[1]:
                continue
        before = np.concatenate([row[:, :1] - 1 if last is None else last, row[:, :-1]], axis=1)
        last = row[:, -1:]
        same = (row[:3] == before[:3]).all(axis=0)
        again = same & (row[3:5] != before[3:5]).any(axis=0)  # a row that stands twice is one run
        if again.any():
            yield out(None, row[3, again], row[4, again], row[5, again])
        first = row[:, ~same] if held is None else np.concatenate([held, row[:, ~same]], axis=1)
        if not first.shape[1]:
            continue
        like = first[0, 1:] == first[0, :-1]
        keep = np.concatenate([[twin], like]) | np.concatenate([like, [False]])
        held, twin = first[:, -1:], bool(keep[-1])
        own = first[:, :-1][:, keep[:-1]]
        if own.shape[1]:
            yield out(own[0], own[3], own[4], own[5])
    if held is not None and twin:
        yield out(held[0], held[3], held[4], held[5])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every kept run."""
    for rows, buf, off in chunks(batches):
        data, at = buf.tobytes(), off.tolist()
        keys, handles, starts, bytes_ = [], [], [], []
        for d, (h, runs) in enumerate(zip(rows.column("h").to_pylist(), rows.column("runs"), strict=True)):
            r = runs.values
            s, n = r.field("start").to_pylist(), r.field("n").to_pylist()
            keys.append(r.field("key"))
            handles += [h] * len(s)
            starts += s
            bytes_ += [data[at[d] + a : at[d] + a + k + LENGTH - 1] for a, k in zip(s, n, strict=True)]
            if len(bytes_) > 50_000:
                yield _cut_rows(keys, bytes_, handles, starts)
                keys, handles, starts, bytes_ = [], [], [], []
        if bytes_:
            yield _cut_rows(keys, bytes_, handles, starts)


def _cut_rows(keys, bytes_, handles, starts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(bytes_, pa.binary()), pa.array(handles, pa.int64()), pa.array(starts, pa.int32())], names=["key", "bytes", "h", "start"])


def _as_runs(h: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Marks from repeated windows, those that follow each other joined."""
    order = np.lexsort((pos, h))
    h, pos = h[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return _mark(h[first], pos[first], np.diff(np.append(first, len(h))))


def _mark(h, start, n, k1=None, k2=None) -> pa.RecordBatch:
    none = pa.nulls(len(h), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), none if k1 is None else pa.array(k1, pa.int64()), none if k2 is None else pa.array(k2, pa.int64())], schema=_MARKS)


def _windows(strings: list[bytes], h: list[int], start: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text with a 0 between strings, place of each window in it, handle, place in the document)."""
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    size = np.array([len(x) for x in strings], np.int64)
    at = np.cumsum(size + 1) - size - 1
    n = size - LENGTH + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return text, np.repeat(at, n) + inner, np.repeat(np.array(h, np.int64), n), np.repeat(np.array(start, np.int64), n) + inner


def _earlier(strings: list[bytes], h: list[int], start: list[int]) -> pa.RecordBatch:
    """Marks of the windows that one at an earlier place equals, by the suffix array of the strings."""
    text, at, handle, pos = _windows(strings, h, start)
    number = repeats(text.astype(np.int64) + 1, at)
    order = np.lexsort((pos, handle, number))
    later = np.zeros(len(at), bool)
    a, b = order[:-1], order[1:]
    later[b] = (number[b] == number[a]) & ((handle[b] != handle[a]) | (pos[b] != pos[a]))  # a row that stands twice is one string
    return _as_runs(handle[later], pos[later])


def _content_keys(strings: list[bytes], h: list[int], start: list[int]) -> pa.RecordBatch:
    """A row per window, with 128 bits of the digest of its bytes."""
    text, at, handle, pos = _windows(strings, h, start)
    keys = digests(text, at, at + LENGTH)
    return _mark(handle, pos, np.ones(len(at), np.int64), keys[:, 0], keys[:, 1])


def _matcher(text_bytes: int, hot_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[list] = [[], [], []]  # strings, handles and starts of finished keys
        own: list[list] = [[], [], []]  # those of the key at hand
        size = own_size = 0
        key, hot = None, False
        for b in batches:
            columns = (b.column(c) for c in ("key", "bytes", "h", "start"))
            for k, s, h, at in zip(*(c.to_pylist() for c in columns), strict=True):
                if k != key:
                    if hot and own[0]:
                        yield _content_keys(*own)
                    elif not hot:
                        for x, y in zip(full, own, strict=True):
                            x.extend(y)
                        size += own_size
                        if size >= text_bytes:
                            yield _earlier(*full)
                            full, size = [[], [], []], 0
                    key, hot, own, own_size = k, False, [[], [], []], 0
                own[0].append(s), own[1].append(h), own[2].append(at)
                own_size += len(s)
                if own_size >= hot_bytes or (hot and own_size >= text_bytes):
                    hot = True
                    yield _content_keys(*own)
                    own, own_size = [[], [], []], 0
        if hot and own[0]:
            yield _content_keys(*own)
        elif not hot:
            full = [x + y for x, y in zip(full, own, strict=True)]
        if full[0]:
            yield _earlier(*full)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in chunks(batches):
        cover = np.zeros(len(buf) + 1, np.int32)
        for d, runs in enumerate(rows.column("runs")):
            if runs.is_valid:
                start, n = runs.values.field("start").to_numpy(), runs.values.field("n").to_numpy()
                np.add.at(cover, off[d] + start, 1)
                np.add.at(cover, off[d] + start + n + LENGTH - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        starts, _ = spans_of(gone, off)
        total = np.concatenate([[0], np.cumsum(gone)])
        at = off.tolist()
        kept = [hashlib.sha256(buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield batch(_ARROW, doc_id=rows.column("doc_id"), n_bytes=np.diff(off), n_removed=total[off[1:]] - total[off[:-1]], n_spans=np.diff(np.searchsorted(starts, off)), kept_sha256=kept)


def _with_handles(rows: DataFrame) -> DataFrame:
    """Rows with a number ``h`` that names their document and is ordered as documents are: the id, where that will do."""
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.withColumn("h", F.col("doc_id"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_text": F.xxhash64("text")})
    ids = rows.select("_id", "_text").distinct().repartitionByRange("_id", "_text").sortWithinPartitions("_id", "_text")
    return rows.join(saved(ids.withColumn("h", F.monotonically_increasing_id())), ["_id", "_text"]).select("doc_id", "text", "h")


def suffix_dedup(docs: DataFrame, text_bytes: int = TEXT_BYTES, hot_bytes: int = HOT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _with_handles(rows)
    texts = rows.select("h", "text")
    runs = texts.mapInArrow(_runs, RUN_SCHEMA).repartition("key").sortWithinPartitions("key", "content", "content2", "h", "start")
    shared = saved(runs.mapInArrow(_shared, SHARED_SCHEMA))
    wanted = shared.where("key is not null").groupBy("h").agg(F.collect_set(F.struct("key", "start", "n")).alias("runs"))
    strings = texts.join(wanted, "h").select("h", "text", "runs").mapInArrow(_cut, "key long, bytes binary, h long, start int")
    found = strings.repartition("key").sortWithinPartitions("key").mapInArrow(_matcher(text_bytes, hot_bytes), "h long, start long, n long, k1 long, k2 long")
    found = saved(found)
    # windows of hot keys: all but the earliest of equal content are repeats
    window = found.where("k1 is not null")
    first = window.groupBy("k1", "k2").agg(F.min(F.struct("h", "start")).alias("first"), F.count("*").alias("k")).where("k > 1").select("k1", "k2", "first")
    later = window.join(first, ["k1", "k2"]).where(F.struct("h", "start") > F.col("first")).select("h", "start", "n")
    whole = shared.where("key is null").select("h", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))
    marks = found.where("k1 is null").select("h", "start", "n").unionByName(later).unionByName(whole)
    by_doc = marks.groupBy("h").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(by_doc, "h", "left").select("doc_id", "text", "runs").mapInArrow(_remove, SCHEMA)
