"""Stateful operators: what a stream knows lies in maps and values of the state store, by bucket of keys.

Keys are dealt by hash over ``BUCKETS`` buckets, which are the groups of the stream: an access to the store is a message to the JVM and
a group costs some ms, so a group of its own for every key would cost more than the rows do. A bucket's step takes the rows of a
batch in the order of a column; it reads and writes the few numbers of each of its keys at once, and of numbered entries the blocks that the batch
touches, so neither state nor output grows with the stream. A bucket's rows of one batch are in one task: bound the batch
(``maxFilesPerTrigger``), not the stream. A batch comes after all earlier ones: an operator cannot put rows of different batches in order, so a
source must hand them out in order (``events.replayed`` does). Keys, kinds and tokens may be null; a null is a value of its own.

The state store must be the RocksDB one; ``events`` sets it for the queries that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import IntegralType

from ..tables import unused

#: Buckets of keys; a stream keeps the number that it began with, as its checkpoint does.
BUCKETS = 1024
#: Entries that a block of state entries is to have, at the density of a bucket's first batch.
BLOCK = 256


class _Bucketed(StatefulProcessor):
    """A processor that gets the rows of a bucket and a batch, in order if there is one, with their keys as plain values."""

    order: str | None = None

    def bind(self, name: str, kind: str, integral: bool) -> None:
        self.name, self.kind, self.integral = name, kind, integral

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)

    def keys(self, rows: pd.DataFrame) -> list:
        """Keys as the state has them; whole numbers come as texts, since pandas would make floats of them beside a null."""
        values = rows[self.name].astype(object).where(rows[self.name].notna(), None).tolist()
        if self.integral:
            return [None if k is None else int(k) for k in values]
        return [k.to_pydatetime() if isinstance(k, pd.Timestamp) else k for k in values]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: TimerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames:
            f = pd.concat(frames, ignore_index=True)
            if self.order:
                f = f.sort_values(self.order, kind="stable", ignore_index=True)
            yield self.step(self.keys(f), f)

    def close(self) -> None:
        pass


def _with_state(df: DataFrame, key: str, processor: _Bucketed, schema: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    (bucket,) = unused(df, "bucket")
    kind = df.schema[key].dataType
    processor.bind(key, kind.simpleString(), isinstance(kind, IntegralType))

    def dealt(rows: DataFrame):
        sent = F.col(key).cast("string") if processor.integral else F.col(key)
        return rows.withColumn(bucket, F.pmod(F.xxhash64(F.col(key).cast(kind)), F.lit(BUCKETS)).cast("int")).withColumn(key, sent).groupBy(bucket)

    return dealt(df).transformWithStateInPandas(processor, schema, mode, "None", dealt(initial) if initial is not None else None)


class _Values:
    """The numbers of each key of a bucket, read and written together."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: _Bucketed, *columns: str):
        self.state = handle.getValueState(name, ", ".join(f"`{c}` array<{t}>" for c, t in ((key.name, key.kind), *(c.split() for c in columns))))

    def read(self) -> dict:
        return {k: list(v) for k, *v in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def write(self, values: dict) -> None:
        self.state.update(tuple(list(c) for c in zip(*((k, *v) for k, v in values.items()), strict=True)))


class _Blocks:
    """Numbered entries of the keys of a bucket, in blocks of a range of numbers: a batch reads and writes the blocks that it touches, once each.

    A block's range is chosen by the first numbers that a bucket sees, so that it has some ``BLOCK`` entries whether keys number
    their entries each for itself or all together.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: _Bucketed, columns: tuple[str, ...]):
        self.state = handle.getMapState(name, "block long", ", ".join((f"`{key.name}` array<{key.kind}>", *(f"{c} array<long>" for c in ("number", *columns)))))
        self.range = handle.getValueState(f"{name}_range", "width long")
        self.width = 0
        self.open: dict[int, dict[tuple, tuple[int, ...]]] = {}
        self.touched: set[int] = set()

    def begin(self, numbers) -> None:
        """Before a batch: its numbers, for a bucket that has none yet."""
        if self.range.exists():
            self.width = int(self.range.get()[0])
        elif len(numbers):
            self.width = max(1, (int(max(numbers)) - int(min(numbers)) + 1) * BLOCK // len(numbers))
            self.range.update((self.width,))

    def block(self, number: int) -> dict[tuple, tuple[int, ...]]:
        b = number // self.width
        if (found := self.open.get(b)) is None:
            stored = self.state.getValue((b,)) if self.state.containsKey((b,)) else None
            found = self.open[b] = {} if stored is None else {(k, n): tuple(v) for k, n, *v in zip(*stored, strict=True)}
        return found

    def get(self, key, number: int) -> tuple[int, ...] | None:
        return self.block(number).get((key, number))

    def put(self, key, number: int, *value: int) -> None:
        self.block(number)[key, number] = value
        self.touched.add(number // self.width)

    def pop(self, key, number: int) -> None:
        self.block(number).pop((key, number), None)
        self.touched.add(number // self.width)

    def write(self) -> None:
        """Store what has changed, and forget what was read: the next bucket comes."""
        for b in self.touched:
            if own := self.open[b]:
                columns = zip(*((*k, *v) for k, v in own.items()), strict=True)
                self.state.updateValue((b,), tuple(list(c) for c in columns))
            elif self.state.containsKey((b,)):
                self.state.removeKey((b,))
        self.open, self.touched = {}, set()


class _Tokens(_Bucketed):
    def __init__(self, token: str, order: str):
        self.token, self.order = token, order

    def open(self, handle):
        self.last = _Values(handle, "last", self, "token string")

    def step(self, kinds, rows):
        last, out = self.last.read(), []
        for kind, token in zip(kinds, rows[self.token].astype(object).where(rows[self.token].notna(), None).tolist(), strict=True):
            if kind not in last or last[kind][0] != token:
                out.append((kind, token))
                last[kind] = [token]
        self.last.write(last)
        return pd.DataFrame(out, columns=["kind", "token"])


def changed_tokens(df: DataFrame, kind: str, token: str, order: str) -> DataFrame:
    """Requests whose token differs from the last one of their kind: (kind, token); the same token again is no request.

    The first token of a kind is a request, null or not.
    """
    return _with_state(df.select(kind, token, order), kind, _Tokens(token, order), "kind string, token string", "Append")


class _Cursor(_Bucketed):
    def __init__(self, order: str):
        self.order = order

    def open(self, handle):
        self.counts = _Values(handle, "counts", self, "generated long", "consumed long")
        self.waiting = _Blocks(handle, "waiting", self, ("at",))

    def handleInitialState(self, key, initial, timer):
        # the rows of a bucket may come in several frames
        counts = self.counts.read()
        for k, generated, consumed in zip(self.keys(initial), initial["generated"].tolist(), initial["consumed"].tolist(), strict=True):
            counts[k] = [int(generated), int(consumed)]
        self.counts.write(counts)
        own = initial.dropna(subset=["index_no"])
        index = own["index_no"].astype(int).tolist()
        self.waiting.begin(index)
        for k, i, at in zip(self.keys(own), index, own["at"].astype(int).tolist(), strict=True):
            self.waiting.put(k, i, at)
        self.waiting.write()

    def step(self, keys, rows):
        counts, seen, waiting = self.counts.read(), {}, self.waiting
        waiting.begin(rows["index_no"])
        for key, index, issued, at in zip(keys, rows["index_no"].tolist(), (rows["action"] == "issued").tolist(), rows[self.order].tolist(), strict=True):
            own = seen.get(key)
            if own is None:
                own = seen[key] = counts.setdefault(key, [0, 0])
            held = waiting.get(key, index) is not None
            own[0] += issued
            if issued and not held:  # what waits already keeps its place
                waiting.put(key, index, at)
            elif held and not issued:
                waiting.pop(key, index)
                own[1] += 1
        waiting.write()
        self.counts.write(counts)
        return pd.DataFrame([(str(k), *v) for k, v in seen.items()], columns=["key", "generated", "consumed"])


def consumption(df: DataFrame, key: str, order: str, carried: DataFrame | None = None) -> DataFrame:
    """Cursor of each consumer from events ``issued`` and ``consumed`` of running indices: (key, generated, consumed) by batch.

    The state holds the indices that are out, in blocks, and nothing of the others. ``outstanding`` reads them
    from a checkpoint; ``carried`` (from ``carried_over``) starts a new stream, of another source or stage, with them.
    """
    rows = df.select(key, "index_no", "action", F.col(order).cast("long").alias(order))
    return _with_state(rows, key, _Cursor(order), "key string, generated long, consumed long", "Update", carried)


def _entries(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The entries of a state variable, a row for each place of its arrays."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    value = "value" if "value" in state.columns else "user_map_value"
    return state.select(F.inline(F.arrays_zip(*[f"{value}.`{f}`" for f in state.schema[value].dataType.names])))


def outstanding(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, index_no, at) of what was issued and not consumed when the stream stopped; ``at`` is the order of issue."""
    return _entries(spark, checkpoint, "waiting").withColumnRenamed("number", "index_no")


def carried_over(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The state of a stopped ``consumption``, for the stream that goes on with it: a row for each index that is out, or one without."""
    out = outstanding(spark, checkpoint).withColumnRenamed(key, "_key")
    return _entries(spark, checkpoint, "counts").join(out, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "index_no", "at", "generated", "consumed")


class _Reuse(_Bucketed):
    def __init__(self, order: str, eligible: str, depth: int):
        self.order, self.eligible, self.depth = order, eligible, depth

    def open(self, handle):
        self.uses = _Values(handle, "uses", self, "uses long")

    def step(self, keys, rows):
        uses, seen = self.uses.read(), {}
        for key, ok in zip(keys, rows[self.eligible].fillna(False).astype(bool).tolist(), strict=True):
            # a row that is not eligible sets the count to 0, and so does one that finds the depth reached
            own = uses.setdefault(key, [0])
            own[0] = own[0] + 1 if ok and own[0] < self.depth else 0
            seen[key] = own[0]
        self.uses.write(uses)
        return pd.DataFrame([(str(k), n, n > 0) for k, n in seen.items()], columns=["key", "uses", "again"])


def reuse_limited(df: DataFrame, key: str, order: str, eligible: str, depth: int) -> DataFrame:
    """How often each sample was used again in a row: (key, uses, again); an ineligible row or the depth resets the count."""
    return _with_state(df.select(key, order, eligible), key, _Reuse(order, eligible, depth), "key string, uses long, again boolean", "Update")


class _Agreement(_Bucketed):
    """Rounds of a sample wait until every replica has spoken, and are settled in order."""

    def __init__(self, replicas: int, depth: int):
        self.replicas, self.depth = replicas, depth

    def open(self, handle):
        self.place = _Values(handle, "place", self, "next long", "uses long")
        self.rounds = _Blocks(handle, "rounds", self, ("heard", "no"))

    def step(self, keys, rows):
        place, seen, rounds = self.place.read(), {}, self.rounds
        rounds.begin(rows["round"])
        # a bit for each replica: who has spoken, and who would not use the sample again
        for key, r, replica, ok in zip(keys, rows["round"].tolist(), rows["replica"].tolist(), rows["ok"].fillna(False).astype(bool).tolist(), strict=True):
            own = seen.get(key)
            if own is None:
                own = seen[key] = place.setdefault(key, [0, 0])
            if r >= own[0]:  # others are settled already
                heard, no = rounds.get(key, r) or (0, 0)
                rounds.put(key, r, heard | 1 << replica, no if ok else no | 1 << replica)
        done = []
        for key, own in seen.items():
            while (said := rounds.get(key, own[0])) and said[0] == (1 << self.replicas) - 1:
                again = not said[1] and own[1] < self.depth
                own[1] = own[1] + 1 if again else 0
                done.append((str(key), own[0], again, own[1]))
                rounds.pop(key, own[0])
                own[0] += 1
        rounds.write()
        self.place.write(place)
        return pd.DataFrame(done, columns=["key", "round", "again", "uses"])


def agreed_reuse(df: DataFrame, key: str, replicas: int, depth: int) -> DataFrame:
    """Whether a sample is used again, round by round: (key, round, again, uses), only when all replicas find it eligible.

    Rows are (key, round, replica, ok), in any order, with rounds from 0 and replicas from 0 to ``replicas`` - 1 (62 at
    most). A round is settled when every replica has spoken and all rounds before it are settled, so one late replica holds its
    sample; the state keeps two bit sets for each round that is open.
    """
    if not 0 < replicas <= 62:
        raise ValueError("from 1 to 62 replicas")
    rows = df.where(F.col("replica").between(0, replicas - 1) & (F.col("round") >= 0)).select(key, "round", "replica", "ok")
    return _with_state(rows, key, _Agreement(replicas, depth), "key string, round long, again boolean, uses long", "Append")


class _Queues(_Bucketed):
    def __init__(self, order: str):
        self.order = order

    def open(self, handle):
        self.counts = _Values(handle, "counts", self, "tail long", "asked long", "served long")
        self.items = _Blocks(handle, "items", self, ("item", "part"))

    def step(self, keys, rows):
        counts, items, out, fresh = self.counts.read(), self.items, [], {}
        for key, action, item, parts in zip(keys, rows["action"].tolist(), rows["item"].tolist(), rows["parts"].tolist(), strict=True):
            own = counts.setdefault(key, [0, 0, 0])
            if action == "next":
                own[1] += 1
            else:
                for p in range(parts):
                    fresh[key, own[0]] = item, p
                    own[0] += 1
            ready = min(own[0], own[1])
            out += [(key, n) for n in range(own[2], ready)]  # one place is served after the other
            own[2] = ready
        # only what lay in the queue before, or stays in it, is a matter of the store
        served, old = set(out), [(k, n) for k, n in out if (k, n) not in fresh]
        stay = {k: v for k, v in fresh.items() if k not in served}
        items.begin([n for _, n in (*old, *stay)])
        for place in old:
            fresh[place] = items.get(*place)
            items.pop(*place)
        for place, value in stay.items():
            items.put(*place, *value)
        items.write()
        self.counts.write(counts)
        return pd.DataFrame([(str(k), n, *fresh[k, n]) for k, n in out], columns=["key", "place", "item", "part"])


def queued_documents(df: DataFrame, key: str, order: str) -> DataFrame:
    """Documents handed out one a request, first in, first out: (key, place, item, part).

    Rows are (key, ``order``, action, item, parts): an ``item`` brings ``parts`` documents, a ``next`` asks for one. What
    has not been asked for stays queued, and a request that finds the queue empty waits for the next item, over batches and restarts.
    """
    whole = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none).cast("long")).alias(c)
    return _with_state(df.select(key, order, "action", whole("item", -1), whole("parts", 0)), key, _Queues(order), "key string, place long, item long, part long", "Append")


class _History(_Bucketed):
    def __init__(self, chunk: str, row: str, sink: int, window: int):
        self.chunk, self.row, self.sink, self.window = chunk, row, sink, window

    def open(self, handle):
        self.newest = _Values(handle, "newest", self, "chunk long")
        self.chunks = handle.getValueState("chunks", f"`{self.name}` array<{self.kind}>, chunk array<long>, row array<long>")

    def step(self, keys, rows):
        newest, seen = self.newest.read(), set(keys)
        chunks, numbers = rows[self.chunk].tolist(), rows[self.row].tolist()
        for key, c in zip(keys, chunks, strict=True):
            own = newest.setdefault(key, [c])
            own[0] = max(own[0], c)
        before = zip(*self.chunks.get(), strict=True) if self.chunks.exists() else ()
        # what has fallen out of the window goes, and a late row of a chunk that is gone is not kept
        stays = [(k, c, n) for k, c, n in (*before, *zip(keys, chunks, numbers, strict=True)) if c < self.sink or c > newest[k][0] - self.window]
        held = dict.fromkeys(seen, 0)
        for k, _, _ in stays:
            if k in held:
                held[k] += 1
        self.chunks.update(tuple(list(c) for c in zip(*stays, strict=True)))
        self.newest.write(newest)
        return pd.DataFrame([(str(k), newest[k][0], n) for k, n in held.items()], columns=["key", "newest", "held"])


def sliding_history(df: DataFrame, key: str, chunk: str, row: str, sink: int, window: int) -> DataFrame:
    """History that is kept while a sequence grows: (key, newest, held) by batch, the newest chunk and the number of rows held.

    Rows of the first ``sink`` chunks and of the last ``window`` chunk numbers stay, as in ``visibility.kept_history``; what falls out is taken from
    the state. ``held_rows`` reads from a checkpoint which rows they are. Rows may come in any order within a window.
    """
    if window <= 0:
        raise ValueError("a history without a window keeps everything")
    rows = df.select(key, F.col(chunk).cast("long").alias(chunk), F.col(row).cast("long").alias(row)).where(F.col(chunk).isNotNull() & F.col(row).isNotNull())
    return _with_state(rows, key, _History(chunk, row, sink, window), "key string, newest long, held long", "Update")


def held_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, chunk, row) of what a stopped ``sliding_history`` holds."""
    return _entries(spark, checkpoint, "chunks")
