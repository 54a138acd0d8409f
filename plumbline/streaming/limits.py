"""Token-bucket limits on a stream, with state that leaves when it says nothing any more.

Each key's state is one number, the time at which its bucket is full again. An event-time timer at that time removes it:
a full bucket is what a key without state has, so nothing is forgotten. State and timers live in RocksDB.

A key's calls of a micro-batch arrive one by one, in no order. A handful is sorted in memory. The calls of a busy key
become sorted runs that go to the state store in small blocks. As many runs as are merged at a time become one longer run, and
the last ones are merged block by block. So the calls are walked in time order, while memory holds one run that is being sorted,
or one block of each of a few runs. Answers leave in frames of one run: Spark's form for single rows would hold all answers of a key.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    BinaryType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

from plumbline.operators.profile import quoted
from plumbline.operators.replay import TokenBucket
from plumbline.session import rocksdb_state

#: Calls of one run that is sorted in memory, and of one of its blocks in the state store.
RUN, BLOCK = 10_000, 500
#: Runs that are merged at a time.
MERGED = 64
#: The columns that the stream gets for the walk, last of all.
ADDED = ("__micros", "__tie")


class BucketLimit(StatefulProcessor):
    """Walks each key's calls through its bucket. A call's last columns are its time in microseconds, its tie and, with
    ``timers``, its watermark column."""

    def __init__(self, bucket: TokenBucket, columns: Sequence[str], timers: bool, run: int = RUN, block: int = BLOCK) -> None:
        self.bucket, self.timers, self.run, self.block = bucket, timers, run, block
        self.width = len(columns)
        self.answer = Row(*columns, "allowed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.full_at = handle.getValueState("full_at", "full_at long")
        self.blocks = handle.getMapState("blocks", "run int, block int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for values in self._walked(rows):
            yield self.answer(*values)

    def _walked(self, rows: Iterator[Sequence]) -> Iterator[tuple]:
        """The calls in order, each with its answer."""
        held = self.full_at.get()
        state = before = self.bucket.FULL if held is None else held[0]
        calls = ([self._order(row), tuple(row[: self.width])] for row in rows)
        ordered = self._run(calls)
        second = self._run(calls)
        if second:
            self.spooled, levels = 0, [[]]
            self._add(levels, ordered)
            self._add(levels, second)
            del ordered, second
            while more := self._run(calls):
                self._add(levels, more)
            ordered = self._merged([run for level in levels for run in level])
        for (timed, micros, *_), values in ordered:
            passed = None
            if timed:
                state, (passed,) = self.bucket(state, micros)
            yield (*values, passed)
        if state != before:
            self._remember(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.full_at.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _order(self, row: Row) -> tuple:
        """Calls without a time first, then by time and tie, a null tie before others."""
        micros, tie = row[self.width], row[self.width + 1]
        return micros is not None, 0 if micros is None else micros, tie is not None, tie

    def _run(self, calls: Iterator[list]) -> list[list]:
        return sorted(islice(calls, self.run), key=lambda call: call[0])

    def _remember(self, state: int) -> None:
        self.full_at.update((state,))
        if self.timers:
            # One timer a key: an earlier one would find the bucket not yet full.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-state // (self.bucket.scale * 1_000)))

    @staticmethod
    def _merged(runs: list[Iterator[list]]) -> Iterator[list]:
        return heapq.merge(*runs, key=lambda call: call[0])

    def _add(self, levels: list[list[Iterator[list]]], run: Iterable[list], at: int = 0) -> None:
        """A run joins its level; a full level becomes one run of the next, so a call is written once per level."""
        levels[at].append(self._spooled(run))
        if len(levels[at]) == MERGED:
            merged, levels[at] = self._merged(levels[at]), []
            if at + 1 == len(levels):
                levels.append([])
            self._add(levels, merged, at + 1)

    def _spooled(self, run: Iterable[list]) -> Iterator[list]:
        """A sorted run, put into the state store now and taken out again block by block."""
        number, blocks, calls = self.spooled, 0, iter(run)
        self.spooled += 1
        while block := list(islice(calls, self.block)):
            self.blocks.updateValue((number, blocks), (pickle.dumps(block),))
            blocks += 1
        return self._taken(number, blocks)

    def _taken(self, number: int, blocks: int) -> Iterator[list]:
        for at in range(blocks):
            block = pickle.loads(self.blocks.getValue((number, at))[0])
            self.blocks.removeKey((number, at))
            yield from block


class FramedBucketLimit(BucketLimit):
    """The same on frames, whose answers leave while a key is walked."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*self.answer]
        calls = (call for frame in rows for call in zip(*(frame[c].tolist() for c in frame.columns)))
        answers = self._walked(calls)
        while part := list(islice(answers, self.run)):
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(names, zip(*part))})

    def _order(self, row: Sequence) -> tuple:
        timed, micros, *tie = super()._order(row)
        return timed, int(micros), *tie


def _carried(field: StructField) -> tuple[Column, Column] | None:
    """How a column travels through frames and back without any loss, most as text; None where it does not. Frames hold whole numbers
    beside nulls as doubles, times as nanoseconds, and tell no null from NaN."""
    column, kind = quoted(field.name), field.dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("string"), F.timestamp_micros(column.cast("long"))
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("string"), F.date_from_unix_date(column.cast("int"))
    if isinstance(kind, (IntegralType, BooleanType, DoubleType, FloatType, TimestampNTZType)):
        return column.cast("string"), column.cast(kind)
    if isinstance(kind, (StringType, BinaryType, DecimalType)):
        return column, column
    return None


def _ordered(field: StructField) -> Column | None:
    """A tie that frames hold as it is; None where there is none."""
    column, kind = quoted(field.name), field.dataType
    if isinstance(kind, (StringType, BinaryType, DecimalType)):
        return column
    if isinstance(kind, TimestampType):
        column = F.unix_micros(column)
    elif isinstance(kind, DateType):
        column = F.unix_date(column)
    elif isinstance(kind, BooleanType):
        column = column.cast("int")
    return column.cast("decimal(20,0)") if isinstance(kind, (IntegralType, TimestampType, DateType, BooleanType)) else None


def rate_limit_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, tie: str, per_minute: int = 60, late: str | None = "1 hour",
    run: int = RUN, block: int = BLOCK,
) -> DataFrame:
    """Adds ``allowed`` per call from a token bucket per key.

    The calls of a micro-batch are taken in time order, ties by ``tie``; on input in time order the result equals the batch
    replay, however it is cut into batches. With ``late`` the state of a key goes when the watermark, that far
    behind the newest call, has passed the time at which its bucket is full; calls behind the watermark are dropped, as on any
    watermarked stream. ``late=None`` drops none and keeps one number per key for good. A call without a time gets
    null and takes no token. ``run`` and ``block`` bound the calls of one key in memory, not the result.
    """
    rocksdb_state(stream.sparkSession)
    schema = StructType([*stream.schema.fields]).add("allowed", "boolean")
    time = F.col(ts).cast("timestamp")
    carried = [_carried(field) for field in stream.schema.fields]
    # Nested columns go row by row, and so do the keys and ties that change their equality or order on the way.
    order = _ordered(stream.schema[tie])
    framed = order is not None and None not in carried and not any(isinstance(stream.schema[k].dataType, (DoubleType, FloatType)) for k in keys)
    columns, micros = ["*"], F.unix_micros(time)
    if framed:
        columns, micros = [there.alias(c) for (there, _), c in zip(carried, stream.columns)], micros.cast("string")
    else:
        order = quoted(tie)
    # A frame's times end in 2262; only the watermark reads this one.
    bounds = [F.lit(f"{year}-01-01 00:00:00").cast("timestamp") for year in (1700, 2260)]
    seen = F.when(time < bounds[0], bounds[0]).when(time > bounds[1], bounds[1]).otherwise(time) if framed else time
    timed = stream.select(*columns, micros.alias(ADDED[0]), order.alias(ADDED[1]), seen.alias("__time"))
    if late is None:
        timed = timed.drop("__time")
    else:
        timed = timed.withWatermark("__time", late)
    mode = "none" if late is None else "eventtime"
    grouped = timed.groupBy(*[quoted(k) for k in keys])
    bucket = TokenBucket(per_minute)
    if not framed:
        return grouped.transformWithState(BucketLimit(bucket, stream.columns, late is not None, run, block), schema, "append", mode)
    passed = StructType([*timed.schema.fields[: len(carried)]]).add("allowed", "boolean")
    found = grouped.transformWithStateInPandas(FramedBucketLimit(bucket, stream.columns, late is not None, run, block), passed, "append", mode)
    return found.select(*[back.alias(c) for (_, back), c in zip(carried, stream.columns)], "allowed")
