"""Sequential decisions per key, replayed in parallel.

Rate limits, concurrency gates and hash chains carry state from one row of a key to the next. The rows are cut into
ordered chunks (``ordered_chunks``), so a hot key spans many tasks. Each chunk is walked by one task that streams
Arrow batches and holds only the state. What crosses a chunk boundary is settled first, from one summary row per chunk:

* a token bucket has a compact transfer function, so two passes are always enough;
* a concurrency gate forgets everything at an idle instant, when all earlier calls of its key have ended, admitted or
  not. A chunk with such an instant hands on a state that no earlier chunk can change, so two passes are enough where a
  log has gaps; only a stretch without any over a whole chunk is replayed from guessed states, until no guess is wrong;
* a hash chain has neither, so the chunks of one chain run in turn, different chains side by side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators.ordered import CHUNK, ordered_chunks
from plumbline.operators.profile import quoted

KEY = "__key"
#: ``latest`` is the latest end of the calls of the last key, ``quiet`` the last start that none of its calls in the chunk reaches.
SUMMARY = "chunk int, first_key string, last_key string, first_end string, last_end string, quiet long, latest long"

Advance = Callable[..., tuple[object, tuple]]


def keyed_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Ordered chunks by one text key (injective over several columns, null included)."""
    keyed = df.withColumn(KEY, F.to_json(F.struct(*[quoted(k) for k in keys])))
    return ordered_chunks(keyed, [KEY], order, partitions, prepare)


def summarise(
    batches: Iterator[pa.RecordBatch], inputs: Sequence[str], advance: Advance, fresh, starts: dict[int, object]
) -> Iterator[pa.RecordBatch]:
    """One row for the chunk: its outer keys, and the states after its first and its last key."""
    chunk = first_key = key = state = first_end = None
    for chunk, this, *values in _rows(batches, inputs):
        if this != key:
            if key is None:
                first_key, state = this, starts.get(chunk, fresh)
            else:
                first_end = state if first_end is None else first_end
                state = fresh
            key = this
        state, _ = advance(state, *values)
    if key is not None:
        yield _summary(chunk, first_key, key, state if first_end is None else first_end, state)


def _emit(
    batches: Iterator[pa.RecordBatch],
    inputs: Sequence[str],
    outputs: StructType,
    advance: Advance,
    fresh,
    starts: dict[int, object],
) -> Iterator[pa.RecordBatch]:
    """The rows of the chunk with the outputs of ``advance``; all other columns pass as they are."""
    added = to_arrow_schema(outputs)
    key = state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        results = []
        chunk = batch.column(CHUNK)[0].as_py()
        for this, *values in zip(batch.column(KEY).to_pylist(), *(batch.column(c).to_pylist() for c in inputs), strict=True):
            if this != key:
                state = starts.get(chunk, fresh) if key is None else fresh
                key = this
            state, result = advance(state, *values)
            results.append(result)
        columns = [pa.array(list(values), field.type) for values, field in zip(zip(*results, strict=True), added, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added.names])


def replay(
    chunks: DataFrame, inputs: Sequence[str], outputs: str, advance: Advance, fresh, starts: dict[int, object]
) -> DataFrame:
    """All rows with the output columns (a DDL string), every chunk starting from its settled state."""
    added = StructType.fromDDL(outputs)
    schema = StructType([*chunks.schema.fields, *added.fields])
    walk = partial(_emit, inputs=list(inputs), outputs=added, advance=advance, fresh=fresh, starts=starts)
    return chunks.mapInArrow(walk, schema).drop(KEY, CHUNK)


def _summaries(chunks: DataFrame, inputs: Sequence[str], walk) -> dict[int, dict]:
    """One row per chunk on the driver: as many rows as the job has partitions."""
    rows = chunks.select(CHUNK, KEY, *inputs).mapInArrow(walk, SUMMARY).collect()
    return {
        r["chunk"]: {
            "first": r["first_key"], "last": r["last_key"], "first_end": json.loads(r["first_end"]), "last_end": json.loads(r["last_end"]),
            "quiet": r["quiet"], "latest": r["latest"],
        }
        for r in rows
    }


def _summary(chunk: int, first_key: str, last_key: str, first_end, last_end, quiet: int | None = None, latest: int | None = None) -> pa.RecordBatch:
    numbers = [(name, pa.array([value], pa.int64())) for name, value in (("quiet", quiet), ("latest", latest))]
    texts = [("first_key", first_key), ("last_key", last_key), ("first_end", json.dumps(first_end)), ("last_end", json.dumps(last_end))]
    columns = [("chunk", pa.array([chunk], pa.int32())), *[(name, pa.array([value], pa.string())) for name, value in texts], *numbers]
    return pa.RecordBatch.from_arrays([column for _, column in columns], [name for name, _ in columns])


def _rows(batches: Iterator[pa.RecordBatch], inputs: Sequence[str]) -> Iterator[tuple]:
    """(chunk, key, inputs ...) of each row."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in (CHUNK, KEY, *inputs)), strict=True)


def _continued(found: dict[int, dict]) -> list[tuple[int, int]]:
    """(earlier chunk, chunk) wherever a key goes on from one chunk to the next."""
    order = sorted(found)
    return [(a, b) for a, b in zip(order, order[1:], strict=False) if found[a]["last"] == found[b]["first"]]


def _rejoined(found: dict[int, dict], links: list[tuple[int, int]]) -> set[int]:
    """Chunks whose last state does not depend on their start: an idle instant of theirs lies behind all earlier ends."""
    before: dict[int, int] = {}
    for a, b in links:
        row = found[a]
        one_key = row["first"] == row["last"]
        ends = [e for e in (row["latest"], before.get(a) if one_key else None) if e is not None]
        if ends:
            before[b] = max(ends)
    return {chunk for chunk, row in found.items() if row["quiet"] is not None and row["quiet"] >= before.get(chunk, row["quiet"])}


def settle(
    chunks: DataFrame, inputs: Sequence[str], summarise: Callable, fresh, speculate: bool, rejoined: Callable | None = None
) -> dict[int, object]:
    """Start state of every chunk that continues a key.

    All chunks are summarised once from a fresh state. Then chunks are summarised again where the state handed over
    differs from the one they were started with, until none does. With ``speculate`` a chunk may start from a state
    that is itself still a guess; without, it waits until its predecessor is final. ``rejoined`` names chunks that
    need no second summary. Either way the result is exact.
    """
    walk = partial(summarise, inputs=list(inputs), fresh=fresh)
    found = _summaries(chunks, inputs, partial(walk, starts={}))
    links = _continued(found)
    settled = rejoined(found, links) if rejoined else set()
    waiting = {b for _, b in links}
    starts: dict[int, object] = {}

    def one_key(chunk: int) -> bool:
        return found[chunk]["first"] == found[chunk]["last"]

    def handed_over(chunk: int):
        return found[chunk]["first_end" if one_key(chunk) else "last_end"]

    while True:
        ready = {
            b: handed_over(a)
            for a, b in links
            if (speculate or a not in waiting or not one_key(a)) and starts.get(b, fresh) != handed_over(a)
        }
        if not ready:
            return starts
        starts.update(ready)
        # Only a chunk that is one run of its key passes the new state on.
        rerun = {chunk: state for chunk, state in ready.items() if one_key(chunk) and chunk not in settled}
        if rerun:
            again = chunks.where(F.col(CHUNK).isin(sorted(rerun)))
            found.update(_summaries(again, inputs, partial(walk, starts=rerun)))
        waiting -= set(ready)


def _narrow(df: DataFrame, needed: Sequence[str], keep: Sequence[str] | None) -> DataFrame:
    """Only the needed columns and those to keep; ``None`` keeps all."""
    return df if keep is None else df.select(*dict.fromkeys([*needed, *keep]))


# -- token bucket -----------------------------------------------------------------------------------------------


class TokenBucket:
    """A bucket of ``per_minute`` tokens, refilled evenly, in exact integer arithmetic.

    The state is one number: the time at which the bucket would be full again. Times are scaled so that one token is
    ``token`` units and one microsecond is ``scale`` units.
    """

    FULL = -(2**62)

    def __init__(self, per_minute: int) -> None:
        common = math.gcd(60_000_000, per_minute)
        self.scale = per_minute // common
        self.token = 60_000_000 // common
        self.slack = (per_minute - 1) * self.token

    def __call__(self, full_at: int, micros: int | None) -> tuple[int, tuple]:
        if micros is None:
            return full_at, (None,)
        now = micros * self.scale
        if full_at <= now + self.slack:
            return (full_at if full_at > now else now) + self.token, (True,)
        return full_at, (False,)

    def spread(self, pieces: list[tuple], now: int) -> list[tuple]:
        """Advance a function of the unknown start state by one call.

        Pieces are ``(low, high, fixed, value)``: for starts in (low, high] the state is ``value`` if fixed, else
        start + value. Up to ``now`` the bucket is full, up to ``now + slack`` a token is left, above it none.
        """
        out: list[tuple] = []

        def put(low: int, high: int, fixed: bool, value: int) -> None:
            if low < high:
                if out and out[-1][1] == low and out[-1][2:] == (fixed, value):
                    out[-1] = (out[-1][0], high, fixed, value)
                else:
                    out.append((low, high, fixed, value))

        for low, high, fixed, value in pieces:
            if fixed:
                after = value
                if value <= now + self.slack:
                    after = max(value, now) + self.token
                put(low, high, True, after)
            else:
                full, some = now - value, now + self.slack - value
                put(low, min(high, full), True, now + self.token)
                put(max(low, full), min(high, some), False, value + self.token)
                put(max(low, some), high, False, value)
        return out

    @staticmethod
    def apply(stages: list, start: int) -> int:
        """End state from a start state: the stages of the summarised function, one after the other."""
        for pieces in stages:
            for low, high, fixed, value in pieces:
                if low < start <= high:
                    start = value if fixed else start + value
                    break
            else:
                raise ValueError("start state outside of the summarised range")
        return start


def _image(pieces: list[tuple]) -> tuple[int, int]:
    """Smallest interval (low, high] that holds all values of a piecewise function."""
    low = min(value - 1 if fixed else low + value for low, _, fixed, value in pieces)
    return low, max(value if fixed else high + value for _, high, fixed, value in pieces)


def _bucket_summary(batches: Iterator[pa.RecordBatch], bucket: TokenBucket) -> Iterator[pa.RecordBatch]:
    """Chunk summary whose ``first_end`` is the first key's end state as a function of its start state.

    Refused and capped calls make start states meet, so the values soon lie close together. Whenever their interval
    has shrunk by a tenth, the function so far is put aside as a finished stage and a new one starts on that interval.
    That keeps every function short, and the stages of a chunk are few: their number grows with the logarithm of the
    bucket size, not with the calls.
    """
    chunk = first_key = key = pieces = None
    stages: list[list[tuple]] = []
    width = bucket.slack + bucket.token
    lowest = state = bucket.FULL
    for chunk, this, micros in _rows(batches, ["__micros"]):
        if key is None:
            first_key = this
        elif this != key:
            state = bucket.FULL
        key = this
        if micros is None:
            continue
        now = micros * bucket.scale
        if key != first_key:
            state, _ = bucket(state, micros)
            continue
        if pieces is None:
            # An earlier call leaves the bucket full again at most a whole bucket after it.
            pieces = [(bucket.FULL - 1, now + bucket.slack + bucket.token, False, 0)]
        if now + bucket.slack >= lowest:
            pieces = bucket.spread(pieces, now)
            low, high = _image(pieces)
            if len(pieces) > 4 and high - low <= 0.9 * width:
                stages.append(pieces)
                pieces, width = [(low, high, False, 0)], high - low
            lowest = low + 1
    if key is not None:
        yield _summary(chunk, first_key, key, stages if pieces is None else [*stages, pieces], state)


def rate_limit_replay(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, per_minute: int = 60, partitions: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``allowed``: whether a token bucket per key, full at the start, lets the call through.

    ``tie`` is a unique column that orders calls of the same instant. ``keep`` names the other columns to carry along
    (all by default); on wide logs carry none and join back by ``tie``. A call without a time gets null and takes no token.
    """
    bucket = TokenBucket(per_minute)
    timed = _narrow(events, [*keys, ts, tie], keep).withColumn("__micros", F.unix_micros(F.col(ts).cast("timestamp")))
    chunks = keyed_chunks(timed, keys, ["__micros", tie], partitions)
    found = _summaries(chunks, ["__micros"], partial(_bucket_summary, bucket=bucket))
    starts: dict[int, int] = {}
    for a, b in _continued(found):
        row = found[a]
        if row["first"] == row["last"]:
            starts[b] = TokenBucket.apply(row["first_end"], starts.get(a, bucket.FULL))
        else:
            starts[b] = row["last_end"]
    return replay(chunks, ["__micros"], "allowed boolean", bucket, bucket.FULL, starts).drop("__micros")


# -- concurrency gate -------------------------------------------------------------------------------------------


def _gate(ends: list[int], start: int | None, end: int | None, cap: int) -> tuple[list[int], tuple]:
    if start is None or end is None:
        return ends, (None,)
    running = [e for e in ends if e > start]
    if len(running) >= cap:
        return running, (False,)
    return sorted([*running, end]), (True,)


def _gate_summary(
    batches: Iterator[pa.RecordBatch], inputs: Sequence[str], fresh: list[int], starts: dict[int, list[int]], cap: int
) -> Iterator[pa.RecordBatch]:
    """The chunk's summary with the idle instants of its last key, over all calls, admitted or not."""
    chunk = first_key = key = state = first_end = quiet = latest = None
    for chunk, this, start, end in _rows(batches, inputs):
        if this != key:
            if key is None:
                first_key, state = this, starts.get(chunk, fresh)
            else:
                first_end = state if first_end is None else first_end
                state, quiet, latest = fresh, None, None
            key = this
        state, _ = _gate(state, start, end, cap)
        if start is not None and end is not None:
            if latest is None or start >= latest:
                quiet = start
            latest = end if latest is None else max(latest, end)
    if key is not None:
        yield _summary(chunk, first_key, key, state if first_end is None else first_end, state, quiet, latest)


def concurrency_replay(
    log: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, cap: int = 4, partitions: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``admitted``: a call is refused when ``cap`` admitted calls of its key still run; refused calls occupy nothing.

    Calls that have ended at a start no longer run. The number of jobs is fixed if every chunk of a key that spans several
    has an instant at which nothing runs. A call without a start or an end gets null and occupies nothing.
    """
    timed = _narrow(log, [*keys, start, end, tie], keep).withColumn("__start", F.unix_micros(F.col(start).cast("timestamp"))).withColumn(
        "__end", F.unix_micros(F.col(end).cast("timestamp"))
    )
    chunks = keyed_chunks(timed, keys, ["__start", tie], partitions)
    starts = settle(chunks, ["__start", "__end"], partial(_gate_summary, cap=cap), [], speculate=True, rejoined=_rejoined)
    return replay(chunks, ["__start", "__end"], "admitted boolean", partial(_gate, cap=cap), [], starts).drop("__start", "__end")
