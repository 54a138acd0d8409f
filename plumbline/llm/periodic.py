"""Periodic runs of words: scale-tiled search, boundary Z-functions, stitched intervals.

A run of period q is a maximal interval of places i with word i = word i + q, and q words more. For the octave of periods
P <= q < 2 P a document is cut into tiles so short that every run long enough fills a whole tile. A tile that some q
of its octave may fill (tested by window hashes, which can only err towards yes) becomes a row with the words around
it. Tiles are dealt over the cluster by document, octave and place, so the tiles of one long document are solved side by
side: the Z-function at a tile's first boundary gives, for every q, how far it matches to the right, the Z-function of the
reversed words how far to the left. Fragments are shuffled by document and period, and those that touch are stitched.

If the first q words of a run are a power of a shorter block, the whole run has that block's period; such a q is left out in
each tile, so what is stitched has its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Consecutive tiles of one octave share a row up to so many words.
ROW_WORDS = 2_048
#: Words whose windows are tested at a time, and tiles times periods.
SLICE_WORDS, SLICE_CELLS = 1_000_000, 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

TABLE = "row long, id long, digest string, text string, octave int, start long, tile long, stop long, words array<int>"


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """A tenth of all documents, by their key, with a periodic end."""
    n, h = len(words), 1 if key is None else zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def tile_words(octave: int) -> int:
    """Words of a tile: an interval of max(6 - q, 3 q) matches, q in the octave, holds a whole tile at any place."""
    return 3 * octave // 2 if octave > 1 else 3


def octaves(n: int) -> Iterator[int]:
    """The octaves whose runs fit into n words."""
    octave = 1
    while n >= max(LEAST_WORDS, LEAST_PERIODS * octave):
        yield octave
        octave *= 2


def candidate_tiles(hashes: np.ndarray) -> dict[int, np.ndarray]:
    """For each octave, the tiles that repeat after some period of it, by the hashes of the words.

    Window hashes are polynomials modulo 2^64: equal windows have equal hashes, so no tile is lost.
    """
    n = len(hashes)
    found = {}
    if n < LEAST_WORDS:
        return found
    powers = np.multiply.accumulate(np.full(n, _BASE))
    inverses = np.multiply.accumulate(np.full(n, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    for octave in octaves(n):
        size = tile_words(octave)
        windows = (sums[size:] - sums[:-size]) * inverses[: n - size + 1]
        # Behind the last window stand values that match nothing by more than chance.
        tiles = windows[: len(windows) - octave : size]
        later = np.lib.stride_tricks.sliding_window_view(np.append(windows[octave:], np.zeros(octave, np.uint64)), octave)[::size][: len(tiles)]
        step = max(1, SLICE_CELLS // octave)
        hit = np.concatenate([(later[k : k + step] == tiles[k : k + step, None]).any(axis=1) for k in range(0, len(tiles), step)])
        if hit.any():
            found[octave] = np.nonzero(hit)[0]
    return found


def sections(octave: int, tiles: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first word, first tile's word, end of the last tile, end of the words) of rows that hold consecutive tiles and the words around them."""
    size = tile_words(octave)
    most = max(1, ROW_WORDS // size)
    cuts = np.nonzero(np.diff(tiles) != 1)[0] + 1
    for group in np.split(tiles, cuts):
        for k in range(0, len(group), most):
            first, last = int(group[k]) * size, int(group[min(k + most, len(group)) - 1] + 1) * size
            yield max(0, first - size), first, last, min(n, last + size + 2 * octave)


def z_function(x: list[int]) -> list[int]:
    """For each place, how long the words from there agree with the beginning."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def solve_tile(x: list[int], c: int, octave: int) -> Iterator[tuple[int, int, int]]:
    """(q, begin, end): the matches of each smallest period q of the octave that fills the tile at c, as far as a tile on both sides."""
    size = tile_words(octave)
    right = x[c : c + 2 * size + 2 * octave]
    z = z_function(right)
    left = None
    for q in range(octave, min(2 * octave, len(right))):
        if z[q] < size:
            continue
        # A block of q words that is a power of p words has the period p, a divisor of q.
        if any(q % p == 0 and z[p] >= q - p for p in range(1, q // 2 + 1)):
            continue
        if left is None:
            before, end = x[max(0, c - size) : c], min(len(x), c + 2 * octave)
            left = z_function([*reversed(before), -1, *reversed(x[max(0, c - size) : end])])
        back = left[len(before) + 1 + end - c - q]
        yield q, c - back, c + z[q]


def merged(fragments: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Intervals with those that touch made one."""
    fragments.sort()
    begin, end = fragments[0]
    for b, e in fragments[1:]:
        if b > end:
            yield begin, end
            begin, end = b, e
        end = max(end, e)
    yield begin, end


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``TABLE``: one per document (its text only if it has candidate tiles), and one per row of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("digest", pa.string()), ("text", pa.string()), ("octave", pa.int32()),
                            ("start", pa.int64()), ("tile", pa.int64()), ("stop", pa.int64()), ("words", pa.list_(pa.int32()))])
        for batch in batches:
            out, held = [], 0
            for row, key_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = planted((value.as_py() or b"").split(), key_)
                joined = b" ".join(words)
                tiles = candidate_tiles(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
                shown = joined.decode() if tiles else None
                out.append((row, key_, hashlib.sha256(joined).hexdigest(), shown, None, None, None, None, None))
                if not tiles:
                    continue
                held += len(words)
                known: dict[bytes, int] = {}
                numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
                for octave, at in tiles.items():
                    for begin, first, last, end in sections(octave, at, len(words)):
                        out.append((row, None, None, None, octave, begin, first, last, numbers[begin:end]))
                        held += end - begin
                        if held > SLICE_WORDS:
                            yield _batch(out, schema)
                            out, held = [], 0
            if out:
                yield _batch(out, schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, TABLE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


def fragments(tiles: DataFrame) -> DataFrame:
    """``(row, period, begin, end)``: the matches that the tiles of each row show, every row solved on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row, octave, start, first, last, words in zip(*(batch.column(k) for k in range(6))):
                row, octave, start = row.as_py(), octave.as_py(), start.as_py()
                x, periods = words.as_py(), {}
                for c in range(first.as_py(), last.as_py(), tile_words(octave)):
                    for q, begin, end in solve_tile(x, c - start, octave):
                        periods.setdefault(q, []).append((begin, end))
                out += [(row, q, start + b, start + e) for q, found in periods.items() for b, e in merged(found)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "period", "begin", "end"])

    dealt = tiles.select("row", "octave", "start", "tile", "stop", "words").repartition("row", "octave", "tile")
    return dealt.mapInArrow(run, "row long, period long, begin long, end long")


def stitched(found: DataFrame) -> DataFrame:
    """``(row, start, length, period)`` of every run, from the fragments of each document and period."""
    order = W.partitionBy("row", "period").orderBy("begin")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("begin") > reached).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = islands.groupBy("row", "period", "island").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    runs = runs.select("row", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))


def kept_words(words: list[str], runs: list[dict]) -> list[str]:
    """The words that no run contains behind its first period."""
    out, at = [], 0
    for begin, end in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
        out += words[at:begin]
        at = max(at, end)
    return out + words[at:]


RESULT = ("n_runs", "start", "length", "period", "exponent_milli")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its runs, the longest of them, and the digests of the runs and of the collapsed text.

    ``runs`` holds all runs (start, length, period), by start, then period. A null or empty text has no words and no
    run. A row without a key gets no planted end. Repeated rows each get a row; an empty table gives an empty
    result.
    """
    table = materialise(_documents(docs, key, text), "tiles")
    runs = stitched(fragments(table.where("octave IS NOT NULL")))
    # As many runs as a text has words at most, in the row that holds the text.
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = table.where("octave IS NULL").select("row", "id", "digest", "text").join(runs, "row", "left")
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key_, plain, shown, runs_ in zip(*(batch.column(k) for k in range(4))):
                found = runs_.as_py()
                if not found:
                    out.append((key_.as_py(), [], 0, None, None, None, None, none, plain.as_py()))
                    continue
                longest = min(found, key=lambda r: (-r["length"], r["start"], r["period"]))
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
                rest = " ".join(kept_words(shown.as_py().split(" "), found))
                digests = [hashlib.sha256(s.encode()).hexdigest() for s in (listed, rest)]
                out.append((key_.as_py(), found, len(found), longest["start"], longest["length"], longest["period"], 1000 * longest["length"] // longest["period"], *digests))
            kinds = [pa.int64(), RUNS, *[pa.int64()] * 5, pa.string(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "runs", *RESULT, "runs_sha256", "collapsed_sha256"])

    shape = "id long, runs array<struct<start:long,period:long,length:long>>, " + ", ".join(f"{c} long" for c in RESULT) + ", runs_sha256 string, collapsed_sha256 string"
    found = rows.select("id", "digest", "text", "runs").mapInArrow(run, shape)
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), *RESULT, "runs_sha256", "collapsed_sha256", "runs")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))
