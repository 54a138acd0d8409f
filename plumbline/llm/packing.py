"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, ranges, starts_of
from plumbline.llm.tokens import crc_of, encoder, text_slices

#: Pieces packed together by one task: enough that its last, half-filled bin does not count.
PIECES_PER_SHARD = 8_192


class _Stock:
    """Pieces not yet packed, by length. A big integer holds one bit for each length in stock."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(lengths, kind="stable")[::-1]
        self.rows: dict[int, list[int]] = {}
        for row in order.tolist():
            self.rows.setdefault(int(lengths[row]), []).append(row)
        self.bits = 0
        self.masks = [(2 << most) - 1 for most in range(int(lengths.max(initial=0)) + 1)]
        for length in self.rows:
            self.bits |= 1 << length

    def largest(self, most: int) -> int:
        """The largest length in stock up to ``most``; 0 if none."""
        if most <= 0:
            return 0
        return max(0, ((self.bits & self.masks[most]) if most < len(self.masks) else self.bits).bit_length() - 1)

    def take(self, length: int) -> int:
        rows = self.rows[length]
        row = rows.pop()
        if not rows:
            self.bits &= ~(1 << length)
        return row

    def put(self, length: int, row: int) -> None:
        self.rows[length].append(row)
        self.bits |= 1 << length

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two lengths in stock with the largest sum up to ``room`` and over ``above``; None if there are none."""
        best, found = above, None
        a = self.largest(room - 1)
        while a and 2 * a > best:
            b = self.largest(min(a, room - a))
            if b == a and len(self.rows[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece (1 to ``capacity`` long).

    A bin is filled greedily with the largest piece that fits. If a gap stays, its smallest piece goes back when two
    pieces in stock fill the room of piece and gap more tightly.
    """
    stock = _Stock(lengths)
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while stock.bits:
        room, rows = capacity, []
        while length := stock.largest(room):
            rows.append((length, stock.take(length)))
            room -= length
        if room and len(rows) > 1:
            length, row = rows[-1]
            if pair := stock.best_two(room + length, length):
                rows.pop()
                rows += [(x, stock.take(x)) for x in pair]
                stock.put(length, row)
        at = 0
        for length, row in rows:
            bins[row], places[row] = number, at
            at += length
        number += 1
    return bins, places


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, longer ones cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in text_slices(batches):
            ids, counts = encode.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            pieces = -(-counts // capacity)
            number = ranges(np.zeros(len(pieces), np.int64), pieces)
            begin = number * capacity
            size = np.minimum(capacity, np.repeat(counts, pieces) - begin)
            offsets = np.append(np.repeat(starts_of(counts), pieces) + begin, len(ids))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), pieces)))
            crc = pa.array(crc_of(ids, offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(number.astype(np.int32)), pa.array(begin), pa.array(size), crc], ["k", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")
    return found.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every document.

    Only small rows move: texts are encoded where they are read, and the cut pieces are written once. Pieces are dealt
    in turn to shards of about ``PIECES_PER_SHARD``; each shard is packed on its own. A null or empty text is a document of its end id; repeated rows are documents of
    their own; an empty table gives an empty result.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces")
    shards = max(1, -(-pieces.count() // PIECES_PER_SHARD))
    # Round robin within each part of the written table, each part beginning elsewhere: shards of one size, repeats spread.
    place = F.monotonically_increasing_id()
    turn = F.shiftright(place, 33) + place.bitwiseAND(F.lit((1 << 33) - 1))
    dealt = pieces.withColumn("shard", F.pmod(turn, F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, places = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["shard"].astype("int64") * (1 << 40) + bins, offset=places).drop(columns="shard")

    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
