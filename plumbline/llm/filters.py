"""How five filters interact: what each removes, and wastes, at every place of every order.

A document's failures are a bit mask. Over masks and orders the removal step is a min-plus product: the least, over the
filters of the mask, of the filter's position in the order. Documents are counted by part and mask on Spark, 32 rows a
part at most; the removal steps then scatter those counts, weighted by all, good and toxic documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Partitions over which rows without a key are spread in the join with the labels.
SALTS = 64

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"
_DUPLICATE = 1 << FILTERS.index("E")


def text_failures(raw: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits."""
    words = raw.split()
    points, capitals = len(raw.translate(None, _CONTINUED)), len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw.translate(None, _SYMBOLS)) < len(raw)
    failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * points, symbols)
    return sum(bit << k for k, bit in enumerate(failed))


def measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``(id, part, mask, digest)`` of every row: the filters that its text fails, and the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2).cast(pa.binary()):
                raw = value.as_py() or b""
                masks.append(text_failures(raw))
                digests.append(hashlib.sha256(raw).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "mask", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, part string, mask int, digest binary")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)`` of the measured rows, filter E included.

    Copies are counted per text before the smallest key of a text is looked up, so a text that fills a third of the
    table is a few rows by then. Rows of the smallest key are originals, however often they are repeated. ``labels`` is
    ``(id, good, toxic)``, one row a key; a row without a key has no label, is no copy, and makes no copies.
    """
    salt = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    marked = rows.withColumn("salt", salt).join(labels.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["digest", "mask", "part", "good", "toxic"]
    keyed = marked.groupBy(*kinds, "id").agg(F.count("*").alias("n"))
    each = keyed.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"))
    original = F.when(F.col("low") == F.min("low").over(W.partitionBy("digest")), F.col("at_low")).otherwise(0) + F.col("unkeyed")
    split = each.withColumn("first", F.coalesce(original, F.lit(0)))
    copies = F.struct(F.col("mask").bitwiseOR(F.lit(_DUPLICATE)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
    split = split.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("first").alias("n")), copies)))

    def weight(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight(F.col("good")).alias("good"), weight(F.col("toxic")).alias("toxic"))


def removal_ranks(filters: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders, the masks as a matrix, and for each (mask, order) the step that removes it (one beyond the last: none).

    The last is the min-plus product of the masks' costs (0 where a filter fails, else beyond every step) and the
    positions of the filters, the inverse of each order.
    """
    orders = np.array(list(permutations(range(filters))))
    positions = np.argsort(orders, axis=1) + 1
    masks = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    costs = np.where(masks == 1, 0, filters + 1)
    ranks = np.minimum((costs[:, None, :] + positions[None, :, :]).min(axis=2), filters + 1)
    return orders, masks, ranks


def interactions(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Every count by (order, step), from one part's documents by mask."""
    orders, masks, ranks = removal_ranks()
    steps = orders.shape[1]

    def scattered(weights: np.ndarray) -> np.ndarray:
        found = np.zeros((len(orders), steps + 2), np.int64)
        np.add.at(found, (np.arange(len(orders))[None, :], ranks), weights[:, None])
        return found[:, 1 : steps + 1]

    removed = scattered(counts)
    failing = counts @ masks
    shapley = np.zeros(steps, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "kept": counts.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": failing[orders] - removed,
        "unique_fails": counts[1 << orders], "good_lost": scattered(good), "toxic_lost": scattered(toxic), "shapley": shapley[orders],
    }


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order and step of the five filters, with what happens there.

    A null text is the empty text, a null part the empty part. Every row of ``docs`` counts as a document of its own; repeated
    rows of one key are no copies of each other. A key's label is 1 if any of its label rows is. An empty
    table gives no rows.
    """
    marks = labels.select(F.col(key).cast("long").alias("id"), *[F.col(c).eqNullSafe(F.lit(1)).alias(c) for c in ("quality", "toxic")])
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    totals = mask_counts(measured(docs, key, text, part), marks)
    # 32 rows at most for each part.
    parts = totals.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))
    names = ["".join(FILTERS[f] for f in order) for order in removal_ranks()[0]]
    steps = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                weights = np.zeros((3, 1 << steps), np.int64)
                for entry in row["rows"]:
                    weights[:, entry["mask"]] = entry["n"], entry["good"], entry["toxic"]
                found = interactions(*weights)
                columns = [pa.array([row["part"]] * (steps * len(names))), pa.array([name for name in names for _ in range(steps)]),
                           pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
                columns += [pa.array(found[c].reshape(-1), pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
