"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import materialise
from plumbline.session import broadcast_if_small

#: Vectors per block of candidates, and queries per block of queries: one task holds one of each.
BLOCK = 8_192
QUERY_BLOCK = 1_024


def quantised(vectors: DataFrame, vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    value = F.col(vector)
    usable = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def threshold_walk(
    matrix: np.ndarray, ids: np.ndarray, lists: np.ndarray, wanted: np.ndarray, own: np.ndarray, k: int, least: list[int | None],
) -> tuple[list[list[tuple[int, int]]], int]:
    """The best ``k`` (score, id) of a block for each query, ties to smaller ids, a query's own id left out; and how many queries walked at all.

    ``lists[d]`` holds the rows in ascending order of dimension d. Sorted access walks every list from both ends, and a row met
    for the first time is scored in full, by random access, for all queries still walking. A row not met yet scores no
    more for a query than the sum of its weighted values at the current depth, from the end that each weight favours. A query
    stops once this bound is below its kth score, or below ``least``, a kth score it has elsewhere; at depth 0 that
    passes the whole block by. Depth grows in steps that double.
    """
    n, dims = matrix.shape
    best: list[list[tuple[int, int]]] = [[] for _ in wanted]
    active = list(range(len(wanted)))
    walked: set[int] = set()
    floors = list(least)
    seen = np.zeros(n, bool)
    every = np.arange(dims)
    depth, step = 0, max(4, k)
    while active and not seen.all():
        asked = wanted[active]
        if dims:
            top, bottom = matrix[lists[:, n - 1 - depth], every], matrix[lists[:, depth], every]
            bound = (np.where(asked > 0, top, bottom) * asked).sum(axis=1).tolist()
            active = [q for q, b in zip(active, bound, strict=True) if floors[q] is None or b >= floors[q]]
            if not active:
                break
            asked = wanted[active]
        walked.update(active)
        to = min(n, depth + step)
        met = np.full(n, not dims)
        met[lists[:, depth:to].ravel()] = True
        met[lists[:, n - to : n - depth].ravel()] = True
        rows = np.nonzero(met & ~seen)[0]
        seen |= met
        names = ids[rows]
        scores = asked @ matrix[rows].T
        for q, line in zip(active, scores, strict=True):
            fits = names != own[q]
            if floors[q] is not None:
                fits &= line >= floors[q]
            found, named = line[fits], names[fits]
            if len(found) > k:
                enough = found >= np.partition(found, len(found) - k)[len(found) - k]
                found, named = found[enough], named[enough]
            if len(found):
                best[q] = sorted(best[q] + list(zip(found.tolist(), named.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
                if len(best[q]) == k and (floors[q] is None or best[q][-1][0] > floors[q]):
                    floors[q] = best[q][-1][0]
        depth, step = to, 2 * step
    return best, len(walked)


def threshold_topk(matrix: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The best ``k`` (score, id) of a block for one query."""
    return threshold_walk(matrix, ids, lists, query[None, :], np.array([own]), k, [None])[0][0]


def _dot_kind(most: int, dims: int) -> type:
    """The fastest number type in which every inner product is exact."""
    if most * most * max(dims, 1) < 2**52:
        return np.float64
    return np.int64 if most * most * max(dims, 1) < 2**62 else object


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best integer inner products of each query over all vectors.

    Components become floor(scale * x). Ties go to the smaller key. A candidate with the query's own key is left out;
    equal rows count once. Vectors that are null or hold a null or non-finite component, and rows without a key, take
    no part; a query meets only vectors of as many components. Empty tables give an empty result.

    Candidates are dealt to blocks of about ``BLOCK`` by their leading component, so that blocks differ in what they can
    score. A query first walks the block of its own leading component; its kth score there goes along to all other blocks, which pass it by
    where they cannot reach it. Queries travel in blocks of about ``QUERY_BLOCK``, and each pair of blocks is one bounded task;
    the best k of each block and query are merged.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")

    def prepared(df: DataFrame, name: str) -> DataFrame:
        found = df.select(F.col(key).cast("long").alias("id"), quantised(df, vector, scale).alias("v"))
        return materialise(found.where("id IS NOT NULL AND v IS NOT NULL").distinct().withColumn("class", _leading(F.col("v"))), name)

    vectors_, asked = prepared(vectors, "vectors"), prepared(queries, "queries")
    homes = materialise(_homes(vectors_), "homes")
    candidates = materialise(_packed(_dealt(vectors_, homes), "c"), "candidates")
    pieces = F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK)))).cast("string")
    at_home = _packed(_dealt(asked, homes).withColumn("home", F.col("block")).withColumn("block", F.concat("block", F.lit("/"), pieces)), "q", "home")
    first = _searched(candidates.join(at_home.drop("dims"), F.col("c_block") == F.col("home")), k, False)
    first = materialise(first, "first")
    kth = first.groupBy("query_id", "q_hash").agg(F.when(F.count("*") >= k, F.min("score")).cast("string").alias("low"))
    known = _dealt(asked, homes).withColumn("q_hash", F.xxhash64("v"))
    known = known.join(kth, (known["id"] == kth["query_id"]) & (known["q_hash"] == kth["q_hash"]), "left").select("id", "v", "dims", F.col("block").alias("home"), "low")
    others = materialise(_packed(known.withColumn("block", pieces), "q", "home", "low"), "asked")
    # Each candidate block is sent once to every query block: the pairs are the search itself, one bounded task each.
    pairs = candidates.join(others, "dims")
    second = _searched(pairs.withColumn("home", F.lit(None).cast("string")), k, True)
    found = first.unionByName(second).drop("q_hash")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # Equal scores of one key come from differing rows of that key: each is a row of its own.
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _leading(v: Column) -> Column:
    """The place and sign of the component that is largest in amount, the first of equals; -1 without components."""
    amounts = F.transform(v, lambda x: F.abs(x))
    at = F.array_position(amounts, F.array_max(amounts)) - 1
    return F.when(F.size(v) == 0, F.lit(-1)).otherwise(2 * at + (F.get(v, at.cast("int")) < 0).cast("long")).cast("long")


def _homes(vectors: DataFrame) -> DataFrame:
    """``(dims, class, base, pieces)``: small classes side by side in blocks, large ones in blocks of their own. One row per class."""
    sizes = vectors.groupBy(F.size("v").alias("dims"), "class").agg(F.count("*").alias("n"))
    before = F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).over(Window.partitionBy("dims").orderBy("class"))
    small = F.concat_ws("-", F.lit("s"), "dims", F.floor((before - 1) / BLOCK))
    base = F.when(F.col("n") < BLOCK, small).otherwise(F.concat_ws("-", F.lit("l"), "dims", "class"))
    return sizes.select("dims", "class", base.alias("base"), F.ceil(F.col("n") / BLOCK).alias("pieces"))


def _dealt(df: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows with the block of their class; null where no candidate is of the class."""
    keyed = df.withColumn("dims", F.size("v")).join(broadcast_if_small(homes), ["dims", "class"], "left")
    piece = F.pmod(F.xxhash64("id", "v"), F.col("pieces"))
    return keyed.select("id", "v", "dims", F.concat_ws("-", "base", piece.cast("string")).alias("block")).withColumn("block", F.when(F.col("block") != "", F.col("block")))


def _packed(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    """One row for each block: sorted keys, flat values, and the columns ``more`` as lists beside the keys."""
    rows = F.sort_array(F.collect_list(F.struct("id", "v", *more))).alias("rows")
    packed = df.groupBy("block", "dims").agg(rows)
    lists = [F.col(f"rows.{m}").alias(m if m != "home" else "homes") for m in more]
    first = [F.element_at("homes", 1).alias("home")] if "home" in more else []
    return packed.select(F.col("block").alias(f"{prefix}_block"), "dims", F.col("rows.id").alias(f"{prefix}_ids"), F.flatten("rows.v").alias(f"{prefix}_values"), *lists).select("*", *first)


def _searched(pairs: DataFrame, k: int, elsewhere: bool) -> DataFrame:
    """``(query_id, q_hash, vec_id, score)``: the best k of each pair of blocks; with ``elsewhere`` without the queries at home in the block."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                dims = int(row.dims)
                ids, asked_ids = np.asarray(row.c_ids, np.int64), np.asarray(row.q_ids, np.int64)
                matrix = np.asarray(row.c_values, np.int64).reshape(len(ids), dims)
                wanted = np.asarray(row.q_values, np.int64).reshape(len(asked_ids), dims)
                hashes = np.asarray(row.q_hashes, np.int64)
                least: list[int | None] = [None] * len(asked_ids)
                if elsewhere:
                    away = np.array([home != row.c_block for home in row.homes], bool)
                    asked_ids, wanted, hashes = asked_ids[away], wanted[away], hashes[away]
                    least = [None if low is None else int(low) for low, a in zip(row.lows, away, strict=True) if a]
                most = max(int(np.abs(matrix).max(initial=0)), int(np.abs(wanted).max(initial=0)))
                kind = _dot_kind(most, dims)
                matrix, wanted = matrix.astype(kind), wanted.astype(kind)
                lists = np.argsort(matrix, axis=0, kind="stable").T
                best, _ = threshold_walk(matrix, ids, lists, wanted, asked_ids, k, least)
                out = [(int(q), int(h), int(i), int(s)) for q, h, found in zip(asked_ids, hashes, best, strict=True) for s, i in found]
                yield pd.DataFrame(out, columns=["query_id", "q_hash", "vec_id", "score"])

    width = F.sequence(F.lit(0), F.size("q_ids") - 1)
    hashes = F.transform(width, lambda i: F.xxhash64(F.slice("q_values", i * F.col("dims") + 1, F.col("dims"))))
    pairs = pairs.withColumns({"q_hashes": hashes, "lows": F.col("low") if elsewhere else F.lit(None).cast("array<string>")})
    # A handful of packed rows must not share a task: one row for each partition, as far as partitions go.
    dealt = pairs.select("c_block", "dims", "c_ids", "c_values", "q_block", "q_ids", "q_values", "q_hashes", "homes", "lows").repartition("q_block", "c_block", "dims")
    return dealt.mapInPandas(search, "query_id long, q_hash long, vec_id long, score long")
