"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, materialise
from plumbline.operators.ordered import running_total

#: Words, and rows, of a block: the unit that shards draw. Words of an output shard.
BLOCK_WORDS = 200_000
BLOCK_ROWS = 20_000
SHARD_WORDS = 1_000_000
RULES = "rules array<struct<after:bigint,upto:bigint,most:bigint>>"
CUT = f"sid int, spot long, block long, full boolean, {RULES}, left long"


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if sizes[k] > 0]
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if total * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = total * weights[k] / weight
            break
        for k in over:
            targets[k] = float(most * sizes[k])
            total -= targets[k]
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def leaf_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Blocks of each source that one shard gets: the walk from the root of the splitting tree to its leaf.

    A node splits its exact quotas between the shards left and right of its middle. The left side's share of each
    source is one multivariate hypergeometric draw whose generator is seeded by the node, so every walk through a
    node sees the same draw and leaves need not know each other.
    """
    low, high, held = 0, shards, quotas
    while high - low > 1:
        middle = (low + high) // 2
        draws = int(held.sum())
        left_draws = draws * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(held, left_draws, method="marginals")
        if shard < middle:
            high, held = middle, left
        else:
            low, held = middle, held - left
    return held


def _sources(rows: DataFrame, source: str, weights: Sequence[float], most: float) -> list[dict]:
    """One entry per source, in code point order with null last: its sizes, weight and target.

    The sources of a mix are its configuration: one summary row for each reaches the driver.
    """
    least = F.min(F.when(F.col("size") > 0, F.col("size")))
    found = rows.groupBy(source).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), least.alias("least")).collect()
    found = sorted(found, key=lambda r: (r[0] is None, r[0] or ""))
    targets = capped_targets([r["words"] for r in found], [weights[k % len(weights)] for k in range(len(found))], most)
    return [
        {"sid": k, "source": r[0], "words": int(r["words"]), "rows": int(r["rows"]), "least": r["least"], "target": t}
        for k, (r, t) in enumerate(zip(found, targets, strict=True))
    ]


def _shard_draws(spark: SparkSession, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """``(sid, draw, shard)``: which shard takes each numbered draw of each source."""
    held = np.array(quotas, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                yield pd.DataFrame({"sid": np.arange(len(held)), "shard": int(shard), "quota": leaf_quotas(held, shards, int(shard), seed)})

    leaves = spark.range(shards).mapInPandas(run, "sid int, shard long, quota long").where("quota > 0")
    # In chunks: a source may have a quota in every shard.
    first = F.col("upto") - F.col("quota")
    return running_total(leaves, ["sid"], ["shard"], F.col("quota"), "upto").withColumn("first", first).select("sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("draw"), "shard")


def fitting(order: np.ndarray, size: np.ndarray, room: float) -> list[tuple[int, int, int]]:
    """What a block gives to a room of words, going through its rows in order and skipping those that do not fit.

    The rows taken are those of one of the returned ranges (after, upto] of the order whose size is at most the third
    number. Rows of equal order are of equal size and go together, so no range holds such a group that does not fit.
    """
    order, first, group = np.unique(order, return_index=True, return_inverse=True)
    own = np.asarray(size)[first]
    size = np.bincount(group, weights=size).astype(np.int64)
    rules, after, left = [], -(2**63), int(room)
    while True:
        open_ = np.nonzero((order > after) & (own <= left))[0]
        if not len(open_):
            return rules
        n = int(np.searchsorted(np.cumsum(size[open_]), left, side="right"))
        if n == 0:
            after = int(order[open_[0]])
            continue
        upto = int(order[open_[n - 1]])
        rules.append((after, upto, left))
        left -= int(size[open_[:n]].sum())
        after = upto


def _rules(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block that is taken in part; a block holds about ``block_words`` words, so this is bounded."""
    order, size, room = pdf["order"].to_numpy(), pdf["size"].to_numpy(), int(pdf["room"].iloc[0])
    rules, taken = fitting(order, size, room), np.zeros(len(pdf), bool)
    for after, upto, most in rules:
        taken |= (order > after) & (order <= upto) & (size <= most)
    listed = [{"after": a, "upto": b, "most": c} for a, b, c in rules]
    return pdf[["sid", "spot", "block", "full"]].iloc[:1].assign(rules=[listed], left=room - int(size[taken].sum()))


def _last_pass(own: DataFrame, listed: list[dict]) -> DataFrame:
    """``(sid, block, pass, spot, rules)`` of the blocks that the last, partial pass draws; null ``rules``: the block as it is.

    A source's blocks are gone through in their order and rows that do not fit are skipped, to the end of the pass. One
    round sums up, by block, what fits in the room left; blocks up to the one that fills the room give all of that, and the
    room which that one leaves goes on to the blocks behind it. A round ends with less room than some row that fitted
    before it, and rows stand in hashed order, so rounds grow as the logarithm of the rows. The driver sees one row per source.
    """
    spark = own.sparkSession
    found = spark.createDataFrame([], f"sid int, block long, pass int, spot long, {RULES}")
    least = {x["sid"]: x["least"] or 0 for x in listed}
    state = [(x["sid"], int(x["rest"]), None, None) for x in listed if x["rest"] >= 1]
    while state:
        at = F.broadcast(spark.createDataFrame(state, "sid int, left long, past_spot long, past_block long"))
        # Behind the first block that was taken in part, only rows with words that fit count.
        first = F.col("past_spot").isNull()
        behind = (F.col("spot") > F.col("past_spot")) | ((F.col("spot") == F.col("past_spot")) & (F.col("block") > F.col("past_block")))
        rows = own.join(at, "sid").where(first | (behind & (F.col("size") > 0) & (F.col("size") <= F.col("left"))))
        groups = rows.groupBy("sid", "spot", "block", "pass", "left", first.alias("first"), "order").agg(F.sum("size").alias("size"))
        fits = F.coalesce(F.sum(F.when(F.col("size") <= F.col("left"), F.col("size"))), F.lit(0))
        blocks = groups.groupBy("sid", "spot", "block", "pass", "left", "first").agg(F.sum("size").alias("held"), fits.alias("fits"))
        upto = F.sum("fits").over(Window.partitionBy("sid").orderBy("spot", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        blocks = blocks.withColumn("room", F.col("left") - upto + F.col("fits")).where("room > 0 AND (first OR fits > 0)")
        blocks = blocks.withColumn("full", F.col("fits") > F.col("room"))
        blocks = materialise(blocks.withColumn("whole", F.col("first") & (F.col("held") <= F.col("room"))), "reached")
        part = blocks.where("NOT whole").select("sid", "spot", "block", "room", "full").join(own.select("sid", "block", "order", "size"), ["sid", "block"])
        cut = part.groupBy("sid", "spot", "block").applyInPandas(_rules, CUT)
        cut = materialise(cut, "cut")
        given = blocks.join(cut.select("sid", "block", "rules"), ["sid", "block"], "left").where("whole OR size(rules) > 0")
        found = found.unionByName(given.select("sid", "block", "pass", "spot", "rules"))
        state = [(r["sid"], r["left"], r["spot"], r["block"]) for r in cut.where("full").collect() if r["left"] >= max(1, least[r["sid"]])]
    return found


def _numbered(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The given row as one struct, so that its column names cannot clash, beside its key, source and size in words."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(source).alias("source"), size.alias("size"))


def _draws(docs: DataFrame, key: str, text: str, source: str, weights: Sequence[float], most: float, seed: int,
           block_words: int, block_rows: int, shard_words: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``words, target, draws`` to numbered rows; ``draws`` is an array of (pass, shard)."""
    spark = docs.sparkSession
    sizes = materialise(_numbered(docs, key, text, source).select("k", "source", "size"), "sizes")
    listed = _sources(sizes, "source", weights, most)
    for x in listed:
        x["blocks"] = max(1, -(-x["words"] // block_words), -(-x["rows"] // block_rows))
        x["passes"] = int(min(most, x["target"] // x["words"])) if x["words"] else 0
        x["rest"] = max(0.0, x["target"] - x["passes"] * x["words"])
    kinds = "sid int, source string, words long, target double, blocks long, passes int, rest double"
    names = [kind.split()[0] for kind in kinds.split(", ")]
    # One row per source.
    table = F.broadcast(spark.createDataFrame([tuple(x[c] for c in names) for x in listed], kinds).withColumnRenamed("source", "_source"))

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        found = found.withColumn("order", F.xxhash64(F.lit(seed), "k", "size"))
        return found.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("blocks")))

    own = placed(sizes)
    spot = F.xxhash64(F.lit(seed + 2), "sid", "pass", "block")
    blocks = own.groupBy("sid", "block", "passes").agg(F.count("*").alias("n")).where("passes > 0")
    whole = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("spot", spot)
    last = _last_pass(own.withColumnRenamed("passes", "pass").withColumn("spot", spot), listed)
    drawn = last.unionByName(whole.select("sid", "block", "pass", "spot"), allowMissingColumns=True)
    numbered = running_total(drawn, ["sid"], ["pass", "spot", "block"], F.lit(1), "upto")
    draws = materialise(numbered.withColumn("draw", (F.col("upto") - 1).cast("long")).drop("spot", "upto"), "draws")
    counted = {r["sid"]: r["n"] for r in draws.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    shards = max(1, round(sum(x["target"] for x in listed) / shard_words))
    dealt = draws.join(_shard_draws(spark, [counted.get(x["sid"], 0) for x in listed], shards, seed), ["sid", "draw"])
    spot = F.struct(F.col("pass"), F.col("shard"))
    per_block = dealt.groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("rules").isNull(), spot))).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("rules").isNotNull(), spot))).alias("part"),
        F.first("rules", ignorenulls=True).alias("rules"),  # only the last pass has any
    )
    per_block = materialise(per_block, "blocks")
    none = F.array().cast("array<struct<pass:int,shard:bigint>>")
    fits = F.exists("rules", lambda r: (F.col("order") > r["after"]) & (F.col("order") <= r["upto"]) & (F.col("size") <= r["most"]))
    taken = F.concat(F.coalesce("whole", none), F.when(fits, F.col("part")).otherwise(none))
    return lambda rows: placed(rows).join(per_block, ["sid", "block"], "left").withColumn("draws", taken)


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0,
    seed: int = 7, block_words: int = BLOCK_WORDS, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(key, size, source_size, target, draws)`` of every row; ``draws`` lists the (pass, shard) pairs that take it.

    A row's size is its number of words (null text: 0). Sources in code point order, null last, weigh ``weights`` in
    turn; targets share the total of all sizes, none above ``most`` times its source. Rows are dealt to the blocks of
    their source by a hash (the permutation), blocks stand in hashed order anew for each pass, and a source's target
    is met by whole passes and a part of one more: rows are taken in that order, and those that do not fit in the room left
    are skipped, to the end of the pass. So what a source gives misses its target by less than the smallest row with words
    that the last pass leaves out (repeated rows of one key and size go together there), or by less than a word. The
    splitting tree deals the draws to shards. Repeated rows are rows of their own; no rows give an empty result; reruns agree.
    """
    add = _draws(docs, key, text, source, weights, most, seed, block_words, block_rows, shard_words)
    rows = add(_numbered(docs, key, text, source).select("k", "source", "size"))
    return rows.select(F.col("k").alias(key), "size", F.col("words").alias("source_size"), "target", "draws")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0,
    seed: int = 7, block_words: int = BLOCK_WORDS, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The mixture itself: the given columns, a row as often as it is drawn, each shard together and in shuffled order."""
    add = _draws(docs, key, text, source, weights, most, seed, block_words, block_rows, shard_words)
    drawn = add(_numbered(docs, key, text, source)).select("row", "order", F.explode("draws").alias("draw"))
    drawn = drawn.select("row", F.col("draw.shard").alias("shard"), F.xxhash64(F.lit(seed + 3), "draw.pass", "order").alias("place"))
    return drawn.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")
