"""Table profiles: row count, nulls, numbers, percentiles, distincts, lengths, top values, semantic types."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from plumbline.operators.ordered import running_total
from plumbline.session import cut_lineage

# Name fragments of the semantic rules, tried in this order.
IDENTIFIER_PARTS = ("_id", "id_", "uuid", "guid")
TIMESTAMP_PARTS = ("created_at", "updated_at", "timestamp", "_at", "_date", "_time")
BOOLEAN_PARTS = ("is_", "has_", "_flag", "_enabled")
MONEY_PARTS = ("amount", "price", "total", "cost")
FREETEXT_PARTS = ("name", "title", "description")

ENUM_LIMIT = 12
SKETCH_ITEMS = 10_000
#: Values read beyond those asked for, so that equal counts can be ordered by value.
SKETCH_MARGIN = 1_000
TOP_TYPE = "array<struct<rank: int, value: string, count: bigint>>"


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _long_form(df: DataFrame, columns: Sequence[str], stats: dict[str, tuple], shared: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate pass over ``df``, then one row per column.

    ``stats`` maps an output name to (function from column name to aggregate, type). ``shared`` aggregates are
    computed once and repeated on every row.
    """
    shared = shared or {}
    if not columns:
        empty = ", ".join(["column string", *[f"{n} bigint" for n in shared], *[f"{n} {t}" for n, (_, t) in stats.items()]])
        return df.sparkSession.createDataFrame([], empty)
    aggregates = [expr.alias(f"__s_{name}") for name, expr in shared.items()]
    for i, column in enumerate(columns):
        aggregates += [make(column).cast(kind).alias(f"__{i}_{name}") for name, (make, kind) in stats.items()]
    wide = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                *[F.col(f"__s_{name}").alias(name) for name in shared],
                *[F.col(f"__{i}_{name}").alias(name) for name in stats],
            )
            for i, column in enumerate(columns)
        ]
    )
    return wide.select(F.explode(rows).alias("row")).select("row.*")


def _null_stats() -> dict[str, tuple]:
    return {
        "null_count": (lambda c: F.count_if(quoted(c).isNull()), "bigint"),
        "null_rate": (
            lambda c: F.try_divide(F.count_if(quoted(c).isNull()).cast("double"), F.count(F.lit(1)).cast("double")),
            "double",
        ),
    }


def _number_stats(numeric: set[str]) -> dict[str, tuple]:
    def only(make):
        return lambda c: make(quoted(c).cast("double")) if c in numeric else F.max(F.lit(None).cast("double"))

    return {"min": (only(F.min), "double"), "max": (only(F.max), "double"), "mean": (only(F.avg), "double")}


def _text_length_stats(texts: set[str]) -> dict[str, tuple]:
    def only(make):
        return lambda c: make(F.length(quoted(c))) if c in texts else F.max(F.lit(None).cast("int"))

    return {
        "avg_length": (only(F.avg), "double"),
        "min_length": (only(F.min), "int"),
        "max_length": (only(F.max), "int"),
    }


def _hashable(df: DataFrame, column: str) -> Column:
    """The column as something distinct sketches accept; maps and variants only as text."""
    simple = df.schema[column].dataType.simpleString()
    return quoted(column).cast("string") if "map<" in simple or "variant" in simple else quoted(column)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_rates(df: DataFrame) -> DataFrame:
    """Null count and rate of every column; the rate of an empty table is null."""
    return _long_form(df, df.columns, _null_stats(), {"row_count": F.count(F.lit(1))})


def numeric_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of every numeric column, as doubles."""
    numeric = _numeric(df)
    return _long_form(df, numeric, _number_stats(set(numeric)))


def length_stats(df: DataFrame) -> DataFrame:
    """Average, shortest and longest length of every text column, in characters."""
    texts = _texts(df)
    return _long_form(df, texts, _text_length_stats(set(texts)))


def _slot(column: str, kind: DataType) -> tuple[str, Column, Callable[[Column], Column]]:
    """(slot, the column as that slot, the slot back as text): numbers and times are grouped as numbers, not as text."""
    value = quoted(column)
    if isinstance(kind, IntegralType):
        return "whole", value.cast("bigint"), lambda v: v.cast("string")
    if isinstance(kind, (DoubleType, FloatType)):
        return "real", value.cast("double"), lambda v: v.cast(kind).cast("string")
    if isinstance(kind, TimestampType):
        return "whole", F.unix_micros(value), lambda v: F.timestamp_micros(v).cast("string")
    if isinstance(kind, DateType):
        return "whole", F.unix_date(value).cast("bigint"), lambda v: F.date_from_unix_date(v.cast("int")).cast("string")
    return "text", value.cast("string"), lambda v: v


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, count)`` of all non-null values; one scan and one shuffle for all columns.

    Cells travel as (column number, typed slot) and become text only after they are counted.
    """
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    slots = [_slot(c, df.schema[c].dataType) for c in columns]
    types = {"text": "string", "whole": "bigint", "real": "double"}
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                *[(value if slot == name else F.lit(None).cast(kind)).alias(name) for name, kind in types.items()],
            )
            for i, (slot, value, _) in enumerate(slots)
        ]
    )
    filled = F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull()
    counted = (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .where(filled)
        .groupBy("place", *types)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    value = F.col("text")
    for i, (slot, _, shown) in enumerate(slots):
        if slot != "text":
            value = F.when(F.col("place") == i, shown(F.col(slot))).otherwise(value)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return counted.select(name.alias("column"), value.alias("value"), "count")


def distinct_stats(df: DataFrame, approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct non-null values per column and their ratio to all rows.

    Exact counting moves every distinct value once; ``approx`` needs one pass with fixed-size sketches.
    """
    if approx:
        stats = {
            "distinct_count": (lambda c: F.approx_count_distinct(_hashable(df, c), rsd), "bigint"),
            "distinct_ratio": (
                lambda c: F.try_divide(F.approx_count_distinct(_hashable(df, c), rsd).cast("double"), F.count(F.lit(1)).cast("double")),
                "double",
            ),
        }
        return _long_form(df, df.columns, stats)
    counted = value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    rows = _long_form(df, df.columns, {}, {"row_count": F.count(F.lit(1))})
    count = F.coalesce("distinct_count", F.lit(0))
    return rows.join(counted, "column", "left").select(
        "column",
        count.alias("distinct_count"),
        F.try_divide(count.cast("double"), F.col("row_count").cast("double")).alias("distinct_ratio"),
    )


def _sketched_top(column: str, k: int, tracked: int = SKETCH_ITEMS) -> Column:
    """Most frequent values from a fixed-size sketch, exact while a column has fewer values than the sketch tracks.

    ``SKETCH_MARGIN`` more values than ``k`` are read where the sketch holds them, to order equal counts by value.
    """
    if k > tracked:
        raise ValueError(f"a sketch of {tracked} values cannot give the {k} most frequent ones; ask for the exact form")
    items = F.call_function("approx_top_k", quoted(column).cast("string"), F.lit(min(tracked, k + SKETCH_MARGIN)), F.lit(tracked))
    found = F.filter(items, lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("value"))))
    return F.transform(ordered, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["value"].alias("value"), (-x["n"]).alias("count")))


def top_values(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """The ``k`` most frequent non-null values of every column; equal counts are ordered by value.

    The rank filter is applied on the map side first (window group limit), so a key-like column does not send
    all its values to one task. ``approx`` needs one pass and moves sketches only.
    """
    if approx:
        names = list(columns if columns is not None else df.columns)
        stats = {"top": (lambda c: _sketched_top(c, k), TOP_TYPE)}
        rows = _long_form(df, names, stats).select("column", F.explode(F.slice("top", 1, k)).alias("t"))
        return rows.select("column", "t.value", "t.count", "t.rank")
    by_count = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return value_counts(df, columns).withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)


def percentiles(
    df: DataFrame, probs: Sequence[float] = (0.5, 0.95, 0.99), exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Percentiles of every numeric column, one row per column and probability.

    The default is one pass of mergeable sketches. ``exact`` interpolates between the two neighbouring ranks; the
    ranks come from value counts with a distributed running total, never from a sorted column in one task.
    """
    numeric = _numeric(df)
    probs = list(probs)
    if not exact:
        stats = {"values": (lambda c: F.percentile_approx(quoted(c).cast("double"), probs, accuracy), "array<double>")}
        wide = _long_form(df, numeric, stats)
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("values").alias("value"))
        return wide.select("column", F.explode(pairs).alias("pair")).select("column", "pair.prob", "pair.value")
    if not numeric:
        return df.sparkSession.createDataFrame([], "column string, prob double, value double")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in numeric])
    counts = (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = running_total(counts, ["column"], ["value"], F.col("count"), "last")
    wanted = ranked.groupBy("column").agg(F.max("last").alias("n")).select(
        F.col("column").alias("of"), "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    ).withColumn("position", F.col("prob") * (F.col("n") - 1))
    # A value with ranks [first, last] serves the lower and the upper neighbour of a zero-based position.
    first = F.col("last") - F.col("count")
    low = F.floor("position").between(first, F.col("last") - 1)
    high = F.ceil("position").between(first, F.col("last") - 1)
    # Bounded by the schema: one row per numeric column and probability.
    hits = ranked.join(F.broadcast(wanted), (F.col("column") == F.col("of")) & (low | high))
    ends = hits.groupBy("column", "prob", "position").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = F.col("position") - F.floor("position")
    return ends.select("column", "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value"))


def semantic_type(name: str, kind: DataType, rules: str = "name") -> str:
    """Meaning of a column from its name, then its type; the first rule that matches wins."""
    lowered = name.lower()
    named = [
        (IDENTIFIER_PARTS, "identifier"),
        (TIMESTAMP_PARTS, "timestamp"),
        (BOOLEAN_PARTS, "boolean"),
        (MONEY_PARTS, "money"),
    ]
    if lowered == "id":
        return "identifier"
    for parts, meaning in named:
        if any(part in lowered for part in parts):
            return meaning
    if rules == "name+type":
        if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
            return "timestamp"
        if isinstance(kind, BooleanType):
            return "boolean"
    if isinstance(kind, NumericType):
        return "number"
    if isinstance(kind, StringType):
        return "freetext" if any(part in lowered for part in FREETEXT_PARTS) else "category"
    return "unknown"


def semantic_types(df: DataFrame, rules: str = "name") -> DataFrame:
    """Semantic type of every column; ``rules='name+type'`` also trusts date, time and boolean types."""
    rows = [
        (i, f.name, f.dataType.simpleString(), semantic_type(f.name, f.dataType, rules))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string, semantic_type string")


def sample_rows(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None, policy=None) -> DataFrame:
    """``n`` rows, masked when a policy is given; deterministic when ``order_by`` is unique."""
    from plumbline.operators.mask import mask

    if order_by:
        df = df.orderBy(*order_by)
    limited = df.limit(n)
    return limited if policy is None else mask(limited, policy)


def _counted_top(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, as one list, from the value counts."""
    by_count = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return (
        counts.withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= k)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
    )


def _with_exact_top(df: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """``wide`` with counted top values where a column may have more values than its sketch holds."""
    wide = cut_lineage(wide)
    # Distinct counts are sketched too, so half of what a sketch holds leaves room for their error. One row per column.
    unsure = [r["column"] for r in wide.where(F.col("distinct_count") > SKETCH_ITEMS // 2).select("column").collect()]
    if not unsure:
        return wide
    counted = _counted_top(value_counts(df, unsure), k).withColumnRenamed("top", "__counted")
    return wide.join(counted, "column", "left").withColumn("top", F.coalesce("__counted", "top")).drop("__counted")


def profile(
    df: DataFrame,
    top_k: int = 5,
    probs: Sequence[float] = (0.5, 0.95, 0.99),
    approx: bool = True,
    rules: str = "name",
    policy=True,
    enum_limit: int = ENUM_LIMIT,
    exact_top: bool = False,
) -> DataFrame:
    """Full profile, one row per column.

    One aggregate pass gives counts, nulls, numbers, percentiles (sketch) and lengths, and by sketches distincts, top values and, up
    to ``enum_limit`` distinct values, the whole value set; only fixed-size sketches are shuffled. ``approx=False`` takes
    distincts and top values from a second pass over the value counts, which moves every distinct value once.
    ``exact_top`` takes that pass for the columns with more values than a sketch surely holds, and for their top values only.

    Top values are masked by ``policy`` (a ``MaskPolicy``; True is the default one, None shows raw values), and a
    value set with a masked value is left out.
    """
    from plumbline.operators.mask import MaskPolicy, masked_values

    numeric, texts = set(_numeric(df)), set(_texts(df))
    probs = list(probs)
    kept = max(top_k, enum_limit)

    def sketch(c):
        return F.percentile_approx(quoted(c).cast("double"), probs) if c in numeric else F.max(F.lit(None).cast("array<double>"))

    stats = {**_number_stats(numeric), **_text_length_stats(texts), "percentiles": (sketch, "array<double>")}
    columns = list(df.columns)
    if approx:
        stats |= _null_stats()
        stats["distinct_count"] = (lambda c: F.approx_count_distinct(_hashable(df, c), 0.02), "bigint")
        stats["top"] = (lambda c: _sketched_top(c, kept), TOP_TYPE)
    wide = _long_form(df, columns, stats, {"row_count": F.count(F.lit(1))})
    if approx:
        wide = wide.withColumn("top", F.slice("top", 1, kept))
        if exact_top:
            wide = _with_exact_top(df, wide, kept)
    else:
        # Both branches read the counts, so they share one shuffle; the nulls are what the counts leave over.
        counts = value_counts(df, columns)
        distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("count").alias("filled"))
        wide = wide.join(distinct, "column", "left").join(_counted_top(counts, kept), "column", "left").withColumns({
            "distinct_count": F.coalesce("distinct_count", F.lit(0)),
            "null_count": F.col("row_count") - F.coalesce("filled", F.lit(0)),
        })
        wide = wide.withColumn("null_rate", F.try_divide(F.col("null_count").cast("double"), F.col("row_count").cast("double")))
    facts = semantic_types(df, rules)
    joined = facts.join(wide, "column").withColumn("hidden", F.lit(False))
    if policy:
        # A dozen values per column: taken apart, masked and put together again.
        values = joined.select("*", F.explode_outer("top").alias("t")).withColumn("raw", F.col("t.value"))
        shown = values.withColumn("shown", masked_values(df, "column", "raw", MaskPolicy() if policy is True else policy))
        entry = F.when(F.col("t").isNotNull(), F.struct(F.col("t.rank").alias("rank"), F.col("shown").alias("value"), F.col("t.count").alias("count")))
        others = [c for c in joined.columns if c not in ("column", "top", "hidden")]
        joined = shown.groupBy("column").agg(
            *[F.first(c).alias(c) for c in others],
            F.sort_array(F.collect_list(entry)).alias("top"),
            F.bool_or(~F.col("shown").eqNullSafe(F.col("raw"))).alias("hidden"),
        ).withColumn("top", F.when(F.size("top") > 0, F.col("top")))
    pairs = F.transform(F.slice("top", 1, top_k), lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count")))
    enum = F.when(
        F.col("distinct_count").between(1, enum_limit) & ~F.col("hidden"), F.array_sort(F.transform("top", lambda v: v["value"]))
    )
    has_rows = F.col("row_count") > 0
    return joined.select(
        "ordinal", "column", "type", "semantic_type", "row_count",
        F.when(has_rows, F.col("null_count")).alias("null_count"),
        "null_rate", "min", "max", "mean",
        *[F.get("percentiles", i).alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)],
        F.when(has_rows, F.col("distinct_count")).alias("distinct_count"),
        F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count").cast("double")).alias("distinct_ratio"),
        "avg_length", "min_length", "max_length",
        pairs.alias("top_values"),
        enum.alias("enum_values"),
    )


@dataclass(frozen=True)
class TableProfile:
    """A whole profile: one row per column, masked sample rows, and findings per entity."""

    columns: DataFrame
    sample: DataFrame
    pii: DataFrame


def table_profile(
    df: DataFrame, row_key: Sequence[str], top_k: int = 5, sample_n: int = 10, policy=True, approx: bool = True, rules: str = "name"
) -> TableProfile:
    """Column statistics, a masked sample in key order, and the personal data found in the whole table."""
    from plumbline.operators.mask import MaskPolicy
    from plumbline.operators.pii import pii_summary

    chosen = MaskPolicy() if policy is True else policy
    return TableProfile(
        profile(df, top_k, approx=approx, rules=rules, policy=chosen),
        sample_rows(df, sample_n, row_key, chosen),
        pii_summary(df, row_key),
    )
