"""A displayed table against the data it claims to show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import compare
from plumbline.operators.profile import quoted

# What a release does about each severity.
ACTIONS = {"exact_mismatch": "block", "rounded_truncation": "monitor", "format_mismatch": "ticket"}


def norm_key(key: Column) -> Column:
    """Keys as trimmed text."""
    return F.trim(key.cast("string"))


def _indexed(df: DataFrame, key: str, cols: Sequence[str], order_by: Sequence[str], side: str) -> DataFrame:
    """One row per key, the last duplicate by ``order_by`` (the largest row without one), with the number of rows behind it."""
    row = F.struct(*[quoted(c) for c in cols], F.lit(0).alias("__none"))
    last = F.max_by(row, F.struct(*[quoted(c) for c in order_by])) if order_by else F.max(row)
    return df.groupBy(norm_key(quoted(key)).alias(f"__{side}")).agg(last.alias(f"{side}_row"), F.count(F.lit(1)).alias(f"{side}_rows"))


def align(
    rendered: DataFrame, truth: DataFrame, key: str, value_cols: Sequence[str], order_by: Sequence[str] = (), truth_order: Sequence[str] = ()
) -> DataFrame:
    """Both tables side by side, one row per key. Duplicates are reduced before the join, so no key can multiply."""
    left = _indexed(rendered, key, value_cols, order_by, "rendered")
    right = _indexed(truth, key, value_cols, truth_order, "db")
    joined = left.join(right, F.col("__rendered").eqNullSafe(F.col("__db")), "full_outer")
    return joined.select(
        F.coalesce("__rendered", "__db").alias("key"), "rendered_row", "rendered_rows", "db_row", "db_rows"
    )


def verify(
    rendered: DataFrame,
    truth: DataFrame,
    key: str,
    value_cols: Sequence[str],
    tolerance: float = 0.0,
    order_by: Sequence[str] = (),
    truth_order: Sequence[str] = (),
) -> DataFrame:
    """Cell discrepancies ``(key, column, rendered, db, severity)`` of the keys both sides hold."""
    both = align(rendered, truth, key, value_cols, order_by, truth_order).where("rendered_rows IS NOT NULL AND db_rows IS NOT NULL")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("rendered_row")[c].cast("string").alias("rendered"),
                F.col("db_row")[c].cast("string").alias("db"),
                compare(F.col("rendered_row")[c].cast("string"), F.col("db_row")[c], truth.schema[c].dataType, tolerance).alias("severity"),
            )
            for c in value_cols
        ]
    )
    bad = F.filter(cells, lambda cell: cell["severity"].isNotNull())
    return both.select("key", F.explode(bad).alias("c")).select("key", "c.*")


def unmatched(
    rendered: DataFrame, truth: DataFrame, key: str, value_cols: Sequence[str], order_by: Sequence[str] = (), truth_order: Sequence[str] = ()
) -> DataFrame:
    """Keys on one side only, and keys that repeat: ``(key, side, rows)``."""
    both = align(rendered, truth, key, value_cols, order_by, truth_order)
    found = F.array(
        F.when(F.col("db_rows").isNull(), F.struct(F.lit("only_rendered").alias("side"), F.col("rendered_rows").alias("rows"))),
        F.when(F.col("rendered_rows").isNull(), F.struct(F.lit("only_db").alias("side"), F.col("db_rows").alias("rows"))),
        F.when(F.col("rendered_rows") > 1, F.struct(F.lit("duplicate_rendered").alias("side"), F.col("rendered_rows").alias("rows"))),
        F.when(F.col("db_rows") > 1, F.struct(F.lit("duplicate_db").alias("side"), F.col("db_rows").alias("rows"))),
    )
    return both.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("key", "f.*")


def verify_summary(discrepancies: DataFrame) -> DataFrame:
    """Discrepancies per severity with the release action."""
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return discrepancies.groupBy("severity").agg(F.count(F.lit(1)).alias("cells")).withColumn("action", F.element_at(action, F.col("severity")))
