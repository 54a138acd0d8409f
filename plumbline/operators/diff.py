"""The same table in two environments: schema, counts, buckets, rows and cells.

Both sides are put below each other and grouped once. That is one shuffle without a join: keys that repeat, even a
key that fills a third of a side, are reduced on the map side and cannot multiply.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, MapType, VariantType

from plumbline.operators.profile import quoted
from plumbline.session import broadcast_if_small, cut_lineage

BUCKETS = 32


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns added on the right, removed from the left, or retyped (types compared without case)."""
    before = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    after = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    rows = [("added", c, None, t) for c, t in after.items() if c not in before]
    rows += [("removed", c, t, None) for c, t in before.items() if c not in after]
    rows += [("retyped", c, t, after[c]) for c, t in before.items() if c in after and t.lower() != after[c].lower()]
    return left.sparkSession.createDataFrame(rows, "change string, column string, left_type string, right_type string")


def _pct(left: Column, right: Column) -> Column:
    rise = F.when(right > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(left == 0, rise).otherwise((right - left) / left * 100.0)


def _two_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False)))


def _side_counts() -> list[Column]:
    return [F.count_if("__left").alias("left_count"), F.count_if(~F.col("__left")).alias("right_count")]


def rowcount_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows left and right, difference and change in percent; growth from zero is infinite."""
    counts = _two_sided(left.select(), right.select()).agg(*_side_counts())
    l, r = F.col("left_count"), F.col("right_count")
    return counts.select(l, r, (r - l).alias("delta"), _pct(l, r).alias("delta_pct"))


def rowcount_diff_by(left: DataFrame, right: DataFrame, keys: dict[str, Column] | Sequence[str]) -> DataFrame:
    """Row counts per group, a group missing on one side counts 0. ``keys`` may be expressions by name."""
    keys = keys if isinstance(keys, dict) else {k: quoted(k) for k in keys}
    pick = [expr.alias(name) for name, expr in keys.items()]
    counts = _two_sided(left.select(*pick), right.select(*pick)).groupBy(*[quoted(k) for k in keys]).agg(*_side_counts())
    return counts.withColumn("delta", F.col("right_count") - F.col("left_count"))


def _key_text(pk: Sequence[str]) -> Column:
    return F.concat_ws("|", *[quoted(k).cast("string") for k in pk])


def comparable(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``columns`` in a form that compares and hashes alike on either side.

    A column retyped between the sides is compared as text; maps are sorted entries, variants are text.
    """

    def side(df: DataFrame, other: DataFrame) -> DataFrame:
        def form(column: str) -> Column:
            kind = df.schema[column].dataType
            if kind != other.schema[column].dataType or isinstance(kind, VariantType):
                return quoted(column).cast("string").alias(column)
            if isinstance(kind, MapType):
                return F.sort_array(F.map_entries(quoted(column))).alias(column)
            return quoted(column).alias(column)

        return df.select(*[form(c) for c in columns])

    return side(left, right), side(right, left)


def key_bucket(pk: Sequence[str], buckets: int = BUCKETS, algorithm: str = "md5") -> Column:
    """Bucket of a key. ``md5`` takes 32 bits of the MD5 of its text, the same in any engine; ``xxhash64`` is faster."""
    if algorithm == "xxhash64":
        return F.pmod(F.xxhash64(*[quoted(k) for k in pk]), F.lit(buckets).cast("bigint"))
    return F.pmod(F.conv(F.substring(F.md5(_key_text(pk)), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def bucket_count_diff(left: DataFrame, right: DataFrame, pk: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows per key bucket on both sides: a quick lower bound for the rows that exist on one side only."""
    bucket = key_bucket(pk, buckets).alias("bucket")
    counts = _two_sided(left.select(bucket), right.select(bucket)).groupBy("bucket").agg(*_side_counts())
    gap = F.col("left_count") - F.col("right_count")
    return counts.select("*", F.greatest(gap, F.lit(0)).alias("only_left"), F.greatest(-gap, F.lit(0)).alias("only_right"))


def bucket_count_summary(buckets: DataFrame) -> DataFrame:
    """Totals over the buckets. Changed rows are not visible to counts and are reported as 0."""
    return buckets.agg(
        F.coalesce(F.sum("only_left"), F.lit(0)).alias("rows_only_left"),
        F.coalesce(F.sum("only_right"), F.lit(0)).alias("rows_only_right"),
        F.lit(0).cast("bigint").alias("rows_changed"),
        F.coalesce(F.sum("left_count"), F.lit(0)).alias("rows_total_compared"),
    )


def _row_hash(columns: Sequence[str], algorithm: str) -> Column:
    """Hash of a row in which no two different rows read alike: nulls are marked and texts carry their length."""
    if algorithm == "xxhash64":
        return F.xxhash64(*[part for c in columns for part in (quoted(c).isNull(), quoted(c))]).cast("decimal(38,0)")
    texts = [quoted(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def _bucket_checksums(
    left: DataFrame, right: DataFrame, pk: Sequence[str], buckets: int, cols: Sequence[str], algorithm: str
) -> DataFrame:
    """Counts and checksums of every key bucket, and whether both sides agree."""
    left, right = comparable(left, right, list(dict.fromkeys([*pk, *cols])))
    pick = [key_bucket(pk, buckets, algorithm).alias("bucket"), _row_hash(cols, algorithm).alias("__hash")]
    summed = _two_sided(left.select(*pick), right.select(*pick)).groupBy("bucket").agg(
        *_side_counts(),
        F.sum(F.when(F.col("__left"), F.col("__hash"))).alias("left_checksum"),
        F.sum(F.when(~F.col("__left"), F.col("__hash"))).alias("right_checksum"),
    )
    same = F.col("left_checksum").eqNullSafe(F.col("right_checksum")) & (F.col("left_count") == F.col("right_count"))
    return summed.withColumn("__same", same)


def bucket_checksum_diff(
    left: DataFrame,
    right: DataFrame,
    pk: Sequence[str],
    buckets: int = BUCKETS,
    cols: Sequence[str] | None = None,
    algorithm: str = "xxhash64",
) -> DataFrame:
    """Key buckets whose row checksums differ; buckets that agree are dropped.

    The checksum is the sum of the row hashes: it ignores row order and combines on the map side. Without ``cols`` the
    columns of both sides are compared.
    """
    cols = list(cols) if cols is not None else [c for c in left.columns if c in right.columns]
    return _bucket_checksums(left, right, pk, buckets, cols, algorithm).where(~F.col("__same")).drop("__same")


def _equal(kinds: dict, column: str, tolerance: float) -> Column:
    l, r = F.col("__l")[column], F.col("__r")[column]
    same = l.eqNullSafe(r)
    if tolerance and isinstance(kinds[column], (DoubleType, FloatType)):
        same = same | F.coalesce(F.abs(l - r) <= F.lit(tolerance), F.lit(False))
    return same


def _compared(left: DataFrame, right: DataFrame, pk: Sequence[str], cols: Sequence[str] | None) -> list[str]:
    if not pk:
        raise ValueError("a value diff needs a primary key")
    return list(cols) if cols is not None else [c for c in left.columns if c in right.columns and c not in pk]


def _classified(left: DataFrame, right: DataFrame, pk: Sequence[str], cols: Sequence[str], tolerance: float) -> tuple[DataFrame, dict]:
    """One row per key: counts, rows of both sides, and the class; and the types in which the columns are compared.

    Of a key that repeats on a side the smallest row stands for the rest, so the result is the same at every run.
    """
    left, right = comparable(left, right, list(dict.fromkeys([*pk, *cols])))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    keys = [quoted(k) for k in pk]
    row = F.struct(*[quoted(c) for c in cols]) if cols else F.struct(F.lit(1).alias("__none"))
    both = _two_sided(left.select(*keys, row.alias("__row")), right.select(*keys, row.alias("__row")))
    paired = both.groupBy(*keys).agg(
        *_side_counts(),
        F.min(F.when(F.col("__left"), F.col("__row"))).alias("__l"),
        F.min(F.when(~F.col("__left"), F.col("__row"))).alias("__r"),
    )
    same = reduce(lambda a, b: a & b, [_equal(kinds, c, tolerance) for c in cols], F.lit(True))
    l, r = F.col("left_count"), F.col("right_count")
    kind = (
        F.when(r == 0, "only_left")
        .when(l == 0, "only_right")
        .when((l > 1) | (r > 1), "duplicate")
        .when(same, "equal")
        .otherwise("changed")
    )
    return paired.withColumn("kind", kind), kinds


def value_diff(
    left: DataFrame,
    right: DataFrame,
    pk: Sequence[str],
    cols: Sequence[str] | None = None,
    tolerance: float = 0.0,
    prefilter: int | None = None,
) -> DataFrame:
    """Exact counts of rows only left, only right, changed and compared; keys repeated on a shared key are their own class.

    Keys compare null-safe, retyped columns as text. ``tolerance`` is absolute and applies to floating point columns.
    ``prefilter`` (a bucket count) first drops key buckets with equal checksums, which pays when few rows changed and
    the buckets are many; hashes can collide, so it is opt-in. Rows of dropped buckets count as equal and as compared.
    """
    cols = _compared(left, right, pk, cols)
    skipped = None
    if prefilter:
        both = list(dict.fromkeys([*pk, *cols]))
        left, right = comparable(left, right, both)
        buckets = _bucket_checksums(left, right, pk, prefilter, both, "xxhash64")
        bad = buckets.where(~F.col("__same")).select("bucket")
        skipped = buckets.where("__same").agg(F.coalesce(F.sum("left_count"), F.lit(0)).alias("n"))
        bucket = key_bucket(pk, prefilter, "xxhash64")
        left = left.withColumn("bucket", bucket).join(bad, "bucket", "left_semi")
        right = right.withColumn("bucket", bucket).join(bad, "bucket", "left_semi")
    rows, _ = _classified(left, right, pk, cols, tolerance)
    kind, l, r = F.col("kind"), F.col("left_count"), F.col("right_count")
    total = lambda condition, n: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    counts = rows.agg(
        total(kind == "only_left", l).alias("rows_only_left"),
        total(kind == "only_right", r).alias("rows_only_right"),
        F.count_if(kind == "changed").alias("rows_changed"),
        F.count_if(kind == "equal").alias("rows_equal"),
        F.count_if(kind == "duplicate").alias("duplicate_keys"),
        F.coalesce(F.sum(l), F.lit(0)).alias("rows_total_compared"),
    )
    if skipped is None:
        return counts
    rest = skipped.select(*[(F.col("n") if c in ("rows_equal", "rows_total_compared") else F.lit(0).cast("bigint")).alias(c) for c in counts.columns])
    return counts.unionByName(rest).agg(*[F.sum(c).alias(c) for c in counts.columns])


@dataclass(frozen=True)
class RefinedDiff:
    """What a refined diff found: ``counts`` as from ``value_diff``, the differing ``rows`` as from ``value_diff_rows``, and one row
    per level: buckets and rows compared, buckets that differ, and the rows in them."""

    counts: DataFrame
    rows: DataFrame
    levels: DataFrame


def refined_diff(
    left: DataFrame, right: DataFrame, pk: Sequence[str], cols: Sequence[str] | None = None, tolerance: float = 0.0,
    fanout: int = 64, leaf_rows: int = 100_000, levels: int = 5,
) -> RefinedDiff:
    """The value diff of two large tables that differ in few rows, by checksums of ever smaller key buckets.

    The first level compares ``fanout`` buckets; each bucket that differs is split ``fanout`` ways at the next, and only the rows of
    such buckets are hashed again. What crosses a shuffle is one row per task and bucket. It ends when nothing
    differs, when no more than ``leaf_rows`` rows are left, when a level could not halve them, or after ``levels``; the rows left are compared one by one.
    Buckets with equal checksums count as equal; hashes can collide, at one in some 10^18 for each.
    """
    cols = _compared(left, right, pk, cols)
    both = list(dict.fromkeys([*pk, *cols]))
    left, right = comparable(left, right, both)
    key, row = F.xxhash64(*[quoted(k) for k in pk]).alias("__key"), _row_hash(both, "xxhash64").alias("__hash")
    hashed = _two_sided(left.select(key, row), right.select(key, row))
    steps, total, open_ = [], None, None

    def place(level: int) -> Column:
        return F.pmod("__key", F.lit(fanout**level))

    def inside(df: DataFrame, buckets: DataFrame, level: int) -> DataFrame:
        return df.withColumn("__bucket", place(level)).join(broadcast_if_small(buckets), "__bucket", "left_semi").drop("__bucket")

    for level in range(1, levels + 1):
        rows = hashed if open_ is None else inside(hashed, open_, level - 1)
        summed = rows.groupBy(place(level).alias("__bucket")).agg(
            *_side_counts(), F.sum(F.when(F.col("__left"), F.col("__hash"))).alias("l"), F.sum(F.when(~F.col("__left"), F.col("__hash"))).alias("r"))
        same = F.col("l").eqNullSafe(F.col("r")) & (F.col("left_count") == F.col("right_count"))
        summed = cut_lineage(summed.select("__bucket", "left_count", "right_count", same.alias("same")))
        size = F.col("left_count") + F.col("right_count")
        found = summed.agg(
            F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum(size), F.lit(0)).alias("rows"), F.coalesce(F.sum("left_count"), F.lit(0)).alias("left"),
            F.count_if(~F.col("same")).alias("differing"), F.coalesce(F.sum(F.when(~F.col("same"), size)), F.lit(0)).alias("open"),
            F.coalesce(F.sum(F.when(~F.col("same"), F.col("left_count"))), F.lit(0)).alias("open_left"),
        ).first()
        total = found["left"] if total is None else total
        steps.append((level, found["buckets"], found["rows"], found["differing"], found["open"]))
        open_ = summed.where(~F.col("same")).select("__bucket")
        if found["open"] <= leaf_rows or 2 * found["open"] > found["rows"]:
            break
    last = steps[-1][0]
    sides = [inside(side.withColumn("__key", key), open_, last).drop("__key") for side in (left, right)]
    skipped = total - found["open_left"]
    counts = value_diff(*sides, pk, cols, tolerance)
    counts = counts.withColumns({c: F.col(c) + F.lit(skipped).cast("bigint") for c in ("rows_equal", "rows_total_compared")})
    shown = left.sparkSession.createDataFrame(steps, "level int, buckets bigint, rows bigint, differing bigint, rows_differing bigint")
    return RefinedDiff(counts, value_diff_rows(*sides, pk, cols=cols, tolerance=tolerance), shown)


def value_diff_rows(
    left: DataFrame,
    right: DataFrame,
    pk: Sequence[str],
    kind: str | None = None,
    limit: int | None = None,
    cols: Sequence[str] | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """Differing rows with both versions as structs; ``limit`` samples the first keys in key order."""
    rows, _ = _classified(left, right, pk, _compared(left, right, pk, cols), tolerance)
    rows = rows.where(F.col("kind") == kind) if kind else rows.where(F.col("kind") != "equal")
    if limit is not None:
        rows = rows.orderBy(*[quoted(k) for k in pk]).limit(limit)
    return rows.select(*[quoted(k) for k in pk], "kind", F.col("__l").alias("left"), F.col("__r").alias("right"))


def changed_cells(
    left: DataFrame, right: DataFrame, pk: Sequence[str], cols: Sequence[str] | None = None, tolerance: float = 0.0
) -> DataFrame:
    """One row per changed cell of the keys both sides hold once: key, column, both values as text."""
    cols = _compared(left, right, pk, cols)
    rows, kinds = _classified(left, right, pk, cols, tolerance)
    cells = F.array(
        *[
            F.when(
                ~_equal(kinds, c, tolerance),
                F.struct(
                    F.lit(c).alias("column"),
                    F.col("__l")[c].cast("string").alias("left_value"),
                    F.col("__r")[c].cast("string").alias("right_value"),
                ),
            )
            for c in cols
        ]
    )
    changed = rows.where(F.col("kind") == "changed")
    return changed.select(
        *[quoted(k) for k in pk], F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("cell")
    ).select(*[quoted(k) for k in pk], "cell.*")


def changed_cells_by_column(cells: DataFrame) -> DataFrame:
    """Changed cells per column."""
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("changed"))


def environment_diff(
    left: DataFrame,
    right: DataFrame,
    mode: str = "schema_and_rowcount",
    pk: Sequence[str] | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Report rows ``(section, item, left, right, detail)`` for mode schema, schema_and_rowcount or full."""
    if mode not in ("schema", "schema_and_rowcount", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "full" and not pk:
        raise ValueError("a value diff needs a primary key")

    def section(name, df, item, l, r, detail):
        return df.select(
            F.lit(name).alias("section"), item.cast("string").alias("item"), l.cast("string").alias("left"),
            r.cast("string").alias("right"), detail.cast("string").alias("detail"),
        )

    parts = [section("schema", schema_diff(left, right), F.col("column"), F.col("left_type"), F.col("right_type"), F.col("change"))]
    if mode != "schema":
        counts = rowcount_diff(left, right)
        parts.append(section("row_count", counts, F.lit("total"), F.col("left_count"), F.col("right_count"), F.col("delta")))
        if group_by:
            groups = rowcount_diff_by(left, right, [group_by])
            parts.append(section("row_count_by", groups, quoted(group_by), F.col("left_count"), F.col("right_count"), F.col("delta")))
    if mode == "full":
        v = value_diff(left, right, pk)
        items = F.explode(
            F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in v.columns])
        )
        flat = v.select(items.alias("i"))
        nothing = F.lit(None)
        parts.append(section("value", flat, F.col("i.item"), nothing, nothing, F.col("i.n")))
    return reduce(DataFrame.unionByName, parts)
