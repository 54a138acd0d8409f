"""What a schema change touches: table and column changes, proposed tests, downstream risks, the verdict."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lineage import downstream
from plumbline.session import cut_lineage

# Paths that matter to data, as regular expressions.
DATA_PATHS = (
    r"(?i)\.sql$",
    r"^models/",
    r"^migrations/",
    r"^db/migrate/",
    r"^prisma/migrations/",
    r"dbt_project\.yml$",
    r"(?i)schema\.(rb|sql|prisma)$",
)
# Path fragments that also count when changes are fetched for the command line.
DATA_FRAGMENTS = ("models/", "migrations/", "macros/", "snapshots/", "seeds/")


#: Catalog rows that one task sorts; larger catalogs are dealt to more tasks, so that a task's memory does not grow with them.
TASK_ROWS = 200_000


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("__before", F.lit(True)).unionByName(after.withColumn("__before", F.lit(False)))


def _written(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both catalogs, worked out once."""
    pick = ["table", "column", "type"]
    return cut_lineage(_both(before.select(*pick), after.select(*pick)))


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables created or dropped between two catalogs ``(table, column, type)``."""
    return _table_changes(_both(before.select("table"), after.select("table")))


def _table_changes(both: DataFrame) -> DataFrame:
    sides = both.groupBy("table").agg(F.bool_or("__before").alias("was"), F.bool_or(~F.col("__before")).alias("is"))
    kind = F.when(~F.col("was"), "created").when(~F.col("is"), "dropped")
    return sides.select("table", kind.alias("kind")).where(F.col("kind").isNotNull())


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or retyped, with both types (compared exactly)."""
    return _column_changes(_written(before, after))


def _column_changes(both: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    parts = -(-both.count() // task_rows)
    if parts > int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(parts, "table", "column")
    sides = both.groupBy("table", "column").agg(
        F.max(F.when(F.col("__before"), F.col("type"))).alias("before"),
        F.max(F.when(~F.col("__before"), F.col("type"))).alias("after"),
    )
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "retyped")
    )
    return sides.withColumn("kind", kind).where(F.col("kind").isNotNull())


def suggest_from_changes(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Proposed tests for changed tables and columns: ``(table, column, suggestion)``."""
    name = F.concat("table", F.lit("."), "column")
    for_column = F.when(F.col("kind") == "added", F.concat(F.lit("column_not_null: "), name)).when(
        F.col("kind") == "retyped", F.concat(F.lit("column_values_castable: "), name, F.lit(" → "), "after")
    )
    for_table = F.when(F.col("kind") == "created", F.concat(F.lit("row_count_between: "), "table", F.lit(" (min: 1)"))).when(
        F.col("kind") == "dropped", F.concat(F.lit("no_references_left: "), "table")
    )
    rows = columns.select("table", "column", for_column.alias("suggestion")).unionByName(
        tables.select("table", F.lit(None).cast("string").alias("column"), for_table.alias("suggestion"))
    )
    return rows.where(F.col("suggestion").isNotNull())


def path_glob(glob: str) -> str:
    """Anchored regular expression of a path glob; ``**`` crosses folders, ``*`` and ``?`` do not."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p, re.escape(p)) for p in parts) + "$"


def select_changed_files(
    files: DataFrame,
    path_col: str = "path",
    patterns: Sequence[str] = DATA_PATHS,
    fragments: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Changed files that matter: a data path, inside the include globs if there are any, outside the exclude globs."""
    path = F.col(path_col)

    def any_of(conditions):
        return reduce(lambda a, b: a | b, conditions, F.lit(False))

    wanted = any_of([path.rlike(p) for p in patterns] + [path.contains(f) for f in fragments])
    if include:
        wanted = wanted & any_of([path.rlike(path_glob(g)) for g in include])
    if exclude:
        wanted = wanted & ~any_of([path.rlike(path_glob(g)) for g in exclude])
    return files.where(wanted)


def impact(before: DataFrame, after: DataFrame, edges: DataFrame | None = None, max_depth: int | None = 1) -> DataFrame:
    """Full report ``(section, table, column, kind, before, after, detail)``: changes, proposed tests, downstream risks."""
    both = _written(before, after)
    # Each is read several times.
    tables, columns = cut_lineage(_table_changes(both)), cut_lineage(_column_changes(both))
    none = F.lit(None).cast("string")

    def rows(section, df, table, column=none, kind=none, old=none, new=none, detail=none):
        return df.select(
            F.lit(section).alias("section"), table.alias("table"), column.alias("column"), kind.alias("kind"),
            old.alias("before"), new.alias("after"), detail.alias("detail"),
        )

    parts = [
        rows("table", tables, F.col("table"), kind=F.col("kind")),
        rows("column", columns, F.col("table"), F.col("column"), F.col("kind"), F.col("before"), F.col("after")),
        rows("suggestion", suggest_from_changes(tables, columns), F.col("table"), F.col("column"), detail=F.col("suggestion")),
    ]
    if edges is not None:
        fed = downstream(edges, tables.select("table"), max_depth)
        risk = F.concat("origin", F.lit(" → "), "node")
        parts.append(rows("risk", fed, F.col("origin"), kind=F.lit("downstream"), detail=risk))
    return reduce(DataFrame.unionByName, parts)


def impact_conclusion(report: DataFrame, change_set: str = "change_set") -> DataFrame:
    """Verdict per change set: failure on risks or parse failures, neutral on any change, else success.

    ``report`` has a ``section`` column (risk, parse_failure, table, column, ...) next to the change set.
    """
    section = F.col("section")
    counted = report.groupBy(change_set).agg(
        F.count_if(section == "risk").alias("risks"),
        F.count_if(section == "parse_failure").alias("parse_failures"),
        F.count_if(section.isin("table", "column")).alias("changes"),
    )
    verdict = (
        F.when((F.col("risks") > 0) | (F.col("parse_failures") > 0), "failure")
        .when(F.col("changes") > 0, "neutral")
        .otherwise("success")
    )
    return counted.withColumn("conclusion", verdict)
