"""Declarative expectations: one fused scan for everything scalar, one grouped job per uniqueness or reference check."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from decimal import Decimal
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

from plumbline.operators.profile import quoted

RESULT = "ordinal int, expectation string, column string, passed boolean, observed string, expected string, message string"


def load_spec(path: str) -> dict:
    """One spec from a YAML file: ``table`` and a list of ``expectations``."""
    import yaml

    return yaml.safe_load(Path(path).read_text())


def load_specs(directory: str) -> dict[str, dict]:
    """All specs of a directory, ``*.yaml`` before ``*.yml``, keyed by file stem."""
    folder = Path(directory)
    files = sorted(folder.glob("*.yaml")) + sorted(folder.glob("*.yml"))
    return {f.stem: load_spec(str(f)) for f in files}


def _row(ordinal: int, name: str, column: str | None, passed: Column, observed: Column, expected: Column, message: Column) -> Column:
    return F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.lit(name).alias("expectation"),
        F.lit(column).cast("string").alias("column"),
        passed.alias("passed"),
        observed.cast("string").alias("observed"),
        expected.cast("string").alias("expected"),
        F.coalesce(message, F.lit("")).alias("message"),
    )


def _columns_of(name: str, args) -> list[str]:
    if name == "row_count_between":
        return []
    column = args["column"] if isinstance(args, Mapping) else args
    return list(column) if isinstance(column, (list, tuple)) else [column]


def _count_message(count: Column, before: str, after: str) -> Column:
    return F.when(count > 0, F.concat(F.lit(before), count.cast("string"), F.lit(after)))


def _bounds(args: Mapping) -> str:
    return f"min={args.get('min', 0)}, max={args.get('max', 'inf')}"


def _plain_number(text: str) -> str:
    """A whole number without a fraction, so that 3.0 is a member for whole columns too; other texts as they are."""
    try:
        number = Decimal(text)
        return str(int(number)) if number == number.to_integral_value() else text
    except (ArithmeticError, ValueError):
        return text


def _scalar(ordinal: int, name: str, args, as_of: Column, kind: DataType | None = None):
    """(aggregate, function from the aggregated column to a result row) of a scalar expectation."""
    if name == "row_count_between":
        low, high = args.get("min", 0), args.get("max")

        def bounded(n: Column) -> Column:
            passed = n >= F.lit(low)
            if high is not None and high != float("inf"):
                passed = passed & (n <= F.lit(high))
            return _row(ordinal, name, None, passed, n, F.lit(_bounds(args)), F.lit(None))

        return F.count(F.lit(1)), bounded

    column = ",".join(_columns_of(name, args))
    value = quoted(column)

    def zero(suffix: str):
        def row(n: Column) -> Column:
            return _row(ordinal, name, column, n == 0, n, F.lit("0"), _count_message(n, "", suffix))

        return row

    if name in CUSTOM:
        return CUSTOM[name](args), zero(" violation(s)")
    if name == "column_not_null":
        return F.count_if(value.isNull()), zero(f" null(s) in '{column}'")
    if name == "column_values_in_set":
        allowed = [str(v) for v in args["set"]]
        # Values compare in the column's type; a member that is no such value matches nothing.
        members = [F.lit(_plain_number(v) if isinstance(kind, NumericType) else v) for v in allowed]
        if kind is not None and not isinstance(kind, StringType):
            members = [member.try_cast(kind) for member in members]
        inside = F.lit(False)
        for member in members:
            inside = inside | F.coalesce(value == member, F.lit(False))
        return F.count_if(value.isNotNull() & ~inside), zero(f" value(s) outside {allowed!r}")
    if name == "column_values_castable":
        bad = value.isNotNull() & value.try_cast(args["type"]).isNull()
        return F.count_if(bad), zero(f" value(s) not castable to {args['type']}")
    if name == "column_freshness_seconds":
        limit = args["max"]

        def fresh(newest: Column) -> Column:
            micros = F.unix_micros(as_of) - F.unix_micros(newest.cast("timestamp"))
            age = (micros / F.lit(1_000_000)).cast("decimal(20,6)")
            return _row(
                ordinal, name, column, F.coalesce(age, F.lit(0)) <= F.lit(limit), age, F.lit(f"max={limit}"),
                F.when(newest.isNull(), F.lit("no value, counted as age 0")),
            )

        return F.max(value), fresh
    return None


CUSTOM: dict[str, Callable[..., Column]] = {}


def register_expectation(name: str, violations: Callable[..., Column]) -> None:
    """Add an expectation: a function from its arguments to an aggregate that counts violations; it passes at zero.

    It joins the fused scan of ``check`` like the built-in ones.
    """
    if name in SCALAR or name in GROUPED:
        raise ValueError(f"{name!r} is built in")
    CUSTOM[name] = violations


SCALAR = ("row_count_between", "column_not_null", "column_values_in_set", "column_values_castable", "column_freshness_seconds")
GROUPED = ("column_unique", "foreign_key")


def _unique(df: DataFrame, ordinal: int, columns: list[str]) -> DataFrame:
    duplicated = (
        df.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    label = ",".join(columns)
    n = F.col("n")
    row = _row(ordinal, "column_unique", label, n == 0, n, F.lit("0"), _count_message(n, "", f" duplicated value(s) in '{label}'"))
    return duplicated.select(row.alias("row"))


def _foreign_key(df: DataFrame, ordinal: int, args: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    column, parent = args["column"], tables[args["ref_table"]]
    # Children are counted per key first, so a hot key crosses the shuffle as one row.
    children = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    keys = parent.select(quoted(args["ref_column"]).alias("__key")).distinct()
    orphans = children.join(keys, "__key", "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))
    n = F.col("n")
    target = f"{args['ref_table']}.{args['ref_column']}"
    row = _row(ordinal, "foreign_key", column, n == 0, n, F.lit("0"), _count_message(n, "", f" row(s) without parent in {target}"))
    return orphans.select(row.alias("row"))


def _failed(df: DataFrame, ordinal: int, name: str, column: str | None, message: str) -> DataFrame:
    row = (ordinal, name, column, False, None, None, message)
    return df.sparkSession.createDataFrame([row], RESULT).select(F.struct("*").alias("row"))


def check(
    df: DataFrame,
    spec: Mapping | Sequence[Mapping],
    as_of: datetime | str | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run a spec against a table, one row per expectation.

    All scalar expectations share one aggregate over one scan. ``as_of`` replaces the clock for freshness.
    """
    expectations = spec["expectations"] if isinstance(spec, Mapping) else spec
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    aggregates, rows, parts = [], [], []
    for ordinal, expectation in enumerate(expectations, start=1):
        name, args = next(iter(expectation.items()))
        if name not in SCALAR and name not in GROUPED and name not in CUSTOM:
            parts.append(_failed(df, ordinal, name, None, f"unknown expectation: {name!r}"))
            continue
        columns = _columns_of(name, args)
        missing = [c for c in columns if c not in df.columns]
        if missing:
            parts.append(_failed(df, ordinal, name, ",".join(columns), f"unknown column: {missing[0]!r}"))
        elif name == "column_unique":
            parts.append(_unique(df, ordinal, columns))
        elif name == "foreign_key":
            if not tables or args["ref_table"] not in tables:
                parts.append(_failed(df, ordinal, name, columns[0], f"unknown table: {args['ref_table']!r}"))
            else:
                parts.append(_foreign_key(df, ordinal, args, tables))
        else:
            kind = df.schema[columns[0]].dataType if len(columns) == 1 else None
            aggregate, make = _scalar(ordinal, name, args, now, kind)
            aggregates.append(aggregate.alias(f"__{ordinal}"))
            rows.append(make(F.col(f"__{ordinal}")))
    if aggregates:
        parts.insert(0, df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("row")))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, [p.select("row.*") for p in parts])


def report_passed(results: DataFrame) -> DataFrame:
    """Verdict over the rows of ``check``: passed only when every expectation passed."""
    return results.agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.every("passed"), F.lit(True)).alias("ok"),
    )


def check_suite(
    tables: Mapping[str, DataFrame], specs: Mapping[str, Mapping], as_of: datetime | str | None = None
) -> DataFrame:
    """Every spec against its table: passed and total per spec, and whether the table may ship."""
    parts = []
    for stem, spec in specs.items():
        table = spec["table"]
        if table in tables:
            results = check(tables[table], spec, as_of, tables)
            counted = report_passed(results).select(
                F.lit(stem).alias("spec"), F.lit(table).alias("table"), "passed", "total", "ok"
            )
        else:
            spark = next(iter(tables.values())).sparkSession
            total = len(spec["expectations"])
            counted = spark.createDataFrame(
                [(stem, table, 0, total, False)], "spec string, table string, passed bigint, total bigint, ok boolean"
            )
        parts.append(counted)
    return reduce(DataFrame.unionByName, parts)


def suite_verdict(suite: DataFrame) -> DataFrame:
    """Overall verdict of a suite with the failing tables in name order."""
    return suite.agg(
        F.count_if("ok").alias("specs_passed"),
        F.count(F.lit(1)).alias("specs_total"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("table")))), ", ").alias("failing_tables"),
        F.every("ok").alias("release"),
    )
