"""Flat files in, JSON lines out, and the views over a directory of files."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VIEW_NAME = re.compile(r"[A-Za-z0-9_-]+")
_SUFFIXES = (".csv", ".tsv", ".parquet", ".json", ".ndjson", ".jsonl")


def _suffix(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + tail.rsplit(".", 1)[-1].lower() if "." in tail else ""


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read one flat file or directory, the reader chosen by suffix.

    CSV types are inferred only when no ``schema`` is given; at scale pass one, inference reads the file twice.
    """
    suffix = _suffix(path)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if suffix in (".csv", ".tsv"):
        separator = "\t" if suffix == ".tsv" else ","
        return reader.csv(path, header=True, sep=options.get("sep", separator), inferSchema=schema is None)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".json":
        return reader.json(path, multiLine=True)
    if suffix in (".ndjson", ".jsonl"):
        return reader.json(path)
    raise ValueError(f"unsupported file type {suffix!r}: {path}")


def _view_name(name: str) -> str:
    if not _VIEW_NAME.fullmatch(name):
        raise ValueError(f"view names may hold letters, digits, '_' and '-' only: {name!r}")
    return name


def register_views(spark: SparkSession, mapping: Mapping[str, str]) -> list[str]:
    """Register ``{view: path}``; returns the view names in order."""
    for name, path in mapping.items():
        read_file(spark, path).createOrReplaceTempView(f"`{_view_name(name)}`")
    return list(mapping)


def register_dir(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None) -> list[str]:
    """Register every supported file of a directory (or the one file given) as a view named by its stem, in name order.

    An explicit ``mapping`` overrides the directory scan.
    """
    if mapping:
        return register_views(spark, mapping)
    base = path.rstrip("/")
    if "://" not in base:
        base = os.path.abspath(base)
    # Through the store's own listing: direct children only, whatever the store; a table may be a file or a folder of files.
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(base)
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    if store.getFileStatus(root).isFile():
        return register_views(spark, {_stem(base): base})
    entries = sorted(status.getPath().getName() for status in store.listStatus(root))
    return register_views(spark, {_stem(e): f"{base}/{e}" for e in entries if _suffix(e) in _SUFFIXES})


def list_tables(spark: SparkSession) -> DataFrame:
    """Names and kinds of the tables and views of the session."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def describe(df: DataFrame) -> DataFrame:
    """Ordinal, name, type, nullability and primary-key mark (from field metadata) of every column."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, bool(f.metadata.get("primary_key", False)))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, type string, nullable boolean, primary_key boolean"
    )


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None, ts_col: str | None = None) -> None:
    """Append ``df`` as JSON lines, partitioned by a column or by the date of ``ts_col``."""
    if ts_col is not None:
        partition_by = partition_by or "date"
        df = df.withColumn(partition_by, F.to_date(F.col(ts_col)))
    writer = df.write.mode("append")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.json(path)
