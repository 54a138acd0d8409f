"""Schemaless JSON documents held in one string column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct keys that a flattened table of documents may have.
MAX_KEYS = 10_000


def _field(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def infer_document_schema(df: DataFrame, json_col: str, sample: float | None = None) -> DataFrame:
    """Type of every top-level key over all documents; ``mixed`` where documents disagree.

    JSON nulls do not vote. ``sample`` is an opt-in fraction; the default reads every document.
    """
    if sample is not None:
        df = df.sample(fraction=sample, seed=0)
    # The documents become variants once; min and max of the type name replace a distinct count.
    docs = df.select(F.try_parse_json(F.col(json_col)).alias("doc")).where(F.col("doc").isNotNull())
    fields = docs.lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("doc").outer())
    ).select("key", F.schema_of_variant("value").alias("type")).where(F.col("key").isNotNull())
    voted = F.when(F.col("type") != "VOID", F.col("type"))
    return fields.groupBy("key").agg(F.min(voted).alias("lo"), F.max(voted).alias("hi")).select(
        "key",
        F.when(F.col("lo") != F.col("hi"), "mixed").otherwise(F.coalesce("lo", F.lit("VOID"))).alias("type"),
        F.lit(True).alias("nullable"),
    )


def _matches(json_col: str, filter: Mapping[str, object]) -> Column:
    doc = F.try_parse_json(F.col(json_col))
    condition = F.lit(True)
    for key, value in filter.items():
        if value is None:
            hit = F.try_variant_get(doc, _field(key), "string").isNull()
        else:
            hit = _equals(doc, _field(key), value)
        condition = condition & hit
    return condition


def _equals(doc: Column, path: str, value: object) -> Column:
    """The member has the value's own type and equals it; numbers compare as numbers, whole or not."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(doc, path, "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        real = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(doc, path, "double") == F.lit(float(value)))
        if float(value) != int(value):
            return real
        return real | ((kind == "BIGINT") & (F.try_variant_get(doc, path, "bigint") == F.lit(int(value))))
    return (kind == "STRING") & (F.try_variant_get(doc, path, "string") == F.lit(str(value)))


def doc_find(
    df: DataFrame,
    json_col: str,
    filter: Mapping[str, object] | None = None,
    limit: int | None = None,
    keep: tuple[str, ...] = (),
    keys: Mapping[str, str] | None = None,
    max_keys: int = MAX_KEYS,
) -> DataFrame:
    """Documents equal to ``filter`` on its keys, flattened to the union of keys (missing becomes null).

    ``keys`` (name -> type) skips the inference pass. ``keep`` carries columns along and orders a ``limit``. More than ``max_keys``
    distinct keys are an error, since each becomes a column: such documents are tables of members (``doc_members``).
    """
    found = df.where(_matches(json_col, filter or {}))
    if limit is not None:
        found = (found.orderBy(*keep) if keep else found).limit(limit)
    if keys is None:
        # One row per distinct key, the size of a schema; what is no schema is not collected.
        inferred = infer_document_schema(found, json_col).orderBy("key").limit(max_keys + 1).collect()
        if len(inferred) > max_keys:
            raise ValueError(f"more than {max_keys} distinct keys: name the ones wanted, or take the documents as members")
        keys = {row["key"]: row["type"] for row in inferred}
    # Parsed once per document, then taken apart.
    parsed = found.select(*keep, F.try_parse_json(F.col(json_col)).alias("__doc"))
    doc = F.col("__doc")
    plain = {"BIGINT", "DOUBLE", "BOOLEAN"}
    values = [
        F.try_variant_get(doc, _field(key), kind if kind in plain else "string").alias(key)
        for key, kind in keys.items()
    ]
    return parsed.select(*keep, *values)


def doc_members(df: DataFrame, json_col: str, filter: Mapping[str, object] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per top-level member of the documents equal to ``filter``: the ``keep`` columns, key, value as text and type.

    Any number of distinct keys, none of them on the driver. JSON nulls are members without a value.
    """
    found = df.where(_matches(json_col, filter or {})).select(*keep, F.try_parse_json(F.col(json_col)).alias("__doc"))
    members = found.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__doc").outer()))
    return members.select(*keep, "key", F.try_variant_get("value", "$", "string").alias("value"), F.schema_of_variant("value").alias("type"))


def doc_count(df: DataFrame, json_col: str, filter: Mapping[str, object] | None = None) -> DataFrame:
    """Number of documents equal to ``filter`` on its keys."""
    return df.where(_matches(json_col, filter or {})).agg(F.count(F.lit(1)).alias("n"))
