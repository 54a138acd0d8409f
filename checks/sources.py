"""Sources, views and JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import load
from checks.compare import TABLES
from plumbline.operators.profile import row_count
from plumbline.sources.documents import doc_count, doc_find, infer_document_schema
from plumbline.sources.exports import parse_export
from plumbline.sources.files import read_file, register_dir, register_views

FILTER = {"k": 69}


def _read_file(spark, sf):
    return read_file(spark, f"{sf}/customer.parquet")


def _register_dir(spark, sf):
    names = register_dir(spark, sf)
    counts = [row_count(spark.table(f"`{n}`")).select(F.lit(n).alias("table_name"), "row_count") for n in names]
    return reduce(DataFrame.unionByName, counts)


def _register_views(spark, sf):
    register_views(spark, {"sales": f"{sf}/orders.parquet", "buyers": f"{sf}/customer.parquet"})
    return spark.sql(
        "SELECT c_mktsegment, count(*) AS n FROM sales JOIN buyers ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )


def _mixed_docs(events):
    """Event properties with a second key whose type differs between documents."""
    body = F.when(
        F.col("event_id") % 3 == 0,
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("tag"), F.col("event_type").alias("kind"))),
    ).otherwise(
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("user_id").alias("tag")))
    )
    return events.withColumn("doc", body)


def _infer(spark, sf):
    return infer_document_schema(_mixed_docs(load(spark, sf, "events")), "doc")


def _find(spark, sf):
    docs = _mixed_docs(load(spark, sf, "events"))
    return doc_find(docs, "doc", FILTER, keep=("event_id",))


def _count(spark, sf):
    return doc_count(load(spark, sf, "events"), "props", FILTER)


def _export_json(spark, sf):
    """One payload per customer: a list, an object with data, or a single object."""
    orders = load(spark, sf, "orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    rest = F.col("o_orderkey") % 3
    body = (
        F.when(rest == 0, F.to_json(F.array(row, row)))
        .when(rest == 1, F.concat(F.lit('{"data":'), F.to_json(F.array(row)), F.lit("}")))
        .otherwise(F.to_json(row))
    )
    return parse_export(orders.select("o_custkey", body.alias("body")), "body", "json", "id bigint, status string", ("o_custkey",))


def _export_csv(spark, sf):
    orders = load(spark, sf, "orders")
    body = F.concat(
        F.lit("id,status,note\n"), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderstatus"),
        F.lit(',"a, ""b""\nc"\n'), F.col("o_orderkey").cast("string"), F.lit(",Z,plain\n"),
    )
    return parse_export(orders.select(body.alias("body")), "body", "csv", "id bigint, status string, note string")


QUERIES = {
    "read_file": _read_file,
    "register_directory": _register_dir,
    "register_view_mapping": _register_views,
    "document_schema": _infer,
    "document_find": _find,
    "document_count": _count,
    "export_json_rows": _export_json,
    "export_csv_rows": _export_csv,
}

ORACLES = {
    "read_file": "SELECT * FROM customer",
    "register_directory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    "register_view_mapping": """
        SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "document_schema": """
        WITH t AS (
            SELECT 'k' AS key, 'BIGINT' AS type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
            UNION ALL SELECT 'tag', CASE WHEN event_id % 3 = 0 THEN 'STRING' ELSE 'BIGINT' END FROM events
            UNION ALL SELECT 'kind', 'STRING' FROM events WHERE event_id % 3 = 0)
        SELECT key, CASE WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE min(type) END AS type, true AS nullable
        FROM t GROUP BY key""",
    "document_find": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CASE WHEN event_id % 3 = 0 THEN event_type END AS kind,
               CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS tag
        FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 69""",
    "document_count": "SELECT count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 69",
    "export_json_rows": """
        SELECT o_custkey, o_orderkey AS id, o_orderstatus AS status FROM orders
        UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0""",
    "export_csv_rows": """
        SELECT o_orderkey AS id, o_orderstatus AS status, 'a, "b"' || chr(10) || 'c' AS note FROM orders
        UNION ALL SELECT o_orderkey, 'Z', 'plain' FROM orders""",
}
