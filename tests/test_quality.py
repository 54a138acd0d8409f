import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import diff, expect, profile, sketches, suggest

ORDERS = "order_id long, customer_id long, status string, currency string, total_amount double"


@pytest.fixture(scope="module")
def shop(spark):
    data = [(1, 10, "paid", "USD", 99.5), (2, 11, "pending", "EUR", 15.0), (3, 10, "shipped", "GBP", 250.0), (4, 12, "paid", "USD", 1.0), (5, 10, "refunded", "USD", 7.0)]
    return spark.createDataFrame(data, ORDERS)


def test_shop_spec_passes(shop, tmp_path):
    (tmp_path / "orders.yaml").write_text(
        "table: orders\nexpectations:\n  - row_count_between: {min: 1, max: 1000000}\n  - column_not_null: order_id\n  - column_not_null: customer_id\n"
        "  - column_not_null: status\n  - column_unique: order_id\n  - column_values_in_set: {column: status, set: [paid, pending, shipped, refunded, cancelled]}\n"
        "  - column_values_in_set: {column: currency, set: [USD, EUR, GBP, JPY, CAD, AUD]}\n"
    )
    specs = expect.load_specs(str(tmp_path))
    results = expect.check(shop, specs["orders"])
    assert results.count() == 7 and results.where("NOT passed").count() == 0
    verdict = expect.suite_verdict(expect.check_suite({"orders": shop}, specs)).first()
    assert verdict["release"] and verdict["failing_tables"] == ""


def test_failures_are_named(spark, shop):
    dirty = shop.union(spark.createDataFrame([(5, None, None, "XXX", None), (None, 1, "paid", "USD", 1.0), (None, 1, "paid", "USD", 1.0)], ORDERS))
    spec = [
        {"column_not_null": "status"}, {"column_unique": "order_id"}, {"column_values_in_set": {"column": "currency", "set": ["USD", "EUR", "GBP"]}},
        {"no_such_rule": "x"}, {"column_not_null": "no_such_column"}, {"foreign_key": {"column": "customer_id", "ref_table": "c", "ref_column": "id"}},
    ]
    parents = spark.createDataFrame([(10,), (11,), (10,)], "id long")
    got = {r["ordinal"]: r for r in expect.check(dirty, spec, tables={"c": parents}).collect()}
    assert [got[i]["observed"] for i in (1, 2, 3, 6)] == ["1", "2", "1", "3"]
    assert got[1]["message"] == "1 null(s) in 'status'"
    assert got[4]["message"] == "unknown expectation: 'no_such_rule'" and not got[4]["passed"]
    assert got[5]["message"] == "unknown column: 'no_such_column'"
    assert not expect.report_passed(expect.check(dirty, spec, tables={"c": parents})).first()["ok"]


def test_custom_expectation(shop):
    expect.register_expectation("column_positive", lambda args: F.count_if(F.col(args["column"]) <= args.get("above", 0)))
    got = expect.check(shop, [{"column_positive": {"column": "total_amount"}}, {"column_positive": {"column": "total_amount", "above": 10}}]).collect()
    assert [(r["passed"], r["observed"]) for r in got] == [(True, "0"), (False, "2")] and got[1]["message"] == "2 violation(s)"
    with pytest.raises(ValueError):
        expect.register_expectation("column_unique", F.count)


def test_freshness(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    rule = [{"column_freshness_seconds": {"column": "t", "max": 60}}]
    assert expect.check(df, rule, as_of="2026-01-01 00:01:00").first()["passed"]
    assert not expect.check(df, rule, as_of="2026-01-01 00:01:01").first()["passed"]
    empty = expect.check(df.where("false"), rule, as_of="2026-01-01 00:00:00").first()
    assert empty["passed"] and empty["observed"] is None and "age 0" in empty["message"]


def test_suite_with_missing_table(shop):
    suite = expect.check_suite({"orders": shop}, {"a": {"table": "orders", "expectations": [{"row_count_between": {"min": 1}}]}, "b": {"table": "gone", "expectations": []}})
    assert rows(suite, "spec", "ok") == [("a", True), ("b", False)]


def test_profile_of_shop(shop):
    by_column = {r["column"]: r for r in profile.profile(shop, approx=False).collect()}
    assert by_column["order_id"]["semantic_type"] == "identifier" and by_column["total_amount"]["semantic_type"] == "money"
    assert by_column["status"]["top_values"][0] == ("paid", 2) and by_column["status"]["enum_values"] == ["paid", "pending", "refunded", "shipped"]
    assert by_column["total_amount"]["min"] == 1.0 and by_column["total_amount"]["p50"] == 15.0
    assert by_column["status"]["avg_length"] == pytest.approx((4 + 7 + 7 + 4 + 8) / 5)
    one_pass = {r["column"]: r for r in profile.profile(shop, approx=True).collect()}
    assert {c: r["top_values"] for c, r in one_pass.items()} == {c: r["top_values"] for c, r in by_column.items()}
    assert {c: r["enum_values"] for c, r in one_pass.items()} == {c: r["enum_values"] for c, r in by_column.items()}


def test_profile_leaks_nothing(spark):
    data = [(1, "ann@example.com", "Ann A", "call 415-555-0100", "gold"), (2, "bob@example.com", "Bob B", None, "gold"), (3, "cy@example.com", "Cy C", "none", "free")]
    customers = spark.createDataFrame(data, "customer_id long, email string, full_name string, remark string, tier string")
    for approx in (False, True):
        whole = profile.table_profile(customers, ["customer_id"], approx=approx)
        columns = {r["column"]: r for r in whole.columns.collect()}
        assert len(columns) == 5 and columns["email"]["distinct_count"] == 3 and columns["email"]["enum_values"] is None
        assert [v["value"] for v in columns["email"]["top_values"]] == ["[REDACTED:EMAIL]"] * 3
        assert sorted(v["value"] for v in columns["remark"]["top_values"]) == ["[REDACTED:PHONE]", "none"]
        assert columns["tier"]["enum_values"] == ["free", "gold"] and columns["tier"]["top_values"][0] == ("gold", 2)
        assert columns["customer_id"]["top_values"][0] == ("1", 1)
        text = str(columns) + str(whole.sample.collect())
        assert "example.com" not in text and "415-555" not in text and "Ann A" not in text
        assert dict(rows(whole.pii)) == {"EMAIL": 6, "PERSON": 3, "PHONE": 1}
    raw = {r["column"]: r for r in profile.profile(customers, approx=False, policy=None).collect()}
    assert len(raw["email"]["enum_values"]) == 3


def test_empty_table(shop):
    empty = profile.profile(shop.where("false"), approx=False)
    assert empty.count() == 5
    assert empty.where("row_count = 0 AND null_rate IS NULL AND distinct_count IS NULL AND top_values IS NULL").count() == 5
    # What follows from the names alone is still proposed.
    assert rows(suggest.suggest(empty, "orders"), "expectation", "column") == [("column_not_null", "customer_id"), ("column_not_null", "order_id")]


@pytest.mark.parametrize("name,kind,meaning", [
    ("user_id", "string", "identifier"), ("id", "int", "identifier"), ("valid_from", "string", "identifier"), ("created_at", "string", "timestamp"),
    ("is_active", "boolean", "boolean"), ("total_amount", "double", "money"), ("n", "int", "number"), ("full_name", "string", "freetext"),
    ("tier", "string", "category"), ("o_orderdate", "timestamp", "unknown"),
])
def test_semantic_types(spark, name, kind, meaning):
    df = spark.createDataFrame([], f"{name} {kind}")
    assert profile.semantic_types(df).first()["semantic_type"] == meaning


def test_semantic_types_by_type(spark):
    df = spark.createDataFrame([], "o_orderdate timestamp, flagged boolean")
    assert [r["semantic_type"] for r in profile.semantic_types(df, "name+type").collect()] == ["timestamp", "boolean"]


def test_suggestions_round_trip(shop):
    spec = suggest.to_spec(suggest.suggest(profile.profile(shop, approx=False), "orders"))
    assert {"column_unique": "order_id"} in spec["expectations"] and {"row_count_between": {"min": 1, "max": 50}} in spec["expectations"]
    assert expect.check(shop, spec).where("NOT passed").count() == 0


def test_diff_of_a_table_with_itself(shop):
    assert rows(diff.value_diff(shop, shop, ["order_id"])) == [(0, 0, 0, 5, 0, 5)]
    assert diff.bucket_checksum_diff(shop, shop, ["order_id"]).count() == 0
    assert diff.changed_cells(shop, shop, ["order_id"]).count() == 0
    assert diff.schema_diff(shop, shop).count() == 0
    assert rows(diff.rowcount_diff(shop, shop)) == [(5, 5, 0, 0.0)]


def test_diff_of_changed_tables(spark, shop):
    right = shop.where("order_id <> 1").withColumn("status", F.when(F.col("order_id") == 2, None).otherwise(F.col("status"))).withColumn(
        "total_amount", F.col("total_amount") + F.when(F.col("order_id") == 3, 0.001).otherwise(0.0))
    right = right.union(spark.createDataFrame([(None, 1, "x", "USD", 0.0), (4, 12, "paid", "USD", 1.0)], ORDERS))
    assert rows(diff.value_diff(shop, right, ["order_id"])) == [(1, 1, 2, 1, 1, 5)]
    assert rows(diff.value_diff(shop, right, ["order_id"], tolerance=0.01)) == [(1, 1, 1, 2, 1, 5)]
    assert rows(diff.value_diff(shop, right, ["order_id"], prefilter=64), "rows_only_left", "rows_only_right", "rows_changed") == [(1, 1, 2)]
    assert rows(diff.value_diff_rows(shop, right, ["order_id"], kind="only_left"), "order_id") == [(1,)]
    assert diff.value_diff_rows(shop, right, ["order_id"], limit=2).count() == 2
    assert rows(diff.changed_cells(shop, right, ["order_id"], tolerance=0.01)) == [(2, "status", "pending", None)]


def test_null_safe_keys(spark):
    left = spark.createDataFrame([(None, 1, "a"), (1, None, "b")], "k long, j long, v string")
    right = spark.createDataFrame([(None, 1, "A"), (1, None, "b")], "k long, j long, v string")
    assert rows(diff.value_diff(left, right, ["k", "j"])) == [(0, 0, 1, 1, 0, 2)]


def test_growth_from_nothing(shop):
    assert rows(diff.rowcount_diff(shop.where("false"), shop), "delta_pct") == [(float("inf"),)]
    assert rows(diff.rowcount_diff(shop.where("false"), shop.where("false")), "delta_pct") == [(0.0,)]
    assert rows(diff.rowcount_diff_by(shop, shop.where("status <> 'paid'"), ["status"]).where("delta <> 0")) == [("paid", 2, 0, -2)]


def test_environment_modes(shop):
    assert diff.environment_diff(shop, shop.drop("status"), "schema").count() == 1
    with pytest.raises(ValueError):
        diff.environment_diff(shop, shop, "full")
    with pytest.raises(ValueError):
        diff.environment_diff(shop, shop, "other")
    assert diff.environment_diff(shop, shop, "full", ["order_id"], "status").count() == 1 + 4 + 6


def test_schema_diff(spark):
    left = spark.createDataFrame([], "a int, b string, c long")
    right = spark.createDataFrame([], "a bigint, c long, d string")
    assert rows(diff.schema_diff(left, right)) == [("added", "d", None, "string"), ("removed", "b", "string", None), ("retyped", "a", "int", "bigint")]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b` int, `c d` string")
    assert rows(profile.null_rates(df), "column", "null_count") == [("a.b", 0), ("c d", 1)]
    assert profile.profile(df).count() == 2 and diff.value_diff(df, df, ["a.b"]).first()["rows_equal"] == 2


def test_stored_sketches_equal_one_pass(spark, tmp_path):
    """Parts stored day by day and merged: exact where one pass is exact, inside the stated errors elsewhere; a part can be sketched anew."""
    df = spark.range(60_000).select(
        (F.col("id") % 7).cast("int").alias("day"), F.col("id").alias("key"), (F.col("id") * 7919 % 10_007).cast("double").alias("x"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id") % 40)).alias("label"), F.lit(None).cast("string").alias("none"))
    path = str(tmp_path / "sketches")
    for day in range(7):
        part = df.where(F.col("day") == day)
        sketches.store(sketches.sketch(part if day != 3 else part.limit(5), ["day"]), path, ["day"])
    sketches.store(sketches.sketch(df.where("day = 3"), ["day"]), path, ["day"])
    stored = spark.read.parquet(path)
    assert stored.groupBy("day").count().where("count <> 4").isEmpty()
    for some in (stored, stored.where("day IN (1, 3)")):
        part = df if some is stored else df.where("day IN (1, 3)")
        found = {r["column"]: r for r in sketches.profile_of(some).collect()}
        exact = {r["column"]: r for r in profile.profile(part.drop("day"), approx=False, policy=None).collect()}
        assert set(found) == set(exact)
        for name, row in found.items():
            want = exact[name]
            assert [row[c] for c in ("row_count", "null_count", "null_rate", "min", "max", "min_length", "max_length")] == [
                want[c] for c in ("row_count", "null_count", "null_rate", "min", "max", "min_length", "max_length")]
            assert abs(row["distinct_count"] - want["distinct_count"]) <= 4 * sketches.DISTINCT_ERROR * want["distinct_count"]
            if want["mean"] is not None:
                assert abs(row["mean"] - want["mean"]) < 1e-9 * abs(want["mean"])
        assert [(t["value"], t["count"]) for t in found["label"]["top_values"]] == [(t["value"], t["count"]) for t in exact["label"]["top_values"]]
        total = part.count()
        for prob, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            below, upto = part.agg(F.count_if(F.col("x") < found["x"][name]), F.count_if(F.col("x") <= found["x"][name])).first()
            assert below - 2 * sketches.RANK_ERROR * total <= prob * total <= upto + 2 * sketches.RANK_ERROR * total
    by_day = sketches.profile_of(stored, ["day"]).where("column = 'key'").select("day", "row_count")
    assert rows(by_day) == rows(df.groupBy("day").count())


def test_refined_diff_reads_only_what_differs(spark):
    left = spark.range(50_000).select("id", (F.col("id") % 100).alias("n"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    right = left.where("id <> 77 AND id <> 40000").withColumn("n", F.when(F.col("id").isin(5, 9_000), -1).otherwise(F.col("n"))).unionByName(
        spark.createDataFrame([(60_001, 1, "new"), (123, 23, "t123")], "id long, n long, t string"))
    found = diff.refined_diff(left, right, ["id"], fanout=16, leaf_rows=50, levels=5)
    assert rows(found.counts) == rows(diff.value_diff(left, right, ["id"]))
    assert rows(found.rows) == rows(diff.value_diff_rows(left, right, ["id"]))
    levels = found.levels.orderBy("level").collect()
    assert levels[0]["rows"] == 50_000 + 50_000 and levels[0]["differing"] <= 6 and len(levels) >= 3
    assert all(b["rows"] == a["rows_differing"] <= a["rows"] * 0.6 for a, b in zip(levels, levels[1:])) and levels[-1]["rows_differing"] <= 50 * 4
    same = diff.refined_diff(left, left, ["id"])
    assert same.rows.isEmpty() and same.levels.count() == 1 and same.counts.first()["rows_equal"] == 50_000
    nothing = diff.refined_diff(left.limit(0), left.limit(0), ["id"])
    assert nothing.counts.first()["rows_total_compared"] == 0
    # Where everything differs, the first level ends the refinement.
    other = diff.refined_diff(left, left.withColumn("n", F.col("n") + 1), ["id"], leaf_rows=10)
    assert other.levels.count() == 1 and other.counts.first()["rows_changed"] == 50_000


def test_top_values_of_many_are_counted(spark):
    """A sketch of 10,000 values gives a wrong count, or none, for a column of far more; counted, all are right."""
    df = spark.range(60_000).select(
        "id", F.when(F.col("id") % 10_007 == 3, F.lit(7)).otherwise(F.col("id")).alias("nearly"), (F.col("id") % 50).alias("few"))
    exact = profile.profile(df, approx=False, policy=None)
    found = profile.profile(df, policy=None, exact_top=True)
    assert rows(found, "column", "top_values", "enum_values") == rows(exact, "column", "top_values", "enum_values")
