import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import asof, govern
from plumbline.plans import governed

REQUEST = "id int, assistant_id string, connection string, tags array<string>, read_only boolean, tool string, sql struct<is_select: boolean, kind: string, touches: array<string>, joins: int, has_limit: boolean>"


def request(i, tool="query_database", tags=(), read_only=True, is_select=True, kind="SELECT", touches=("orders",), joins=0, assistant="helper", connection="w"):
    return (i, assistant, connection, list(tags), read_only, tool, (is_select, kind, list(touches), joins, True))


def decisions(spark, requests, rules=govern.DEFAULT_RULES):
    decided = govern.evaluate_policy(spark.createDataFrame(requests, REQUEST), rules)
    return {r["id"]: (r["decision"]["verdict"], r["decision"]["matched_rule"]) for r in decided.collect()}


def test_default_rules(spark):
    got = decisions(spark, [
        request(1), request(2, is_select=False), request(3, tags=["prod"]), request(4, touches=["users.password_hash"]),
        request(5, tool="list_tables"), request(6, tool="anomaly_triage"), request(7, tool="verify_rendered_against_db"), request(8, read_only=False),
    ])
    assert got == {
        1: ("permit", "allow-select-read-only"), 2: ("consent_required", "consent-for-non-select"), 3: ("consent_required", "consent-for-prod"),
        4: ("deny", "deny-system-tables"), 5: ("permit", "allow-metadata-tools"), 6: ("deny", "implicit_deny"), 7: ("deny", "implicit_deny"), 8: ("deny", "implicit_deny"),
    }


def test_priority_globs_and_missing_fields(spark):
    rules = [
        {"name": "late", "effect": "allow", "priority": 50},
        {"name": "joins", "effect": "deny", "priority": 10, "when": "sql.joins > 5"},
        {"name": "first", "effect": "consent", "priority": 20, "assistants": ["h?lper-*"], "connections": ["[wx]", "exact"]},
        {"name": "second", "effect": "deny", "priority": 20},
    ]
    got = decisions(spark, [request(1, joins=6), request(2, joins=None, assistant="helper-1"), request(3, assistant="Helper-1"), request(4, assistant="helper-1", connection="exact")], rules)
    assert got == {1: ("deny", "joins"), 2: ("consent_required", "first"), 3: ("deny", "second"), 4: ("consent_required", "first")}
    shipped = decisions(spark, [request(1, touches=["auth.sessions"]), request(2, tags=["prod.pii"]), request(3, tags=["prod.pii", "admin"]), request(4, kind="EXPLAIN")], [*govern.DEFAULT_RULES, *govern.SHIPPED_RULES])
    assert [shipped[i][1] for i in (1, 2, 3, 4)] == ["deny-credential-tables", "deny-pii-tables-for-non-admin-assistants", "allow-select-read-only", "allow-explain-everywhere"]


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text("rules:\n  - {name: only-lists, effect: allow, tools: [list_*], priority: 1}\n")
    rules = govern.load_rules(str(tmp_path / "rules.yaml"))
    assert decisions(spark, [request(1, tool="list_tables"), request(2)], rules) == {1: ("permit", "only-lists"), 2: ("deny", "implicit_deny")}
    (tmp_path / "rules.yaml").write_text("- x")
    with pytest.raises(ValueError):
        govern.load_rules(str(tmp_path / "rules.yaml"))


def test_tenants(spark):
    manifests = spark.createDataFrame([("team-finance", ["finance-ro", "warehouse-ro"]), ("team-growth", ["growth-ro"]), ("free", []), ("default", ["x"])], "tenant_id string, connections array<string>")
    calls = [("team-finance", "finance-ro"), ("team-finance", "growth-ro"), ("team-growth", "growth-ro"), ("unknown", "finance-ro"), ("free", "any"), ("default", "any")]
    got = govern.tenant_filter(spark.createDataFrame(calls, "tenant_id string, connection string"), manifests)
    assert {(r["tenant_id"], r["connection"]): r["allowed"] for r in got.collect()} == {c: c != ("team-finance", "growth-ro") for c in calls}


def test_cost_screen(spark):
    log = [
        (1, False, True, True, False, ["big"], 10, 10), (2, True, True, True, False, ["t"], 10**12, 10), (3, False, False, True, False, ["t", "big"], 10, 10),
        (4, False, True, True, False, ["t"], 100_000_001, 10), (5, False, True, True, False, ["t"], 100_000_000, 10 * 1024**3 + 1), (6, False, False, True, False, ["t"], 1, 1),
        (7, False, False, True, True, ["t"], 1, 1), (8, False, False, False, False, ["big"], None, None),
    ]
    schema = "id int, cross_join boolean, has_limit boolean, is_select boolean, aggregates boolean, touches array<string>, est_rows long, est_bytes long"
    got = {r["id"]: (r["refused"], r["reason"], r["warning"]) for r in govern.cost_screen(spark.createDataFrame(log, schema), large_tables=["big"]).collect()}
    assert [i for i in got if got[i][0]] == [2, 3, 4, 5]
    assert got[2][1] == "cross join" and got[3][1] == "large table without LIMIT: big"
    assert got[6][2] == "would be limited to 10000 rows" and got[7][2] is None and got[1] == (False, None, None)
    loose = govern.CostLimits(refuse_cross_join=False, require_limit_on_large=False, auto_limit=0, max_rows=10**13)
    assert govern.cost_screen(spark.createDataFrame(log, schema), loose, ["big"]).where("refused").count() == 1


def test_over_budget(spark):
    calls = spark.range(130).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") % 65).alias("ts"))
    assert govern.over_budget(calls, "k", "ts", 59).count() == 2 and govern.over_budget(calls, "k", "ts", 60).count() == 0


def test_as_of(spark):
    versions = [("a", 1, False, "a1"), ("a", 5, False, "a5"), ("a", 9, False, "late"), ("b", 2, False, "b2"), ("b", 4, True, "gone"), ("c", 5, False, "exact"), ("d", 7, False, "future"), ("a", 5, False, "a5x")]
    df = spark.createDataFrame(versions, "key string, t int, deleted boolean, v string").withColumn("ts", F.timestamp_seconds("t"))
    got = asof.as_of(df, ["key"], "ts", "1970-01-01 00:00:05", ["v"], "deleted")
    assert rows(got, "key", "v") == [("a", "a5x"), ("c", "exact")] and got.columns == df.columns
    assert rows(asof.as_of(df, ["key"], "ts", "1970-01-01 00:00:05", ["v"]), "key") == [("a",), ("b",), ("c",)]


def test_pinned_rows_do_not_move(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    with asof.pinned(spark.read.parquet(path)) as snapshot:
        spark.range(3).write.mode("append").parquet(path)
        assert snapshot.df.count() == 5 and snapshot.snapshot_ts is not None
        files = [f.removeprefix("file:") for f in snapshot.df.inputFiles()]
        assert files and all(os.path.exists(f.replace("//", "")) or os.path.exists(f) for f in files)
    assert not any(os.path.exists("/" + f.lstrip("/")) for f in files)
    assert spark.read.parquet(path).count() == 8


def test_governed_sql(spark):
    data = [(1, "ann@example.com", "Ann A", "+14155550100", "gold"), (2, "bob@example.com", "Bob B", "+14155550101", "gold"), (3, "cy@example.com", "Cy C", None, "free")]
    spark.createDataFrame(data, "customer_id long, email string, full_name string, phone string, tier string").createOrReplaceTempView("gov_customers")
    outcome = governed.governed_sql(spark, "-- all\nSELECT * FROM gov_customers WHERE tier = :tier;", params={"tier": "gold"})
    assert rows(outcome.df) == [(1, "[REDACTED:EMAIL]", "[REDACTED:PERSON]", "[REDACTED:PHONE]", "gold"), (2, "[REDACTED:EMAIL]", "[REDACTED:PERSON]", "[REDACTED:PHONE]", "gold")]
    audit = outcome.audit().first()
    assert audit["rows"] == 2 and audit["cells"] == 10 and audit["pii_summary"]["PERSON"] == 2 and "example.com" not in str(audit["sample_masked"])
    assert audit["policy_verdict"]["matched_rule"] == "allow-select-read-only"
    for sql in ("WITH t AS (SELECT 1 AS a) SELECT a FROM t", "(SELECT 1) UNION (SELECT 2)", "/* c */ select 1 EXCEPT select 2", "SELECT 1 INTERSECT SELECT 1"):
        assert governed.governed_sql(spark, sql).df.count() <= 2
    for sql in ("DROP VIEW gov_customers", "INSERT INTO t VALUES (1)", "FROM t INSERT INTO u SELECT *"):
        with pytest.raises(governed.Denied) as denied:
            governed.governed_sql(spark, sql)
        assert denied.value.verdict == "consent_required"
    with pytest.raises(Exception):
        governed.governed_sql(spark, "WITH t AS (SELECT 1) INSERT INTO gov_customers SELECT * FROM t")
    with pytest.raises(governed.Denied):
        governed.governed_sql(spark, "SELECT 1", governed.CallContext(touches=["audit_log"]))
    assert spark.table("gov_customers").count() == 3


def test_relations_are_read_from_the_statement(spark):
    spark.range(3).createOrReplaceTempView("audit_log")
    spark.sql("CREATE OR REPLACE TEMP VIEW innocent AS SELECT id FROM audit_log")
    spark.range(3).createOrReplaceTempView("plain")
    for sql in (
        "SELECT * FROM audit_log", "SELECT * FROM innocent", "SELECT * FROM plain WHERE id IN (SELECT id FROM audit_log)", "WITH t AS (SELECT * FROM innocent) SELECT * FROM t",
        "SELECT (SELECT max(id) FROM audit_log) AS m", "SELECT 1 AS id UNION ALL SELECT id FROM audit_log", "SELECT p.id FROM plain p JOIN innocent USING (id)",
    ):
        with pytest.raises(governed.Denied) as denied:
            governed.governed_sql(spark, sql)
        record = denied.value.audit.first()
        assert denied.value.matched_rule == "deny-system-tables" and "audit_log" in record["sql_ast_summary"]["touches"]
        assert record["policy_verdict"]["verdict"] == "deny" and record["rows"] == 0
    facts = governed.governed_sql(spark, "SELECT a.id FROM plain a JOIN plain b ON a.id = b.id ORDER BY 1 LIMIT 2").facts
    assert (facts.kind, facts.touches, facts.joins, facts.has_limit, facts.cross_join) == ("SELECT", ("plain",), 1, True, False)
    assert governed.governed_sql(spark, "SELECT count(*) AS n FROM plain CROSS JOIN plain").facts.cross_join


def test_tenants_and_costs_are_checked(spark):
    spark.range(1000).createOrReplaceTempView("plain")
    tenant = governed.CallContext(tenant_id="t1", connection="spark", tenants={"t1": ["other"]})
    with pytest.raises(governed.Denied) as denied:
        governed.governed_sql(spark, "SELECT 1", tenant)
    assert denied.value.matched_rule == "tenant"
    assert governed.governed_sql(spark, "SELECT 1", governed.CallContext(tenant_id="t1", tenants={"t1": ["spark"]})).df.count() == 1
    limits = governed.CallContext(limits=govern.CostLimits(max_bytes=100))
    with pytest.raises(governed.Denied) as denied:
        governed.governed_sql(spark, "SELECT * FROM plain", limits)
    assert denied.value.matched_rule == "cost" and denied.value.audit.first()["policy_verdict"]["reason"].startswith("estimated bytes")
    cross = governed.CallContext(limits=govern.CostLimits(max_bytes=10**15))
    with pytest.raises(governed.Denied):
        governed.governed_sql(spark, "SELECT a.id FROM plain a CROSS JOIN plain b", cross)


def test_audit_counts_all_bytes(spark):
    spark.range(1000).selectExpr("id", "repeat('x', 100) AS v").createOrReplaceTempView("wide")
    outcome = governed.governed_sql(spark, "SELECT v FROM wide")
    record = outcome.audit(sample_rows=2).first()
    assert record["bytes_returned"] == 1000 * len('{"v":""}') + 100_000 and record["rows"] == 1000 and len(record["sample_masked"]) == 2


def test_capped_result(spark):
    spark.range(50).createOrReplaceTempView("gov_ids")
    outcome = governed.governed_sql(spark, "SELECT id FROM gov_ids", cap_by=["id"], row_cap=10)
    assert outcome.df.count() == 10 and outcome.df.where("truncated").count() == 10 and outcome.warnings
