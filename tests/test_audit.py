import hashlib
import json

from checks import governance
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import audit

RECORD = (
    "seq int, ts timestamp, assistant_id string, assistant_session string, tool string, connection string, sql_hash string, "
    "sql_ast_summary map<string,string>, policy_verdict struct<verdict: string, matched_rule: string, reason: string>, "
    "pii_summary map<string,bigint>, rows bigint, cells bigint, bytes_returned bigint, latency_ms double, sample_masked array<string>"
)


def records(spark, n):
    from datetime import datetime

    data = [
        (i, datetime(2026, 1, 1, 0, 0, i), "helper", "s", "query_database", "c", "sha256:x", {"kind": "SELECT"}, ("permit", "r", None),
         {"EMAIL": i}, i, i * 2, 10, 1.5, ['{"a":"[REDACTED:EMAIL]"}'])
        for i in range(n)
    ]
    return spark.createDataFrame(data, RECORD).withColumn("log", F.lit("main"))


def test_intact_chain(spark):
    chained = audit.chain(records(spark, 5), ["log"], ["seq"])
    assert rows(audit.verify_chain(chained, ["log"], "seq")) == [("main", True, 5, None)]
    first = chained.orderBy("seq").first()
    assert first["prev_record_hash"] == "sha256:0" * 8


def test_changed_second_record_breaks_at_record_2(spark):
    chained = audit.chain(records(spark, 3), ["log"], ["seq"])
    tampered = F.when(F.col("seq") == 1, F.regexp_replace("record", '"rows":1,', '"rows":999,')).otherwise(F.col("record"))
    found = rows(audit.verify_chain(chained.withColumn("record", tampered), ["log"], "seq"))
    assert found == [("main", False, 2, "record 2: record_hash mismatch")]


def test_missing_and_broken_records(spark):
    chained = audit.chain(records(spark, 6), ["log"], ["seq"])
    assert rows(audit.verify_chain(chained.where("seq <> 2"), ["log"], "seq", slice_rows=2)) == [("main", False, 3, "record 3: prev_hash mismatch")]
    broken = chained.withColumn("record", F.when(F.col("seq") == 4, F.lit("{oops")).otherwise(F.col("record")))
    assert rows(audit.verify_chain(broken, ["log"], "seq", slice_rows=2)) == [("main", False, 5, "record 5: invalid JSON")]


def test_rotated_files(spark):
    chained = audit.chain(records(spark, 9), ["log"], ["seq"]).withColumn("file", F.floor(F.col("seq") / 3))
    assert rows(audit.verify_rotated(chained, "file", "seq")) == [("log", True, 9, None)]
    assert rows(audit.verify_rotated(chained.where("file <> 1"), "file", "seq")) == [("log", False, 4, "record 4: prev_hash mismatch")]


def test_jsonl_round_trip(spark, tmp_path):
    chained = audit.chain(records(spark, 4), ["log"], ["seq"])
    chained.select("record").write.text(str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).withColumn("seq", F.get_json_object("value", "$.seq").cast("int")).withColumn("log", F.lit("x"))
    assert rows(audit.verify_chain(lines, ["log"], "seq", record_col="value")) == [("x", True, 4, None)]


def test_audit_records(spark):
    calls = spark.createDataFrame(
        [(1, "SELECT 1", 5, 2), (2, "SELECT 2", 0, 3)], "call_id int, sql string, rows long, columns int"
    ).selectExpr(
        "call_id", "timestamp'2026-01-01' as ts", "'a' as assistant_id", "'s' as assistant_session", "'t' as tool", "'c' as connection", "sql",
        "named_struct('verdict','permit','matched_rule','r','reason','') as policy_verdict", "rows", "columns", "0L as bytes_returned", "0D as latency_ms")
    findings = spark.createDataFrame([(1, "EMAIL"), (1, "EMAIL"), (1, "PHONE")], "call_id int, entity_type string")
    results = spark.createDataFrame([(1, i, f"v{i}") for i in range(5)], "call_id int, n int, v string")
    found = {r["call_id"]: r for r in audit.audit_records(calls, findings, results, ["n"]).collect()}
    assert found[1]["pii_summary"] == {"EMAIL": 2, "PHONE": 1} and found[1]["cells"] == 10
    assert found[1]["sample_masked"] == ['{"n":0,"v":"v0"}', '{"n":1,"v":"v1"}', '{"n":2,"v":"v2"}']
    assert found[2]["pii_summary"] == {} and found[2]["sample_masked"] == []
    assert found[1]["sql_hash"].startswith("sha256:") and len(found[1]["sql_hash"]) == 71


def test_verification_is_native_on_a_sound_log(spark):
    """No Python in the plan unless a record's text has another hash than it states; reordered but sound JSON is still sound."""
    records = spark.createDataFrame([(k % 2, k, f"é, \"record_hash\": {k}") for k in range(60)], "k int, seq long, v string")
    linked = audit.chain(records, ["k"], ["seq"])
    sound = audit.verify_chain(linked, ["k"], "seq", slice_rows=7)
    assert "Python" not in sound._jdf.queryExecution().executedPlan().toString()
    assert rows(sound) == [(0, True, 30, None), (1, True, 30, None)]
    spaced = F.when(F.col("seq") % 5 == 0, F.replace("record", F.lit('","'), F.lit('" , "'))).otherwise(F.col("record"))
    assert rows(audit.verify_chain(linked.withColumn("record", spaced), ["k"], "seq", slice_rows=7)) == rows(sound)
    edited = F.when(F.col("seq") == 21, F.replace("record", F.lit('"k":1'), F.lit('"k":2'))).when(F.col("seq") == 44, F.lit("no json")).when(
        F.col("seq") == 46, F.lit(None)).otherwise(F.col("record"))
    broken = audit.verify_chain(linked.withColumn("record", edited), ["k"], "seq", slice_rows=7)
    assert rows(broken) == [(0, False, 23, "record 23: invalid JSON"), (1, False, 11, "record 11: record_hash mismatch")]


def test_events_of_a_type_are_one_chain(spark, sf):
    """Each type has one record without a predecessor, however many segments its events fill."""
    found = governance.QUERIES["audit_chain"](spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert found.count() == events.count()
    assert found.where(F.col("prev_record_hash") == audit.GENESIS).count() == events.select("event_type").distinct().count()


def test_chain_writes_canonical_json(spark):
    """Names on all sides of the hashes, a stale hash, nested and non-ASCII values: the text is that of json.dumps."""
    rows_ = spark.createDataFrame([(1, "é\"", "old", {"b": 1, "a": 2}, 1.5), (2, None, "old", {}, 2e20)], "id int, zeta string, record_hash_old string, q map<string,int>, alpha double")
    linked = audit.chain(rows_.withColumn("k", F.lit("x")), ["k"], ["id"]).orderBy("id").collect()
    before = audit.GENESIS
    for row in linked:
        record = json.loads(row["record"])
        assert row["record"] == json.dumps(record, separators=(",", ":"), sort_keys=True)
        stated = record.pop("record_hash")
        text = json.dumps(record, separators=(",", ":"), sort_keys=True)
        assert stated == row["record_hash"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        assert record["prev_record_hash"] == row["prev_record_hash"] == before
        before = stated


def test_linked_segments_are_written_once(spark):
    log = spark.range(40).select("id", (F.col("id") % 2).cast("string").alias("log"), F.floor(F.col("id") / 10).alias("segment"))
    linked, seals = audit.segmented_chain(log, ["log"], ["id"], "segment")
    # Before, the seals and every check linked all records anew.
    assert "MapInArrow" not in linked._jdf.queryExecution().executedPlan().toString()
    assert rows(audit.verify_segments(linked, seals, ["log"], "segment", "id"), "log", "valid", "records_seen") == [("0", True, 20), ("1", True, 20)]
