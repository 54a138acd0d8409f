"""Policies, tenants, costs, limits, audit chains and as-of reads over logs derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import load
from plumbline.operators import asof, audit, govern, replay
from plumbline.session import cut_lineage

RULES = [
    *govern.DEFAULT_RULES,
    *govern.SHIPPED_RULES,
    {"name": "deny-agent-three", "effect": "deny", "assistants": ["agent-3*"], "connections": ["conn-[12]"], "priority": 12},
]


def requests(events):
    """One policy request per event."""
    user, event = F.col("user_id"), F.col("event_id")
    tags = (
        F.when(user % 5 == 0, F.array(F.lit("prod")))
        .when(user % 5 == 1, F.array(F.lit("prod.pii")))
        .when(user % 5 == 2, F.array(F.lit("prod.pii"), F.lit("admin")))
        .otherwise(F.array().cast("array<string>"))
    )
    tenant = F.element_at(F.array(*[F.lit(t) for t in ("default", "team-finance", "team-growth", "stranger")]), (user % 4 + 1).cast("int"))
    tool = (
        F.when(F.col("event_type") == "click", "profile_table")
        .when(F.col("event_type") == "purchase", "list_tables")
        .when(F.col("event_type") == "signup", "anomaly_triage")
        .otherwise("query_database")
    )
    touches = F.when(event % 13 == 0, "audit_log").when(event % 13 == 1, "auth.sessions").otherwise("orders")
    sql = F.struct(
        (event % 6 != 0).alias("is_select"),
        F.when(event % 11 == 0, "EXPLAIN").otherwise("SELECT").alias("kind"),
        F.array(touches).alias("touches"),
        F.when(event % 17 != 0, event % 8).cast("int").alias("joins"),
        (event % 2 == 0).alias("has_limit"),
    )
    return events.select(
        "event_id", tenant.alias("tenant_id"),
        F.concat(F.lit("agent-"), (user % 7).cast("string")).alias("assistant_id"),
        F.concat(F.lit("conn-"), (user % 5).cast("string")).alias("connection"),
        tags.alias("tags"), (event % 9 != 0).alias("read_only"), tool.alias("tool"), sql.alias("sql"),
    )


def _policy(spark, sf):
    decided = govern.evaluate_policy(requests(load(spark, sf, "events")), RULES)
    return decided.select("event_id", "decision.verdict", "decision.matched_rule", "decision.reason")


def _default_bundle(spark, sf):
    decided = govern.evaluate_policy(requests(load(spark, sf, "events")))
    return decided.groupBy("tool", "decision.verdict", "decision.matched_rule").agg(F.count(F.lit(1)).alias("calls"))


def _tenants(spark, sf):
    """Manifests from the customers: a tenant may use the connections of the nations it sells to."""
    listed = load(spark, sf, "nation").groupBy((F.col("n_regionkey") % 3).alias("t")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("conn-"), (F.col("n_nationkey") % 3).cast("string")))).alias("connections")
    )
    names = F.when(F.col("t") == 0, "team-finance").when(F.col("t") == 1, "team-growth").otherwise("default")
    empty = F.when(F.col("t") == 1, F.array().cast("array<string>")).otherwise(F.col("connections"))
    manifests = listed.select(names.alias("tenant_id"), empty.alias("connections"))
    checked = govern.tenant_filter(requests(load(spark, sf, "events")), manifests)
    return checked.select("event_id", "tenant_id", "connection", "allowed")


def _query_log(events):
    event = F.col("event_id")
    return events.select(
        "event_id", (event % 23 == 0).alias("cross_join"), (event % 2 == 0).alias("has_limit"), (event % 7 != 0).alias("is_select"),
        (event % 3 == 0).alias("aggregates"), F.array("event_type").alias("touches"),
        ((event % 41) * 3_000_000).alias("est_rows"), ((event % 37) * 400_000_000).alias("est_bytes"),
    )


def _cost(spark, sf):
    screened = govern.cost_screen(_query_log(load(spark, sf, "events")), large_tables=["error", "view"])
    return screened.select("event_id", "refused", "reason", "warning")


def _calls(spark, sf):
    """Calls that last as many minutes as the user number."""
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + F.col("user_id") * 60_000_000)
    return load(spark, sf, "events").select("event_id", "event_type", ts.alias("start"), end.alias("end"))


def _peak(spark, sf):
    return govern.concurrency_peak(_calls(spark, sf), "event_type", "start", "end")


def _gate(spark, sf):
    return replay.concurrency_replay(_calls(spark, sf), ["event_type"], "start", "end", "event_id", cap=3).select("event_id", "event_type", "admitted")


def _fast(spark, sf):
    """The events with time running a thousand times faster, so that limits bite."""
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    return load(spark, sf, "events").select("event_id", "event_type", fast.alias("ts"))


def _rate(spark, sf):
    return replay.rate_limit_replay(_fast(spark, sf), ["event_type"], "ts", "event_id", 30).select("event_id", "event_type", "allowed")


def _over_budget(spark, sf):
    return govern.over_budget(_fast(spark, sf), "event_type", "ts", 5)


def _conversation_calls(spark, sf):
    turns = load(spark, sf, "conversations")
    calls = turns.groupBy(F.col("conv_id").alias("call_id")).agg(F.count(F.lit(1)).alias("rows")).select(
        "call_id", F.timestamp_seconds(F.col("call_id") + 1_700_000_000).alias("ts"), F.lit("agent-1").alias("assistant_id"),
        F.lit("s1").alias("assistant_session"), F.lit("query_database").alias("tool"), F.lit("conn-1").alias("connection"),
        F.concat(F.lit("SELECT "), F.col("call_id").cast("string")).alias("sql"),
        F.struct(F.lit("permit").alias("verdict"), F.lit("r").alias("matched_rule"), F.lit("ok").alias("reason")).alias("policy_verdict"),
        "rows", F.lit(2).alias("columns"), F.lit(10).alias("bytes_returned"), F.lit(1.5).alias("latency_ms"),
    )
    findings = turns.select(F.col("conv_id").alias("call_id"), F.upper("role").alias("entity_type"))
    results = turns.select(F.col("conv_id").alias("call_id"), "turn", "role")
    return audit.audit_records(calls, findings, results, ["turn", "role"])


def _records(spark, sf):
    records = _conversation_calls(spark, sf)
    return records.select(
        "call_id", "sql_hash", "rows", "cells", F.col("pii_summary")["USER"].alias("user_findings"),
        F.size("pii_summary").alias("entities"), F.array_join("sample_masked", "|").alias("sample"),
    )


def _chained(spark, sf):
    """All events, one chain per type."""
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id")
    return audit.chain(events, ["event_type"], ["event_id"])


def _chain(spark, sf):
    return _chained(spark, sf).select("event_id", "prev_record_hash", "record_hash")


def _seals(spark, sf):
    """The chain of one seal per segment that holds the segments of a type together."""
    return _segments(spark, sf)[1].select("event_type", "segment", "sealed_rows", "sealed_hash", "prev_record_hash", "record_hash")


def _verify(spark, sf):
    records, seals = _segments(spark, sf)
    return audit.verify_segments(records, seals, ["event_type"], "segment", "event_id").drop("segments")


def _verify_plain(spark, sf):
    """One chain per user and kind of event."""
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id")
    chained = audit.chain(events, ["user_id", "event_type"], ["event_id"])
    return audit.verify_chain(chained, ["user_id", "event_type"], "event_id", slice_rows=500)


def _verify_tampered(spark, sf):
    """Every 2999th record edited, every 4001st missing."""
    event = F.col("event_id")
    edited = F.when(event % 2999 == 2998, F.regexp_replace("record", '"user_id":', '"user_id":9')).otherwise(F.col("record"))
    broken = _chained(spark, sf).withColumn("record", edited).where(event % 4001 != 4000)
    return audit.verify_chain(broken, ["event_type"], "event_id", slice_rows=500)


def _files(spark, sf):
    """One rotated log per user, a file for every hundred events."""
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id")
    return audit.chain(events, ["user_id"], ["event_id"]).withColumn("file_no", F.floor(F.col("event_id") / 100))


def _rotated(spark, sf):
    return audit.verify_rotated(_files(spark, sf), "file_no", "event_id", ["user_id"])


def _rotated_gap(spark, sf):
    return audit.verify_rotated(_files(spark, sf).where(F.col("file_no") != 3), "file_no", "event_id", ["user_id"])


def _segments(spark, sf):
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id", F.floor(F.col("event_id") / 500).alias("segment"))
    return audit.segmented_chain(events, ["event_type"], ["event_id"], "segment")


def _verify_segments(spark, sf):
    return audit.verify_segments(*_segments(spark, sf), ["event_type"], "segment", "event_id")


def _verify_segments_tampered(spark, sf):
    """One segment lost its last record, one is missing with its seal kept."""
    records, seals = _segments(spark, sf)
    event = F.col("event_id")
    last = records.groupBy("event_type", "segment").agg(F.max("event_id").alias("last"))
    short = records.join(last, ["event_type", "segment"]).where((F.col("segment") != 1) | (event != F.col("last"))).drop("last")
    broken = short.where((F.col("segment") != 0) | (F.col("event_type") != "click"))
    return audit.verify_segments(broken, seals, ["event_type"], "segment", "event_id")


def _audit_log(spark, sf):
    """Audit records of all decided requests."""
    decided = govern.evaluate_policy(requests(load(spark, sf, "events")), RULES)
    events = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    pii = F.map_from_arrays(F.array(F.lit("EMAIL"), F.lit("PHONE")), F.array(F.col("event_id") % 3, F.col("event_id") % 5))
    return decided.join(events, "event_id").select(
        "event_id", "ts", "assistant_id", "tool", "connection", F.col("decision").alias("policy_verdict"),
        (F.col("event_id") % 100).alias("rows"), pii.alias("pii_summary"),
    )


def _tail(spark, sf):
    recent = audit.audit_query(_audit_log(spark, sf), 20, "2024-01-20 00:00:00", ["event_id"])
    return recent.select("event_id", "ts", "tool")


def _rollup(spark, sf):
    return audit.audit_rollup(_audit_log(spark, sf), ["assistant_id", "tool"])


def _rollup_totals(spark, sf):
    log = _audit_log(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    return audit.audit_rollup(log, ["connection", "day"], with_totals=True)


def _entities(spark, sf):
    return audit.audit_entities(_audit_log(spark, sf), ["connection"])


TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _as_of(spark, sf):
    versions = load(spark, sf, "lineitem").withColumn("deleted", F.col("l_returnflag") == "R")
    state = asof.as_of(versions, ["l_orderkey"], "l_shipdate", "1998-06-01 00:00:00", TIES, "deleted")
    return state.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")


def _pinned(spark, sf):
    """Two steps over the same pinned rows."""
    with asof.pinned(load(spark, sf, "orders")) as snapshot:
        totals = snapshot.df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
        dates = snapshot.df.groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("newest"))
        return cut_lineage(totals.join(dates, "o_orderstatus"))


QUERIES = {
    "policy_decisions": _policy,
    "policy_default_bundle": _default_bundle,
    "tenant_filter": _tenants,
    "cost_screen": _cost,
    "concurrency_peak": _peak,
    "concurrency_replay": _gate,
    "rate_limit_replay": _rate,
    "rate_over_budget": _over_budget,
    "audit_records": _records,
    "audit_chain": _chain,
    "audit_chain_seals": _seals,
    "audit_verify": _verify,
    "audit_verify_plain": _verify_plain,
    "audit_verify_tampered": _verify_tampered,
    "audit_verify_rotated": _rotated,
    "audit_verify_rotated_gap": _rotated_gap,
    "audit_verify_segments": _verify_segments,
    "audit_verify_segments_tampered": _verify_segments_tampered,
    "audit_tail": _tail,
    "audit_rollup": _rollup,
    "audit_rollup_totals": _rollup_totals,
    "audit_entities": _entities,
    "as_of_read": _as_of,
    "pinned_snapshot": _pinned,
}

REQUESTS = """SELECT event_id, ts, ['default', 'team-finance', 'team-growth', 'stranger'][user_id % 4 + 1] AS tenant_id,
    'agent-' || user_id % 7 AS assistant_id, 'conn-' || user_id % 5 AS connection,
    user_id % 5 AS tag, event_id % 9 <> 0 AS read_only,
    CASE event_type WHEN 'click' THEN 'profile_table' WHEN 'purchase' THEN 'list_tables' WHEN 'signup' THEN 'anomaly_triage' ELSE 'query_database' END AS tool,
    event_id % 6 <> 0 AS is_select, event_id % 11 = 0 AS explain, event_id % 13 AS touch,
    CASE WHEN event_id % 17 <> 0 THEN event_id % 8 END AS joins FROM events"""
ALL_TOOLS = "('query_database', 'profile_table', 'diff_environments')"
DECIDE = f"""CASE
    WHEN touch = 1 THEN 'deny-credential-tables'
    WHEN tool = 'query_database' AND touch = 0 THEN 'deny-system-tables'
    WHEN assistant_id = 'agent-3' AND connection IN ('conn-1', 'conn-2') THEN 'deny-agent-three'
    WHEN tag = 1 THEN 'deny-pii-tables-for-non-admin-assistants'
    WHEN tool = 'query_database' AND NOT is_select THEN 'consent-for-non-select'
    WHEN joins > 5 THEN 'warn-on-large-joins'
    WHEN tool IN {ALL_TOOLS} AND tag = 0 THEN 'consent-for-prod'
    WHEN tool = 'query_database' AND explain THEN 'allow-explain-everywhere'
    WHEN tool IN {ALL_TOOLS} AND is_select AND read_only THEN 'allow-select-read-only'
    WHEN tool = 'list_tables' THEN 'allow-metadata-tools' ELSE 'implicit_deny' END"""
VERDICT = """CASE WHEN matched_rule LIKE 'deny%' OR matched_rule = 'implicit_deny' THEN 'deny'
    WHEN matched_rule LIKE 'allow%' THEN 'permit' ELSE 'consent_required' END"""
DECIDED = f"SELECT *, {VERDICT} AS verdict FROM (SELECT *, {DECIDE} AS matched_rule FROM ({REQUESTS}))"
CALLS = "SELECT event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + user_id * 60000000 AS e FROM events"
AUDIT = f"SELECT *, event_id % 100 AS rows, event_id % 3 AS emails, event_id % 5 AS phones FROM ({DECIDED})"
ROLLED = """count(*) AS calls, count(*) FILTER (verdict = 'permit') AS permit, count(*) FILTER (verdict = 'deny') AS deny,
    count(*) FILTER (verdict = 'consent_required') AS consent_required, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(emails + phones) AS BIGINT) AS pii_findings"""
GENESIS = audit.GENESIS
CHAIN = f"""WITH RECURSIVE t AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
    c AS (
        SELECT event_id, event_type, rn, '{GENESIS}' AS prev_record_hash, 'sha256:' || sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type
               || '","prev_record_hash":"{GENESIS}","user_id":' || user_id || '}}') AS record_hash FROM t WHERE rn = 1
        UNION ALL
        SELECT t.event_id, t.event_type, t.rn, c.record_hash, 'sha256:' || sha256('{{"event_id":' || t.event_id || ',"event_type":"' || t.event_type
               || '","prev_record_hash":"' || c.record_hash || '","user_id":' || t.user_id || '}}')
        FROM c JOIN t ON t.event_type = c.event_type AND t.rn = c.rn + 1)"""
SEGMENT_CHAIN = f"""WITH RECURSIVE t AS (SELECT event_id, event_type, user_id, event_id // 500 AS segment,
        row_number() OVER (PARTITION BY event_type, event_id // 500 ORDER BY event_id) AS rn FROM events),
    c AS (
        SELECT event_id, event_type, segment, rn, '{GENESIS}' AS prev_record_hash, 'sha256:' || sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type
               || '","prev_record_hash":"{GENESIS}","segment":' || segment || ',"user_id":' || user_id || '}}') AS record_hash FROM t WHERE rn = 1
        UNION ALL
        SELECT t.event_id, t.event_type, t.segment, t.rn, c.record_hash, 'sha256:' || sha256('{{"event_id":' || t.event_id || ',"event_type":"' || t.event_type
               || '","prev_record_hash":"' || c.record_hash || '","segment":' || t.segment || ',"user_id":' || t.user_id || '}}')
        FROM c JOIN t ON t.event_type = c.event_type AND t.segment = c.segment AND t.rn = c.rn + 1)"""
SEALS = f"""{SEGMENT_CHAIN}, l AS (SELECT event_type, segment, count(*) AS sealed_rows, arg_max(record_hash, event_id) AS sealed_hash,
        row_number() OVER (PARTITION BY event_type ORDER BY segment) AS rn FROM c GROUP BY event_type, segment),
    s AS (
        SELECT l.*, '{GENESIS}' AS prev_record_hash, 'sha256:' || sha256('{{"event_type":"' || event_type || '","prev_record_hash":"{GENESIS}","sealed_hash":"'
               || sealed_hash || '","sealed_rows":' || sealed_rows || ',"segment":' || segment || '}}') AS record_hash FROM l WHERE rn = 1
        UNION ALL
        SELECT l.*, s.record_hash, 'sha256:' || sha256('{{"event_type":"' || l.event_type || '","prev_record_hash":"' || s.record_hash || '","sealed_hash":"'
               || l.sealed_hash || '","sealed_rows":' || l.sealed_rows || ',"segment":' || l.segment || '}}')
        FROM s JOIN l ON l.event_type = s.event_type AND l.rn = s.rn + 1)"""

ORACLES = {
    "policy_decisions": f"""SELECT event_id, verdict, matched_rule, CASE
        WHEN matched_rule = 'implicit_deny' THEN 'no policy rule matched; default-deny'
        WHEN verdict = 'deny' THEN 'deny by rule ''' || matched_rule || ''''
        WHEN verdict = 'permit' THEN 'allowed by rule ''' || matched_rule || ''''
        ELSE 'rule ''' || matched_rule || ''' requires consent' END AS reason FROM ({DECIDED})""",
    "policy_default_bundle": f"""SELECT tool, {VERDICT} AS verdict, matched_rule, count(*) AS calls FROM (SELECT tool, CASE
        WHEN tool = 'query_database' AND touch = 0 THEN 'deny-system-tables'
        WHEN tool = 'query_database' AND NOT is_select THEN 'consent-for-non-select'
        WHEN tool IN {ALL_TOOLS} AND tag = 0 THEN 'consent-for-prod'
        WHEN tool IN {ALL_TOOLS} AND is_select AND read_only THEN 'allow-select-read-only'
        WHEN tool = 'list_tables' THEN 'allow-metadata-tools' ELSE 'implicit_deny' END AS matched_rule FROM ({REQUESTS})) GROUP BY ALL""",
    "tenant_filter": f"""SELECT event_id, tenant_id, connection, NOT (tenant_id = 'team-finance' AND connection NOT IN (
        SELECT 'conn-' || n_nationkey % 3 FROM nation WHERE n_regionkey % 3 = 0)) AS allowed FROM ({REQUESTS})""",
    "cost_screen": """SELECT event_id, reason IS NOT NULL AS refused, reason,
        CASE WHEN reason IS NULL AND event_id % 7 <> 0 AND event_id % 2 <> 0 AND event_id % 3 <> 0 THEN 'would be limited to 10000 rows' END AS warning
        FROM (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'cross join'
            WHEN event_id % 7 <> 0 AND event_id % 2 <> 0 AND event_type IN ('error', 'view') THEN 'large table without LIMIT: ' || event_type
            WHEN (event_id % 41) * 3000000 > 100000000 THEN 'estimated rows over 100000000'
            WHEN (event_id % 37) * 400000000 > 10737418240 THEN 'estimated bytes over 10737418240' END AS reason FROM events)""",
    "concurrency_peak": f"""SELECT event_type, CAST(max(level) AS BIGINT) AS peak FROM (
        SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS level FROM (
            SELECT event_type, s AS moment, 1 AS d FROM ({CALLS}) UNION ALL SELECT event_type, e, -1 FROM ({CALLS}))) GROUP BY event_type""",
    "concurrency_replay": f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS rn FROM ({CALLS})),
        c AS (SELECT event_id, event_type, rn, [e] AS running, true AS admitted FROM t WHERE rn = 1
            UNION ALL SELECT event_id, event_type, rn, CASE WHEN len(r) < 3 THEN list_append(r, e) ELSE r END, len(r) < 3
            FROM (SELECT t.event_id, t.event_type, t.rn, t.e, list_filter(c.running, lambda x: x > t.s) AS r
                  FROM c JOIN t ON t.event_type = c.event_type AND t.rn = c.rn + 1))
        SELECT event_id, event_type, admitted FROM c""",
    "rate_limit_replay": """WITH RECURSIVE t AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS us,
            row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
        c AS (SELECT event_id, event_type, rn, us, CAST(29 * 60000000 AS BIGINT) AS left_over, true AS allowed FROM t WHERE rn = 1
            UNION ALL SELECT event_id, event_type, rn, us, CASE WHEN have >= 60000000 THEN have - 60000000 ELSE have END, have >= 60000000
            FROM (SELECT t.event_id, t.event_type, t.rn, t.us, least(30 * 60000000, c.left_over + 30 * (t.us - c.us)) AS have
                  FROM c JOIN t ON t.event_type = c.event_type AND t.rn = c.rn + 1))
        SELECT event_id, event_type, allowed FROM c""",
    "rate_over_budget": """SELECT event_type, make_timestamp(us // 60000000 * 60000000) AS minute, count(*) AS calls
        FROM (SELECT event_type, epoch_us(ts) // 1000 AS us FROM events) GROUP BY 1, 2 HAVING count(*) > 5""",
    "audit_records": """WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations)
        SELECT conv_id AS call_id, 'sha256:' || sha256('SELECT ' || conv_id) AS sql_hash, count(*) AS rows, 2 * count(*) AS cells,
               nullif(count(*) FILTER (role = 'user'), 0) AS user_findings, count(DISTINCT role) AS entities,
               string_agg('{"turn":' || turn || ',"role":"' || role || '"}', '|' ORDER BY n) FILTER (n <= 3) AS sample
        FROM s GROUP BY conv_id""",
    "audit_chain": f"{CHAIN} SELECT event_id, prev_record_hash, record_hash FROM c",
    "audit_chain_seals": f"{SEALS} SELECT event_type, segment, sealed_rows, sealed_hash, prev_record_hash, record_hash FROM s",
    "audit_verify": "SELECT event_type, true AS valid, count(*) AS records_seen, CAST(NULL AS VARCHAR) AS first_error FROM events GROUP BY event_type",
    "audit_verify_plain": """SELECT user_id, event_type, true AS valid, count(*) AS records_seen, CAST(NULL AS VARCHAR) AS first_error
        FROM events GROUP BY user_id, event_type""",
    "audit_verify_tampered": """WITH k AS (SELECT *, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM k WHERE event_id % 4001 <> 4000),
        f AS (SELECT event_type, rn, CASE WHEN before % 4001 = 4000 THEN 'prev_hash mismatch' WHEN event_id % 2999 = 2998 THEN 'record_hash mismatch' END AS error FROM n),
        b AS (SELECT event_type, min(rn) AS rn, arg_min(error, rn) AS error FROM f WHERE error IS NOT NULL GROUP BY event_type)
        SELECT a.event_type, b.rn IS NULL AS valid, coalesce(b.rn, a.n) AS records_seen, 'record ' || b.rn || ': ' || b.error AS first_error
        FROM (SELECT event_type, count(*) AS n FROM n GROUP BY event_type) a LEFT JOIN b ON a.event_type = b.event_type""",
    "audit_verify_rotated": "SELECT user_id, true AS valid, count(*) AS records_seen, CAST(NULL AS VARCHAR) AS first_error FROM events GROUP BY user_id",
    "audit_verify_rotated_gap": """WITH u AS (SELECT user_id, count(*) FILTER (event_id < 300) AS before, count(*) FILTER (event_id BETWEEN 300 AND 399) AS lost,
            count(*) FILTER (event_id >= 400) AS later FROM events GROUP BY user_id)
        SELECT user_id, lost = 0 OR later = 0 AS valid, CASE WHEN lost > 0 AND later > 0 THEN before + 1 ELSE before + later END AS records_seen,
               CASE WHEN lost > 0 AND later > 0 THEN 'record ' || (before + 1) || ': prev_hash mismatch' END AS first_error
        FROM u WHERE before + later > 0""",
    "audit_verify_segments": """SELECT event_type, true AS valid, count(DISTINCT event_id // 500) AS segments, count(*) AS records_seen,
        CAST(NULL AS VARCHAR) AS first_error FROM events GROUP BY event_type""",
    "audit_verify_segments_tampered": """WITH e AS (SELECT event_type, event_id // 500 AS segment, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, false AS valid, count(*) FILTER (event_type <> 'click' OR segment <> 0) AS segments,
               CAST(sum(CASE WHEN segment = 1 THEN n - 1 WHEN segment = 0 AND event_type = 'click' THEN 0 ELSE n END) AS BIGINT) AS records_seen,
               CASE event_type WHEN 'click' THEN 'segment 0: segment missing' ELSE 'segment 1: seal mismatch' END AS first_error
        FROM e GROUP BY event_type""",
    "audit_tail": f"SELECT event_id, ts, tool FROM ({AUDIT}) WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "audit_rollup": f"SELECT assistant_id, tool, {ROLLED} FROM ({AUDIT}) GROUP BY 1, 2",
    "audit_rollup_totals": f"SELECT connection, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {ROLLED} FROM ({AUDIT}) GROUP BY ROLLUP (connection, CAST(CAST(ts AS DATE) AS VARCHAR))",
    "audit_entities": f"""SELECT connection, 'EMAIL' AS entity_type, CAST(sum(emails) AS BIGINT) AS findings FROM ({AUDIT}) GROUP BY 1
        UNION ALL SELECT connection, 'PHONE', CAST(sum(phones) AS BIGINT) FROM ({AUDIT}) GROUP BY 1""",
    "as_of_read": f"""SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, {', '.join(t + ' DESC' for t in TIES)}) AS rn
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-01') WHERE rn = 1 AND l_returnflag <> 'R'""",
    "pinned_snapshot": "SELECT o_orderstatus, count(*) AS orders, max(o_orderdate) AS newest FROM orders GROUP BY 1",
}
