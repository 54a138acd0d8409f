"""Read-only SQL under governance: decide, run, cap, scan, mask and audit, all in one plan."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.audit import SAMPLE_ROWS
from plumbline.operators.govern import DEFAULT_RULES, DEFAULT_TENANT, CostLimits, cost_screen, evaluate_policy, tenant_filter
from plumbline.operators.mask import MaskPolicy, Sensitivity, cap, mask
from plumbline.operators.pii import findings_of
from plumbline.operators.profile import quoted
from plumbline.session import cut_lineage

REQUEST = (
    "assistant_id string, connection string, tags array<string>, read_only boolean, tool string, "
    "sql struct<is_select: boolean, kind: string, touches: array<string>, joins: int, has_limit: boolean>"
)
AUDIT = (
    "ts timestamp, assistant_id string, assistant_session string, tool string, connection string, sql_hash string, "
    "sql_ast_summary map<string,string>, policy_verdict struct<verdict: string, matched_rule: string, reason: string>, "
    "pii_summary map<string,bigint>, rows bigint, cells bigint, bytes_returned bigint, latency_ms double, sample_masked array<string>"
)
_READ_ONLY = re.compile(r"^(?:\s|\(|--[^\n]*\n|/\*.*?\*/)*(select|with|values|table)\b", re.IGNORECASE | re.DOTALL)


class Denied(Exception):
    """The call was refused or needs consent first; ``audit`` is its record, as for calls that ran."""

    def __init__(self, verdict: str, matched_rule: str, reason: str, audit: DataFrame | None = None) -> None:
        super().__init__(reason)
        self.verdict = verdict
        self.matched_rule = matched_rule
        self.audit = audit


@dataclass(frozen=True)
class CallContext:
    """Who asks, over which connection, and what the connection's administrator says about it."""

    assistant_id: str = "local"
    assistant_session: str = "local"
    tool: str = "query_database"
    connection: str = "spark"
    tenant_id: str = DEFAULT_TENANT
    tags: Sequence[str] = ()
    read_only: bool = True
    #: Relations beside those that the statement itself names.
    touches: Sequence[str] = ()
    rules: Sequence[Mapping] = DEFAULT_RULES
    #: Connections by tenant; a tenant that is listed may use only its own.
    tenants: Mapping[str, Sequence[str]] = field(default_factory=dict)
    limits: CostLimits | None = None
    large_tables: Sequence[str] = ()
    policy: MaskPolicy = field(default_factory=MaskPolicy)
    sensitivity: Sensitivity | None = None
    qualifier: str = ""


@dataclass(frozen=True)
class Facts:
    """What a statement does, read from its plans: relations by name, joins, and whether its result is limited."""

    kind: str = "OTHER"
    touches: tuple[str, ...] = ()
    joins: int = 0
    cross_join: bool = False
    has_limit: bool = False
    aggregates: bool = False
    est_rows: int | None = None
    est_bytes: int | None = None


def _nodes(plan) -> Iterator:
    """All nodes of a logical plan: children, common table expressions and subqueries."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        below = [node.children(), node.innerChildren(), node.subqueries()]
        stack += [kids.apply(i) for kids in below for i in range(kids.size()) if kids.apply(i).getClass().getName().startswith(_LOGICAL)]


_LOGICAL = ("org.apache.spark.sql.catalyst.plans.logical", "org.apache.spark.sql.catalyst.analysis", "org.apache.spark.sql.execution.datasources", "org.apache.spark.sql.catalyst.catalog", "org.apache.spark.sql.execution")


def _named(node) -> list[str]:
    """Names of the relations that a plan node stands for, each part-qualified and bare."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = node.multipartIdentifier()
        names = [parts.apply(i) for i in range(parts.size())]
    elif kind == "View":
        names = [x for x in node.desc().identifier().unquotedString().split(".")]
    elif kind == "LogicalRelation" and node.catalogTable().isDefined():
        names = node.catalogTable().get().identifier().unquotedString().split(".")
    else:
        return []
    return list(dict.fromkeys([".".join(names[-2:]), names[-1]]))


def statement_facts(spark: SparkSession, sql: str, df: DataFrame | None = None) -> Facts:
    """Facts of a statement from Catalyst's parsed plan and, given its frame, the analysed and optimised plans.

    Views are followed down to what they read, subqueries and common table expressions included, so a caller cannot
    hide a relation. Names of common table expressions count as relations: better one too many.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    touches = {name for node in _nodes(parsed) for name in _named(node)}
    kind = "SELECT" if is_read_only(sql) else parsed.getClass().getSimpleName()
    if df is None:
        return Facts(kind, tuple(sorted(touches)))
    analysed = df._jdf.queryExecution().analyzed()
    joins, cross, aggregates = 0, False, False
    for node in _nodes(analysed):
        touches.update(_named(node))
        name = node.getClass().getSimpleName()
        if name == "Join":
            joins += 1
            cross = cross or (not node.condition().isDefined() and node.joinType().sql() in ("CROSS", "INNER"))
        aggregates = aggregates or name == "Aggregate"
    top = analysed
    while top.getClass().getSimpleName() in ("Project", "SubqueryAlias", "WithCTE", "Sort") and top.children().size():
        top = top.children().apply(top.children().size() - 1 if top.getClass().getSimpleName() == "WithCTE" else 0)
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    limited = top.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit")
    known = int(str(rows.get())) if rows.isDefined() else None
    # An optimiser without statistics takes relations as endless; that is no estimate.
    size = int(str(stats.sizeInBytes()))
    return Facts(kind, tuple(sorted(touches)), joins, cross, limited, aggregates, known, size if size < 2**62 else None)


@dataclass
class Outcome:
    """The masked result, the decision behind it, and the audit record on request."""

    df: DataFrame
    raw: DataFrame
    sql: str
    context: CallContext
    decision: Mapping[str, str]
    facts: Facts
    started: datetime
    warnings: list[str] = field(default_factory=list)

    def audit(self, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
        """One audit record. The query runs once: its masked rows and findings are written, then summed up.

        The masked sample holds the first rows in the order of their text. The written rows are what ``df`` reads
        from then on.
        """
        clock = time.perf_counter()
        c = self.context
        findings = findings_of(self.raw, c.policy.detectors, c.policy.threshold)
        both = self.raw.select(F.struct(*[quoted(x) for x in self.raw.columns]).alias("__raw"), findings.alias("__found"))
        masked = mask(both.select("__raw.*", "__found"), c.policy, c.sensitivity, c.qualifier, keep=("__found",))
        rows = masked.select(F.struct(*[quoted(x) for x in self.raw.columns]).alias("row"), "__found")
        kept = cut_lineage(rows)
        self.df = kept.select("row.*")
        text = F.to_json("row")
        total = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
        found = kept.select(F.explode("__found").alias("f")).groupBy("f.entity_type").count().collect()
        sample = [r[0] for r in kept.select(text.alias("t")).orderBy("t").limit(sample_rows).collect()]
        return _record(
            self.df.sparkSession, self.sql, c, self.decision, self.facts, self.started, self.warnings, {r[0]: r[1] for r in found},
            total["rows"], total["rows"] * len(self.raw.columns), total["bytes"], (time.perf_counter() - clock) * 1000.0, sample,
        )


def _record(spark, sql, c, decision, facts, started, warnings, found, rows, cells, size, latency, sample) -> DataFrame:
    details = {
        "tenant_id": c.tenant_id, "kind": facts.kind, "touches": json.dumps(sorted({*facts.touches, *c.touches})), "joins": str(facts.joins),
        "has_limit": str(facts.has_limit).lower(),
    }
    if warnings:
        details["warnings"] = json.dumps(warnings)
    verdict = (decision["verdict"], decision["matched_rule"], decision["reason"])
    record = (started, c.assistant_id, c.assistant_session, c.tool, c.connection, _sql_hash(sql), details, verdict, found, rows, cells, size, latency, sample)
    return spark.createDataFrame([record], AUDIT)


def _sql_hash(sql: str) -> str:
    return "sha256:" + hashlib.sha256(sql.encode()).hexdigest()


def is_read_only(sql: str) -> bool:
    """The statement starts as a query: SELECT, WITH, VALUES or TABLE, set operations included."""
    return _READ_ONLY.match(sql) is not None


def decide(spark: SparkSession, context: CallContext, facts: Facts) -> Mapping[str, str]:
    """Decision for one call: the tenant's connections, then the rules, then the cost limits."""
    tenant = spark.createDataFrame([(context.tenant_id, context.connection)], "tenant_id string, connection string")
    listed = spark.createDataFrame([(t, list(x)) for t, x in context.tenants.items()], "tenant_id string, connections array<string>")
    if not tenant_filter(tenant, listed).first()["allowed"]:
        return {"verdict": "deny", "matched_rule": "tenant", "reason": f"connection {context.connection!r} is not listed for the tenant"}
    touches = sorted({*facts.touches, *context.touches})
    sql = (facts.kind == "SELECT", facts.kind, touches, facts.joins, facts.has_limit)
    request = (context.assistant_id, context.connection, list(context.tags), context.read_only, context.tool, sql)
    decision = evaluate_policy(spark.createDataFrame([request], REQUEST), context.rules).select("decision.*").first().asDict()
    if decision["verdict"] != "permit" or context.limits is None:
        return decision
    cost = (facts.cross_join, facts.has_limit, facts.kind == "SELECT", facts.aggregates, touches, facts.est_rows, facts.est_bytes)
    kinds = "cross_join boolean, has_limit boolean, is_select boolean, aggregates boolean, touches array<string>, est_rows bigint, est_bytes bigint"
    screened = cost_screen(spark.createDataFrame([cost], kinds), context.limits, context.large_tables).first()
    if screened["refused"]:
        return {"verdict": "deny", "matched_rule": "cost", "reason": screened["reason"]}
    return decision


def governed_sql(
    spark: SparkSession,
    sql: str,
    context: CallContext = CallContext(),
    params: Mapping[str, object] | None = None,
    cap_by: Sequence[str] | None = None,
    row_cap: int | None = None,
    byte_cap: int | None = None,
) -> Outcome:
    """Run read-only SQL over the registered views and mask the whole result.

    What the statement touches, joins and limits is read from its plans, not believed. ``params`` are bound by name
    (``:name``), never pasted into the text. ``cap_by`` (a unique ordering) with the caller's caps cuts the result and
    adds ``truncated``. The query is placed in a subquery, which only a query can be. A refusal raises ``Denied``
    with its audit record.
    """
    started = datetime.now(timezone.utc)

    def checked(facts: Facts) -> Mapping[str, str]:
        decision = decide(spark, context, facts)
        if decision["verdict"] == "permit" and facts.kind != "SELECT":
            decision = {"verdict": "deny", "matched_rule": "read_only", "reason": "only queries are allowed"}
        if decision["verdict"] != "permit":
            raise Denied(**decision, audit=_record(spark, sql, context, decision, facts, started, [], {}, 0, 0, 0, 0.0, []))
        return decision

    body = sql.strip().rstrip(";")
    if not is_read_only(sql):
        checked(Facts())
    # By name first, so that a refused statement is not even analysed.
    checked(statement_facts(spark, body))
    raw = spark.sql(f"SELECT * FROM (\n{body}\n)", args=dict(params or {}))
    facts = statement_facts(spark, body, raw)
    decision = checked(facts)
    warnings = []
    if cap_by:
        raw = cap(raw, cap_by, row_cap, byte_cap)
        warnings.append(f"capped at {row_cap} rows and {byte_cap} bytes")
    return Outcome(mask(raw, context.policy, context.sensitivity, context.qualifier), raw, sql, context, decision, facts, started, warnings)
