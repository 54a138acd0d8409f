"""Policies, tenants, cost limits and call budgets over tables of requests and query logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.globs import matches_any

DEFAULT_TENANT = "default"

# The built-in rules and the shipped bundle. Conditions are Spark SQL over a request row.
DEFAULT_RULES = (
    {"name": "deny-system-tables", "effect": "deny", "tools": ["query_database"], "priority": 10,
     "when": "array_contains(sql.touches, 'audit_log') OR array_contains(sql.touches, 'users.password_hash')"},
    {"name": "consent-for-non-select", "effect": "consent", "tools": ["query_database"], "priority": 20,
     "when": "NOT sql.is_select"},
    {"name": "consent-for-prod", "effect": "consent", "priority": 30,
     "tools": ["query_database", "profile_table", "diff_environments"], "when": "array_contains(tags, 'prod')"},
    {"name": "allow-select-read-only", "effect": "allow", "priority": 100, "when": "sql.is_select AND read_only",
     "tools": ["query_database", "profile_table", "diff_environments", "explain_lineage", "analyze_pr_data_impact",
               "generate_test_cases", "check_data_quality"]},
    {"name": "allow-metadata-tools", "effect": "allow", "priority": 200,
     "tools": ["list_connections", "list_tables", "describe_table", "audit_query"]},
)
SHIPPED_RULES = (
    {"name": "deny-credential-tables", "effect": "deny", "priority": 5,
     "when": "array_contains(sql.touches, 'users.password_hash') OR array_contains(sql.touches, 'auth.sessions')"},
    {"name": "deny-pii-tables-for-non-admin-assistants", "effect": "deny", "assistants": ["*"], "priority": 15,
     "when": "array_contains(tags, 'prod.pii') AND NOT array_contains(tags, 'admin')"},
    {"name": "warn-on-large-joins", "effect": "consent", "priority": 25, "when": "sql.joins > 5"},
    {"name": "allow-explain-everywhere", "effect": "allow", "tools": ["query_database"], "priority": 50,
     "when": "sql.kind = 'EXPLAIN' OR sql.kind = 'DESCRIBE'"},
)

def load_rules(path: str) -> list[dict]:
    """Rules of a YAML bundle with a top-level ``rules`` list; conditions are Spark SQL."""
    import yaml

    bundle = yaml.safe_load(Path(path).read_text())
    if not isinstance(bundle, dict) or "rules" not in bundle:
        raise ValueError(f"{path}: expected a top-level 'rules' list")
    return bundle["rules"]


_VERDICTS = {"deny": "deny", "consent": "consent_required", "allow": "permit"}
_REASONS = {"deny": "deny by rule '{}'", "consent": "rule '{}' requires consent", "allow": "allowed by rule '{}'"}


def _decision(verdict: str, rule: str, reason: str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("matched_rule"), F.lit(reason).alias("reason"))


def evaluate_policy(requests: DataFrame, rules: Sequence[Mapping] = DEFAULT_RULES) -> DataFrame:
    """Adds ``decision``: the first matching rule by priority (declaration order on a tie), else ``implicit_deny``.

    Rules are configuration, so they become one ordered condition chain: no join and no shuffle. A condition that
    is null, as on a missing field, does not match.
    """
    choices = []
    for rule in sorted(rules, key=lambda r: r.get("priority", 100)):
        condition = (
            matches_any(F.col("assistant_id"), rule.get("assistants", ["*"]))
            & matches_any(F.col("connection"), rule.get("connections", ["*"]))
            & matches_any(F.col("tool"), rule.get("tools", ["*"]))
        )
        if rule.get("when"):
            condition = condition & F.expr(rule["when"])
        effect = rule["effect"]
        choices.append(F.when(condition, _decision(_VERDICTS[effect], rule["name"], _REASONS[effect].format(rule["name"]))))
    fallback = _decision("deny", "implicit_deny", "no policy rule matched; default-deny")
    return requests.withColumn("decision", F.coalesce(*choices, fallback))


def tenant_filter(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Adds ``allowed``: a named tenant with listed connections may use only those.

    The default tenant, a tenant without a manifest and an empty list are not restricted. ``manifests`` is
    ``(tenant_id, connections array)``, one row per tenant; Spark broadcasts it when its size allows.
    """
    listed = manifests.select("tenant_id", F.col("connections").alias("__listed"))
    free = (
        (F.col("tenant_id") == DEFAULT_TENANT)
        | F.col("__listed").isNull()
        | (F.size("__listed") == 0)
        | F.array_contains("__listed", F.col("connection"))
    )
    return requests.join(listed, "tenant_id", "left").withColumn("allowed", F.coalesce(free, F.lit(True))).drop("__listed")


@dataclass(frozen=True)
class CostLimits:
    """Limits of the cost screen."""

    max_rows: int = 100_000_000
    max_bytes: int = 10 * 1024**3
    refuse_cross_join: bool = True
    require_limit_on_large: bool = True
    auto_limit: int = 10_000


def cost_screen(query_log: DataFrame, limits: CostLimits = CostLimits(), large_tables: Sequence[str] = ()) -> DataFrame:
    """Adds ``refused``, ``reason`` and ``warning`` to logged queries.

    Reads ``cross_join``, ``has_limit``, ``is_select``, ``aggregates``, ``touches``, ``est_rows`` and ``est_bytes``.
    """
    big = F.array_sort(F.array_intersect("touches", F.array(*[F.lit(t) for t in large_tables]).cast("array<string>")))
    unbounded = F.col("is_select") & ~F.col("has_limit")
    reason = F.lit(None).cast("string")
    # Built from the last check to the first, so the first broken limit names the reason.
    reason = F.when(F.col("est_bytes") > limits.max_bytes, F.lit(f"estimated bytes over {limits.max_bytes}")).otherwise(reason)
    reason = F.when(F.col("est_rows") > limits.max_rows, F.lit(f"estimated rows over {limits.max_rows}")).otherwise(reason)
    if limits.require_limit_on_large and large_tables:
        named = F.concat(F.lit("large table without LIMIT: "), F.array_join(big, ", "))
        reason = F.when(unbounded & (F.size(big) > 0), named).otherwise(reason)
    if limits.refuse_cross_join:
        reason = F.when(F.col("cross_join"), F.lit("cross join")).otherwise(reason)
    warning = F.when(
        F.col("reason").isNull() & unbounded & ~F.col("aggregates") & F.lit(limits.auto_limit > 0),
        F.lit(f"would be limited to {limits.auto_limit} rows"),
    )
    return query_log.withColumn("reason", reason).withColumn("refused", F.col("reason").isNotNull()).withColumn("warning", warning)


def concurrency_peak(log: DataFrame, key: str, start: str, end: str, slice_seconds: int = 3600) -> DataFrame:
    """Most calls in flight at once per key; a call that ends when another starts does not overlap it.

    Changes are summed per instant on the map side. Running sums go over time slices and then over the slice totals,
    so a key with a third of the log is spread over its slices instead of being sorted in one task.
    """
    instants = log.select(
        key,
        F.explode(
            F.array(
                F.struct(F.unix_micros(F.col(start).cast("timestamp")).alias("at"), F.lit(1).alias("step")),
                F.struct(F.unix_micros(F.col(end).cast("timestamp")).alias("at"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    )
    steps = instants.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    width = slice_seconds * 1_000_000
    sliced = steps.withColumn("slice", F.floor(F.col("at") / width))
    inside = Window.partitionBy(key, "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    per_slice = sliced.withColumn("running", F.sum("step").over(inside)).groupBy(key, "slice").agg(
        F.sum("step").alias("total"), F.max("running").alias("highest")
    )
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("total").over(earlier), F.lit(0)) + F.col("highest")
    return per_slice.withColumn("level", level).groupBy(key).agg(F.greatest(F.max("level"), F.lit(0)).alias("peak"))


def over_budget(events: DataFrame, key: str, ts: str, per_minute: int) -> DataFrame:
    """Minutes in which a key made more calls than its budget."""
    minute = F.window(F.col(ts).cast("timestamp"), "1 minute")
    counted = events.groupBy(key, minute.alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.where(F.col("calls") > per_minute).select(key, F.col("w.start").alias("minute"), "calls")
