"""Composite runs; each returns a step table ``(step, ok, detail, data_json)``.

Steps that feed several others (profiles, a handful of rows) are written once. Everything unbounded stays a table of
its own rows: suggestions, owners and gotchas are one row each, never a list gathered in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.activity import find_owners, recent_changes
from plumbline.operators.anomaly import rolling_baseline
from plumbline.operators.expect import check_suite, suite_verdict
from plumbline.operators.impact import impact
from plumbline.operators.knowledge import notes_for
from plumbline.operators.pages import extract_tables
from plumbline.operators.pii import pii_summary
from plumbline.operators.profile import profile
from plumbline.operators.suggest import suggest
from plumbline.operators.verify import unmatched, verify, verify_summary
from plumbline.session import cut_lineage

STEPS = "step string, ok boolean, detail string, data_json string"
MOSTLY_NULL = 0.5


def _step(df: DataFrame, step: str | Column, detail: Column, data: Column | None = None, ok: Column | bool = True) -> DataFrame:
    name = F.lit(step) if isinstance(step, str) else step
    passed = F.lit(ok) if isinstance(ok, bool) else ok
    return df.select(
        name.alias("step"), passed.alias("ok"), detail.cast("string").alias("detail"),
        (data if data is not None else F.lit(None).cast("string")).alias("data_json"),
    )


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _profile_step(name: str, profiled: DataFrame) -> DataFrame:
    one = profiled.agg(F.max("row_count").alias("n"), F.count(F.lit(1)).alias("c"))
    data = F.to_json(F.struct(F.col("n").alias("row_count"), F.col("c").alias("columns")))
    return _step(one, name, _text(F.col("n"), " rows, ", F.col("c"), " columns"), data)


def _pii_step(findings: DataFrame) -> DataFrame:
    return _step(findings, "pii_summary", _text(F.col("entity_type"), ": ", F.col("findings")), F.to_json(F.struct("entity_type", "findings")))


def _owner_steps(suggestions: DataFrame, action: str) -> DataFrame:
    """Number of owners, then one action per owner."""
    # Both steps read it, so it is written: finding owners reads every path and commit.
    handles = cut_lineage(suggestions.select("handle").distinct())
    counted = handles.agg(F.count(F.lit(1)).alias("n"))
    found = F.when(F.col("n") > 0, _text(F.col("n"), " owner(s)")).otherwise(F.lit("no owners found"))
    return _stack([_step(counted, "identify_owners", found), _step(handles, "action", _text("ping @", F.col("handle"), f" {action}"))])


def migration_safety(
    df: DataFrame,
    table: str,
    before: DataFrame,
    after: DataFrame,
    edges: DataFrame | None = None,
    paths: DataFrame | None = None,
    owners: DataFrame | None = None,
    commits: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """Profile, change impact, owners to ping, drafted expectations and the follow-up task of a schema migration."""
    profiled = cut_lineage(profile(df, approx=approx))
    report = cut_lineage(impact(before, after, edges))
    counts = report.agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("table", "column", "risk")])
    detail = _text(F.col("table"), " table changes · ", F.col("column"), " column changes · ", F.col("risk"), " risks")
    suggestions = suggest(profiled, table)
    drafted = suggestions.agg(F.count(F.lit(1)).alias("n"))
    keys = [f.name for f in df.schema.fields][:1]
    parts = [
        _profile_step("profile_sandbox", profiled),
        _pii_step(pii_summary(df, keys)),
        _step(counts, "pr_impact_analysis", detail, F.to_json(F.struct("table", "column", "risk"))),
        _step(report.where("section = 'suggestion'"), "action", _text("add test: ", F.col("detail"))),
    ]
    if paths is not None and owners is not None and commits is not None:
        parts.append(_owner_steps(find_owners(paths, owners, commits), "for migration review"))
    parts += [
        _step(suggestions, "action", _text("expectation: ", F.col("expectation"), " ", F.col("args_json"))),
        _step(drafted, "suggest_expectations", _text(F.col("n"), " expectation(s) drafted")),
        _step(drafted, "next_task", _text(f"Add data-quality expectations for {table} from migration_safety run")),
    ]
    return _stack(parts)


def anomaly_triage(
    metric: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    label: str,
    window: int = 30,
    threshold: float = 3.0,
    commits: DataFrame | None = None,
    path: str | None = None,
    as_of: datetime | str | None = None,
    owners: DataFrame | None = None,
    notes: DataFrame | None = None,
    authors: int | None = None,
) -> DataFrame:
    """Unusual values against their baseline, recent commits, owners, notes on file and the message to send.

    Owners come first, then the authors of recent commits, each once: all, or the latest ``authors`` of them.
    """
    scored = cut_lineage(rolling_baseline(metric, keys, order, value, window, threshold))
    counts = scored.agg(F.count(F.lit(1)).alias("points"), F.count_if("anomaly").alias("unusual"))
    point = F.to_json(F.struct(*keys, *order, value, "baseline_mean", "delta", "z"))
    parts = [
        _step(counts, "recent_metric_values", _text(F.col("points"), " datapoint(s), ", F.col("unusual"), " unusual"), ok=F.col("unusual") == 0),
        _step(scored.where("anomaly"), "unusual_value", _text(label, " ", F.concat_ws("/", *keys)), point, ok=False),
    ]
    spark = metric.sparkSession
    if commits is not None and path is not None and as_of is not None:
        changes = recent_changes(commits, path, as_of, 30)
        parts.append(_step(changes.agg(F.count(F.lit(1)).alias("n")), "recent_changes", _text(F.col("n"), " commit(s) in the last 30 days")))
        if owners is not None:
            asked = spark.createDataFrame([(path,)], "path string")
            handles = find_owners(asked, owners, commits).select("handle")
            latest = changes.where("author <> ''").groupBy("author").agg(F.max("when").alias("when")).orderBy(F.col("when").desc(), "author")
            pinged = handles.union((latest if authors is None else latest.limit(authors)).select("author"))
            parts.append(_owner_steps(pinged.toDF("handle"), f"about {label}"))
    if notes is not None:
        found = notes_for(spark.createDataFrame([(f"table:{label}",)], "key string"), notes)
        parts.append(_step(found, "known_quirks", F.col("body"), F.to_json(F.struct("body", "author", "created_at"))))
    parts.append(_step(counts, "next_task", _text(f"Investigate anomaly in {label}")))
    return _stack(parts)


def pre_release(tables: Mapping[str, DataFrame], specs: Mapping[str, Mapping], as_of: datetime | str | None = None) -> DataFrame:
    """One step per expectation spec, then the release verdict."""
    if not specs:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([("locate_expectations", False, "no expectation files", None)], STEPS)
    suite = cut_lineage(check_suite(tables, specs, as_of))
    name = F.concat(F.lit("check:"), "spec")
    verdict = suite_verdict(suite)
    attention = F.when(
        F.col("release"), _text(F.col("specs_passed"), "/", F.col("specs_total"), " expectation files passed")
    ).otherwise(_text("blocked by: ", F.col("failing_tables")))
    return _stack([
        _step(suite, name, _text(F.col("passed"), "/", F.col("total"), " passed"), ok=F.col("ok")),
        _step(verdict, "release", attention, ok=F.col("release")),
    ])


def gotchas(profiled: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """What a new reader of the table should know: ``(column, gotcha)``."""
    share = _text(F.format_number(F.col("null_rate") * 100, 1), "%")
    rules = F.array(
        F.when(F.col("null_rate") > MOSTLY_NULL, _text(F.col("column"), " holds no value in ", share, " of the rows")),
        F.when(
            (F.col("semantic_type") == "timestamp") & (F.col("null_rate") == 0),
            _text(F.col("column"), " always has a time; it may come from a default"),
        ),
    )
    rows = profiled.select("column", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("gotcha"))
    if findings is not None:
        present = findings.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        warning = F.lit("holds personal data; share masked results only")
        rows = rows.unionByName(present.select(F.lit(None).cast("string").alias("column"), warning.alias("gotcha")))
    return rows


def handoff(
    df: DataFrame,
    table: str,
    row_key: Sequence[str],
    rules: str = "name",
    paths: DataFrame | None = None,
    owners: DataFrame | None = None,
    commits: DataFrame | None = None,
    notes: DataFrame | None = None,
    as_of: datetime | str | None = None,
    approx: bool = False,
) -> DataFrame:
    """Brief for someone taking a table over: profile, personal data, owners, changes, notes and gotchas."""
    profiled = cut_lineage(profile(df, rules=rules, approx=approx))
    findings = cut_lineage(pii_summary(df, row_key))
    parts = [
        _profile_step("profile", profiled),
        _step(
            profiled, "column", _text(F.col("column"), ": ", F.col("type"), ", ", F.col("semantic_type")),
            F.to_json(F.struct("null_rate", F.slice("top_values", 1, 3).alias("top_values"))),
        ),
        _pii_step(findings),
    ]
    if paths is not None and owners is not None and commits is not None:
        parts.append(_owner_steps(find_owners(paths, owners, commits), f"about {table}"))
    if commits is not None and as_of is not None and paths is not None:
        since = F.lit(str(as_of)).cast("timestamp") - F.make_interval(days=F.lit(60))
        recent = commits.join(paths.toDF("path").distinct(), "path", "left_semi").where(F.col("authored_at") >= since)
        parts.append(_step(recent.agg(F.count(F.lit(1)).alias("n")), "recent_changes", _text(F.col("n"), " commit(s) in last 60 days")))
    if notes is not None:
        found = notes_for(df.sparkSession.createDataFrame([(f"table:{table}",)], "key string"), notes)
        parts.append(_step(found, "known_quirks", F.col("body"), F.to_json(F.struct("body"))))
    parts.append(_step(gotchas(profiled, findings), "gotcha", F.col("gotcha")))
    return _stack(parts)


def rendered_rows(pages: DataFrame, columns: Sequence[str], table_no: int = 0, id_col: str = "page_id") -> DataFrame:
    """The cells of one table per page as string columns, with page and row number."""
    cells = extract_tables(pages, id_col=id_col).where(F.col("table_no") == table_no)
    return cells.select(id_col, "row_no", *[F.col("cells").getItem(c).alias(c) for c in columns])


def dashboard_verify(
    pages: DataFrame, truth: DataFrame, key: str, value_cols: Sequence[str], tolerance: float = 0.0, id_col: str = "page_id",
    truth_order: Sequence[str] = (),
) -> DataFrame:
    """Tables shown on stored pages against the truth: comparison, discrepancies per severity, unmatched keys."""
    shown = cut_lineage(rendered_rows(pages, [key, *value_cols], id_col=id_col))
    order = [id_col, "row_no"]
    found = cut_lineage(verify(shown, truth, key, value_cols, tolerance, order, truth_order))
    total = found.agg(F.count(F.lit(1)).alias("n"))
    sides = unmatched(shown, truth, key, value_cols, order, truth_order).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    by_severity = verify_summary(found)
    return _stack([
        _step(shown.agg(F.count(F.lit(1)).alias("n")), "extract", _text(F.col("n"), " rendered row(s)")),
        _step(total, "compare", _text("mismatches=", F.col("n")), ok=F.col("n") == 0),
        _step(by_severity, "severity", _text(F.col("severity"), "=", F.col("cells"), " → ", F.col("action")), ok=False),
        _step(sides, "unmatched", _text(F.col("side"), "=", F.col("n"))),
    ])


