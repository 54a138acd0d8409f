"""Pages, displayed tables, composite runs, governed SQL and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import governance, lineage, quality
from checks.common import load
from checks.privacy import LABEL, valid_cards
from plumbline.functions.cells import to_number
from plumbline.operators import anomaly, govern, pages, verify
from plumbline.operators.mask import MaskPolicy, Sensitivity
from plumbline.plans import governed, runs
from plumbline.session import scratch_path
from plumbline.streaming import streams

# -- pages ------------------------------------------------------------------------------------------------------


def _table_pages(spark, sf):
    """One stored page per supplier, its table written out; every third table has a plain first-row header."""
    key, name, balance = F.col("s_suppkey").cast("string"), F.col("s_name"), F.format_number("s_acctbal", 2)
    row = F.concat(F.lit("<tr><td>"), key, F.lit("</td><td> "), name, F.lit("\n</td><td>$"), balance, F.lit("</td></tr>"))
    short = F.concat(F.lit("<tr><td>-"), key, F.lit("</td></tr>"))
    head = F.lit("<th>key</th><th></th><th>balance</th>")
    with_head = F.concat(F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), row, short, F.lit("</tbody></table>"))
    plain = F.concat(F.lit("<p>x<table><tr>"), head, F.lit("</tr>"), row, short, F.lit("</table>"))
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.lit("https://bi.example.com/d").alias("url"),
        F.when(F.col("s_suppkey") % 3 == 0, plain).otherwise(with_head).alias("html"))


def _tables(spark, sf):
    cells = pages.extract_tables(_table_pages(spark, sf))
    return cells.select("page_id", "row_no", *[F.col("cells")[c].alias(n) for c, n in (("key", "k"), ("col_1", "name"), ("balance", "balance"))])


def _titles(spark, sf):
    return pages.extract_text(load(spark, sf, "pages"), "title")


def _links(spark, sf):
    return pages.extract_text(load(spark, sf, "pages"), "a").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


def _form_pages(spark, sf):
    key = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<form><input name="user" id="u'), key, F.lit('" required><input type="password" placeholder="pw"><input type=hidden name=t>'),
        F.lit("<select name=s><option>a<option>b</select><textarea data-testid=ta></textarea>"),
        F.lit("<button id=b> Go "), key, F.lit('</button><a role="button" aria-label="more">More</a><input type="submit" value="Send"><button></button></form>'),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("<canvas width=10></canvas>")).when(F.col("c_custkey") % 4 == 1, F.lit('<CANVAS width="0">')).otherwise(""),
    )
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))


def _buttons(spark, sf):
    return pages.list_buttons(_form_pages(spark, sf))


def _inputs(spark, sf):
    return pages.list_inputs(_form_pages(spark, sf))


def _canvas(spark, sf):
    return pages.has_canvas(_form_pages(spark, sf)).select("page_id", "has_canvas")


def _classify(spark, sf):
    """Stored pages, every fifth behind a login URL, every seventh asking for a second factor."""
    key = F.col("page_id")
    url = F.when(key % 5 == 0, F.concat("url", F.lit("/Login"))).otherwise(F.col("url"))
    html = F.when(key % 7 == 0, F.concat(F.lit("<title>Sign In</title><p>Enter the security code</p>"), "html")).otherwise(F.col("html"))
    shown = load(spark, sf, "pages").select("page_id", url.alias("url"), html.alias("html"))
    return pages.classify_pages(shown).select("page_id", "is_login", "is_mfa")


ALLOWED = ["http://therha.example.com", "https://www.cheap-pills.example.com", "https://m.ththth.example.net"]


def _origins(spark, sf):
    gated = pages.origin_gate(load(spark, sf, "pages"), ALLOWED)
    return gated.select("page_id", "origin", "allowed", "log")


# -- displayed tables -------------------------------------------------------------------------------------------


def _shown(column):
    """Displayed prices: money format, thousands suffix, padded text, missing, wrong."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return (
        F.when(key % 10 == 0, F.concat(F.format_number(price / 1000, 1), F.lit("K")))
        .when(key % 10 == 1, F.concat(F.lit(" $"), F.format_number(price, 2)))
        .when(key % 10 == 2, F.lit(None))
        .when(key % 10 == 3, F.lit("n/a"))
        .when(key % 10 == 4, F.format_number(price * 2, 2))
        .otherwise(F.format_number(price, 2))
    ).alias(column)


def _rendered(orders):
    kept = orders.where("o_orderkey % 13 <> 0").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("o_orderkey"), _shown("o_totalprice"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit("?")).otherwise(F.concat(F.lower("o_orderstatus"), F.lit(" "))).alias("o_orderstatus"), F.lit(1).alias("n"))
    extra = orders.where("o_orderkey % 17 = 0").select(
        F.concat(F.lit("x"), F.col("o_orderkey").cast("string")), F.lit("1"), F.lit("f"), F.lit(1))
    stale = kept.where("o_orderkey % 19 = 0").withColumn("o_totalprice", F.lit("0")).withColumn("n", F.lit(0))
    return kept.union(extra).union(stale)


def _to_number(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.round(to_number(_shown("o_totalprice")), 4).alias("number"))


def _verify(spark, sf, tolerance=0.001):
    orders = load(spark, sf, "orders")
    return verify.verify(_rendered(orders), orders, "o_orderkey", ["o_totalprice", "o_orderstatus"], tolerance, ["n"])


def _verify_cells(spark, sf):
    return _verify(spark, sf).select("key", "column", "severity")


def _verify_summary(spark, sf):
    return verify.verify_summary(_verify(spark, sf))


def _unmatched(spark, sf):
    orders = load(spark, sf, "orders")
    return verify.unmatched(_rendered(orders), orders, "o_orderkey", ["o_totalprice"], ["n"])


# -- composite runs ---------------------------------------------------------------------------------------------


def _series(spark, sf):
    """Daily sums per event type."""
    events = load(spark, sf, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def _baseline(spark, sf):
    scored = anomaly.rolling_baseline(_series(spark, sf), ["event_type"], ["day"], "total", window=7, threshold=1.5, block_rows=10)
    rounded = [F.round(c, 5).alias(c) for c in ("baseline_mean", "baseline_std", "delta", "step", "z")]
    return scored.select("event_type", F.col("day").cast("string").alias("day"), "total", *rounded, "anomaly")


def _triage(spark, sf):
    notes = load(spark, sf, "part").select(
        F.lit("table:clicks").alias("key"), F.col("p_name").alias("body"), F.col("p_brand").alias("author"),
        F.lit(None).cast("timestamp").alias("created_at"), F.col("p_partkey").alias("id"))
    log = lineage.commits(spark, sf)
    return runs.anomaly_triage(
        _series(spark, sf), ["event_type"], ["day"], "total", "clicks", 7, 1.5, log, "part/1/1.sql", lineage.AS_OF, lineage.owner_table(spark, sf), notes
    ).select("step", "ok", "detail")


def _migration(spark, sf):
    log = lineage.commits(spark, sf)
    owners = lineage.owner_table(spark, sf)
    before, after = lineage.catalogs(spark, sf)
    return runs.migration_safety(
        load(spark, sf, "customer"), "customer", before, after, lineage._supplier_edges(spark, sf), log.select("path"), owners, log
    ).select("step", "ok", "detail")


def _pre_release(spark, sf):
    return runs.pre_release(
        quality._tables(spark, sf), {"orders_spec": quality.ORDERS_SPEC, "customer_spec": quality.CLEAN_SPEC}, quality.AS_OF
    ).select("step", "ok", "detail")


def _handoff(spark, sf):
    """Orders handed over with everything known of them: owners or committers of all paths, commits of the last weeks, notes on file."""
    orders = load(spark, sf, "orders").withColumns({
        "note": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")),
        "created_at": F.col("o_orderdate").cast("timestamp"),
        "contact_email": F.concat(F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
    })
    log = lineage.commits(spark, sf)
    notes = load(spark, sf, "part").select(
        F.when(F.col("p_size") > 10, "table:orders").otherwise("table:parts").alias("key"), F.col("p_name").alias("body"), F.col("p_brand").alias("author"),
        F.lit(None).cast("timestamp").alias("created_at"), F.col("p_partkey").alias("id"))
    steps = runs.handoff(
        orders, "orders", ["o_orderkey"], paths=log.select("path"), owners=lineage.owner_table(spark, sf), commits=log, notes=notes, as_of=lineage.AS_OF, approx=False)
    return steps.select("step", "ok", "detail")


def _dashboard(spark, sf):
    truth = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1000).otherwise(F.col("s_acctbal")).alias("balance"))
    return runs.dashboard_verify(_table_pages(spark, sf), truth, "key", ["balance"], 0.0001).select("step", "ok", "detail")


# -- governed SQL -----------------------------------------------------------------------------------------------


def _governed(spark, sf):
    load(spark, sf, "documents").createOrReplaceTempView("docs_governed")
    context = governed.CallContext(policy=MaskPolicy(salt="pepper"), sensitivity=Sensitivity({"source": "hash"}))
    return governed.governed_sql(
        spark, "SELECT doc_id, text, source FROM docs_governed WHERE lang = :lang", context, {"lang": "en"}).df


def _governed_capped(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders_governed")
    sql = "SELECT o_orderstatus AS status, count(*) AS n FROM orders_governed GROUP BY 1 UNION SELECT 'all', count(*) FROM orders_governed"
    return governed.governed_sql(spark, sql, cap_by=["status"], row_cap=3).df


def _governed_audit(spark, sf):
    load(spark, sf, "documents").createOrReplaceTempView("docs_governed")
    outcome = governed.governed_sql(spark, "SELECT doc_id, text FROM docs_governed")
    return outcome.audit().select(
        "tool", F.col("policy_verdict.matched_rule").alias("rule"), "rows", "cells", "bytes_returned", F.col("pii_summary")["EMAIL"].alias("emails"),
        F.col("pii_summary")["CREDIT_CARD"].alias("cards"))


def _governed_denied(spark, sf):
    """One call for every way to be refused, and one that runs: the audit records of them all."""
    load(spark, sf, "orders").createOrReplaceTempView("audit_log")
    spark.sql("CREATE OR REPLACE TEMP VIEW innocent AS SELECT o_orderkey FROM audit_log")
    load(spark, sf, "orders").createOrReplaceTempView("orders_governed")
    limits = govern.CostLimits(max_bytes=10**15)
    calls = [
        ("table", "SELECT o_orderkey FROM audit_log", {}),
        ("view", "SELECT count(*) AS n FROM innocent", {}),
        ("subquery", "SELECT o_orderkey FROM orders_governed WHERE o_orderkey IN (SELECT o_orderkey FROM innocent)", {}),
        ("write", "INSERT INTO orders_governed VALUES (1)", {}),
        ("tenant", "SELECT o_orderkey FROM orders_governed", {"tenant_id": "t1", "tenants": {"t1": ["other"]}}),
        ("cost", "SELECT a.o_orderkey FROM orders_governed a CROSS JOIN orders_governed b", {"limits": limits}),
        ("runs", "SELECT o_orderkey FROM orders_governed", {"limits": limits, "tenants": {"t1": ["spark"]}, "tenant_id": "t1"}),
    ]
    records = []
    for name, sql, context in calls:
        try:
            record = governed.governed_sql(spark, sql, governed.CallContext(**context)).audit()
        except governed.Denied as denied:
            record = denied.audit
        records.append(record.select(
            F.lit(name).alias("call"), F.col("policy_verdict.verdict").alias("verdict"), F.col("policy_verdict.matched_rule").alias("rule"),
            F.col("sql_ast_summary")["touches"].alias("touches"), "rows"))
    return reduce(DataFrame.unionByName, records)


# -- streams ----------------------------------------------------------------------------------------------------


def _stream(spark, sf, table):
    """A table as a stream, be it one file or a folder of part files: a pattern may name either, a plain path only a folder."""
    schema = load(spark, sf, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def _sunk(spark, stream, name):
    """Run a stream over what is there now and read its output files."""
    out = scratch_path(spark, name)
    streams.run_available(stream, out, scratch_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def _stream_mask(spark, sf):
    return _sunk(spark, streams.mask_stream(_stream(spark, sf, "documents")), "masked")


def _stream_rate(spark, sf):
    fast = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    events = _stream(spark, sf, "events").select("event_id", "event_type", fast.alias("ts"))
    return _sunk(spark, streams.rate_limit_stream(events, ["event_type"], "ts", "event_id", 30), "limited").select("event_id", "event_type", "allowed")


def _stream_windows(spark, sf):
    return _sunk(spark, streams.window_counts(_stream(spark, sf, "events"), "ts", "1 day", "1 hour", ["event_type"]), "windows")


QUERIES = {
    "page_tables": _tables,
    "page_titles": _titles,
    "page_links": _links,
    "page_source": lambda s, d: pages.extract_text(load(s, d, "pages")),
    "page_buttons": _buttons,
    "page_inputs": _inputs,
    "page_canvas": _canvas,
    "page_classes": _classify,
    "page_origins": _origins,
    "displayed_numbers": _to_number,
    "verify_cells": _verify_cells,
    "verify_summary": _verify_summary,
    "verify_unmatched": _unmatched,
    "anomaly_baseline": _baseline,
    "run_anomaly_triage": _triage,
    "run_migration_safety": _migration,
    "run_pre_release": _pre_release,
    "run_handoff": _handoff,
    "run_dashboard_verify": _dashboard,
    "governed_query": _governed,
    "governed_capped": _governed_capped,
    "governed_audit": _governed_audit,
    "governed_denied": _governed_denied,
    "stream_mask": _stream_mask,
    "stream_rate_limit": _stream_rate,
    "stream_window_counts": _stream_windows,
}

TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
PLAIN = TITLE
for _entity, _char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&amp;?", "&")):
    PLAIN = f"regexp_replace({PLAIN}, '{_entity}', '{_char}', 'g')"
MONEY = "format('{{:,.2f}}', {})"
SHOWN = f"""CASE o_orderkey % 10 WHEN 0 THEN format('{{:,.1f}}', o_totalprice / 1000) || 'K' WHEN 1 THEN ' $' || {MONEY.format('o_totalprice')} WHEN 2 THEN NULL
    WHEN 3 THEN 'n/a' WHEN 4 THEN {MONEY.format('o_totalprice * 2')} ELSE {MONEY.format('o_totalprice')} END"""
# Every rendered key is one order here: the stale copies lose against the newer row.
VERDICTS = """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'o_totalprice' AS "column", CASE
        WHEN o_orderkey % 10 = 0 THEN 'rounded_truncation' WHEN o_orderkey % 10 IN (2, 4) THEN 'exact_mismatch'
        WHEN o_orderkey % 10 = 3 THEN 'format_mismatch' END AS severity FROM orders WHERE o_orderkey % 13 <> 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderstatus', CASE WHEN o_orderkey % 6 = 0 THEN 'format_mismatch' END FROM orders WHERE o_orderkey % 13 <> 0"""
SERIES = "SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"
SUITE = quality.ORACLES["expect_suite"]
BALANCES = """SELECT s_suppkey, abs(b - CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1000 ELSE s_acctbal END) >
    0.0001 * abs(CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1000 ELSE s_acctbal END) AS bad FROM (SELECT *, round(s_acctbal, 2) AS b FROM supplier)"""

TOP_COMMITTERS = f"""SELECT path, author_login AS handle FROM (SELECT path, author_login, row_number() OVER (PARTITION BY path ORDER BY n DESC, author_login) AS rn
    FROM (SELECT path, author_login, count(*) AS n FROM ({lineage.COMMITS}) WHERE author_login IS NOT NULL GROUP BY 1, 2))"""
# Folders 0 to 2 have owners, the brands of their parts; elsewhere the committers stand in.
HANDLES = f"""SELECT p_brand AS handle FROM part WHERE p_partkey % 10 <= 2 AND p_partkey % 10 IN (SELECT l_partkey % 10 FROM lineitem)
    UNION SELECT handle FROM ({TOP_COMMITTERS}) WHERE NOT regexp_matches(path, '^part/[012]/')"""
SCORED = f"""WITH s AS ({SERIES}), b AS (SELECT *, avg(total) OVER w AS m, stddev_samp(total) OVER w AS sd
        FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, coalesce(abs((total - m) / nullif(sd, 0)) > 1.5, false) AS odd FROM b),
    r AS (SELECT sha, coalesce(author_login, 'Someone') AS author, authored_at FROM ({lineage.COMMITS})
          WHERE path = 'part/1/1.sql' AND authored_at >= TIMESTAMP '{lineage.AS_OF}' - INTERVAL 30 DAY),
    o AS (SELECT p_brand AS handle FROM part WHERE p_partkey % 10 = 1 UNION SELECT author FROM r)"""

ORACLES = {
    "run_anomaly_triage": f"""{SCORED}
        SELECT 'recent_metric_values' AS step, count(*) FILTER (odd) = 0 AS ok, count(*) || ' datapoint(s), ' || count(*) FILTER (odd) || ' unusual' AS detail FROM a
        UNION ALL SELECT 'unusual_value', false, 'clicks ' || event_type FROM a WHERE odd
        UNION ALL SELECT 'recent_changes', true, count(*) || ' commit(s) in the last 30 days' FROM r
        UNION ALL SELECT 'identify_owners', true, CASE WHEN count(*) > 0 THEN count(*) || ' owner(s)' ELSE 'no owners found' END FROM o
        UNION ALL SELECT 'action', true, 'ping @' || handle || ' about clicks' FROM o
        UNION ALL SELECT 'known_quirks', true, p_name FROM part
        UNION ALL SELECT 'next_task', true, 'Investigate anomaly in clicks'""",
    "run_migration_safety": f"""{lineage.CATALOGS}, o AS ({HANDLES}), x AS ({quality._suggest_sql()})
        SELECT 'profile_sandbox' AS step, true AS ok, count(*) || ' rows, 5 columns' AS detail FROM customer
        UNION ALL SELECT 'pr_impact_analysis', true, (SELECT count(*) FROM t) || ' table changes · ' || (SELECT count(*) FROM c) || ' column changes · '
            || (SELECT count(*) FROM t JOIN supplier ON "table" = 'supp_' || s_suppkey) || ' risks'
        UNION ALL SELECT 'action', true, 'add test: ' || suggestion FROM s
        UNION ALL SELECT 'identify_owners', true, count(*) || ' owner(s)' FROM o
        UNION ALL SELECT 'action', true, 'ping @' || handle || ' for migration review' FROM o
        UNION ALL SELECT 'action', true, 'expectation: ' || expectation || ' ' || args_json FROM x
        UNION ALL SELECT 'suggest_expectations', true, count(*) || ' expectation(s) drafted' FROM x
        UNION ALL SELECT 'next_task', true, 'Add data-quality expectations for customer from migration_safety run'""",
    "page_tables": f"""SELECT s_suppkey AS page_id, 0 AS row_no, CAST(s_suppkey AS VARCHAR) AS k, s_name AS name, '$' || {MONEY.format('s_acctbal')} AS balance FROM supplier
        UNION ALL SELECT s_suppkey, 1, '-' || s_suppkey, '', '' FROM supplier""",
    "page_titles": f"SELECT page_id, 0 AS n, trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g')) AS text FROM pages WHERE html LIKE '%<title>%'",
    "page_links": r"""SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<a[\s>]')) AS links
        FROM pages WHERE len(regexp_extract_all(html, '(?i)<a[\s>]')) > 0""",
    "page_source": "SELECT page_id, 0 AS n, html AS text FROM pages",
    "page_buttons": """SELECT c_custkey AS page_id, 0 AS "index", 'Go ' || c_custkey AS text, 'button' AS tag, 'b' AS id, CAST(NULL AS VARCHAR) AS testid, CAST(NULL AS VARCHAR) AS aria_label FROM customer
        UNION ALL SELECT c_custkey, 1, 'More', 'a', NULL, NULL, 'more' FROM customer UNION ALL SELECT c_custkey, 2, 'Send', 'input', NULL, NULL, NULL FROM customer""",
    "page_inputs": """SELECT c_custkey AS page_id, 0 AS "index", 'input' AS tag, 'text' AS type, 'user' AS name, 'u' || c_custkey AS id, NULL AS testid, NULL AS placeholder, true AS required, false AS is_password FROM customer
        UNION ALL SELECT c_custkey, 1, 'input', 'password', NULL, NULL, NULL, 'pw', false, true FROM customer
        UNION ALL SELECT c_custkey, 3, 'select', 'select-one', 's', NULL, NULL, NULL, false, false FROM customer
        UNION ALL SELECT c_custkey, 4, 'textarea', 'textarea', NULL, NULL, 'ta', NULL, false, false FROM customer
        UNION ALL SELECT c_custkey, 5, 'input', 'submit', NULL, NULL, NULL, NULL, false, false FROM customer""",
    "page_canvas": "SELECT c_custkey AS page_id, c_custkey % 4 = 0 AS has_canvas FROM customer",
    "page_classes": """WITH p AS (SELECT page_id, lower(CASE WHEN page_id % 5 = 0 THEN url || '/Login' ELSE url END) AS u,
            lower(CASE WHEN page_id % 7 = 0 THEN 'Sign In' ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END) AS t,
            lower(CASE WHEN page_id % 7 = 0 THEN 'Sign In Enter the security code' || html ELSE html END) AS h FROM pages)
        SELECT page_id, len(list_filter(['/login', '/signin', '/sign-in', '/sso', '/auth', '/oauth', 'okta.com', 'auth0.com', 'duo.com', 'ping.com'], lambda m: contains(u, m))) > 0
            OR len(list_filter(['sign in', 'log in', 'login', 'authentication', 'verify your identity'], lambda m: contains(t, m))) > 0 AS is_login,
            len(list_filter(['duo', 'verify your identity', '2-step', 'two-step', 'two-factor', 'security code', 'authenticator', 'push notification', 'approve sign in', 'verify it''s you'],
                lambda m: contains(u || ' ' || t || ' ' || regexp_replace(h, '<[^>]*>', ' ', 'g'), m))) > 0 AS is_mfa FROM p""",
    "page_origins": f"""SELECT page_id, o AS origin, o IN ({', '.join(repr(a) for a in ALLOWED)}) AS allowed,
        CASE WHEN o IN ({', '.join(repr(a) for a in ALLOWED)}) THEN o ELSE 'BLOCKED:' || o END AS log
        FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o FROM pages)""",
    "displayed_numbers": f"""SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN CAST(replace(replace(s, ',', ''), 'K', '') AS DOUBLE) * 1000
        ELSE TRY_CAST(trim(replace(replace(s, ',', ''), '$', '')) AS DOUBLE) END, 4) AS number FROM (SELECT o_orderkey, {SHOWN} AS s FROM orders)""",
    "verify_cells": f"SELECT * FROM ({VERDICTS}) WHERE severity IS NOT NULL",
    "verify_summary": f"""SELECT severity, count(*) AS cells, CASE severity WHEN 'exact_mismatch' THEN 'block' WHEN 'rounded_truncation' THEN 'monitor' ELSE 'ticket' END AS action
        FROM ({VERDICTS}) WHERE severity IS NOT NULL GROUP BY severity""",
    "verify_unmatched": """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'only_db' AS side, 1 AS rows FROM orders WHERE o_orderkey % 13 = 0
        UNION ALL SELECT 'x' || o_orderkey, 'only_rendered', 1 FROM orders WHERE o_orderkey % 17 = 0
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'duplicate_rendered', 2 FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 19 = 0""",
    "anomaly_baseline": f"""WITH s AS ({SERIES}), b AS (SELECT *, avg(total) OVER w AS m, stddev_samp(total) OVER w AS sd, lag(total) OVER (PARTITION BY event_type ORDER BY day) AS p
            FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
        SELECT event_type, CAST(day AS VARCHAR) AS day, total, round(m, 5) AS baseline_mean, round(sd, 5) AS baseline_std, round(total - m, 5) AS delta, round(total - p, 5) AS step,
               round((total - m) / nullif(sd, 0), 5) AS z, coalesce(abs((total - m) / nullif(sd, 0)) > 1.5, false) AS anomaly FROM b""",
    "run_pre_release": f"""SELECT 'check:' || spec AS step, ok, passed || '/' || total || ' passed' AS detail FROM ({SUITE})
        UNION ALL SELECT 'release', bool_and(ok), CASE WHEN bool_and(ok) THEN count(*) FILTER (ok) || '/' || count(*) || ' expectation files passed'
            ELSE 'blocked by: ' || string_agg(DISTINCT "table", ', ' ORDER BY "table") FILTER (NOT ok) END FROM ({SUITE})""",
    "run_handoff": f"""SELECT 'profile' AS step, true AS ok, count(*) || ' rows, 9 columns' AS detail FROM orders
        UNION ALL SELECT 'column', true, unnest(['o_orderkey: bigint, number', 'o_custkey: bigint, number', 'o_orderstatus: string, category', 'o_totalprice: double, money',
            'o_orderdate: timestamp_ntz, unknown', 'o_orderpriority: string, category', 'note: string, category', 'created_at: timestamp, timestamp', 'contact_email: string, category'])
        UNION ALL SELECT 'pii_summary', true, 'EMAIL: ' || count(*) FROM orders
        UNION ALL SELECT 'identify_owners', true, count(*) || ' owner(s)' FROM ({HANDLES})
        UNION ALL SELECT 'action', true, 'ping @' || handle || ' about orders' FROM ({HANDLES})
        UNION ALL SELECT 'recent_changes', true, count(*) || ' commit(s) in last 60 days' FROM ({lineage.COMMITS}) WHERE authored_at >= TIMESTAMP '{lineage.AS_OF}' - INTERVAL 60 DAY
        UNION ALL SELECT 'known_quirks', true, p_name FROM part WHERE p_size > 10
        UNION ALL SELECT 'gotcha', true, 'note holds no value in ' || format('{{:.1f}}', 100.0 * count(*) FILTER (o_orderkey % 4 <> 0) / count(*)) || '% of the rows' FROM orders
        UNION ALL SELECT 'gotcha', true, 'created_at always has a time; it may come from a default'
        UNION ALL SELECT 'gotcha', true, 'holds personal data; share masked results only'""",
    "run_dashboard_verify": f"""SELECT 'extract' AS step, true AS ok, 2 * count(*) || ' rendered row(s)' AS detail FROM supplier
        UNION ALL SELECT 'compare', count(*) FILTER (bad) = 0, 'mismatches=' || count(*) FILTER (bad) FROM ({BALANCES})
        UNION ALL SELECT 'severity', false, 'exact_mismatch=' || count(*) FILTER (bad) || ' → block' FROM ({BALANCES}) HAVING count(*) FILTER (bad) > 0
        UNION ALL SELECT 'unmatched', true, 'only_rendered=' || count(*) FROM supplier""",
    "governed_query": f"""SELECT doc_id, CASE WHEN label IS NULL THEN text ELSE '[REDACTED:' || label || ']' END AS text, '[H:' || left(sha256('pepper|' || source), 16) || ']' AS source
        FROM (SELECT *, {LABEL} AS label FROM documents WHERE lang = 'en')""",
    "governed_capped": """SELECT *, true AS truncated FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION SELECT 'all', count(*) FROM orders) ORDER BY status LIMIT 3""",
    "governed_audit": r"""SELECT 'query_database' AS tool, 'allow-select-read-only' AS rule, count(*) AS rows, 2 * count(*) AS cells,
        (SELECT CAST(sum(strlen(to_json({'doc_id': doc_id, 'text': CASE WHEN label IS NULL THEN text ELSE '[REDACTED:' || label || ']' END}))) AS BIGINT)
         FROM (SELECT *, LABEL AS label FROM documents)) AS bytes_returned,
        count(*) FILTER (regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails,
        count(*) FILTER (CARDS) AS cards FROM documents""".replace("CARDS", f"len({valid_cards('text')}) > 0").replace("LABEL", LABEL),
    "governed_denied": """SELECT call, CASE call WHEN 'runs' THEN 'permit' WHEN 'write' THEN 'consent_required' ELSE 'deny' END AS verdict, rule, touches,
        CASE call WHEN 'runs' THEN (SELECT count(*) FROM orders) ELSE 0 END AS rows
        FROM (VALUES ('table', 'deny-system-tables', '["audit_log"]'), ('view', 'deny-system-tables', '["audit_log", "innocent"]'),
                     ('subquery', 'deny-system-tables', '["audit_log", "innocent", "orders_governed"]'), ('write', WRITE_RULE, '[]'),
                     ('tenant', 'tenant', '["orders_governed"]'), ('cost', 'cost', '["orders_governed"]'),
                     ('runs', 'allow-select-read-only', '["orders_governed"]')) v(call, rule, touches)""".replace("WRITE_RULE", "'consent-for-non-select'"),
    "stream_mask": f"""SELECT doc_id, lang, source, n_chars, CASE WHEN label IS NULL THEN text ELSE '[REDACTED:' || label || ']' END AS text
        FROM (SELECT *, {LABEL} AS label FROM documents)""",
    "stream_rate_limit": governance.ORACLES["rate_limit_replay"],
    "stream_window_counts": """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS rows, max(ts) AS newest
        FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
}
