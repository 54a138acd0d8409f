"""Lineage, change impact, knowledge, ownership and activity over graphs and logs derived from the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import load
from plumbline.operators import activity, impact, knowledge, lineage, textindex
from plumbline.session import scratch_path
from plumbline.sources import manifests

SPLIT = "1998-01-01 00:00:00"
AS_OF = "2000-01-01 00:00:00"


def _name(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark, sf):
    """region -> nation -> customer -> order and supplier -> nation: a graph that grows with the data."""
    nation, customer, orders = (load(spark, sf, t) for t in ("nation", "customer", "orders"))
    supplier = load(spark, sf, "supplier")
    parts = [
        nation.select(_name("region.", "n_regionkey").alias("src"), _name("nation.", "n_nationkey").alias("dst")),
        customer.select(_name("nation.", "c_nationkey"), _name("customer.", "c_custkey")),
        orders.select(_name("customer.", "o_custkey"), _name("order.", "o_orderkey")),
        supplier.select(_name("supplier.", "s_suppkey"), _name("nation.", "s_nationkey")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _upstream(spark, sf):
    targets = load(spark, sf, "orders").select(_name("order.", "o_orderkey"))
    return lineage.upstream(edges(spark, sf), targets, 3, separator=">")


def _reached(spark, sf):
    """What any order comes from, a row for each source."""
    return lineage.reached_upstream(edges(spark, sf), load(spark, sf, "orders").select(_name("order.", "o_orderkey")))


def _downstream(spark, sf):
    changed = load(spark, sf, "region").select(_name("region.", "r_regionkey"))
    found = lineage.downstream(edges(spark, sf), changed)
    return found.select("origin", "node", "depth", F.array_join("path", ">").alias("path"))


def _manifest(spark, sf):
    """One manifest per customer, naming its nation as parent, exploded back into nodes and edges."""
    uid = _name("nation.", "c_nationkey")
    node = F.struct(uid.alias("name"), F.lit("model").alias("resource_type"), F.lit(None).cast("string").alias("original_file_path"), F.concat(uid, F.lit(".sql")).alias("path"))
    children = F.map_from_arrays(F.array(uid), F.array(F.array(_name("customer.", "c_custkey"))))
    body = F.to_json(F.struct(F.map_from_arrays(F.array(uid), F.array(node)).alias("nodes"), children.alias("child_map")))
    parsed = load(spark, sf, "customer").select(F.from_json(body, manifests.MANIFEST).alias("m")).select("m.*")
    nodes, found = manifests.manifest_tables(parsed)
    return found.join(nodes.distinct(), found.src == nodes.unique_id).select("src", "dst", "path", "resource_type")


def _annotate(spark, sf):
    nodes = load(spark, sf, "customer").select(F.concat(F.lit("db.sales."), "c_mktsegment").alias("name"), "c_custkey")
    models = load(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_mktsegment").alias("name"), F.concat(F.lit("models/"), "c_mktsegment", F.lit(".sql")).alias("path"))
    return lineage.annotate_models(nodes, models)


def catalogs(spark, sf):
    """Catalogs of parts per supplier, from the lines shipped before and after a date."""
    lines = load(spark, sf, "lineitem")
    named = lines.select("l_suppkey", (F.col("l_partkey") % 50).alias("part"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").alias("d"))

    def parts(df):
        # Grouped by numbers, which are smaller to sort than the names.
        found = df.groupBy("l_suppkey", "part").agg(F.max("type").alias("type"))
        return found.select(_name("supp_", "l_suppkey").alias("table"), _name("part_", "part").alias("column"), "type")

    split = F.lit(SPLIT).cast("timestamp")
    before = parts(named.where((F.col("d") < split) & (F.col("l_suppkey") % 10 != 3)))
    after = parts(named.where((F.col("d") >= split) & (F.col("l_suppkey") % 10 != 7)))
    return before, after


def _tables(spark, sf):
    return impact.table_changes(*catalogs(spark, sf))


def _columns(spark, sf):
    return impact.column_changes(*catalogs(spark, sf))


def _suggest(spark, sf):
    before, after = catalogs(spark, sf)
    return impact.suggest_from_changes(impact.table_changes(before, after), impact.column_changes(before, after))


def _supplier_edges(spark, sf):
    return load(spark, sf, "supplier").select(_name("supp_", "s_suppkey").alias("src"), _name("nation_", "s_nationkey").alias("dst"))


def _impact(spark, sf):
    return impact.impact(*catalogs(spark, sf), _supplier_edges(spark, sf))


def _files(spark, sf):
    """Changed files named after the lines."""
    line = F.col("l_linenumber")
    folder = F.when(line == 1, "models/scratch").when(line == 2, "models/marts").when(line == 3, "src").when(line == 4, "db/migrate").otherwise("docs")
    kind = F.when(F.col("l_partkey") % 3 == 0, ".SQL").when(F.col("l_partkey") % 3 == 1, ".sql").otherwise(".py")
    path = F.concat(folder, F.lit("/p"), F.col("l_partkey").cast("string"), kind)
    return load(spark, sf, "lineitem").select(path.alias("path")).distinct()


def _select_files(spark, sf):
    return impact.select_changed_files(_files(spark, sf), exclude=["models/scratch/**"])


def _select_included(spark, sf):
    return impact.select_changed_files(_files(spark, sf), fragments=impact.DATA_FRAGMENTS, include=["models/**/*.sql", "src/*.py"])


def _conclusion(spark, sf):
    """One change set per order: returned lines are risks, open lines are changes."""
    section = F.when(F.col("l_returnflag") == "R", "risk").when(F.col("l_linestatus") == "O", "column").otherwise("note")
    report = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("change_set"), section.alias("section"))
    return impact.impact_conclusion(report)


def _notes(spark, sf, limit=None):
    orders = load(spark, sf, "orders")
    notes = orders.select(
        _name("customer:", "o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("body"),
        F.col("o_orderdate").alias("created_at"))
    keys = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(_name("customer:", "c_custkey"))
    return knowledge.notes_for(keys, notes, limit)


def _search(spark, sf):
    """Every benchmark passage as an all-terms query over the documents."""
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return knowledge.search(load(spark, sf, "documents"), queries, "doc_id", "text", limit=20)


def _search_indexed(spark, sf):
    """The same from a written index: built on one half of the documents, extended by the other, some of it replaced and removed."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    late = F.col("doc_id") % 2 == 1
    stale = docs.where(F.col("doc_id") % 7 == 0).withColumn("text", F.lit("an older text"))
    index = textindex.TextIndex.build(docs.where(~late & (F.col("doc_id") % 7 != 0)).unionByName(stale), scratch_path(spark, "index"), "doc_id", "text", 8)
    index.append(docs.where(late | (F.col("doc_id") % 7 == 0)), "doc_id", "text")
    index.remove(docs.where(F.col("doc_id") % 11 == 0).select("doc_id"))
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    older = spark.range(1).select((F.lit(-1) - F.col("id")).alias("query_id"), F.lit("older TEXT").alias("query"))
    return index.search(queries.unionByName(older), "doc_id", limit=20)


def _search_words(spark, sf):
    """Common two-word queries, where the limit of the report applies."""
    pairs = load(spark, sf, "documents").select(F.element_at(F.split("text", r"\s+", 2), 1).alias("a"), "lang").distinct()
    queries = pairs.select(F.concat_ws(" ", "a", "lang").alias("query_id"), F.col("a").alias("query"))
    return knowledge.search(load(spark, sf, "documents"), queries, "doc_id", "text", limit=5)


def _owners(spark, sf):
    place = F.when(F.col("s_nationkey") % 5 != 0, _name("nation:", "s_nationkey")).otherwise(_name("planet:", "s_nationkey"))
    owners = load(spark, sf, "supplier").select(
        place.alias("key"), F.col("s_name").alias("owner"), F.lit("owner").alias("role"), F.lit("manual").alias("source"))
    return knowledge.owners_for(load(spark, sf, "nation").select(_name("nation:", "n_nationkey")), owners)


def _paths(spark, sf):
    return load(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")).distinct()


def _path_owners(spark, sf):
    """Owners by language folder, and by deeper folders for some pages."""
    docs = load(spark, sf, "documents")
    folders = docs.select(F.concat(F.lit("path:"), "lang").alias("key"), F.concat(F.lit("team-"), "lang").alias("owner")).distinct()
    folder = F.when(F.col("page_id") % 3 == 0, F.lit("path:")).otherwise(F.lit("path:archive/"))
    deep = load(spark, sf, "pages").select(
        F.concat(folder, F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")).alias("key"),
        F.lit("page-owner").alias("owner")).distinct()
    kind = lambda df, source: df.withColumn("role", F.lit("owner")).withColumn("source", F.lit(source))
    return kind(folders, "codeowners").unionByName(kind(deep.where("key <> 'path:'"), "manual")).where("key <> 'path:de'")


def _owners_of_paths(spark, sf):
    return knowledge.owners_of_paths(_paths(spark, sf), _path_owners(spark, sf))


def _orders_as_tasks(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
    due = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), status.alias("status"), due.alias("due_at"),
        F.col("o_orderdate").alias("updated_at"))


def _tasks(spark, sf):
    return knowledge.open_tasks(_orders_as_tasks(spark, sf)).select("id", "owner", "status", "due_at")


def _tasks_per_owner(spark, sf):
    return knowledge.open_tasks(_orders_as_tasks(spark, sf), per_owner=10).select("id", "owner", "due_at", "rank")


def _decisions(spark, sf):
    docs = load(spark, sf, "documents")
    decisions = docs.select("doc_id", F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")).alias("affects"))
    keys = docs.select(F.concat(F.lit("lang:"), "lang").alias("k")).where("k <> 'lang:en'")
    return knowledge.decisions_affecting(keys, decisions).select("key", "doc_id")


def _digests(spark, sf):
    files = F.array(_name("part/", "o_custkey"), _name("order/", "o_orderkey"))
    return load(spark, sf, "orders").select(
        F.lit("shop").alias("repo"), F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("merged_at"), files.alias("files_touched"))


def _touching(spark, sf):
    return knowledge.changes_touching(_digests(spark, sf), "part/12").select("number", "merged_at", F.array_join("files_touched", ",").alias("files"))


def _upsert(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_shipdate").alias("o_orderdate"))
    return knowledge.upsert(orders.where("o_orderkey % 4 <> 0"), lines, ["o_orderkey"], ["o_orderdate", "o_totalprice", "o_orderstatus"])


def _insert_ignore(spark, sf):
    base = load(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("key"), F.col("c_mktsegment").alias("owner"), F.lit("old").alias("source"))
    base = base.where("key % 2 = 0").distinct()
    extra = load(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("key"), F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("source"))
    return knowledge.insert_ignore(base, extra, ["key", "owner"], ["source"])


def _status(spark, sf):
    tasks = _orders_as_tasks(spark, sf)
    updates = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("updated_at"))
    changed = updates.groupBy("id", "updated_at").agg(F.max("status").alias("status"))
    return knowledge.update_status(tasks, changed).select("id", "status", "updated_at")


def _codeowners(spark, sf):
    key = F.col("doc_id")
    line = (
        F.when(key % 5 == 0, F.lit("# only a comment"))
        .when(key % 5 == 1, F.concat(F.lit("/src/"), "source"))
        .when(key % 5 == 2, F.concat(F.lit("/src/"), "source", F.lit("/  @"), "lang", F.lit("  ops@example.com # note")))
        .when(key % 5 == 3, F.concat(F.lit("*.sql\t@"), "lang"))
        .otherwise(F.lit("   "))
    )
    return manifests.parse_codeowners(load(spark, sf, "documents").select(line.alias("value")))


def _pr_json(spark, sf):
    user = F.when(F.col("o_orderkey") % 10 != 0, F.struct(_name("dev", "o_custkey").alias("login")))
    body = F.struct(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), user.alias("user"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("merged_at"),
        F.array(_name("part/", "o_custkey")).alias("_files"), F.repeat("o_orderpriority", F.lit(60)).alias("body"),
    )
    return load(spark, sf, "orders").select(F.to_json(body).alias("body"))


def _prs(spark, sf):
    digests, _ = manifests.ingest_prs(_pr_json(spark, sf), "body", F.lit("shop"))
    return digests.select("repo", "number", "title", "author", "merged_at", F.element_at("files_touched", 1).alias("file"), "summary")


def _contributors(spark, sf):
    return manifests.ingest_prs(_pr_json(spark, sf), "body", F.lit("shop"))[1]


def commits(spark, sf):
    lines = load(spark, sf, "lineitem")
    path = F.concat(F.lit("part/"), (F.col("l_partkey") % 10).cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".sql"))
    login = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(_name("dev", "l_suppkey"))
    return lines.select(
        F.sha1(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("sha"), path.alias("path"), login.alias("author_login"),
        F.lit("Someone").alias("author_name"), F.col("l_shipdate").alias("authored_at"),
        F.concat(F.lit("Change "), F.col("l_orderkey").cast("string"), F.lit("\nmore text")).alias("message"))


def _recent(spark, sf):
    return activity.recent_changes(commits(spark, sf), "part/3", AS_OF, 30)


def _who(spark, sf):
    return activity.who_changed(commits(spark, sf), "part/3", AS_OF, 90)


def owner_table(spark, sf):
    """Owners of the folders 0 to 2, the brands of their parts; others own folders that no commit touches."""
    folder = F.when(F.col("p_partkey") % 10 <= 2, F.lit("path:part/")).otherwise(F.lit("path:legacy/"))
    return load(spark, sf, "part").select(
        F.concat(folder, (F.col("p_partkey") % 10).cast("string")).alias("key"), F.col("p_brand").alias("owner"),
        F.lit("owner").alias("role"), F.when(F.col("p_partkey") % 10 == 1, "manual").otherwise("codeowners").alias("source")).distinct()


def _find_owners(spark, sf):
    log = commits(spark, sf)
    found = activity.find_owners(log.select("path"), owner_table(spark, sf), log)
    return found.withColumn("confidence", F.round("confidence", 9))


QUERIES = {
    "lineage_upstream": _upstream,
    "lineage_reached_upstream": _reached,
    "lineage_downstream": _downstream,
    "lineage_manifest": _manifest,
    "lineage_annotate_models": _annotate,
    "impact_table_changes": _tables,
    "impact_column_changes": _columns,
    "impact_suggestions": _suggest,
    "impact_changed_files": _select_files,
    "impact_included_files": _select_included,
    "impact_conclusion": _conclusion,
    "impact_report": _impact,
    "knowledge_notes": _notes,
    "knowledge_latest_notes": lambda s, d: _notes(s, d, 2),
    "knowledge_search": _search,
    "knowledge_search_indexed": _search_indexed,
    "knowledge_search_words": _search_words,
    "knowledge_owners": _owners,
    "knowledge_path_owners": _owners_of_paths,
    "knowledge_open_tasks": _tasks,
    "knowledge_next_tasks": _tasks_per_owner,
    "knowledge_decisions": _decisions,
    "knowledge_changes_touching": _touching,
    "knowledge_upsert": _upsert,
    "knowledge_insert_ignore": _insert_ignore,
    "knowledge_task_status": _status,
    "codeowners_rows": _codeowners,
    "pr_digests": _prs,
    "pr_contributors": _contributors,
    "activity_recent_changes": _recent,
    "activity_who_changed": _who,
    "activity_find_owners": _find_owners,
}

EDGES = """SELECT 'region.' || n_regionkey AS src, 'nation.' || n_nationkey AS dst FROM nation
    UNION SELECT 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer
    UNION SELECT 'customer.' || o_custkey, 'order.' || o_orderkey FROM orders
    UNION SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey FROM supplier"""


def _closure_sql(origins, come, go, depth):
    """Paths in this graph are unique per (origin, node) except none: every node pair has one shortest path."""
    return f"""WITH RECURSIVE e AS ({EDGES}), c AS (
        SELECT name AS origin, name AS node, 0 AS depth, name AS path FROM ({origins})
        UNION ALL SELECT c.origin, e.{go}, c.depth + 1, c.path || '>' || e.{go} FROM c JOIN e ON e.{come} = c.node WHERE c.depth < {depth})
        SELECT origin, node, depth, min(path) AS path FROM c WHERE depth > 0 GROUP BY origin, node, depth"""


NAMED = """SELECT 'supp_' || l_suppkey AS "table", 'part_' || l_partkey % 50 AS "column", l_returnflag AS type, l_shipdate AS d, l_suppkey FROM lineitem"""
CATALOGS = f"""WITH b AS (SELECT "table", "column", max(type) AS type FROM ({NAMED}) WHERE d < TIMESTAMP '{SPLIT}' AND l_suppkey % 10 <> 3 GROUP BY 1, 2),
    a AS (SELECT "table", "column", max(type) AS type FROM ({NAMED}) WHERE d >= TIMESTAMP '{SPLIT}' AND l_suppkey % 10 <> 7 GROUP BY 1, 2),
    t AS (SELECT DISTINCT "table", 'created' AS kind FROM a WHERE "table" NOT IN (SELECT "table" FROM b)
          UNION ALL SELECT DISTINCT "table", 'dropped' FROM b WHERE "table" NOT IN (SELECT "table" FROM a)),
    c AS (SELECT * FROM (SELECT coalesce(a."table", b."table") AS "table", coalesce(a."column", b."column") AS "column", b.type AS before, a.type AS after,
                 CASE WHEN b.type IS NULL THEN 'added' WHEN a.type IS NULL THEN 'removed' WHEN a.type <> b.type THEN 'retyped' END AS kind
          FROM a FULL OUTER JOIN b ON a."table" = b."table" AND a."column" = b."column") WHERE kind IS NOT NULL),
    s AS (SELECT "table", "column", CASE kind WHEN 'added' THEN 'column_not_null: ' || "table" || '.' || "column"
                 WHEN 'retyped' THEN 'column_values_castable: ' || "table" || '.' || "column" || ' → ' || after END AS suggestion FROM c WHERE kind <> 'removed'
          UNION ALL SELECT "table", NULL, CASE kind WHEN 'created' THEN 'row_count_between: ' || "table" || ' (min: 1)'
                 ELSE 'no_references_left: ' || "table" END FROM t)"""
FILES = """SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'models/scratch' WHEN 2 THEN 'models/marts' WHEN 3 THEN 'src' WHEN 4 THEN 'db/migrate' ELSE 'docs' END
    || '/p' || l_partkey || CASE l_partkey % 3 WHEN 0 THEN '.SQL' WHEN 1 THEN '.sql' ELSE '.py' END AS path FROM lineitem"""
NOTES = "SELECT 'customer:' || o_custkey AS key, o_orderkey AS id, o_orderpriority AS body, o_orderdate AS created_at FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
TERMS = r"list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


def _search_sql(queries, limit, documents="documents"):
    return f"""WITH q AS (SELECT query_id, {TERMS.format('query')} AS terms FROM ({queries})),
        d AS (SELECT doc_id, {TERMS.format('text')} AS tokens FROM {documents})
        SELECT query_id, doc_id, rank FROM (
            SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
            FROM q JOIN d ON list_has_all(d.tokens, q.terms) WHERE len(q.terms) > 0) WHERE rank <= {limit}"""


PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
TRIMMED = "trim({}, '/')"
TASKS = """SELECT o_orderkey AS id, o_orderpriority AS owner, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS due_at, o_orderdate AS updated_at FROM orders"""
COMMITS = """SELECT sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS sha, 'part/' || l_partkey % 10 || '/' || l_partkey || '.sql' AS path,
    CASE WHEN l_linenumber <> 7 THEN 'dev' || l_suppkey END AS author_login, l_shipdate AS authored_at, 'Change ' || l_orderkey AS message FROM lineitem"""
RECENT = f"""SELECT sha, coalesce(author_login, 'Someone') AS author, authored_at AS "when", message FROM ({COMMITS})
    WHERE path LIKE 'part/3/%' AND authored_at >= TIMESTAMP '{AS_OF}' - INTERVAL {{}} DAY"""

ORACLES = {
    "lineage_upstream": _closure_sql("SELECT 'order.' || o_orderkey AS name FROM orders", "dst", "src", 3),
    "lineage_reached_upstream": """WITH c AS (SELECT 'customer.' || o_custkey AS node, o_custkey, min('order.' || o_orderkey) AS origin FROM orders GROUP BY o_custkey),
        n AS (SELECT c_nationkey, 'nation.' || c_nationkey AS node, min(struct_pack(origin := origin, parent := c.node)) AS best
              FROM c JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
        s AS (SELECT 'region.' || n_regionkey AS node, c_nationkey FROM n JOIN nation ON n_nationkey = c_nationkey
              UNION ALL SELECT 'supplier.' || s_suppkey, c_nationkey FROM n JOIN supplier ON s_nationkey = c_nationkey),
        r AS (SELECT s.node, min(struct_pack(origin := best.origin, parent := n.node)) AS best FROM s JOIN n USING (c_nationkey) GROUP BY s.node)
        SELECT node, origin, 1 AS depth, origin AS parent FROM c
        UNION ALL SELECT node, best.origin, 2, best.parent FROM n UNION ALL SELECT node, best.origin, 3, best.parent FROM r""",
    "lineage_downstream": _closure_sql("SELECT 'region.' || r_regionkey AS name FROM region", "src", "dst", 10),
    "lineage_manifest": """SELECT 'nation.' || c_nationkey AS src, 'customer.' || c_custkey AS dst, 'nation.' || c_nationkey || '.sql' AS path, 'model' AS resource_type FROM customer""",
    "lineage_annotate_models": """SELECT c_custkey, 'db.sales.' || c_mktsegment AS name,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN 'models/' || c_mktsegment || '.sql' END AS model_path FROM customer""",
    "impact_table_changes": f"{CATALOGS} SELECT * FROM t",
    "impact_column_changes": f"{CATALOGS} SELECT * FROM c",
    "impact_suggestions": f"{CATALOGS} SELECT * FROM s",
    "impact_changed_files": rf"""SELECT path FROM ({FILES}) WHERE (regexp_matches(path, '(?i)\.sql$') OR path LIKE 'models/%' OR path LIKE 'db/migrate/%')
        AND path NOT LIKE 'models/scratch/%'""",
    "impact_included_files": f"""SELECT path FROM ({FILES}) WHERE path LIKE 'models/%' AND path LIKE '%.sql'""",
    "impact_conclusion": """SELECT change_set, risks, CAST(0 AS BIGINT) AS parse_failures, changes,
        CASE WHEN risks > 0 THEN 'failure' WHEN changes > 0 THEN 'neutral' ELSE 'success' END AS conclusion FROM (
        SELECT l_orderkey AS change_set, count(*) FILTER (l_returnflag = 'R') AS risks,
               count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS changes FROM lineitem GROUP BY 1)""",
    "impact_report": f"""{CATALOGS}
        SELECT 'table' AS section, "table", NULL AS "column", kind, NULL AS before, NULL AS after, NULL AS detail FROM t
        UNION ALL SELECT 'column', "table", "column", kind, before, after, NULL FROM c
        UNION ALL SELECT 'suggestion', "table", "column", NULL, NULL, NULL, suggestion FROM s
        UNION ALL SELECT 'risk', "table", NULL, 'downstream', NULL, NULL, "table" || ' → nation_' || s_nationkey FROM t JOIN supplier ON "table" = 'supp_' || s_suppkey""",
    "knowledge_notes": NOTES,
    "knowledge_latest_notes": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, id DESC) AS rank FROM ({NOTES})) WHERE rank <= 2",
    "knowledge_search": _search_sql("SELECT item_id AS query_id, text AS query FROM benchmark", 20),
    "knowledge_search_indexed": _search_sql(
        "SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT -1, 'older TEXT'", 20, "documents WHERE doc_id % 11 <> 0"),
    "knowledge_search_words": _search_sql(
        r"SELECT DISTINCT a || ' ' || lang AS query_id, a AS query FROM (SELECT regexp_split_to_array(text, '\s+')[1] AS a, lang FROM documents)", 5),
    "knowledge_owners": """SELECT 'nation:' || n_nationkey AS key, s_name AS owner, CASE WHEN s_name IS NOT NULL THEN 'owner' END AS role,
        CASE WHEN s_name IS NOT NULL THEN 'manual' END AS source FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey % 5 <> 0""",
    "knowledge_path_owners": f"""WITH o AS (SELECT * FROM (SELECT DISTINCT 'path:' || lang AS key, 'team-' || lang AS owner, 'owner' AS role, 'codeowners' AS source FROM documents
            UNION ALL SELECT DISTINCT 'path:' || {TRIMMED.format(PATH)}, 'page-owner', 'owner', 'manual' FROM pages WHERE page_id % 3 = 0) WHERE key NOT IN ('path:', 'path:de')),
        p AS (SELECT path, i, 'path:' || array_to_string(string_split({TRIMMED.format('path')}, '/')[1:i], '/') AS key
              FROM (SELECT path, unnest(range(1, len(string_split({TRIMMED.format('path')}, '/')) + 1)) AS i FROM (SELECT DISTINCT {PATH} AS path FROM pages))),
        m AS (SELECT path, max(i) AS i FROM p WHERE key IN (SELECT key FROM o) GROUP BY path)
        SELECT p.path, p.key, owner, role, source FROM m JOIN p ON m.path = p.path AND m.i = p.i JOIN o ON o.key = p.key""",
    "knowledge_open_tasks": f"SELECT id, owner, status, due_at FROM ({TASKS}) WHERE status <> 'done'",
    "knowledge_next_tasks": f"""SELECT id, owner, due_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY due_at NULLS FIRST, id) AS rank
        FROM ({TASKS}) WHERE status <> 'done') WHERE rank <= 10""",
    "knowledge_decisions": "SELECT 'lang:' || lang AS key, doc_id FROM documents WHERE lang <> 'en'",
    "knowledge_changes_touching": """SELECT o_orderkey AS number, o_orderdate AS merged_at, 'part/' || o_custkey || ',order/' || o_orderkey AS files
        FROM orders WHERE 'part/' || o_custkey LIKE 'part/12%' """,
    "knowledge_upsert": """WITH u AS (SELECT l_orderkey, l_linestatus, l_extendedprice, l_shipdate, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate DESC, l_extendedprice DESC, l_linestatus DESC) AS rn FROM lineitem)
        SELECT l_orderkey AS o_orderkey, l_linestatus AS o_orderstatus, l_extendedprice AS o_totalprice, l_shipdate AS o_orderdate FROM u WHERE rn = 1
        UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "knowledge_insert_ignore": """SELECT CAST(c_nationkey AS BIGINT) AS key, c_mktsegment AS owner, CASE WHEN c_nationkey % 2 = 0 THEN 'old' ELSE min(c_name) END AS source
        FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "knowledge_task_status": f"""WITH u AS (SELECT l_orderkey, l_shipdate, max(l_linestatus) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS rn
            FROM lineitem GROUP BY 1, 2)
        SELECT id, coalesce(s, status) AS status, coalesce(l_shipdate, updated_at) AS updated_at FROM ({TASKS}) LEFT JOIN u ON l_orderkey = id AND rn = 1""",
    "codeowners_rows": """SELECT 'path:src/' || source AS key, unnest([lang, 'ops@example.com']) AS owner, 'owner' AS role, 'codeowners' AS source FROM documents WHERE doc_id % 5 = 2
        UNION ALL SELECT 'path:*.sql', lang, 'owner', 'codeowners' FROM documents WHERE doc_id % 5 = 3""",
    "pr_digests": """SELECT 'shop' AS repo, o_orderkey AS number, o_orderpriority AS title, CASE WHEN o_orderkey % 10 <> 0 THEN 'dev' || o_custkey ELSE '' END AS author,
        strftime(o_orderdate, '%Y-%m-%d') AS merged_at, 'part/' || o_custkey AS file, repeat(o_orderpriority, 60) AS summary FROM orders""",
    "pr_contributors": """SELECT DISTINCT 'repo:shop' AS key, CASE WHEN o_orderkey % 10 <> 0 THEN 'dev' || o_custkey ELSE '' END AS owner,
        'contributor' AS role, 'git_blame' AS source FROM orders""",
    "activity_recent_changes": RECENT.format(30),
    "activity_who_changed": f"SELECT author, count(*) AS commits FROM ({RECENT.format(90)}) GROUP BY author",
    "activity_find_owners": f"""WITH c AS (SELECT path, author_login, count(*) AS n FROM ({COMMITS}) WHERE author_login IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, author_login) AS rn, sum(n) OVER (PARTITION BY path) AS total FROM c),
        o AS (SELECT DISTINCT p_partkey % 10 AS d, p_brand FROM part WHERE p_partkey % 10 <= 2)
        SELECT path, p_brand AS handle, 'owner' AS role, 'knowledge/' || CASE d WHEN 1 THEN 'manual' ELSE 'codeowners' END AS source,
               CAST(CASE d WHEN 1 THEN 0.95 ELSE 0.85 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT path FROM ({COMMITS})) JOIN o ON path LIKE 'part/' || d || '/%'
        UNION ALL SELECT path, author_login, 'contributor', 'git_blame', round(least(0.7, n / total), 9) FROM r
        WHERE path NOT LIKE 'part/0/%' AND path NOT LIKE 'part/1/%' AND path NOT LIKE 'part/2/%'""",
}
