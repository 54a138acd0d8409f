import os
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import lineage as lineage_checks

from plumbline.operators import activity, impact, knowledge, lineage, textindex
from plumbline.plans import runs
from plumbline.session import shared_dir


def closure(edges, origins, limit=None):
    out = {}
    for origin in origins:
        depth, frontier, seen = 0, {origin}, {origin}
        while frontier and (limit is None or depth < limit):
            depth += 1
            frontier = {d for s, d in edges if s in frontier} - seen
            seen |= frontier
            out |= {(origin, n): depth for n in frontier}
    return out


def test_closures_with_cycles(spark):
    rng = random.Random(1)
    edges = {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "d"), ("x", "x"), ("x", "a")}
    edges |= {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)}
    df = spark.createDataFrame(sorted(edges) * 2, "src string, dst string")
    origins = ["a", "x", "n1", "n2", "nothing"]
    starts = spark.createDataFrame([(o,) for o in origins], "name string")
    for limit in (None, 1, 3):
        got = lineage.downstream(df, starts, limit)
        assert {(r["origin"], r["node"]): r["depth"] for r in got.collect()} == closure(edges, origins, limit)
        back = lineage.upstream(df, starts, limit)
        assert {(r["origin"], r["node"]): r["depth"] for r in back.collect()} == closure({(d, s) for s, d in edges}, origins, limit)
    paths = {(r["origin"], r["node"]): r["path"] for r in lineage.downstream(df, starts).collect()}
    assert paths["a", "e"] == ["a", "b", "d", "e"]


@pytest.mark.parametrize("hub", [2, 10_000])
def test_closures_with_hubs(spark, hub):
    """Hubs in blocks, nulls, and paths from parent to parent: the smallest parent of those that lead on soonest."""
    rng = random.Random(hub)
    edges = {("hub", f"n{k}") for k in range(40)} | {(f"n{k}", "hub") for k in range(0, 40, 3)} | {(f"n{rng.randrange(40)}", f"m{rng.randrange(25)}") for _ in range(70)}
    edges |= {(f"m{rng.randrange(25)}", f"m{rng.randrange(25)}") for _ in range(20)}
    df = spark.createDataFrame([*sorted(edges), ("hub", None), (None, "n1")], "src string, dst string")
    origins = ["hub", "n1", "n2", "m3"]
    starts = spark.createDataFrame([(o,) for o in [*origins, None]], "name string")
    want, parents = {}, {}
    for origin in origins:
        depth, level, seen = 0, {origin}, {origin}
        want[origin, origin] = [origin]
        while level:
            depth += 1
            new = {d for s, d in edges if s in level} - seen
            for node in new:
                parents[origin, node] = (depth, min(s for s, d in edges if d == node and s in level))
                want[origin, node] = [*want[origin, parents[origin, node][1]], node]
            level, seen = new, seen | new
    got = lineage.downstream(df, starts, hub=hub).collect()
    assert {(r["origin"], r["node"]): r["path"] for r in got} == {k: v for k, v in want.items() if len(v) > 1}
    got = lineage.downstream(df, starts, paths=False, hub=hub).collect()
    assert {(r["origin"], r["node"]): (r["depth"], r["parent"]) for r in got} == parents
    got = {r["node"]: (r["depth"], r["origin"]) for r in lineage.reached_downstream(df, starts, hub=hub).collect()}
    nearest = {}
    for (origin, node), (depth, _) in parents.items():
        if node not in origins:
            nearest[node] = min((depth, origin), nearest.get(node, (depth, origin)))
    assert got == nearest
    back = {(r["node"], r["origin"], r["depth"]) for r in lineage.reached_upstream(df.toDF("dst", "src").select("src", "dst"), starts, hub=hub).collect()}
    assert back == {(node, origin, depth) for node, (depth, origin) in nearest.items()}


def test_upstream_rows_grow_with_the_data(spark, sf):
    """With stated targets the result grows no faster than the tables."""
    small, large = (lineage_checks.QUERIES["lineage_upstream"](spark, d).count() for d in (sf, "/root/testdata/sf0.01"))
    assert sf != "/root/testdata/sf0.001" or large <= 12 * small


def test_upstream_of_every_order(spark, sf):
    """Every order is a target, as its SQL says: none is left out."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("origin"))
    assert rows(lineage_checks.QUERIES["lineage_upstream"](spark, sf).select("origin").distinct()) == rows(orders.distinct())


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_upstream_writes_no_row_for_each_pair(spark):
    """Targets that share their only ways on share what lies behind these: it is written once, not for each of them."""
    edges = [(f"mid{k % 20}", f"target{k}") for k in range(2_000)] + [("hub", f"mid{k}") for k in range(20)] + [(f"source{k}", "hub") for k in range(400)]
    df, targets = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"target{k}",) for k in range(2_000)], "name string")
    before = folder_bytes(shared_dir(spark))
    found = lineage.upstream(df, targets, 3, separator=">")
    # Before, 800,000 pairs were written twice.
    assert folder_bytes(shared_dir(spark)) - before < 2_000_000
    assert found.count() == 2_000 * 402
    got = found.where("origin = 'target7'").orderBy("depth", "node").select("node", "depth", "path").limit(3)
    assert [tuple(r) for r in got.collect()] == [("mid7", 1, "target7>mid7"), ("hub", 2, "target7>mid7>hub"), ("source0", 3, "target7>mid7>hub>source0")]


@pytest.mark.parametrize(("limit", "far"), [(None, False), (None, True), (0, False), (2, False), (3, True), (4, False)])
def test_closures_along_shared_ways(spark, monkeypatch, limit, far):
    """Chains into hubs, circles, dead ends, back to their own origins and to other ones, with and without small tables at every task."""
    if far:
        monkeypatch.setattr(lineage, "broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr(lineage, "TASK_PAIRS", 50)
    edges = {(f"a{k}", f"b{k % 6}") for k in range(48)} | {(f"b{k}", f"c{k % 3}") for k in range(5)}  # b5 is a dead end
    edges |= {("c0", f"d{k}") for k in range(9)} | {("d1", "a0"), ("d2", "a3"), ("d3", "b2"), ("d4", "c0"), ("d5", "e")}
    edges |= {("c1", "b1"), ("c2", "a2")}  # circles of single ways, one of them through an origin
    edges |= {("a40", "d7"), ("a41", "a41"), ("a42", "a0"), ("a42", "b0")}
    origins = [*(f"a{k}" for k in range(48)), "b3", "c0", "nowhere"]
    want = {}
    for origin in origins:
        depth, level, seen, paths = 0, {origin}, {origin}, {origin: [origin]}
        while level and (limit is None or depth < limit):
            depth += 1
            new = {d for s, d in edges if s in level} - seen
            for node in new:
                paths[node] = [*paths[min(s for s, d in edges if d == node and s in level)], node]
                want[origin, node] = paths[node]
            level, seen = new, seen | new
    df = spark.createDataFrame([*sorted(edges), ("a0", None), (None, "b1")], "src string, dst string")
    starts = spark.createDataFrame([(o,) for o in [*origins, "a1", None]], "name string")
    got = [tuple(r) for r in lineage.downstream(df, starts, limit).select("origin", "node", "depth", "path").collect()]
    assert sorted(got) == sorted((*pair, len(path) - 1, path) for pair, path in want.items())
    back = df.toDF("dst", "src").select("src", "dst")
    got = [tuple(r) for r in lineage.upstream(back, starts, limit, separator="/").select("origin", "node", "depth", "path").collect()]
    assert sorted(got) == sorted((*pair, len(path) - 1, "/".join(path)) for pair, path in want.items())
    got = [tuple(r) for r in lineage.upstream(back, starts, limit, paths=False).select("origin", "node", "depth", "parent").collect()]
    assert sorted(got) == sorted((*pair, len(path) - 1, path[-2]) for pair, path in want.items())


def test_annotate(spark):
    nodes = spark.createDataFrame([("db.s.orders",), ("orders",), ("other",)], "name string")
    models = spark.createDataFrame([("orders", "models/orders.sql")], "name string, path string")
    assert rows(lineage.annotate_models(nodes, models)) == [("db.s.orders", "models/orders.sql"), ("orders", "models/orders.sql"), ("other", None)]


def test_impact(spark):
    kind = "table string, column string, type string"
    before = spark.createDataFrame([("orders", "order_id", "BIGINT"), ("orders", "total", "NUMERIC"), ("orders", "old", "INT"), ("legacy_users", "id", "INT")], kind)
    after = spark.createDataFrame([("orders", "order_id", "BIGINT"), ("orders", "total", "DOUBLE"), ("orders", "discount_pct", "NUMERIC"), ("fresh", "id", "INT")], kind)
    assert rows(impact.table_changes(before, after)) == [("fresh", "created"), ("legacy_users", "dropped")]
    assert rows(impact.column_changes(before, after), "table", "column", "kind") == [
        ("fresh", "id", "added"), ("legacy_users", "id", "removed"), ("orders", "discount_pct", "added"), ("orders", "old", "removed"), ("orders", "total", "retyped")]
    edges = spark.createDataFrame([("legacy_users", "report"), ("report", "board"), ("orders", "x")], "src string, dst string")
    report = impact.impact(before, after, edges)
    assert rows(report.where("section = 'risk'"), "detail") == [("legacy_users → report",)]
    assert rows(impact.impact(before, after, edges, None).where("section = 'risk'"), "detail") == [("legacy_users → board",), ("legacy_users → report",)]
    assert rows(report.where("section = 'suggestion'"), "detail") == [
        ("column_not_null: fresh.id",), ("column_not_null: orders.discount_pct",), ("column_values_castable: orders.total → DOUBLE",),
        ("no_references_left: legacy_users",), ("row_count_between: fresh (min: 1)",)]
    assert rows(impact.impact_conclusion(report.withColumn("change_set", F.lit(1))), "conclusion") == [("failure",)]
    quiet = report.where("section <> 'risk'").withColumn("change_set", F.lit(1))
    assert rows(impact.impact_conclusion(quiet), "conclusion") == [("neutral",)]
    assert rows(impact.impact_conclusion(quiet.where("section = 'suggestion'")), "conclusion") == [("success",)]


def test_changed_files(spark):
    paths = ["a/b.SQL", "models/x.py", "db/migrate/1.rb", "prisma/migrations/a/b", "p/dbt_project.yml", "db/schema.rb", "src/models/x.py", "README.md", "models/scratch/y.sql", "macros/m.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(impact.select_changed_files(df)) == [(p,) for p in sorted(paths[:6] + ["models/scratch/y.sql"], key=repr)]
    assert ("macros/m.txt",) in rows(impact.select_changed_files(df, fragments=impact.DATA_FRAGMENTS))
    assert rows(impact.select_changed_files(df, include=["models/**/*.sql"])) == [("models/scratch/y.sql",)]
    assert ("models/scratch/y.sql",) not in rows(impact.select_changed_files(df, exclude=["models/scratch/**"]))


def test_notes_and_search(spark):
    notes = spark.createDataFrame([(1, "table:orders", "Booked in UTC timezone", "2026-01-01"), (2, "table:orders", "Refunds are negative", "2026-01-03"), (3, "table:users", "Émails are hashed; timezone n/a", "2026-01-02")], "id int, key string, body string, created_at string")
    keys = spark.createDataFrame([("table:orders",), ("table:orders",)], "k string")
    assert [r["id"] for r in knowledge.notes_for(keys, notes).collect()] == [2, 1]
    assert rows(knowledge.notes_for(keys, notes, 1), "id") == [(2,)]
    queries = spark.createDataFrame([(1, "UTC"), (2, "timezone"), (3, "émails timezone"), (4, "refunds utc"), (5, "nowhere timezone"), (6, " ,. "), (7, "are"), (8, "EMAILS")], "query_id int, query string")
    want = [(1, 1), (2, 1), (2, 3), (3, 3), (7, 2), (7, 3), (8, 3)]
    assert rows(knowledge.search(notes, queries, "id", "body"), "query_id", "id") == want
    assert rows(knowledge.search(notes, queries, "id", "body", broadcast_cells=0), "query_id", "id") == want
    assert rows(knowledge.search(notes, queries, "id", "body", limit=1), "query_id", "id") == [(1, 1), (2, 1), (3, 3), (7, 2), (8, 3)]


def test_search_makes_its_queries_once_and_keeps_the_first_texts(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(None if k % 50 == 0 else (k * 37) % 400, " ".join(w for j, w in enumerate(words) if k % (j + 2) == 0)) for k in range(600)]
    texts = spark.createDataFrame(texts, "id long, body string").repartition(5)
    made = spark.sparkContext.accumulator(0)

    def query(k):
        made.add(1)
        return " ".join([*words, "alpha beta", "gamma delta", "none"][k % 7 :][:1])

    queries = spark.range(7).select(F.col("id").alias("query_id"), F.udf(query)("id").alias("query"))
    counted = knowledge.search(texts, queries, "id", "body", limit=4).collect()
    # Before, every step made the queries anew.
    assert made.value <= 14  # one pass, in a filter and a projection
    whole = [(r["query_id"], r["id"], r["rank"]) for r in knowledge.search(texts, queries, "id", "body").collect()]
    assert sorted(map(tuple, counted), key=repr) == sorted([r for r in whole if r[2] <= 4], key=repr) and len(counted) == 24
    for limit in (1, 2, 30, 100, 101):
        some = knowledge.search(texts, queries, "id", "body", limit=limit, named_terms=0).collect()
        assert sorted(map(tuple, some), key=repr) == sorted([r for r in whole if r[2] <= limit], key=repr)


def test_index_is_extended_replaced_trimmed_and_compacted(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Red apples, green pears"), (2, "red wine"), (3, None), (None, "red without a number"), (4, "Café rouge")], "id long, body string")
    index = textindex.TextIndex.build(texts, str(tmp_path / "one"), "id", "body", buckets=4)
    queries = spark.createDataFrame([("a", "RED"), ("b", "red pears"), ("c", "cafe"), ("d", "missing red"), ("e", "--")], "query_id string, query string")

    def answers(of, limit=None):
        return [(q, i) for q, i, _ in rows(of.search(queries, limit=limit))]

    assert answers(index) == [("a", 1), ("a", 2), ("b", 1), ("c", 4)]
    assert index.append(spark.createDataFrame([(2, "white wine"), (5, "red cafe, pears"), (6, "")], "id int, body string"), "id", "body") == 1
    assert answers(index) == [("a", 1), ("a", 5), ("b", 1), ("b", 5), ("c", 4), ("c", 5)]
    index.remove(spark.createDataFrame([(1,), (4,), (77,)], "id long"))
    index.append(spark.createDataFrame([(4, "red again")], "id long, body string"), "id", "body")
    assert answers(index) == [("a", 4), ("a", 5), ("b", 5), ("c", 5)] and answers(index, 1) == [("a", 4), ("b", 5), ("c", 5)]
    small = index.compact(str(tmp_path / "two"))
    assert answers(small) == answers(index)
    counted = dict(rows(small.frequencies(spark.createDataFrame([("red",), ("wine",), ("none",)], "term string"))))
    assert counted == {"red": 2, "wine": 1}


def test_index_holds_a_term_of_a_text_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "red apple red"), (1, "Red wine"), (2, "red")], "id long, body string")
    index = textindex.TextIndex.build(texts, str(tmp_path / "one"), "id", "body", buckets=2)
    index.append(spark.createDataFrame([(2, "red pear"), (3, "red"), (3, "red, pear")], "id long, body string"), "id", "body")
    written = spark.read.parquet(str(tmp_path / "one" / "postings"))
    want = [(0, 1, "apple"), (0, 1, "red"), (0, 1, "wine"), (0, 2, "red"), (1, 2, "pear"), (1, 2, "red"), (1, 3, "pear"), (1, 3, "red")]
    assert rows(written, "generation", "id", "term") == want
    asked = spark.createDataFrame([("red",), ("pear",)], "term string")
    assert rows(index.postings(asked), "id", "term") == [(1, "red"), (2, "pear"), (2, "red"), (3, "pear"), (3, "red")]
    # Before, all postings that were read were shuffled to make them distinct.
    small = index.compact(str(tmp_path / "two"))
    assert "Exchange" not in small.postings(asked)._jdf.queryExecution().executedPlan().toString()
    assert rows(small.postings(asked)) == rows(index.postings(asked))


def test_index_reads_only_the_buckets_asked(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = textindex.TextIndex.build(docs, str(tmp_path / "index"), "doc_id", "text")
    found = index.postings(spark.createDataFrame([("the",), ("law",)], "term string"))
    plan = re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"PartitionFilters: \[[^]]*bucket IN \(", plan) and re.search(r"PushedFilters: \[[^]]*In\(term", plan)
    queries = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    plain = knowledge.search(docs, queries, "doc_id", "text", limit=3)
    assert rows(index.search(queries, "doc_id", limit=3)) == rows(plain)
    monkeypatch.setattr(textindex, "NAMED_TERMS", 1)
    assert rows(index.search(queries, "doc_id", limit=3)) == rows(plain)
    assert rows(knowledge.search(docs, queries, "doc_id", "text", limit=3, named_terms=1)) == rows(plain)


def test_owners(spark):
    owners = spark.createDataFrame([("path:models/marts", "alice", "owner", "manual"), ("path:models/marts", "bob", "owner", "codeowners"), ("path:models", "carol", "owner", "codeowners"), ("path:", "root", "owner", "manual")], "key string, owner string, role string, source string")
    paths = spark.createDataFrame([("models/marts/orders.sql",), ("/models/x.sql",), ("src/a.sql",)], "path string")
    assert rows(knowledge.owners_of_paths(paths, owners), "path", "owner") == [("/models/x.sql", "carol"), ("models/marts/orders.sql", "alice"), ("models/marts/orders.sql", "bob")]
    assert rows(knowledge.owners_for(spark.createDataFrame([("path:models",), ("path:none",)], "k string"), owners), "key", "owner") == [("path:models", "carol"), ("path:none", None)]
    commits = spark.createDataFrame(
        [("s" * 12 + str(i), "src/a.sql", login, "Name", f"2026-01-{day:02d} 00:00:00", "fix\nmore") for i, (login, day) in enumerate([("dan", 1), ("dan", 20), ("eve", 21), (None, 22), ("", 23), ("fay", 24), ("gus", 25)])],
        "sha string, path string, author_login string, author_name string, authored_at string, message string")
    found = activity.find_owners(paths, owners, commits, committers_per_path=3)
    assert rows(found.where("path = 'models/marts/orders.sql'"), "handle", "source", "confidence") == [("alice", "knowledge/manual", 0.95), ("bob", "knowledge/codeowners", 0.85)]
    assert rows(found.where("path = 'src/a.sql'"), "handle", "confidence") == [("dan", 2 / 6), ("eve", 1 / 6)]
    assert activity.find_owners(paths, owners, commits).where("path = 'src/a.sql'").count() == 4
    recent = activity.recent_changes(commits, "src", "2026-01-31 00:00:00", 15)
    assert rows(recent, "author", "message") == [("Name", "fix"), ("Name", "fix"), ("dan", "fix"), ("eve", "fix"), ("fay", "fix"), ("gus", "fix")]
    assert len(recent.first()["sha"]) == 13
    short = activity.recent_changes(commits, "src", "2026-01-31 00:00:00", 15, sha_chars=10, message_chars=2)
    assert rows(short.distinct(), "sha", "message")[0] == ("s" * 10, "fi")
    assert [tuple(r) for r in activity.who_changed(commits, "/src/a.sql", "2026-01-31 00:00:00", 90, 2).collect()] == [("Name", 2), ("dan", 2)]


def test_tasks_decisions_digests(spark):
    tasks = spark.createDataFrame([(1, "a", "open", "2026-02-01"), (2, "a", "in_progress", None), (3, "a", "done", None), (4, "b", "open", "2026-01-01")], "id int, owner string, status string, due_at string")
    assert [r["id"] for r in knowledge.open_tasks(tasks).collect()] == [2, 4, 1]
    assert [r["id"] for r in knowledge.open_tasks(tasks, owner="a").collect()] == [2, 1]
    assert rows(knowledge.open_tasks(tasks, per_owner=1), "id") == [(2,), (4,)]
    decisions = spark.createDataFrame([(1, ["table:legacy_users", "table:x"]), (2, ["table:legacy"])], "id int, affects array<string>")
    assert rows(knowledge.decisions_affecting(spark.createDataFrame([("table:legacy_users",)], "k string"), decisions), "id") == [(1,)]
    digests = spark.createDataFrame([("r", 1, "2026-01-01", ["models/a.sql"]), ("r", 2, "2026-01-02", ["src/models/a.sql"]), ("r", 3, "2026-01-03", ["x", "models/b.sql"])], "repo string, number int, merged_at string, files_touched array<string>")
    assert [r["number"] for r in knowledge.changes_touching(digests, "models/").collect()] == [3, 1]


def test_upserts(spark):
    base = spark.createDataFrame([("r", 1, "old"), ("r", 2, "keep")], "repo string, number int, title string")
    updates = spark.createDataFrame([("r", 1, "b"), ("r", 1, "a"), ("r", 3, "new")], "repo string, number int, title string")
    assert rows(knowledge.upsert(base, updates, ["repo", "number"], ["title"])) == [("r", 1, "b"), ("r", 2, "keep"), ("r", 3, "new")]
    assert rows(knowledge.insert_ignore(base, updates, ["repo", "number"], ["title"])) == [("r", 1, "old"), ("r", 2, "keep"), ("r", 3, "new")]
    nullable = spark.createDataFrame([("r", 1, None)], "repo string, number int, title string")
    assert rows(knowledge.upsert(base, nullable, ["repo", "number"])) == [("r", 1, None), ("r", 2, "keep")]
    tasks = spark.createDataFrame([(1, "open", "t0"), (2, "open", "t0")], "id int, status string, updated_at string")
    changes = spark.createDataFrame([(1, "in_progress", "t1"), (1, "done", "t2"), (9, "done", "t1")], "id int, status string, updated_at string")
    assert rows(knowledge.update_status(tasks, changes)) == [(1, "done", "t2"), (2, "open", "t0")]


def test_large_catalogs_go_to_more_tasks(spark):
    """The rows of a task are bounded, whatever the size of the catalogs, and the changes stay the same."""
    columns = spark.range(6_000).select(
        F.concat(F.lit("t"), F.col("id") % 300).alias("table"), F.concat(F.lit("c"), F.col("id")).alias("column"), F.lit("int").alias("type"))
    both = impact._both(columns, columns.withColumn("type", F.when(F.col("column").endswith("7"), "long").otherwise(F.col("type"))))
    found = impact._column_changes(both, task_rows=300)
    assert rows(found) == rows(impact._column_changes(both)) and found.count() == 600
    assert found.rdd.getNumPartitions() == 40


def test_owners_are_found_once(spark):
    """Both owner steps read the written handles: no plan behind them reads paths, owners or commits again."""
    paths = spark.createDataFrame([("a/x",), ("b/y",), ("b/y",)], "path string")
    owners = spark.createDataFrame([("path:a", "ann", "owner", "manual")], "key string, owner string, role string, source string")
    commits = spark.createDataFrame([("b/y", "bob"), ("b/y", None)], "path string, author_login string")
    steps = runs._owner_steps(activity.find_owners(paths, owners, commits), "about x")
    assert rows(steps, "step", "detail") == [("action", "ping @ann about x"), ("action", "ping @bob about x"), ("identify_owners", "2 owner(s)")]
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
