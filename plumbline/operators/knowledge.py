"""Notes, owners, tasks, decisions and change digests, looked up for whole tables of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.operators.profile import quoted
from plumbline.session import BROADCAST_CELLS, broadcast_if_small, cut_lineage, written

OPEN_STATES = ("open", "in_progress")
#: Distinct terms of a table of queries up to which a search names them in its plan.
NAMED_TERMS = 10_000
#: Largest limit for which a search finds out first how far the first texts of a term reach.
FEW = 100


def notes_for(keys: DataFrame, notes: DataFrame, limit: int | None = None, tie: str = "id") -> DataFrame:
    """Notes of each key, newest first; ``keys`` is one column, ``notes`` has ``key`` and ``created_at``.

    Without a limit the rows are sorted by (key, newest): a range sort, which splits a key with very many notes.
    """
    found = notes.join(keys.toDF("key").distinct(), "key", "left_semi")
    newest = [F.col("created_at").desc(), quoted(tie).desc()]
    if limit is None:
        return found.orderBy("key", *newest)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*newest))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def asked_terms(queries: DataFrame, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """``(__q, __terms)`` of every query with a term."""
    return queries.select(quoted(query_id).alias("__q"), terms(quoted(query_col)).alias("__terms")).where(F.size("__terms") > 0)


def search(
    texts: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str = "query_id",
    query_col: str = "query", limit: int | None = None, broadcast_cells: int = BROADCAST_CELLS, named_terms: int = NAMED_TERMS,
) -> DataFrame:
    """Texts that hold every term of a query, for a table of queries: ``(query id, text id, rank)`` in id order.

    Texts and queries are tokenised once, and only occurrences of the queries' own terms are kept and written. Up to ``named_terms`` distinct
    terms they are picked out before a text's terms become rows, beyond it by a join. ``textindex`` holds the same
    occurrences for good. Tables are broadcast only while they are counted small.
    """
    # Written first: the queries may take as long to make as the texts, and all steps need them.
    asked = cut_lineage(asked_terms(queries, query_id, query_col))
    bodies = texts.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text"))
    wanted = asked.select(F.explode("__terms").alias("__term")).distinct()
    found = terms(F.col("__text"))
    named = [r["__term"] for r in wanted.limit(named_terms + 1).collect()]
    # The outer form keeps Spark from tokenising twice, once only to drop empty texts.
    if len(named) <= named_terms:
        held = bodies.select("__id", F.explode_outer(F.filter(found, lambda term: term.isin(named))).alias("__term"))
        hits = held.where("__term IS NOT NULL")
    else:
        known = broadcast_if_small(wanted, limit=broadcast_cells)
        hits = bodies.select("__id", F.explode_outer(found).alias("__term")).join(known, "__term")
    return lookup(written(hits, "hits"), asked, id_col, query_id, limit, broadcast_cells)


def lookup(
    hits: DataFrame, asked: DataFrame, id_col: str, query_id: str, limit: int | None = None, broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """The answers to ``asked`` from the occurrences ``(__id, __term)`` of its terms, both written tables.

    Each query is looked up by its rarest term, and the other terms are tested on the candidates, so frequent terms never
    build pairs. Of the texts with the only term of a query, ``limit`` are kept before queries are joined; queries with a term that
    occurs nowhere are dropped.
    """
    wanted = asked.select("__q", F.explode("__terms").alias("__term"))
    # Counted before the join: a term found in a third of the texts crosses the shuffle as a few rows per task. Texts are dealt to
    # as many slots as are asked for: where none is empty, the largest of their smallest ids is no smaller than the last one asked for.
    slots = limit if limit is not None and 1 < limit <= FEW else 1
    slot = F.pmod(F.xxhash64("__id"), F.lit(slots)).alias("__slot")
    dealt = hits.groupBy("__term", slot).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__least"))
    reach = F.when((F.lit(limit or 0) == slots) & (F.count("__least") == slots), F.max("__least"))
    frequency = dealt.groupBy("__term").agg(F.sum("__n").alias("__df"), reach.alias("__reach"))
    # The list is as long as the query itself.
    by_rarity = F.sort_array(F.collect_list(F.struct("__df", "__term")))
    ranked = wanted.join(frequency, "__term").groupBy("__q").agg(
        F.transform(by_rarity, lambda x: x["__term"]).alias("__found"), F.max("__reach").alias("__reach")
    )
    lookups = cut_lineage(
        asked.join(ranked, "__q").where(F.size("__found") == F.size("__terms")).select(
            "__q", F.element_at("__found", 1).alias("__term"), F.expr("slice(__found, 2, size(__found))").alias("__rest"), "__reach"
        )
    )
    single = lookups.where(F.size("__rest") == 0).select("__q", "__term", "__reach")
    several = lookups.where(F.size("__rest") > 0)
    firsts = hits.join(broadcast_if_small(single.select("__term", "__reach").distinct(), limit=broadcast_cells), "__term")
    firsts = firsts.where("__reach IS NULL OR __id IS NULL OR __id <= __reach").drop("__reach")
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("__term").orderBy("__id"))
        firsts = firsts.withColumn("__place", place).where(F.col("__place") <= limit)
    candidates = cut_lineage(hits.join(broadcast_if_small(several, F.size("__rest") + 1, broadcast_cells), "__term").select("__q", "__id", "__rest"))
    # Only what is tested is gathered: other terms of candidates, and other texts, stay where they are.
    others = broadcast_if_small(several.select(F.explode("__rest").alias("__term")).distinct(), limit=broadcast_cells)
    listed = broadcast_if_small(candidates.select("__id").distinct(), limit=broadcast_cells)
    tested_terms = hits.join(others, "__term", "left_semi").join(listed, "__id", "left_semi")
    held = tested_terms.groupBy("__id").agg(F.collect_set("__term").alias("__held"))
    tested = candidates.join(held, "__id").where(F.forall("__rest", lambda t: F.array_contains("__held", t)))
    found = firsts.join(single.drop("__reach"), "__term").select("__q", "__id").unionByName(tested.select("__q", "__id"))
    rank = F.row_number().over(Window.partitionBy("__q").orderBy("__id"))
    placed = found.withColumn("rank", rank)
    return (placed if limit is None else placed.where(F.col("rank") <= limit)).select(
        F.col("__q").alias(query_id), F.col("__id").alias(id_col), "rank"
    )


def owners_for(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners of each key, one row per owner; a key without owners keeps one row with nulls."""
    return keys.toDF("key").distinct().join(owners.select("key", "owner", "role", "source"), "key", "left")


def path_prefixes(path: Column) -> Column:
    """All leading parts of a path as ``path:`` keys, shortest first."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("path:"), F.array_join(F.slice(parts, 1, i), "/"))
    )


def owners_of_paths(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """All owners at the deepest owned prefix of each path; paths without one are absent. ``paths`` is one column."""
    owned = owners.select("key").distinct()
    prefixes = paths.toDF("path").distinct().select("path", F.posexplode(path_prefixes(F.col("path"))).alias("depth", "key"))
    deepest = prefixes.join(owned, "key", "left_semi").groupBy("path").agg(F.max_by("key", "depth").alias("key"))
    return deepest.join(owners.select("key", "owner", "role", "source"), "key").select("path", "key", "owner", "role", "source")


def open_tasks(tasks: DataFrame, owner: str | None = None, per_owner: int | None = None, tie: str = "id") -> DataFrame:
    """Tasks that are open or in progress by due date, undated first; ``per_owner`` keeps the first of each owner."""
    found = tasks.where(F.col("status").isin(*OPEN_STATES))
    if owner is not None:
        found = found.where(F.col("owner") == owner)
    due = [F.col("due_at").asc_nulls_first(), quoted(tie)]
    if per_owner is None:
        return found.orderBy(*due)
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(*due))
    return found.withColumn("rank", rank).where(F.col("rank") <= per_owner)


def decisions_affecting(keys: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions for each key; ``decisions.affects`` is an array of keys."""
    affected = decisions.withColumn("key", F.explode(F.array_distinct("affects")))
    return affected.join(keys.toDF("key").distinct(), "key", "left_semi")


def changes_touching(digests: DataFrame, prefix: str, limit: int | None = None, tie: Sequence[str] = ("repo", "number")) -> DataFrame:
    """Digests with a touched file below ``prefix``, the latest first, all or ``limit`` of them."""
    touched = digests.where(F.exists("files_touched", lambda f: f.startswith(prefix)))
    ordered = touched.orderBy(F.col("merged_at").desc(), *[quoted(t) for t in tie])
    return ordered if limit is None else ordered.limit(limit)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """``base`` with rows replaced or added by key; the last update by ``order_by`` wins.

    An aggregate, not a window: versions of one key are combined on the map side.
    """
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    latest = F.struct("__new", *[F.when(F.col("__new") == 1, quoted(c)) for c in order_by])
    return _winner(both, keys, F.max_by, latest, base.columns)


def insert_ignore(base: DataFrame, additions: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows whose key is new; of several additions the first by ``order_by`` stays."""
    both = base.withColumn("__new", F.lit(0)).unionByName(additions.withColumn("__new", F.lit(1)))
    first = F.struct("__new", *[F.when(F.col("__new") == 1, quoted(c)) for c in order_by])
    return _winner(both, keys, F.min_by, first, base.columns)


def _winner(both: DataFrame, keys: Sequence[str], pick, order: Column, columns: Sequence[str]) -> DataFrame:
    rest = F.struct(*[quoted(c) for c in columns if c not in keys], F.lit(0).alias("__none"))
    rows = both.groupBy(*[quoted(k) for k in keys]).agg(pick(rest, order).alias("__row"))
    return rows.select(*[quoted(c) if c in keys else F.col("__row")[c].alias(c) for c in columns])


def update_status(tasks: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Tasks with the latest status per task from ``updates`` ``(id, status, updated_at)``."""
    latest = updates.groupBy(quoted(key)).agg(
        F.max_by("status", "updated_at").alias("__status"), F.max("updated_at").alias("__at")
    )
    joined = tasks.join(latest, key, "left")
    return joined.withColumn("status", F.coalesce("__status", "status")).withColumn(
        "updated_at", F.coalesce("__at", "updated_at")
    ).drop("__status", "__at")
