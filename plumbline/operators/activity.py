"""Who changed what lately, and who to ask."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.knowledge import owners_of_paths
from plumbline.session import cut_lineage

MANUAL_CONFIDENCE = 0.95
LISTED_CONFIDENCE = 0.85
COMMIT_CONFIDENCE = 0.7


def _touches(path: str) -> Column:
    clean = path.strip("/")
    return (F.col("path") == clean) | F.col("path").startswith(clean + "/")


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def _since(as_of: datetime | str, days: int) -> Column:
    return F.col("authored_at").cast("timestamp") >= F.lit(str(as_of)).cast("timestamp") - F.make_interval(days=F.lit(days))


def recent_changes(
    commits: DataFrame, path: str, as_of: datetime | str, days: int = 30, sha_chars: int | None = None, message_chars: int | None = None
) -> DataFrame:
    """Commits to a path (a file or a folder) in the last ``days``: whole hash and first line of the message, or so many characters.

    ``commits`` has ``sha, path, author_login, author_name, authored_at, message``, one row per touched path.
    """
    author = F.coalesce(F.when(F.col("author_login") != "", F.col("author_login")), F.col("author_name"), F.lit(""))
    return commits.where(_touches(path) & _since(as_of, days)).select(
        _head(F.col("sha"), sha_chars).alias("sha"),
        author.alias("author"),
        F.col("authored_at").alias("when"),
        _head(F.split(F.coalesce("message", F.lit("")), "\r\n|\r|\n").getItem(0), message_chars).alias("message"),
    )


def who_changed(commits: DataFrame, path: str, as_of: datetime | str, days: int = 90, top: int | None = None) -> DataFrame:
    """Commits per author of a path, the busiest first; all of them or the ``top`` ones."""
    counted = recent_changes(commits, path, as_of, days).where(F.col("author") != "").groupBy("author").agg(
        F.count(F.lit(1)).alias("commits")
    )
    ordered = counted.orderBy(F.col("commits").desc(), "author")
    return ordered if top is None else ordered.limit(top)


def find_owners(paths: DataFrame, owners: DataFrame, commits: DataFrame, committers_per_path: int | None = None) -> DataFrame:
    """``(path, handle, role, source, confidence)``: registered owners, else the committers of the path, all or the busiest ones."""
    # Written: the paths and their owners are read three times.
    asked = cut_lineage(paths.toDF("path").distinct())
    registered = cut_lineage(owners_of_paths(asked, owners))
    listed = registered.select(
        "path", F.col("owner").alias("handle"), "role", F.concat(F.lit("knowledge/"), "source").alias("source"),
        F.when(F.col("source") == "manual", F.lit(MANUAL_CONFIDENCE)).otherwise(F.lit(LISTED_CONFIDENCE)).alias("confidence"),
    )
    # Commits are counted per (path, author) first; what is ranked is one row per author.
    counts = commits.where(F.col("author_login").isNotNull()).groupBy("path", "author_login").agg(F.count(F.lit(1)).alias("n"))
    unowned = asked.join(registered.select("path").distinct(), "path", "left_anti")
    totals = counts.groupBy("path").agg(F.sum("n").alias("total"))
    busiest = Window.partitionBy("path").orderBy(F.col("n").desc(), "author_login")
    committers = (
        counts.join(unowned, "path", "left_semi")
        .withColumn("rank", F.row_number().over(busiest))
        .where((F.lit(True) if committers_per_path is None else F.col("rank") <= committers_per_path) & (F.col("author_login") != ""))
        .join(totals, "path")
        .select(
            "path", F.col("author_login").alias("handle"), F.lit("contributor").alias("role"), F.lit("git_blame").alias("source"),
            F.least(F.lit(COMMIT_CONFIDENCE), F.col("n") / F.col("total")).alias("confidence"),
        )
    )
    return listed.unionByName(committers)
