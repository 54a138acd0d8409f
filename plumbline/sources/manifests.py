"""Model manifests, ownership files and change digests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "nodes map<string, struct<name: string, resource_type: string, original_file_path: string, path: string>>, "
    "child_map map<string, array<string>>"
)


def manifest_tables(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of manifests already read with the ``MANIFEST`` schema."""
    nodes = manifest.select(F.explode("nodes").alias("unique_id", "n")).select(
        "unique_id", "n.name", "n.resource_type", F.coalesce("n.original_file_path", "n.path").alias("path")
    )
    edges = manifest.select(F.explode("child_map").alias("src", "children")).select("src", F.explode("children").alias("dst"))
    return nodes, edges


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(unique_id, name, resource_type, path)`` and edges ``(src, dst)`` of a manifest JSON file."""
    return manifest_tables(spark.read.schema(MANIFEST).json(path, multiLine=True))


def parse_codeowners(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Owner rows ``(key, owner, role, source)`` of CODEOWNERS lines; comments and lines without an owner are skipped.

    Paths lose their outer slashes and owners their ``@``; patterns stay literal keys.
    """
    words = F.split(F.trim(F.regexp_replace(F.split(F.col(line_col), "#").getItem(0), r"\s+", " ")), " ")
    rows = lines.select(words.alias("w")).where(F.size("w") >= 2)
    path = F.regexp_replace(F.element_at("w", 1), "^/+|/+$", "")
    return rows.select(
        F.concat(F.lit("path:"), path).alias("key"), F.explode(F.expr("slice(w, 2, size(w) - 1)")).alias("owner")
    ).select(
        "key", F.regexp_replace("owner", "^@+", "").alias("owner"), F.lit("owner").alias("role"), F.lit("codeowners").alias("source")
    )


def ingest_prs(df: DataFrame, json_col: str, repo: Column | str, summary_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(digests, contributors) from pull-request JSON, one document per row.

    A digest keeps the body, or its first ``summary_chars`` characters; every author becomes a contributor of the repository.
    """
    kind = "number int, title string, user struct<login: string>, merged_at string, _files array<string>, body string"
    repo = F.col(repo) if isinstance(repo, str) else repo
    parsed = df.select(repo.alias("repo"), F.from_json(F.col(json_col), kind).alias("p"))
    digests = parsed.select(
        "repo", "p.number", "p.title",
        F.coalesce("p.user.login", F.lit("")).alias("author"),
        F.coalesce("p.merged_at", F.lit("")).alias("merged_at"),
        F.coalesce("p._files", F.array().cast("array<string>")).alias("files_touched"),
        F.coalesce("p.body" if summary_chars is None else F.left("p.body", F.lit(summary_chars)), F.lit("")).alias("summary"),
    )
    contributors = digests.select(
        F.concat(F.lit("repo:"), "repo").alias("key"), F.col("author").alias("owner"),
        F.lit("contributor").alias("role"), F.lit("git_blame").alias("source"),
    ).distinct()
    return digests, contributors
