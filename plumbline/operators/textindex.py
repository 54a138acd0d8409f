"""A written inverted index over texts: built once, extended and trimmed by generations, read only for the terms asked.

Below the index's folder stand, each partitioned by generation:

* ``postings`` (term, id), partitioned also by a hash bucket of the term and sorted by term, so that a lookup reads the
  buckets of its terms and, in them, the row groups that can hold them; a text holds a term once;
* ``frequencies`` (term, texts), one row per term;
* ``ids`` (id, copies), the texts written, and ``gone`` (id), texts removed or replaced: their postings of earlier generations
  count no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.text import terms
from plumbline.operators import knowledge
from plumbline.operators.profile import quoted
from plumbline.session import broadcast_if_small, cut_lineage, written

BUCKETS = 64
#: Distinct terms up to which a lookup names its terms in the filter of the scan; beyond it they are a join.
NAMED_TERMS = 2_000
#: Shares into which the postings are dealt, per partition of a shuffle: many enough for tasks of like size.
DEALT = 3


class TextIndex:
    """An index in a shared folder. ``buckets`` is fixed when it is built and read back afterwards."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- tables ---------------------------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _facts(self) -> tuple[int, str, int]:
        """Buckets, the type of the ids, and the newest generation, from the folder's own small tables."""
        row = self._table("about").first()
        newest = self._table("written").agg(F.max("generation")).first()[0]
        return row["buckets"], row["id_type"], newest

    # -- writing --------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, texts: DataFrame, path: str, id_col: str, text_col: str, buckets: int = BUCKETS) -> TextIndex:
        """A new index of all texts. A text without an id is left out; of several texts with one id all count."""
        index = cls(texts.sparkSession, path)
        kind = StructType([texts.schema[id_col]]).fields[0].dataType.simpleString()
        index.spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(kind).alias("id_type")).coalesce(1).write.parquet(f"{index.path}/about")
        bodies = index._bodies(texts, id_col, text_col, kind)
        added = index._ids(bodies.groupBy("id").agg(F.count(F.lit(1)).alias("copies")), 0)
        index._gone(added.select("id").limit(0), 0)
        index._write(bodies, added, 0, buckets)
        return index

    def append(self, texts: DataFrame, id_col: str, text_col: str) -> int:
        """Adds texts as a new generation and returns its number; a text whose id is already there takes the place of the old one."""
        buckets, kind, newest = self._facts()
        bodies = self._bodies(texts, id_col, text_col, kind)
        earlier = self._table("ids").where(F.col("generation") <= newest).select("id")
        added = self._ids(bodies.groupBy("id").agg(F.count(F.lit(1)).alias("copies")), newest + 1)
        self._gone(added.select("id").join(earlier, "id", "left_semi"), newest + 1)
        self._write(bodies, added, newest + 1, buckets)
        return newest + 1

    def remove(self, ids: DataFrame) -> int:
        """Takes texts out by id (one column); their postings stay in the files until ``compact``."""
        _, kind, newest = self._facts()
        self._gone(ids.toDF("id").select(F.col("id").cast(kind)).where("id IS NOT NULL").distinct(), newest + 1)
        self._mark(newest + 1)
        return newest + 1

    def compact(self, path: str) -> TextIndex:
        """A new index of one generation with the postings that still count."""
        buckets, kind, _ = self._facts()
        fresh = TextIndex(self.spark, path)
        self._table("about").coalesce(1).write.parquet(f"{fresh.path}/about")
        kept = fresh._ids(self._living(self._table("ids")).select("id", F.lit(1).cast("long").alias("copies")), 0)
        fresh._gone(kept.select("id").limit(0), 0)
        fresh._store(self._living(self._table("postings")).select("id", "term"), 0, buckets)
        return fresh

    @staticmethod
    def _bodies(texts: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
        return texts.select(quoted(id_col).cast(kind).alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL")

    def _ids(self, ids: DataFrame, generation: int) -> DataFrame:
        path = f"{self.path}/ids/generation={generation}"
        ids.write.parquet(path)
        return self.spark.read.schema(ids.schema).parquet(path)

    def _write(self, bodies: DataFrame, ids: DataFrame, generation: int, buckets: int) -> None:
        found = bodies.select("id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term IS NOT NULL")
        # A text holds each of its terms once; only several texts with one id can repeat them.
        repeated = not ids.where("copies > 1").isEmpty()
        self._store(found.distinct() if repeated else found, generation, buckets)

    def _store(self, found: DataFrame, generation: int, buckets: int) -> None:
        # One shuffle, without a sample of the texts: a bucket is dealt out by id, so a term of a third of all texts fills many
        # tasks and files.
        shares = -(-DEALT * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        placed = found.withColumn("bucket", self._bucket(F.col("term"), buckets))
        dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(shares)))
        postings = f"{self.path}/postings/generation={generation}"
        dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(postings)
        written = self.spark.read.schema("term string, bucket int").parquet(postings)
        counted = written.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
        counted.write.parquet(f"{self.path}/frequencies/generation={generation}")
        self._mark(generation)

    def _gone(self, ids: DataFrame, generation: int) -> None:
        ids.write.parquet(f"{self.path}/gone/generation={generation}")

    def _mark(self, generation: int) -> None:
        """The last step of every change: a generation counts from here on."""
        self.spark.range(1).select(F.lit(generation).alias("generation")).coalesce(1).write.mode("append").parquet(f"{self.path}/written")

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    # -- reading --------------------------------------------------------------------------------------------------

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows of finished generations whose id is not removed or replaced by a later one."""
        newest = self._facts()[2]
        gone = self._table("gone").where(F.col("generation") <= newest).groupBy("id").agg(F.max("generation").alias("until"))
        rows = rows.where(F.col("generation") <= newest)
        if gone.isEmpty():
            return rows
        dead = broadcast_if_small(cut_lineage(gone))
        return rows.join(dead, "id", "left").where("until IS NULL OR generation >= until").drop("until")

    def postings(self, asked: DataFrame) -> DataFrame:
        """``(id, term)`` of every text that holds one of the terms (one column); reads only their buckets."""
        buckets, _, _ = self._facts()
        wanted = cut_lineage(asked.toDF("term").distinct())
        table = self._table("postings")
        if wanted.count() <= NAMED_TERMS:
            named = [r["term"] for r in wanted.collect()]
            places = [r[0] for r in wanted.select(self._bucket(F.col("term"), buckets)).distinct().collect()]
            table = table.where(F.col("bucket").isin(places) & F.col("term").isin(named))
        else:
            # The buckets of the terms prune the scan while it runs.
            keyed = wanted.withColumn("bucket", self._bucket(F.col("term"), buckets))
            table = table.join(broadcast_if_small(keyed), ["bucket", "term"], "left_semi")
        # An id lives in one generation, where it has each term once.
        return self._living(table).select("id", "term")

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """``(term, texts)`` of the terms (one column), removed and replaced texts counted until ``compact``."""
        newest = self._facts()[2]
        found = self._table("frequencies").where(F.col("generation") <= newest).join(asked.toDF("term").distinct(), "term", "left_semi")
        return found.groupBy("term").agg(F.sum("texts").alias("texts"))

    def search(self, queries: DataFrame, id_col: str = "id", query_id: str = "query_id", query_col: str = "query", limit: int | None = None) -> DataFrame:
        """As ``knowledge.search`` over the indexed texts; no text is read."""
        asked = cut_lineage(knowledge.asked_terms(queries, query_id, query_col))
        hits = self.postings(asked.select(F.explode("__terms"))).select(F.col("id").alias("__id"), F.col("term").alias("__term"))
        return knowledge.lookup(written(hits, "hits"), asked, id_col, query_id, limit)
