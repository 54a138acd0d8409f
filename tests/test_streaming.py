from checks import runs
from conftest import rows
import pandas as pd
from pyspark.sql import functions as F
from test_ordered import hot_log

from plumbline.operators import mask, replay
from plumbline.streaming import limits, streams


def written_in_parts(spark, df, order, path, parts):
    """Files that a stream reads one per batch, in time order."""
    for i, chunk in enumerate(parts):
        df.where(F.col(order).between(*chunk)).coalesce(1).write.mode("append").parquet(f"{path}/{i}")


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def sunk(spark, stream, tmp_path):
    streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_rate_limit_stream_equals_replay(spark, tmp_path):
    log = [r for r in hot_log(21, n=300) if r[1] is not None]
    df = spark.createDataFrame(log, "id long, key string, s long, e long").select("id", "key", F.timestamp_micros("s").alias("ts"))
    path = str(tmp_path / "in")
    written_in_parts(spark, df, "id", path, [(0, 99), (100, 199), (200, 299)])
    streamed = sunk(spark, streams.rate_limit_stream(source(spark, df, path), ["key"], "ts", "id", 20), tmp_path)
    batch = replay.rate_limit_replay(df, ["key"], "ts", "id", 20, 5)
    assert rows(streamed, "id", "allowed") == rows(batch, "id", "allowed")
    assert batch.where("NOT allowed").count() > 0


def test_hot_key_is_merged_in_blocks(spark, tmp_path):
    """A key of many runs a micro-batch, out of order, with ties and calls without a time."""
    log = spark.range(3_000).select(
        "id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"),
        F.when(F.col("id") % 97 > 0, F.timestamp_micros(F.lit(10**15) + (F.col("id") * 7919 % 1_500) * 400_000)).alias("ts"),
        F.when(F.col("id") % 3 > 0, (F.lit(2**60) + F.col("id"))).alias("_other one"))
    path = str(tmp_path / "in")
    log.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    streamed = sunk(spark, streams.rate_limit_stream(stream, ["key"], "ts", "id", 20, run=40, block=7), tmp_path)
    timed = replay.rate_limit_replay(log.where("ts IS NOT NULL"), ["key"], "ts", "id", 20, 5)
    assert rows(streamed.where("ts IS NOT NULL")) == rows(timed, *streamed.columns)
    untimed = streamed.where("ts IS NULL")
    assert untimed.count() == 31 and untimed.where("allowed IS NOT NULL").isEmpty()


def test_answers_of_a_busy_key_leave_in_frames(spark, tmp_path, monkeypatch):
    # A frame each time, where before all answers of a key were one; columns come through unchanged.
    monkeypatch.setattr(limits, "MERGED", 3)
    k = F.col("id")
    log = spark.range(2000).select(
        "id", F.when(k % 3 > 0, "busy").alias("key"), F.when(k % 50 > 0, F.timestamp_micros((k * 7919) % 2000 * 400_000 + 5)).alias("ts"),
        F.when(k % 5 > 0, k + 2**60 + 1).alias("n"), F.when(k % 4 == 0, F.lit("NaN")).when(k % 4 == 1, "-0.1").when(k % 4 == 2, "Infinity").cast("double").alias("d"),
        F.when(k % 2 > 0, F.timestamp_seconds(k * 10**8)).alias("far"), F.date_add(F.lit("0999-01-01").cast("date"), k.cast("int")).alias("day"),
        (k / 7).cast("decimal(20,5)").alias("m"), F.encode(k.cast("string"), "utf-8").alias("b"), F.when(k % 3 > 0, k % 2 == 0).alias("f"),
    )
    path = str(tmp_path / "in")
    log.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    limited = streams.rate_limit_stream(stream, ["key"], "ts", "id", 20, run=40, block=7, late=None)
    assert "timestamp_micros(cast(ts" in limited._jdf.queryExecution().analyzed().toString() and limited.schema.names == [*log.columns, "allowed"]
    streamed = sunk(spark, limited, tmp_path)
    told = [F.col(c).cast("string") if c != "b" else F.hex(c) for c in [*log.columns, "allowed"]]
    assert rows(streamed.select(*told)) == rows(replay.rate_limit_replay(log, ["key"], "ts", "id", 20).select(*told))
    walk = limits.FramedBucketLimit(limits.TokenBucket(20), ["id"], False, run=40)
    walk.full_at, walk.blocks = Held(), Blocks()
    frames = list(walk.handleInputRows((), iter([pd.DataFrame({"id": range(500), "micros": range(500), "tie": range(500)})]), None))
    assert len(frames) == 13 and max(map(len, frames)) == 40 and walk.blocks.most <= 4 * 500 and not walk.blocks.held
    assert pd.concat(frames)["id"].tolist() == list(range(500))


class Held:
    def get(self):
        return None

    def update(self, value):
        pass


class Blocks:
    """A map state in memory."""

    def __init__(self):
        self.held, self.most = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.most = max(self.most, len(self.held))

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]


def test_idle_keys_leave_the_state(spark, tmp_path):
    """Every batch brings new keys, an hour later; the state holds those of the last hours, and the answers are the replay's."""
    log = spark.range(400).select(
        "id", F.concat(F.lit("k"), F.expr("id DIV 50"), F.lit("-"), F.col("id") % 5).alias("key"),
        F.timestamp_seconds(F.lit(10**9) + F.expr("id DIV 50") * 3_600 + F.col("id") % 50).alias("ts"))
    path = str(tmp_path / "in")
    written_in_parts(spark, log, "id", path, [(50 * k, 50 * k + 49) for k in range(8)])
    stream = streams.rate_limit_stream(source(spark, log, path), ["key"], "ts", "id", 3, late="10 minutes")
    query = streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 30 and held[-1] <= 15
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out, "id", "allowed") == rows(replay.rate_limit_replay(log, ["key"], "ts", "id", 3), "id", "allowed")
    assert out.where("NOT allowed").count() > 0


def test_unbounded_lateness_keeps_every_call(spark, tmp_path):
    log = spark.createDataFrame([(0, "a", 10_000), (1, "a", 1), (2, "a", 20_000), (3, "a", 2)], "id long, key string, s long").select("id", "key", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "in")
    written_in_parts(spark, log, "id", path, [(k, k) for k in range(4)])
    out = sunk(spark, streams.rate_limit_stream(source(spark, log, path), ["key"], "ts", "id", 1, late=None), tmp_path)
    assert rows(out, "id", "allowed") == [(0, True), (1, False), (2, True), (3, False)]


def test_mask_stream_equals_mask(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    assert rows(sunk(spark, streams.mask_stream(stream), tmp_path)) == rows(mask.mask(docs))


def test_stream_reads_a_folder_of_part_files(spark, sf, tmp_path):
    """Larger tables are folders; a stream that took one file of that name gave no rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for path in (str(tmp_path), sf):
        assert rows(runs.QUERIES["stream_mask"](spark, path)) == rows(mask.mask(docs))


def test_masked_cells_are_observed(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    query = streams.run_available(streams.mask_stream(stream, observe="masked"), str(tmp_path / "out"), str(tmp_path / "state"))
    seen = [p["observedMetrics"]["masked"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(m["rows"] for m in seen) == docs.count()
    assert sum(m["text"] for m in seen) == mask.mask(docs).where(F.col("text").startswith("[REDACTED:")).count() > 0


def test_late_rows_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(0, 10), (1, 20), (2, 200), (3, 210), (4, 15), (5, 500)], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "in")
    written_in_parts(spark, df, "id", path, [(0, 1), (2, 2), (3, 3), (4, 4), (5, 5)])
    counts = sunk(spark, streams.window_counts(source(spark, df, path), "ts", "1 minute", "30 seconds"), tmp_path)
    got = [(r["window_start"].minute, r["rows"], r["newest"].second) for r in counts.orderBy("window_start").collect()]
    assert got == [(0, 2, 20), (3, 2, 30)]
