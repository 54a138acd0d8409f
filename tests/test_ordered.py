"""Ordered work over many partitions, with one key that holds most rows, against plain Python."""

import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import audit, govern, replay
from plumbline.operators.anomaly import rolling_baseline
from plumbline.operators.ordered import CHUNK, ordered_chunks, running_total
from plumbline.operators.profile import percentiles


def hot_log(seed, n=600, gap=400_000, keys=("hot", "a", "b", None), length=3_000_000):
    """Calls in micros; two thirds of them belong to one key, some at the same instant."""
    rng = random.Random(seed)
    now, log = 0, []
    for i in range(n):
        now += rng.choice([0, 1, gap // 3, gap, gap * 2, gap * 40 if rng.random() < 0.02 else gap])
        key = "hot" if rng.random() < 0.66 else rng.choice(keys)
        log.append((i, key, now, now + rng.randrange(1, length)))
    return log


def as_frame(spark, log):
    df = spark.createDataFrame(log, "id long, key string, s long, e long").repartition(5)
    return df.select("id", "key", F.timestamp_micros("s").alias("start"), F.timestamp_micros("e").alias("end"), "s")


def test_hot_key_spreads_over_chunks(spark):
    df = as_frame(spark, hot_log(1))
    chunks = ordered_chunks(df, ["key"], ["s", "id"], 8)
    assert chunks.where("key = 'hot'").select(CHUNK).distinct().count() >= 4
    assert chunks.count() == 600


def test_running_total(spark):
    log = hot_log(2)
    df = running_total(as_frame(spark, log), ["key"], ["s", "id"], F.col("id"), "total", 8)
    want, sums = [], {}
    for i, key, *_ in sorted(log, key=lambda r: (r[2], r[0])):
        sums[key] = sums.get(key, 0) + i
        want.append((i, sums[key]))
    assert rows(df, "id", "total") == sorted(want, key=repr)


def test_rate_limit_replay(spark):
    # The last two keep a large bucket empty for long, over many chunks.
    cases = [(3, 60, 400_000, 600), (4, 7, 900_000, 600), (5, 1, 5_000_000, 600), (6, 130, 100_000, 600), (15, 300, 20_000, 4000), (16, 97, 9_000, 3000)]
    for seed, per_minute, gap, n in cases:
        log = hot_log(seed, n=n, gap=gap)
        got = replay.rate_limit_replay(as_frame(spark, log), ["key"], "start", "id", per_minute, 8)
        tokens, last, want = {}, {}, []
        full, unit = per_minute * 60_000_000, 60_000_000
        for i, key, s, _ in sorted(log, key=lambda r: (r[2], r[0])):
            have = min(full, tokens.get(key, full) + (s - last.get(key, s)) * per_minute)
            allowed = have >= unit
            tokens[key], last[key] = have - unit if allowed else have, s
            want.append((i, allowed))
        assert rows(got, "id", "allowed") == sorted(want, key=repr)
        assert 0 < sum(a for _, a in want) < len(want)


def test_sixty_calls_pass_and_the_next_is_refused(spark):
    log = [(i, key, 0, 1) for key in ("x", "y") for i in range(61)]
    df = as_frame(spark, [(n, *r[1:]) for n, r in enumerate(log)])
    got = replay.rate_limit_replay(df, ["key"], "start", "id", 60, 6)
    assert rows(got.groupBy("key").agg(F.count_if("allowed")), ) == [("x", 60), ("y", 60)]


def test_concurrency_replay(spark):
    for seed, cap in [(7, 1), (8, 2), (9, 4)]:
        log = hot_log(seed)
        got = replay.concurrency_replay(as_frame(spark, log), ["key"], "start", "end", "id", cap, 8)
        running, want = {}, []
        for i, key, s, e in sorted(log, key=lambda r: (r[2], r[0])):
            ends = [x for x in running.get(key, []) if x > s]
            admitted = len(ends) < cap
            running[key] = ends + [e] if admitted else ends
            want.append((i, admitted))
        assert rows(got, "id", "admitted") == sorted(want, key=repr)


def test_gate_that_never_coalesces(spark):
    """Back-to-back calls keep the first admitted pattern alive over all chunks."""
    log = [(i, "hot", i * 10, i * 10 + 15) for i in range(200)]
    got = replay.concurrency_replay(as_frame(spark, log), ["key"], "start", "end", "id", 1, 10)
    assert rows(got, "id", "admitted") == sorted([(i, i % 2 == 0) for i in range(200)], key=repr)


def test_concurrency_peak(spark):
    log = hot_log(10)
    got = govern.concurrency_peak(as_frame(spark, log), "key", "start", "end", slice_seconds=20)
    peaks = {}
    for key in {r[1] for r in log}:
        steps = sorted([(s, 1) for _, k, s, _ in log if k == key] + [(e, -1) for _, k, _, e in log if k == key])
        level, best = 0, 0
        for i, (at, step) in enumerate(steps):
            level += step
            if i + 1 == len(steps) or steps[i + 1][0] != at:
                best = max(best, level)
        peaks[key] = best
    assert dict(rows(got)) == peaks


def test_exact_percentiles(spark):
    rng = random.Random(11)
    values = [rng.choice([1.0, 2.5, rng.random() * 100]) for _ in range(777)]
    df = spark.createDataFrame([(v, int(v), None) for v in values], "x double, n int, empty double").repartition(4)
    got = {(r["column"], r["prob"]): r["value"] for r in percentiles(df, [0.0, 0.3, 0.5, 0.95, 1.0], exact=True).collect()}
    for name, series in (("x", pd.Series(values)), ("n", pd.Series([int(v) for v in values]))):
        for p in (0.0, 0.3, 0.5, 0.95, 1.0):
            assert abs(got[name, p] - series.quantile(p)) < 1e-9
    assert ("empty", 0.5) not in got


def test_rolling_baseline(spark):
    rng = random.Random(12)
    points = [("hot" if i % 4 else "cold", i, rng.random() * 10 + (50 if i % 97 == 0 else 0)) for i in range(500)]
    df = spark.createDataFrame(points, "k string, i long, v double").repartition(4)
    got = rolling_baseline(df, ["k"], ["i"], "v", window=12, threshold=3.0, block_rows=20, partitions=6)
    frame = pd.DataFrame(points, columns=["k", "i", "v"])
    past = frame.groupby("k")["v"].transform(lambda s: s.shift().rolling(12, min_periods=1).mean())
    want = {i: m for i, m in zip(frame["i"], past, strict=True)}
    found = {r["i"]: r["baseline_mean"] for r in got.collect()}
    assert len(found) == 500 == got.count()
    assert all((found[i] is None and pd.isna(m)) or abs(found[i] - m) < 1e-9 for i, m in want.items())


def test_default_partitioning_spreads_a_hot_key(spark):
    """Without a partition count the session's shuffle partitions apply; adaptive merging is off to get several."""
    log = hot_log(13)
    want = rows(replay.rate_limit_replay(as_frame(spark, log), ["key"], "start", "id", 40, 1), "id", "allowed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordered_chunks(as_frame(spark, log), ["key"], ["s", "id"]).select(CHUNK).distinct().count() > 4
        assert rows(replay.rate_limit_replay(as_frame(spark, log), ["key"], "start", "id", 40), "id", "allowed") == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_chain_over_chunks(spark):
    import hashlib
    import json

    records = spark.createDataFrame([("hot" if i % 3 else "cold", i, f"é{i}") for i in range(90)], "k string, seq long, v string").repartition(4)
    chained = audit.chain(records, ["k"], ["seq"], 7)
    want = {}
    for key in ("hot", "cold"):
        previous = audit.GENESIS
        for i in range(90):
            if ("hot" if i % 3 else "cold") == key:
                body = {"k": key, "seq": i, "v": f"é{i}", "prev_record_hash": previous}
                payload = json.dumps(body, separators=(",", ":"), sort_keys=True).encode()
                previous = "sha256:" + hashlib.sha256(payload).hexdigest()
                want[i] = previous
    assert {r["seq"]: r["record_hash"] for r in chained.collect()} == want
    verified = audit.verify_chain(chained, ["k"], "seq", slice_rows=8)
    assert rows(verified) == [("cold", True, 30, None), ("hot", True, 60, None)]


def jobs_of(spark, name, work):
    """How many Spark jobs the work takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_gate_with_idle_instants_takes_two_passes(spark):
    """One busy key with an idle instant now and then: the jobs do not grow with the chunks. Without any, it stays exact."""
    rng, now, log = random.Random(15), 0, []
    for i in range(900):
        now += 50_000 if i % 17 else 9_000_000
        log.append((i, "hot", now, now + rng.randrange(1, 2_000_000)))
    want = gate_by_hand(log, 3)
    found = {}
    for parts in (3, 24):
        df = as_frame(spark, log)
        found[parts] = jobs_of(spark, f"gate-{parts}", lambda: rows(replay.concurrency_replay(df, ["key"], "start", "end", "id", 3, parts), "id", "admitted"))
        assert rows(replay.concurrency_replay(df, ["key"], "start", "end", "id", 3, parts), "id", "admitted") == want
    assert found[3] == found[24]
    dense = [(i, key, s // 100, e) for i, key, s, e in log]
    assert rows(replay.concurrency_replay(as_frame(spark, dense), ["key"], "start", "end", "id", 3, 24), "id", "admitted") == gate_by_hand(dense, 3)


def gate_by_hand(log, cap):
    running, want = {}, []
    for i, key, start, end in sorted(log, key=lambda r: (r[2], r[0])):
        live = [e for e in running.get(key, []) if e > start]
        want.append((i, len(live) < cap))
        running[key] = live + [end] * (len(live) < cap)
    return sorted(want, key=repr)


def test_calls_without_a_time_are_not_decided(spark):
    log = [(0, "a", None, 5, None), (1, "a", 1, 9, 2**60 + 1), (2, "a", 2, None, None), (3, "a", 3, 9, 3), (4, "a", 4, 9, None), (5, "b", None, None, 1)]
    df = spark.createDataFrame(log, "id long, key string, s long, e long, other long").select(
        "id", "key", F.timestamp_micros("s").alias("start"), F.timestamp_micros("e").alias("end"), "other")
    for parts in (1, 4):
        gate = replay.concurrency_replay(df, ["key"], "start", "end", "id", 2, parts)
        assert rows(gate, "id", "admitted") == [(0, None), (1, True), (2, None), (3, True), (4, False), (5, None)]
        limit = replay.rate_limit_replay(df, ["key"], "start", "id", 2, parts)
        assert rows(limit, "id", "allowed") == [(0, None), (1, True), (2, True), (3, False), (4, False), (5, None)]
        # Columns that are only carried along keep every digit.
        assert rows(limit, "id", "other") == [(i, other) for i, _, _, _, other in log]


def test_replay_carries_only_what_is_asked(spark):
    df = as_frame(spark, hot_log(14, n=50))
    assert replay.rate_limit_replay(df, ["key"], "start", "id", 60, 3, keep=[]).columns == ["key", "start", "id", "allowed"]
    assert replay.concurrency_replay(df, ["key"], "start", "end", "id", 2, 3, keep=["s"]).columns == ["key", "start", "end", "id", "s", "admitted"]


def test_profile_of_nested_columns(spark):
    from plumbline.operators.profile import profile

    df = spark.createDataFrame([([1.0, 2.0], {"a": 1}, (1, "x")), ([1.0, 2.0], {"b": 2}, None)], "v array<float>, m map<string,int>, s struct<i: int, t: string>")
    for approx in (False, True):
        got = {r["column"]: r for r in profile(df, approx=approx).collect()}
        assert [got[c]["distinct_count"] for c in "vms"] == [1, 2, 1] and got["s"]["null_count"] == 1
