"""SimHash components, periodic runs and the filter audit: brute force, planted cases and edges."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import filters, periodic, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("id", "fp", "row", "n", "part", "mask", "digest", "salt", "list", "period", "begin", "end", "octave", "text_", "component", "good", "size", "low")
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["x"] * len(CLASH)) for i, t, lang in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def same_rows(found, want):
    assert sorted(map(repr, found)) == sorted(map(repr, want))


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(key, fingerprint, component) by comparing all pairs of different fingerprints."""
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    kinds = np.array(sorted(set(prints)), np.uint64)
    for k, p in enumerate(kinds):
        for other in kinds[k + 1 :][np.bitwise_count(kinds[k + 1 :] ^ p) <= 4]:
            label[find(int(p))] = find(int(other))
    least = {}
    for (key, *_), p in zip(rows, prints):
        if key is not None:
            least[find(p)] = min(key, least.get(find(p), key))
    return [(key, f"{p:016x}", least.get(find(p))) for (key, *_), p in zip(rows, prints)]


def test_simhash_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same_rows([tuple(r) for r in queries.op11_simhash_neardup(spark, sf).collect()], brute_components(rows))


def test_simhash_edges(spark):
    long = " ".join(f"Word{k} and" for k in range(40_000))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t\r\x0b\x0c", None), (3, "one TWO three", "a"), (4, "One\ttwo  three", "a"), (5, long, "a"), (6, long + " end", "a"),
            (None, "no key here at all", "a"), (9, "No key here AT all", "a"), (None, "nothing else has this one", "a"), (7, "É ﬁne x 漢字 😀 Σ İ", "a"), (7, "another text of the same key", "a"), (8, "x", "a"), (8, "x", "a")]
    found = [tuple(r) for r in simhash.simhash_components(frame(spark, rows)).collect()]
    want = brute_components(rows)
    same_rows(found, want)
    assert {(3, 3), (4, 3), (0, 0), (2, 0), (6, 5), (None, 9), (None, None)} <= {(i, c) for i, _, c in found}
    assert simhash.simhash_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4, 1_024])
def test_fingerprint_components(spark, monkeypatch, block):
    """Chains of four-bit steps, pairs at four and five bits, and one dense group, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    pick = random.Random(block)
    prints = {0, 15, 31 << 40, (1 << 64) - 1}
    for _ in range(40):
        at = pick.getrandbits(64)
        for _ in range(pick.randrange(1, 8)):
            prints.add(at)
            at ^= sum(1 << k for k in pick.sample(range(64), pick.choice((4, 4, 5))))
    centre, loose = pick.getrandbits(64), pick.sample(range(64), 14)
    prints |= {centre ^ sum((pick.random() < 0.4) << k for k in loose) for _ in range(600)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r["fp"]: r["component"] for r in simhash.fingerprint_components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    array = np.array(signed, np.int64).view(np.uint64)
    label = np.array(signed)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    while True:
        least = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert {p: found.get(p, p) for p in signed} == dict(zip(signed, label.tolist()))


def test_index_reaches_every_pair(spark):
    """Any four differing bits leave a pair in a common list."""
    pick = random.Random(5)
    pairs = [(a, a ^ sum(1 << k for k in pick.sample(range(63), 4))) for a in (pick.getrandbits(63) for _ in range(300))]
    lists = simhash.index(spark.createDataFrame([(p,) for pair in pairs for p in pair], "fp long"))
    met = lists.alias("a").join(lists.alias("b"), "list").where("a.fp < b.fp").select(F.col("a.fp"), F.col("b.fp")).distinct().collect()
    assert {tuple(sorted(p)) for p in pairs} <= set(map(tuple, met))


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(w):
    """Runs by definition: every maximal interval of matches of every period, without those that a smaller period has too."""
    ids = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.empty(0, int)
    runs = {}
    for q in range(1, len(ids) // 4 + 1):
        edge = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for s, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
            if e - s + q >= max(6, 4 * q):
                runs.setdefault((s, e - s + q), q)
    return sorted((s, q, n) for (s, n), q in runs.items())


def brute_periodic(key, text):
    w = words(text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = brute_runs(w)
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, q, n in runs), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
    return (key, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), *digests)


def test_periodic_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()]
    same_rows(found, [brute_periodic(*r) for r in rows])
    assert sum(r[1] > 0 for r in found) >= len(rows) // 20


def generated(pick):
    """Words with runs of all kinds: powers, powers of powers, cut and nested repeats, few letters."""
    out = []
    for _ in range(pick.randrange(1, 9)):
        block = [pick.choice("abc") for _ in range(pick.choice((1, 1, 2, 3, 4, 5, 7, 8, 11, 16, 31)))]
        if pick.random() < 0.3:
            block = block * pick.randrange(2, 4) + [pick.choice("abcd")]
        out += (block * 9)[: pick.randrange(1, 8 * len(block) + 1)]
        out += [f"u{pick.random()}"] * (pick.random() < 0.3)
    return out


def test_periodic_runs_against_definition(spark, monkeypatch):
    monkeypatch.setattr(periodic, "ROW_WORDS", 16)
    pick = random.Random(8)
    rows = [(k, " ".join(generated(pick)), "a") for k in range(500)]
    found = [tuple(r)[:-1] for r in periodic.periodic_runs(frame(spark, rows)).collect()]
    same_rows(found, [brute_periodic(i, t) for i, t, _ in rows])


def test_periodic_edges(spark):
    line = "the same line of words again and again"
    noise = " ".join(f"n{k}" for k in range(30_000))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\x0b", "a"), (3, "x x x x x", "a"), (4, "x x x x x x", "a"), (4, "x x x x x x", "a"), (None, "y " * 20_000, "a"),
            (None, (line + "\n") * 3_000, "a"), (None, noise, "a"), (None, noise + " " + (noise[:60_000] + " ") * 5 + noise, "a"), (None, "É  " * 9 + "漢 字 " * 4, "a")]
    found = [tuple(r)[:-1] for r in periodic.periodic_runs(frame(spark, rows)).collect()]
    want = [brute_periodic(i, t) for i, t, _ in rows if t is None or len(t) < 200_000]
    assert len(found) == len(rows) and set(map(repr, want)) <= set(map(repr, found))
    assert (None, 1, 30_000) == next((r[0], r[1], r[2]) for r in found if r[3] is not None and r[3] > 40_000)
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


# --- filter audit ----------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and i > first[t]}
        mine = [x for x in labels if i is not None and x[0] == i]
        facts.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in sorted({f[0] for f in facts}):
        own = [f for f in facts if f[0] == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, name in enumerate(order, 1):
                here = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                alone = sum(f[1][name] and sum(f[1].values()) == 1 for f in own)
                lines.append((part, order, step, len(left), len(here), sum(f[1][name] for f in own) - len(here), alone, sum(f[2] for f in here), sum(f[3] for f in here), name))
                shapley[name] += len(here)
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return out


def test_filter_audit_edges(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (4, long, "en"), (5, long, "de"), (6, long, "de"), (None, long, "en"), (None, "a $ B", "fr"), (7, "AB " * 250, "en"),
            (8, "x" * 300_000, "en"), (9, long + " #", "en"), (10, "same " * 400, None), (11, "same " * 400, "en"), (12, "ÀÉ 漢字 A" * 80, "en"), (13, long.upper(), "de")]
    labels = [(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (None, 1, 1), (10, None, 1), (11, 1, 0), (99, 1, 1), (13, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in filters.filter_audit(frame(spark, rows), table).collect()]
    same_rows(found, brute_audit(rows, labels))
    assert filters.filter_audit(frame(spark, []), table).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["good_lost"], r["toxic_lost"]) for r in filters.filter_audit(frame(spark, rows), nothing).collect()} == {(0, 0)}


def test_filter_audit_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    same_rows([tuple(r) for r in queries.op13_filter_audit(spark, sf).collect()], brute_audit(rows, labels))
