"""Exact n-gram Jaccard join by prefix filters and prefix trees, down to components of similar documents.

The sets are the distinct word n-grams of a text as 64-bit hashes. Two sets of Jaccard similarity 4/5 or more share at least ``l`` of the n-grams with which each begins,
when that beginning has n - ceil(4n/5) + l n-grams, in any global order. Three exact filters narrow the sets before
any pair is formed:

1. In the order of the hashes, a set whose beginning has fewer n-grams in common with any other set than that goes out. The n-grams of all
   beginnings are counted with map-side aggregation, so a passage that many documents share is a few rows.
2. Of the rest, a set goes out if fewer than 4/5 of all its n-grams occur in any other set of the rest.
3. The n-grams left are put in order of frequency, the rare ones first, so that passages that many documents share come
   last. Sets that share an n-gram of their (shortest) beginnings are candidates if the n-grams that each shares with any
   set at all, and their sizes, still allow the similarity.

Copies are one set. Candidates first meet the centre of their group, the set with the fewest n-grams of its own; only
sets that stay outside the centre's component meet the other sets. A probe set and its candidates, sorted by their
n-grams, are a prefix tree walked depth first: the overlap along a shared path is computed once, and a subtree is
pruned where the n-grams of the probe already passed over exceed what a similar set may miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, list_column, materialise, small, starts_of, texts_of
from plumbline.llm.components import connected
from plumbline.llm.tokens import slices

#: Similarity as a fraction, and the share of a set by which the first filter's beginnings are longer than needed.
NUMERATOR, DENOMINATOR = 4, 5
LONGER = 20
#: Rows broadcast at most, counted before; beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000
SALTS = 64
#: Candidates of one centre that one task verifies.
BLOCK = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES[_SPACES] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte array that ends in white space: a polynomial over its bytes."""
    space = _SPACES[raw]
    edge = np.diff(space.astype(np.int8), prepend=1)
    begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(begin):
        return np.empty(0, np.uint64), begin
    longest = int((end - begin).max())
    powers = np.multiply.accumulate(np.full(longest, _ODD, np.uint64))
    # Position within the word, by run lengths from each word's first byte to the next word's.
    runs = np.diff(np.append(begin, len(raw)))
    inside = np.arange(len(raw) - begin[0]) - np.repeat(begin - begin[0], runs)
    values = _BYTES[raw[begin[0] :]] * powers[np.minimum(inside, longest - 1)]
    return mixed(np.add.reduceat(values, begin - begin[0]) + (end - begin).astype(np.uint64)), begin


def shingle_sets(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text in ascending order, end to end, and how many each has.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer than n words is one n-gram.
    """
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    words, begin = word_hashes(raw)
    first = np.searchsorted(begin, bounds)
    counts = np.diff(first)
    parts, owners = [], []
    total = len(words) - n + 1
    if total > 0:
        grams = np.zeros(total, np.uint64)
        for k in range(n):
            grams = (grams + words[k : k + total]) * _ODD
            grams ^= grams >> np.uint64(29)
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = owner[:total] == owner[n - 1 : n - 1 + total]
        parts.append(mixed(grams[whole]))
        owners.append(owner[:total][whole])
    for k in np.nonzero((counts > 0) & (counts < n))[0].tolist():
        short = np.array([counts[k]], np.uint64)
        for at in range(first[k], first[k + 1]):
            short = mixed((short + words[at : at + 1]) * _ODD)
        parts.append(short)
        owners.append(np.array([k]))
    if not parts:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    values, owner = np.concatenate(parts).view(np.int64), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(texts))


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any similar set."""
    return -(-n * NUMERATOR // DENOMINATOR)


def set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    found = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values.view(np.uint64) ^ np.uint64(salt)))])
        ends = np.cumsum(counts)
        found.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return found[0], found[1]


def _sets(docs: DataFrame, key: str, text: str, n: int, whole: bool, mark: Column | None = None) -> DataFrame:
    """``(id, mark, n, d1, d2, grams)``: size, digests, and all n-grams (``whole``) or those of the first filter's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                values, counts = shingle_sets(texts[a:b], n)
                d1, d2 = set_digests(values, counts)
                kept = counts
                if not whole:
                    kept = np.minimum(counts, counts - needed(counts) + np.maximum(1, counts // LONGER))
                    place = np.arange(len(values)) - np.repeat(starts_of(counts), counts)
                    values = values[place < np.repeat(kept, counts)]
                given = [batch.column(k).slice(a, b - a) for k in (0, 2)]
                columns = [*given, pa.array(counts, pa.int64()), pa.array(d1), pa.array(d2), list_column(values, kept, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n", "d1", "d2", "grams"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"))
    return rows.mapInArrow(run, "id long, mark string, n long, d1 long, d2 long, grams array<long>")


def _own_grams(rows: DataFrame, name: str) -> DataFrame:
    """``(name, own)``: how many n-grams only this set has. Rows of one ``name`` are copies.

    Aggregated before it moves, so no n-gram is hot.
    """
    grams = rows.select(F.col(name).alias("name"), F.explode("grams").alias("g"))
    single = grams.groupBy("g").agg(F.min("name").alias("one"), F.max("name").alias("last")).where("one = last")
    return single.groupBy(F.col("one").alias(name)).agg(F.count("*").alias("own"))


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` with a key in ``keys`` (distinct, written): broadcast if counted few, else a shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on)


def overlaps(probe: np.ndarray, members: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, bool, bool]]:
    """(id, overlap, whether it is exact, similar) of each member; members come sorted by their n-grams, a prefix tree depth first.

    ``met[d]`` is the overlap of the path of d n-grams with the probe, ``passed[d]`` the probe's n-grams up to its last.
    What the two differ by the probe has already missed for every set below that node. The overlap of a pruned member
    is what the probe can still have at the pruned node, an upper bound.
    """
    may_miss = len(probe) - int(needed(np.array(len(probe))))
    before = np.empty(0, np.int64)
    met, passed = np.zeros(1, np.int64), np.zeros(1, np.int64)
    dead, most = None, 0
    for number, grams in members:
        common = min(len(before), len(grams))
        differ = np.nonzero(before[:common] != grams[:common])[0]
        shared = int(differ[0]) if len(differ) else common
        if dead is not None and shared >= dead:
            yield number, most, False, False
            continue
        shared = min(shared, len(met) - 1)
        met, passed, dead, before = met[: shared + 1], passed[: shared + 1], None, grams
        for at in range(shared, len(grams), 256):
            step = grams[at : at + 256]
            place = np.searchsorted(probe, step)
            hit = probe[np.minimum(place, len(probe) - 1)] == step
            met = np.concatenate([met, met[-1] + np.cumsum(hit)])
            passed = np.concatenate([passed, place + hit])
            missed = passed[at + 1 :] - met[at + 1 :] > may_miss
            if missed.any():
                dead = at + 1 + int(np.argmax(missed))
                most = len(probe) - int(passed[dead] - met[dead])
                break
        if dead is not None:
            yield number, most, False, False
        else:
            yield number, int(met[-1]), True, (NUMERATOR + DENOMINATOR) * int(met[-1]) >= NUMERATOR * (len(probe) + len(grams))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b, overlap, exact, similar)``. All candidates b of a are walked as one prefix tree, in blocks of bounded size."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = pairs.join(counts, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    members = dealt.join(sets.select(F.col("id").alias("b"), "grams"), "b").select("a", "block", F.lit(1).alias("kind"), "b", "grams")
    probes = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    probes = probes.join(sets.select(F.col("id").alias("a"), "grams"), "a").select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("b"), "grams")
    rows = probes.union(members).repartition("a", "block").sortWithinPartitions("a", "block", "kind", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, int, int, np.ndarray]]:
            for batch in batches:
                a, block, kind, b = (batch.column(k).to_pylist() for k in range(4))
                lists = batch.column(4)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                for k in range(len(a)):
                    yield a[k], block[k], kind[k], b[k], values[offsets[k] : offsets[k + 1]]

        rows_ = each()
        row = next(rows_, None)
        while row is not None:
            a, block, _, _, probe = row

            def members_(a: int = a, block: int = block) -> Iterator[tuple[int, np.ndarray]]:
                nonlocal row
                while (row := next(rows_, None)) is not None and row[:2] == (a, block):
                    yield row[3], row[4]

            if found := list(overlaps(probe, members_())):
                ids, sizes, exact, same = zip(*found, strict=True)
                columns = [pa.array([a] * len(found), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(exact), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "overlap", "exact", "similar"])

    return rows.mapInArrow(run, "a long, b long, overlap long, exact boolean, similar boolean")


def _enough(overlap: Column, a: str, b: str) -> Column:
    """Whether an overlap suffices for sets of these sizes: 9 * overlap >= 4 * (sizes)."""
    return overlap * (NUMERATOR + DENOMINATOR) >= (F.col(f"{a}_n") + F.col(f"{b}_n")) * NUMERATOR


def by_frequency(sets: DataFrame) -> DataFrame:
    """``(id, n, alive, grams)``: each n-gram replaced by a number that sorts by frequency among the sets, then by hash.

    The number holds the frequency (4,095 at most, which orders all that matters) above 51 bits of the hash. ``alive``
    counts the n-grams that another of the sets has too; the others stand first.
    """
    grams = sets.select("id", F.explode("grams").alias("g"))
    frequency = F.least(F.col("f"), F.lit(4095)).cast("long")
    number = F.shiftleft(frequency, 51).bitwiseOR(F.col("g").bitwiseAND(F.lit((1 << 51) - 1)))
    counted = grams.join(grams.groupBy("g").agg(F.count("*").alias("f")), "g").select("id", "f", number.alias("g"))
    ordered = counted.groupBy("id").agg(F.sort_array(F.collect_list("g")).alias("grams"), F.count_if(F.col("f") > 1).alias("alive"))
    return sets.select("id", "n").join(ordered, "id").where(F.col("alive") >= F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))


def similar_components(sets: DataFrame) -> DataFrame:
    """``(id, component)`` of the sets ``(id, n, alive, grams)`` that are similar to another one; the rest has no row.

    A pair's overlap lies in the n-grams from its first common one on; ``left`` is how many of them each set shares
    with any other. Pairs without enough are never formed.
    """
    dead = F.col("n") - F.col("alive")
    length = (F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1 - dead).cast("int")
    some = sets.where(length > 0).select("id", "n", "alive", F.posexplode(F.slice("grams", (dead + 1).cast("int"), length)).alias("place", "g"))
    begin = materialise(some.withColumn("left", F.col("alive") - F.col("place")).drop("place"), "begin")
    # A group's centre is the set with the smallest share of n-grams of its own: a copy's origin, if it is there.
    rank = F.struct(((F.col("n") - F.col("alive")) / F.col("n")).alias("own"), F.col("id").alias("id"), "n", "alive", "left")
    groups = begin.groupBy("g").agg(F.min(rank).alias("c"), F.count("*").alias("size")).where("size > 1")
    groups = materialise(groups.select("g", *[F.col(f"c.{c}").alias(f"a_{c}") for c in ("id", "n", "alive", "left")]).withColumnRenamed("a_id", "a"), "groups")
    members = begin.select("g", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("alive").alias("b_alive"), F.col("left").alias("b_left"))
    near = (F.col("a") != F.col("b")) & _enough(F.least("a_left", "b_left"), "a", "b")
    first = materialise(members.join(groups, "g").where(near).select("a", "b").distinct(), "pairs")
    verified = materialise(_verify(first, sets), "verified")
    links = verified.where("similar").select("a", "b")
    labels = connected(links)
    # Sets outside the component of their group's centre meet the group's sets of other components. Each set's overlap
    # with the centre is known (or bounded); what two sets share lies inside the centre or outside it.
    known = members.join(labels.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    centres = groups.join(labels.select(F.col("node").alias("a"), "component"), "a", "left")
    centres = centres.select("g", "a", "a_n", "a_alive", F.coalesce("component", "a").alias("main"))
    known = known.join(centres, "g").join(verified.select("a", "b", "overlap", "exact"), ["a", "b"], "left")
    centre = F.col("a") == F.col("b")
    known = known.withColumns({
        # At most so many of a set's shared n-grams lie in the centre, and at most so many outside it.
        "b_inside": F.when(centre, F.col("b_alive")).otherwise(F.least(F.coalesce("overlap", "a_alive"), F.col("b_alive"))),
        "b_outside": F.when(centre, F.lit(0)).otherwise(F.col("b_alive") - F.when(F.col("exact"), F.col("overlap")).otherwise(F.lit(0))),
    })
    known = materialise(known.select("g", "b", "b_n", "b_left", "b_inside", "b_outside", "component", "main"), "known")
    renamed = [F.col(c).alias(c.replace("b", "a", 1)) for c in ("b", "b_n", "b_left", "b_inside", "b_outside")]
    outside = known.where("component <> main").select("g", *renamed, F.col("component").alias("a_component"))
    shared = F.least("a_inside", "b_inside") + F.least("a_outside", "b_outside")
    far = (F.col("a_component") != F.col("component")) & _enough(F.least("a_left", "b_left"), "a", "b") & _enough(shared, "a", "b")
    # Two sets that are both outside meet once.
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("b"))
    second = outside.join(known, "g").where(far & once).select("a", "b").distinct()
    second = second.join(first.union(first.select("b", "a")), ["a", "b"], "left_anti")
    more = materialise(_verify(materialise(second, "pairs"), sets).where("similar").select("a", "b"), "links")
    if more.isEmpty():
        return labels.select(F.col("node").alias("id"), "component")
    return connected(links.union(more)).select(F.col("node").alias("id"), "component")


def _classes(docs: DataFrame, key: str, text: str, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, n, d1, d2)`` of every row, and ``(n, d1, d2, class, first, component)`` of every distinct set with words: the sets it
    links with, the smallest key that has the set, and the smallest that its links reach.

    A set is known by its first digest, never by a key: rows of one key may hold different texts.
    """
    sets = scratch.write(_sets(docs, key, text, n, whole=False).drop("mark"), "sets")
    rows = scratch.write(sets.drop("grams"), "rows")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    # Copies become one set, in two steps, so that no set is hot.
    copies = rows.where("id IS NOT NULL AND n > 0").groupBy("n", "d1", "d2", salt.alias("salt")).agg(F.min("id").alias("id"))
    distinct = scratch.write(copies.groupBy("n", "d1", "d2").agg(F.min("id").alias("id")), "distinct")
    beginning = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + F.greatest(F.lit(1), F.floor(F.col("n") / LONGER)))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) / LONGER))
    own = _own_grams(sets.where("id IS NOT NULL AND n > 0"), "d1")
    first = distinct.join(own, "d1", "left").where(beginning - F.coalesce("own", F.lit(0)) >= least)
    first = scratch.write(first.select("id", "n", "d1", "d2"), "first")
    scratch.drop(sets)
    texts = _semi(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), first.select("id").distinct(), "id")
    whole = _sets(texts, "id", "t", n, whole=True).join(first, ["id", "n", "d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    whole = scratch.write(whole.select(F.col("d1").alias("id"), "n", "grams"), "whole")
    own = _own_grams(whole, "id")
    alive = F.col("n") - F.coalesce("own", F.lit(0))
    kept = whole.join(own, "id", "left").where(alive >= F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))
    kept = scratch.write(kept.select("id", "n", "grams"), "kept")
    scratch.drop(whole)
    ordered = scratch.write(by_frequency(kept), "ordered")
    scratch.drop(kept)
    found = scratch.write(similar_components(ordered), "found")
    scratch.drop(ordered)
    named = distinct.join(found.select(F.col("id").alias("d1"), F.col("component").alias("class")), "d1", "left").withColumn("class", F.coalesce("class", "d1"))
    smallest = named.groupBy("class").agg(F.min("id").alias("component"))
    return rows, scratch.write(named.join(smallest, "class").select("n", "d1", "d2", "class", F.col("id").alias("first"), "component"), "classes")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row: set size, and the smallest key reachable by links.

    Two documents link when the Jaccard similarity of their sets of word n-grams is 4/5 or more. A null, empty or
    blank text has the empty set and links with nothing, its component is its own key; a row without a key has the
    component null. Repeated rows each get a row, and so do rows of one key with different texts, each with the component of
    its own text; an empty table gives an empty result.
    """
    rows, classes = _classes(docs, key, text, n, Scratch())
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    salted = rows.where("id IS NOT NULL AND n > 0").select("n", "d1", "d2", salt.alias("salt")).distinct().join(classes, ["n", "d1", "d2"])
    result = rows.withColumn("salt", salt).join(salted.select("n", "d1", "d2", "salt", "component"), ["n", "d1", "d2", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    kind = docs.schema[key].dataType
    return result.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest key. Rows without a key all stay.

    Rows of one key and one set of n-grams become one, rows of one key without words too. Of rows of one key with different
    texts every one stays that no other row stands for.
    """
    scratch = Scratch()
    rows, classes = _classes(docs, key, text, n, scratch)
    # Of the sets whose key names the component, one: a key may hold several of them, and name several components.
    heads = classes.where(F.col("first") == F.col("component")).groupBy("class", "component").agg(F.min(F.struct("d1", "d2")).alias("d"))
    heads = heads.select(F.col("component").alias("id"), "d.d1", "d.d2")
    heads = heads.union(rows.where("id IS NOT NULL AND n = 0").select("id", "d1", "d2").distinct())
    heads = scratch.write(heads, "heads")
    mixed = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("n", "d1", "d2")).alias("low"), F.max(F.struct("n", "d1", "d2")).alias("high")).where("low <> high")
    mixed = scratch.write(mixed.select("id"), "mixed")
    plain = scratch.write(heads.select("id").distinct().join(mixed, "id", "left_anti").select(F.col("id").alias("_k")), "kept-keys")
    found = docs.join(plain, docs[key] == plain["_k"], "left_semi").dropDuplicates([key])
    # Keys with several texts, if there are any: their texts are read again.
    several = _semi(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), mixed, "id")
    digest = F.sha2("t", 256)
    known = _sets(several, "id", "t", n, whole=False, mark=digest).join(heads, ["id", "d1", "d2"], "left_semi").groupBy("id", "d1", "d2").agg(F.min("mark").alias("mark"))
    known = known.select(F.col("id").alias("_k"), F.col("mark").alias("_m")).distinct()
    others = docs.join(known, (docs[key] == known["_k"]) & F.sha2(docs[text], 256).eqNullSafe(known["_m"]), "left_semi").dropDuplicates([key, text])
    return found.unionByName(others).unionByName(docs.where(F.col(key).isNull()))
