"""SimHash near-duplicates: an inverted index of bytes at their positions, with count filtering.

Fingerprints of 64 bits that differ in at most four bits share at least four of their eight bytes, each at its
position. A pair that reaches this count stands together in the list of those four positional bytes, so the index has
one list for every choice of four positions and their bytes (70 choices); the lists of a single byte would hold a
256th of all fingerprints each. In a list, the shared positional bytes of a pair are tallied, pairs that reach the
minimum are kept, and their differing bits are counted.

Equal fingerprints are one entry. The entries of a list first meet its smallest and its largest one, twice: as
entries, and as members of the components found by then. Then only entries outside the component of the list's smallest one
meet the others, in blocks. So a dense group of near copies is joined by stars and not by all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import materialise
from plumbline.llm.components import connected

WORDS, SEED = 4, 42
BYTES, DISTANCE = 8, 4
#: Positional bytes that two similar fingerprints share at least.
SHARED = BYTES - DISTANCE
#: Shingles whose bits are counted at a time.
SLICE = 16_384
SALTS = 64
#: Entries of one list that one block of the second pass holds.
BLOCK = 1_024


def shingle_hashes(raw: bytes, n: int = WORDS) -> Iterator[int]:
    """XXH64 of every run of n words (of all words, if there are fewer), A-Z in lower case, joined by spaces."""
    words = raw.lower().split()
    joined = b" ".join(words)
    if len(words) < n:
        return iter([xxhash.xxh64_intdigest(joined, SEED)] if words else [])
    begins = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = (b - 1 for b in begins[n:])
    return map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, begins, ends)), repeat(SEED))


def fingerprint(raw: bytes, n: int = WORDS) -> int:
    """The bits set in over half of a text's hashes; zero without words."""
    hashes = shingle_hashes(raw, n)
    total, ones = 0, np.zeros(64, np.int64)
    while len(part := np.fromiter(islice(hashes, SLICE), np.uint64)):
        total += len(part)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(id, fp)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(value.as_py() or b"", n) for value in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _masks() -> list[int]:
    """One mask, as a signed long, for every choice of positions that a similar pair may share."""
    masks = [sum(255 << (8 * at) for at in chosen) for chosen in combinations(range(BYTES), SHARED)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def index(entries: DataFrame) -> DataFrame:
    """``(list, fp, ...)``: the lists of every fingerprint. A list is named by a hash of its positions and their bytes."""
    dealt = entries.select("*", F.posexplode(F.array(*[F.lit(m) for m in _masks()])).alias("choice", "mask"))
    return dealt.select(F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("list"), *entries.columns)


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    differ = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(differ, 8 * at).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for at in range(BYTES)), F.lit(0))


def similar(a: Column, b: Column) -> Column:
    """The count filter, then the differing bits."""
    return (shared_bytes(a, b) >= SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with the components that these links ``(component, other)`` between components make one."""
    labels = connected(links, "component", "other").withColumnRenamed("component", "joined")
    found = known.join(labels, known["component"] == labels["node"], "left")
    return materialise(found.select("fp", F.coalesce("joined", known["component"]).alias("component")), "known")


def fingerprint_components(entries: DataFrame) -> DataFrame:
    """``(fp, component)`` of the distinct fingerprints ``fp`` that share a list with another one; the rest has no row."""
    of_list = W.partitionBy("list")
    ends = index(entries.select("fp")).withColumns({"low": F.min("fp").over(of_list), "high": F.max("fp").over(of_list)})
    members = materialise(ends.where("low < high").select("fp", "low", "high").distinct(), "members")
    # One link for each entry makes the first components.
    pairs = members.select("fp", F.explode(F.array("low", "high")).alias("end"))
    stars = pairs.where((F.col("fp") != F.col("end")) & similar(F.col("fp"), F.col("end"))).groupBy("fp").agg(F.min("end").alias("other"))
    known = members.select("fp", F.col("fp").alias("component")).distinct()
    known = _joined(known, materialise(stars.select(F.col("fp").alias("component"), "other"), "stars"))
    # The same again between components, so that a group has few of them left.
    entry = F.struct("fp", "component")
    ends = index(known).withColumn("ends", F.array(F.min(entry).over(of_list), F.max(entry).over(of_list)))
    pairs = ends.select("fp", "component", F.explode("ends").alias("end"))
    across = pairs.where((F.col("component") != F.col("end.component")) & similar(F.col("fp"), F.col("end.fp")))
    across = materialise(across.select("component", F.col("end.component").alias("other")).distinct(), "across")
    if not across.isEmpty():
        known = _joined(known, across)
    # Lists that one component fills are settled; of the others, the component of the smallest entry is the main one.
    mixed = index(known).withColumns({"main": F.min(entry).over(of_list)["component"], "size": F.count("*").over(of_list)})
    mixed = mixed.withColumn("outside", F.max(F.col("component") != F.col("main")).over(of_list))
    mixed = materialise(mixed.where("outside").drop("outside"), "mixed")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    inside = mixed.select("list", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"), "fp", "component", "main")
    each = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    outside = mixed.where("component <> main").select("list", each, F.col("fp").alias("end"), F.col("component").alias("other"))
    # Two entries that are both outside meet once.
    once = (F.col("component") == F.col("main")) | (F.col("end") < F.col("fp"))
    more = outside.join(inside, ["list", "block"]).where((F.col("component") != F.col("other")) & once & similar(F.col("fp"), F.col("end")))
    more = materialise(more.select("component", "other").distinct(), "links")
    return known if more.isEmpty() else _joined(known, more)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row: 16 hexadecimal digits, and the smallest key reachable by links.

    Two rows link when their fingerprints differ in at most four bits. A null, empty or blank text has the fingerprint zero
    and links like any other. Repeated rows each get a row. A row without a key joins its component but cannot name it;
    a component without any key is null. An empty table gives an empty result.
    """
    table = materialise(fingerprints(docs, key, text, n), "fingerprints")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    # Copies become one entry, in two steps, so that no fingerprint is hot.
    copies = materialise(table.groupBy("fp", salt).agg(F.min("id").alias("id")), "copies")
    entries = materialise(copies.groupBy("fp").agg(F.min("id").alias("id")), "entries")
    found = entries.join(fingerprint_components(entries), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = found.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = materialise(found.join(names, "component").select("fp", "component_id"), "classes")
    salted = copies.select("fp", "salt").join(classes, "fp")
    kind = docs.schema[key].dataType
    return table.select("id", "fp", salt).join(salted, ["fp", "salt"]).select(
        F.col("id").cast(kind).alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))
