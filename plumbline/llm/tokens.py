"""Token ids as Parquet list columns, written in document order and read back selectively.

The encoder calls the tokenizers library once per distinct word of a task. Its pre-tokenizer drops white space, so
the ids of a text are the ids of its words end to end. Arrow splits the texts and numbers the distinct words of a slice;
only these are looked up, and only those never met are encoded. Words of plain lower-case
letters go straight to the library's BPE model, since the normaliser and the pre-tokenizer leave them as they are;
all others, and whole texts that hold combining or rarer characters or a special token, take the full tokenizer.
"""

from __future__ import annotations

import codecs
import re
import sys
import types
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import list_column, ranges, starts_of
from plumbline.session import scratch_path

#: Small Latin letters that lower-casing and composition leave alone, and marks that never join a word.
LETTERS = "a-zß-öø-ÿ"
MARKS = ".,!?;:%$#&*|"
_PLAIN = re.compile(f"[{LETTERS}]+")
#: Behind these, marks are a token of their own.
_ENDS = frozenset(chr(c) for c in range(256) if re.fullmatch(f"[{LETTERS}0-9]", chr(c)))
#: Words kept per worker process before those used once go: bounds its memory.
WORDS_KEPT = 300_000
#: Stands for a text that takes the full tokenizer as a whole; every text that holds it is one.
SPECIAL = "<|"


def _byte_letters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return "".join(letters[b] for b in range(256))


class Encoder:
    """Encodes texts; ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` for any text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        # Of each row: where its ids begin, how many they are, and how often it was used.
        self.table = np.zeros((3, 1 << 14), np.int64)
        # The empty word is row 0 and has no ids.
        self.rows = 1
        self.index: dict[str, int] = {"": 0}

    def _shrink(self) -> None:
        """Only words used again stay, the most used ones if they are many."""
        begin, length, uses = self.table[:, : self.rows]
        rows = np.fromiter(self.index.values(), np.int64, len(self.index))
        bar = max(2, int(np.partition(uses[rows], len(rows) // 2)[len(rows) // 2]) + 1)
        stay = uses[rows] >= bar
        words, rows = list(compress(self.index, stay.tolist())), rows[stay]
        ids, lengths = self.flat[ranges(begin[rows], length[rows])], length[rows]
        self.clear()
        self._known(words, ids, lengths)

    def _rows(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """New rows of the id table; the number of the first."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(lengths) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.flat[self.used : self.used + len(ids)] = ids
        first, end = self.rows, self.rows + len(lengths)
        self.table[:, first:end] = self.used + starts_of(lengths), lengths, np.zeros(len(lengths), np.int64)
        self.used, self.rows = self.used + len(ids), end
        return first

    def _known(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = self._rows(ids, lengths)
        self.index.update(zip(words, range(first, first + len(words))))

    def _found(self, words: Sequence[str]) -> np.ndarray:
        """The rows of words, -1 for those not met."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def _modelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words of plain letters, straight from the model."""
        lines = codecs.charmap_decode("\n".join(words).encode(), "strict", self.letters)[0]
        return _flat([t.id for t in found] for found in map(self.model.tokenize, lines.split(self.letters[ord("\n")])))

    def _encoded(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.full.encode(text, add_special_tokens=False).ids for text in texts)

    def _learn(self, words: list[str]) -> None:
        """New words join the table: what stands before marks, and the marks, are encoded once and put together."""
        heads = [bare if bare[-1:] in _ENDS else word for word, bare in zip(words, [w.rstrip(MARKS) for w in words])]
        tails = [word[len(head) :] for word, head in zip(words, heads)]
        new = [part for part in dict.fromkeys([*heads, *dict.fromkeys(tails)]) if part not in self.index]
        plain = [_PLAIN.fullmatch(part) is not None for part in new]
        letters, others = list(compress(new, plain)), [part for part, known in zip(new, plain) if not known]
        if letters:
            self._known(letters, *self._modelled(letters))
        self._known(others, *self._encoded(others))
        marked = [k for k, tail in enumerate(tails) if tail]
        pairs = np.stack([self._found([part[k] for k in marked]) for part in (heads, tails)], axis=1)
        begin, length, _ = self.table[:, pairs.ravel()]
        self._known([words[k] for k in marked], self.flat[ranges(begin, length)], length.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text; a null text is empty."""
        if len(self.index) > WORDS_KEPT:
            self._shrink()
        if self.used > 16 * WORDS_KEPT:
            self.clear()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("")
        special = _special(column)
        whole = self._encoded(column.filter(pa.array(special)).to_pylist())
        if special.any():
            column = pc.if_else(pa.array(special), pa.scalar(SPECIAL, column.type), column)
        split = pc.ascii_split_whitespace(pc.ascii_lower(column))
        n_words = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.values.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        rows = self._found(words)
        new = np.flatnonzero(rows < 0)
        if len(new):
            unknown = [words[k] for k in new.tolist()]
            self._learn([word for word in unknown if word != SPECIAL])
            rows[new] = self._found(unknown)
        self.table[2, rows] += np.bincount(codes, minlength=len(words))
        places = rows[codes]
        if special.any():
            # Each is one word; the text as a whole is not kept for reuse.
            places[starts_of(n_words)[special]] = self._rows(*whole) + np.arange(special.sum())
        begin, lengths = self.table[0, places], self.table[1, places]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(n_words)]
        return self.flat[ranges(begin, lengths)], np.diff(ends, prepend=0)


def _flat(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and their lengths."""
    ids: list[int] = []
    lengths: list[int] = []
    for found in lists:
        ids += found
        lengths.append(len(found))
    return np.array(ids, np.uint32), np.array(lengths, np.int64)


def _special(column: pa.Array) -> np.ndarray:
    """Whether each text has to be encoded as a whole."""
    special = pc.match_substring(column, SPECIAL).to_numpy(zero_copy_only=False).copy()
    data = column.buffers()[2]
    if data is not None:
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        # Lead bytes from 0xCC on: characters from U+0300 on, where case and composition can interact.
        rare = np.flatnonzero(raw >= 0xCC)
        special[np.searchsorted(offsets, rare + offsets[0], "right") - 1] = True
    return special


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; tasks that run in it one after another share its word table."""
    # Functions travel by value, so a variable of this module would be new in every task.
    kept = sys.modules.setdefault("_plumbline_worker", types.ModuleType("_plumbline_worker")).__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` characters (or one longer text), so that memory stays bounded."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, the second column, have at most ``most`` bytes (or one longer text), so that memory stays bounded."""
    for batch in batches:
        before = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = size = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(before, size + most, "right")))
            yield batch.slice(begin, end - begin)
            begin, size = end, before[end - 1]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, local_start, n_tokens, input_ids)``: the ids of each whole text, then ``end_id``.

    ``local_start`` counts the ids of the rows before this one in the same partition. A null text is empty; its ids
    are the end id alone. Rows stay as they are, repeated or not; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer), 0
        for batch in text_slices(batches):
            ids, counts = encode.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
            counts = counts + 1
            starts = pa.array(before + starts_of(counts))
            before += len(ids)
            columns = [batch.column(0), starts, pa.array(counts), list_column(ids, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "local_start", "n_tokens", "input_ids"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = found.mapInArrow(run, f"k {kind}, local_start long, n_tokens long, input_ids array<int>")
    return found.select(F.col("k").alias(key), "local_start", "n_tokens", "input_ids")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    parts: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 1 << 18, encoding: str = "delta",
) -> None:
    """Write the ids of all documents to ``path`` in ascending key order, ties by text.

    Texts are range partitioned by key, so the numbers of the files follow document order. Rows are as from
    ``encode_documents``.
    Row groups and pages have the given sizes; the writer adds column and offset indexes, so a reader fetches only
    the pages of the documents or columns asked for. ``encoding`` is ``dictionary`` (short pages of bit-packed codes)
    or ``delta`` (format 2 pages, where ids are delta-packed).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    table = docs.select(F.col(key), F.col(text))
    count = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.repartitionByRange(count, F.col(key)).sortWithinPartitions(F.col(key), F.col(text))
    rows = encode_documents(ordered, tokenizer, end_id, key, text)
    (
        rows.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def _part() -> Column:
    """The number of the file's partition, which follows document order."""
    return F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long").alias("part")


def _with_start(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """``rows`` with ``start``: the ids of all documents before. Only one row per file enters the window and the broadcast."""
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "part", "local_start")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(key, n_tokens, start)`` of a written table; the ids themselves are not read."""
    meta = spark.read.parquet(path).drop("input_ids").select("*", _part())
    return _with_start(meta, meta)


def crc_of(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Unsigned CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def token_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` read back from the files of a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            crc = crc_of(ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["k", "part", "local_start", "n_tokens", "ids_crc32"])

    table = spark.read.parquet(path)
    kind = table.schema[key].dataType.simpleString()
    tokens = table.select(F.col(key).alias("k"), _part(), "local_start", "n_tokens", "input_ids")
    digests = tokens.mapInArrow(run, f"k {kind}, part long, local_start long, n_tokens long, ids_crc32 long")
    found = _with_start(digests, table.select("n_tokens", _part()))
    return found.select(F.col("k").alias(key), "start", "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of the given keys. The smallest and largest key reach the scan, whose statistics and page indexes skip the rest."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    table = spark.read.parquet(path)
    if low is None:
        return table.limit(0)
    return table.where(F.col(key).between(low, high)).join(keys.select(key).distinct(), key, "left_semi")


def encoded_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id") -> str:
    """Write ``docs`` as tokens below the shared folder; the path."""
    path = scratch_path(spark, "llm-tokens")
    write_tokens(docs, path, tokenizer, end_id, key)
    return path
