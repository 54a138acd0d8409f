"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import remove_scratch, scratch_path

#: A word: a run of characters other than ASCII white space (a pattern for Java's engine).
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    A lambda variable holds the value, so no optimizer rule can copy the expression into a loop.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again; survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, removed one by one when the next table is written."""

    def __init__(self) -> None:
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialise``."""
        path = scratch_path(df.sparkSession, f"llm-{name}")
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table, path in self.paths:
            if any(table is t for t in tables):
                remove_scratch(table.sparkSession, path)
        self.paths = [(table, path) for table, path in self.paths if not any(table is t for t in tables)]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values end to end and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run begins when runs of these lengths stand end to end."""
    return np.cumsum(counts) - counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of every run, end to end."""
    total = int(counts.sum())
    return np.repeat(starts - starts_of(counts), counts) + np.arange(total)
