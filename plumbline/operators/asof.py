"""Reading a versioned table as of a time, and pinning one snapshot for several steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import quoted
from plumbline.session import remove_scratch, scratch_path


def as_of(
    df: DataFrame,
    keys: Sequence[str],
    ts_col: str,
    at: datetime | str,
    tie: Sequence[str] = (),
    delete_flag: str | None = None,
) -> DataFrame:
    """Latest version per key not later than ``at``; keys whose latest version is a delete are dropped.

    The latest version is an aggregate, combined on the map side, so a key with very many versions stays cheap.
    ``tie`` orders versions of the same instant.
    """
    limit = F.lit(str(at)).cast(df.schema[ts_col].dataType)
    newest = F.struct(quoted(ts_col), *[quoted(t) for t in tie])
    rest = [c for c in df.columns if c not in keys]
    latest = (
        df.where(quoted(ts_col) <= limit)
        .groupBy(*[quoted(k) for k in keys])
        .agg(F.max_by(F.struct(*[quoted(c) for c in rest]), newest).alias("__v"))
    )
    columns = [quoted(c) if c in keys else F.col("__v")[c].alias(c) for c in df.columns]
    rows = latest.select(*columns)
    return rows.where(~F.coalesce(quoted(delete_flag), F.lit(False))) if delete_flag else rows


@dataclass(frozen=True)
class Snapshot:
    """A materialised table and the time it was taken."""

    df: DataFrame
    snapshot_ts: datetime


@contextmanager
def pinned(df: DataFrame) -> Iterator[Snapshot]:
    """The rows of ``df`` written once as a table in the shared folder; every step inside reads the same copy.

    The copy is columnar, so steps still read only the columns and row groups they need. It is removed at the end, so
    a result that outlives the block must be written inside it.
    """
    taken = datetime.now(timezone.utc)
    path = scratch_path(df.sparkSession, "snapshot")
    try:
        df.write.parquet(path)
        yield Snapshot(df.sparkSession.read.schema(df.schema).parquet(path), taken)
    finally:
        remove_scratch(df.sparkSession, path)
