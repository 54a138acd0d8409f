"""Audit records: building, hash chaining, verifying, querying and rolling up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.profile import quoted
from plumbline.operators.replay import keyed_chunks, replay, settle, summarise
from plumbline.session import cut_lineage, written

# Fixed value: what stands for the record before the first one.
GENESIS = "sha256:0" * 8
SAMPLE_ROWS = 3
SLICE_ROWS = 65_536


def audit_records(calls: DataFrame, findings: DataFrame, results: DataFrame, order_by: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One record per call, with the first ``sample_rows`` masked rows of its result.

    ``calls`` has ``call_id, ts, assistant_id, assistant_session, tool, connection, sql, policy_verdict, rows, columns,
    bytes_returned, latency_ms``; ``findings`` has ``call_id, entity_type``; ``results`` holds the masked rows with
    their ``call_id``, ordered by ``order_by``.
    """
    counts = findings.groupBy("call_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    # One entry per entity type, so the list is as short as the detector bank.
    summary = counts.groupBy("call_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("pii_summary")
    )
    first = Window.partitionBy("call_id").orderBy(*[quoted(c) for c in order_by])
    row = F.struct(*[quoted(c) for c in results.columns if c != "call_id"])
    # The rank filter is pushed below the shuffle: a call with very many rows sends no more than its sample.
    sample = (
        results.withColumn("__n", F.row_number().over(first))
        .where(F.col("__n") <= sample_rows)
        .groupBy("call_id")
        .agg(F.sort_array(F.collect_list(F.struct("__n", row.alias("row")))).alias("s"))
        .select("call_id", F.transform("s", lambda x: F.to_json(x["row"])).alias("sample_masked"))
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return (
        calls.join(summary, "call_id", "left")
        .join(sample, "call_id", "left")
        .select(
            "call_id", "ts", "assistant_id", "assistant_session", "tool", "connection",
            F.concat(F.lit("sha256:"), F.sha2("sql", 256)).alias("sql_hash"),
            "policy_verdict",
            F.coalesce("pii_summary", empty).alias("pii_summary"),
            "rows",
            (F.col("rows") * F.col("columns")).alias("cells"),
            "bytes_returned", "latency_ms",
            F.coalesce("sample_masked", F.array().cast("array<string>")).alias("sample_masked"),
        )
    )


# Made once: json.dumps makes an encoder for every record.
_ENCODER = json.JSONEncoder(separators=(",", ":"), sort_keys=True)


def _canonical(record: dict) -> bytes:
    return _ENCODER.encode(record).encode()


def _digest(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def _members(record: dict) -> str:
    return _ENCODER.encode(record)[1:-1] if record else ""


def _pieces(bodies: pd.Series) -> pd.DataFrame:
    """The canonical JSON of each record around its two hashes: what stands before the previous one, between them, and behind."""
    rows = []
    for body in bodies:
        record = json.loads(body)
        record.pop("record_hash", None)
        record.pop("prev_record_hash", None)
        before = _members({k: v for k, v in record.items() if k < "prev_record_hash"})
        between = _members({k: v for k, v in record.items() if "prev_record_hash" < k < "record_hash"})
        behind = _members({k: v for k, v in record.items() if k > "record_hash"})
        rows.append((
            "{" + (before + "," if before else "") + '"prev_record_hash":"', '"' + ("," + between if between else ""), ("," + behind if behind else "") + "}"
        ))
    return pd.DataFrame(rows, columns=["__head", "__middle", "__end"])


PIECES = ["__head", "__middle", "__end"]


def _link(previous: str, head: str, middle: str, end: str) -> tuple[str, tuple]:
    digest = _digest(f"{head}{previous}{middle}{end}".encode())
    return digest, (previous, digest, f'{head}{previous}{middle},"record_hash":"{digest}"{end}')


def chain(records: DataFrame, chain_key: Sequence[str], order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Link records into one hash chain per ``chain_key``: adds ``prev_record_hash``, ``record_hash`` and the JSON ``record``.

    A record's hash covers the canonical JSON of all its other fields, the previous hash included. That makes a chain
    sequential by definition: its chunks run in turn, in bounded memory, while different chains run side by side.
    Canonical JSON is made before, all chunks at once; what runs in turn only puts texts together and hashes them.
    ``order_by`` must end in a unique column.
    """
    pieces = F.pandas_udf(_pieces, ", ".join(f"{p} string" for p in PIECES))

    def prepare(rows: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(*[quoted(c) for c in records.columns]))
        return rows.withColumn("__pieces", pieces(body)).select("*", "__pieces.*").drop("__pieces")

    chunks = keyed_chunks(records, chain_key, order_by, partitions, prepare)
    starts = settle(chunks, PIECES, partial(summarise, advance=_link), GENESIS, speculate=False)
    outputs = "prev_record_hash string, record_hash string, record string"
    return replay(chunks, PIECES, outputs, _link, GENESIS, starts).drop(*PIECES)


def segmented_chain(
    records: DataFrame, chain_key: Sequence[str], order_by: Sequence[str], segment: str, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, seals) of chains that are cut into segments: the form for long logs.

    ``segment`` is a column of whole numbers that grow along a chain, as an hour or a file number. Every segment is a
    chain of its own that begins anew, so segments are linked side by side and the number of jobs does not grow with
    the log. One seal per segment holds its rows and its last hash, and the seals, far fewer, are chained per key:
    a segment changed, cut short, left out or moved breaks its seal or the chain of seals.
    """
    # Written once: seals and every check read it, and none of them links the records anew.
    linked = written(chain(records, [*chain_key, segment], order_by, partitions), "linked")
    last = F.max_by("record_hash", F.struct(*[quoted(c) for c in order_by]))
    seals = linked.groupBy(*[quoted(k) for k in chain_key], quoted(segment)).agg(
        F.count(F.lit(1)).alias("sealed_rows"), last.alias("sealed_hash")
    )
    return linked, chain(seals, chain_key, [segment])


def verify_segments(
    records: DataFrame, seals: DataFrame, chain_key: Sequence[str], segment: str, seq: str, record_col: str = "record"
) -> DataFrame:
    """One row per chain: validity, segments, records, and the first broken segment with its error.

    Hashes and links inside the segments, the chain of the seals, and each segment against its seal are all checked.
    """
    keys = [quoted(k) for k in chain_key]
    inside = verify_chain(records, [*chain_key, segment], seq, record_col)
    found = records.groupBy(*keys, quoted(segment)).agg(
        F.count(F.lit(1)).alias("__rows"), F.max_by(F.get_json_object(quoted(record_col), "$.record_hash"), quoted(seq)).alias("__last")
    )
    seal = F.from_json("record", "sealed_rows bigint, sealed_hash string")
    sealed = seals.select(*keys, quoted(segment), seal["sealed_rows"].alias("__sealed_rows"), seal["sealed_hash"].alias("__sealed_hash"))
    both = found.join(sealed, [*chain_key, segment], "full_outer").join(inside, [*chain_key, segment], "left")
    error = (
        F.when(F.col("__sealed_rows").isNull(), "no seal")
        .when(F.col("__rows").isNull(), "segment missing")
        .when(~F.col("valid"), F.col("first_error"))
        .when((F.col("__rows") != F.col("__sealed_rows")) | ~F.col("__last").eqNullSafe(F.col("__sealed_hash")), "seal mismatch")
    )
    first = F.min(F.when(error.isNotNull(), F.struct(quoted(segment).alias("at"), error.alias("error"))))
    per_chain = both.groupBy(*keys).agg(
        F.count("__rows").alias("segments"), F.coalesce(F.sum("__rows"), F.lit(0)).alias("records_seen"), first.alias("__bad")
    )
    links = verify_chain(seals, chain_key, segment).select(*keys, F.col("valid").alias("__linked"), F.col("first_error").alias("__seal_error"))
    text = F.concat(F.lit("segment "), F.col("__bad.at").cast("string"), F.lit(": "), F.col("__bad.error"))
    return per_chain.join(links, list(chain_key), "left").select(
        *keys, (F.col("__bad").isNull() & F.coalesce("__linked", F.lit(False))).alias("valid"), "segments", "records_seen",
        F.coalesce(text, F.concat(F.lit("seals, "), F.col("__seal_error"))).alias("first_error"),
    )


def _rehash(records: pd.Series) -> pd.Series:
    """Hash of each JSON record without its own hash; None where the text is not a JSON object."""
    hashes = []
    for text in records:
        try:
            record = json.loads(text)
            record.pop("record_hash", None)
            hashes.append(_digest(_canonical(record)))
        except (ValueError, TypeError, AttributeError):
            hashes.append(None)
    return pd.Series(hashes, dtype=object)


def _as_written(record: Column, stated: Column) -> Column:
    """Hash of the text without the member that states its hash, whether that member stands first or behind another."""
    member = F.concat(F.lit('"record_hash":"'), stated, F.lit('"'))
    behind = F.replace(record, F.concat(F.lit(","), member), F.lit(""))
    rest = F.replace(behind, F.concat(F.lit("{"), member, F.lit(",")), F.lit("{"))
    return F.concat(F.lit("sha256:"), F.sha2(rest, 256))


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__computed`` for ``__record``, which goes.

    Records as ``chain`` writes them are canonical already, so the hash of their text is compared first, as an expression. Only
    records whose text has another hash than they state are parsed and brought into canonical form, in Python.
    """
    same = F.coalesce(_as_written(F.col("__record"), F.col("__stated")) == F.col("__stated"), F.lit(False))
    checked = cut_lineage(rows.withColumn("__record", F.when(~same, F.coalesce("__record", F.lit("")))))
    sound = checked.where("__record IS NULL").withColumn("__computed", F.col("__stated")).drop("__record")
    differing = checked.where("__record IS NOT NULL")
    if differing.isEmpty():
        return sound
    return sound.unionByName(differing.withColumn("__computed", F.pandas_udf(_rehash, "string")("__record")).drop("__record"))


def _verified(records: DataFrame, chain_key: Sequence[str], slice_: Column, seq: str, record_col: str) -> DataFrame:
    """Per chain: validity, records seen and the first error.

    Links are compared inside slices, and at the seams from one row per slice, so no chain is gathered in one task.
    """
    keys = [quoted(k) for k in chain_key]
    names = [f"__k{i}" for i in range(len(keys))]
    record = quoted(record_col)
    rows = _hashed(records.select(
        *[k.alias(n) for k, n in zip(keys, names, strict=True)],
        slice_.alias("__slice"), quoted(seq).alias("__seq"),
        F.get_json_object(record, "$.prev_record_hash").alias("__prev"),
        F.get_json_object(record, "$.record_hash").alias("__stated"),
        record.alias("__record"),
    ))
    inside = Window.partitionBy(*names, "__slice").orderBy("__seq")
    linked = rows.withColumn("__n", F.row_number().over(inside)).withColumn("__before", F.lag("__stated").over(inside))
    # From the plain rows: this branch does not need the windows.
    seams = rows.groupBy(*names, "__slice").agg(
        F.count(F.lit(1)).alias("__rows"), F.max_by("__stated", "__seq").alias("__last")
    )
    across = Window.partitionBy(*names).orderBy("__slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    seams = seams.select(
        *[F.col(n).alias(f"{n}s") for n in names], F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
        F.coalesce(F.lag("__last").over(across), F.lit(GENESIS)).alias("__carried"),
    )
    same = F.col("__slice").eqNullSafe(F.col("__s"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    joined = linked.join(seams, same)
    expected = F.when(F.col("__n") == 1, F.col("__carried")).otherwise(F.col("__before"))
    place = F.col("__n") + F.col("__offset")
    error = (
        F.when(F.col("__computed").isNull(), "invalid JSON")
        .when(~F.col("__prev").eqNullSafe(expected), "prev_hash mismatch")
        .when(~F.col("__stated").eqNullSafe(F.col("__computed")), "record_hash mismatch")
    )
    first = F.min(F.when(error.isNotNull(), F.struct(place.alias("n"), error.alias("error"))))
    found = joined.groupBy(*names).agg(F.count(F.lit(1)).alias("total"), first.alias("bad"))
    return found.select(
        *[F.col(n).alias(k) for n, k in zip(names, chain_key, strict=True)],
        F.col("bad").isNull().alias("valid"),
        F.coalesce(F.col("bad.n"), F.col("total")).cast("bigint").alias("records_seen"),
        F.when(F.col("bad").isNotNull(), F.concat(F.lit("record "), F.col("bad.n").cast("string"), F.lit(": "), F.col("bad.error"))).alias("first_error"),
    )


def verify_chain(
    records: DataFrame, chain_key: Sequence[str], seq: str, record_col: str = "record", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Check every link and every hash of each chain; ``seq`` is a numeric position that grows along the chain.

    A record's hash is right if its text without the hash has it, or the canonical JSON of its other fields.
    """
    return _verified(records, chain_key, F.floor(quoted(seq) / F.lit(slice_rows)), seq, record_col)


def verify_rotated(
    records: DataFrame, file_order: str, seq: str, chain_key: Sequence[str] = (), record_col: str = "record"
) -> DataFrame:
    """Check a log rotated over files: the first record of a file must continue the last record of the file before."""
    if not chain_key:
        records, chain_key = records.withColumn("log", F.lit("log")), ["log"]
    return _verified(records, chain_key, quoted(file_order), seq, record_col)


def audit_query(records: DataFrame, limit: int | None, since: datetime | str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Records from the newest on, ``limit`` of them or all, optionally not older than ``since``."""
    if since is not None:
        records = records.where(F.col("ts") >= F.lit(str(since)).cast("timestamp"))
    ordered = records.orderBy(F.col("ts").desc(), *[quoted(t).desc() for t in tie])
    return ordered if limit is None else ordered.limit(limit)


def audit_rollup(records: DataFrame, by: Sequence[str], with_totals: bool = False) -> DataFrame:
    """Calls, verdicts and findings per entity for each group; ``with_totals`` adds the subtotals of a rollup.

    Reads ``policy_verdict.verdict``, ``rows`` and ``pii_summary``.
    """
    verdict = F.col("policy_verdict.verdict")
    columns = [quoted(b) for b in by]
    grouped = records.rollup(*columns) if with_totals else records.groupBy(*columns)
    return grouped.agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.count_if(verdict == v).alias(v) for v in ("permit", "deny", "consent_required")],
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.aggregate(F.map_values("pii_summary"), F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("pii_findings"),
    )


def audit_entities(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Findings per group and entity type."""
    columns = [quoted(b) for b in by]
    flat = records.select(*columns, F.explode("pii_summary").alias("entity_type", "n"))
    return flat.groupBy(*columns, "entity_type").agg(F.sum("n").alias("findings"))
