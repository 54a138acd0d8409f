"""Finding personal data and secrets in whole tables, and guarding and scrubbing free text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.detectors import (
    NAME_CONFIDENCE,
    THRESHOLD,
    VALUE_PATTERNS,
    card_numbers,
    has_digit,
    name_entity,
    select_detectors,
)
from plumbline.functions.leaves import score
from plumbline.operators.profile import quoted

DEFAULT_DETECTORS = ("column_name", "regex")

# Limits of the free-text guard.
MAX_BODY_BYTES = 16 * 1024
MAX_EMAILS = 5
MAX_PHONES = 5
MAX_CARDS = 3

# Credential shapes in messages and their replacements.
SECRET_SHAPES = (
    (r"(?i)password=[^ ;,)]+", "password=***"),
    (r"(?i)token=[^ ;,)]+", "token=***"),
    (r"//[^:/@\s]+:[^/@\s]+@", "//***:***@"),
)


def column_name_findings(df: DataFrame) -> DataFrame:
    """Columns whose name alone marks them; schema only, no data is read."""
    rows = [(c, name_entity(c), NAME_CONFIDENCE) for c in df.columns if name_entity(c)]
    return df.sparkSession.createDataFrame(rows, "column string, entity_type string, confidence double")


def scanned_columns(df: DataFrame, cols: Sequence[str] | None, scan_types: str = "all") -> list[str]:
    """Columns whose values are scanned: all of them, or the text columns only."""
    if scan_types not in ("all", "text"):
        raise ValueError("scan_types is 'all' or 'text'")
    if cols is not None:
        return list(cols)
    return [f.name for f in df.schema.fields if scan_types == "all" or isinstance(f.dataType, StringType)]


def scan(
    df: DataFrame,
    row_key: Sequence[str],
    detectors: Sequence[str] = DEFAULT_DETECTORS,
    threshold: float = THRESHOLD,
    cols: Sequence[str] | None = None,
    scan_types: str = "all",
) -> DataFrame:
    """Findings ``(row key, column, detector, entity_type, confidence)`` of the whole table.

    Cells of every type are scanned: texts inside arrays, structs, maps and binaries like any text, whole numbers by
    the detectors that need nothing but digits. ``scan_types="text"`` leaves all but text columns out.

    A marked column name is a finding on every row, null cells included; values are findings where a detector
    reaches the threshold. One projection and one explode, no shuffle.
    """
    keys = [quoted(k) for k in row_key]
    findings = findings_of(df, detectors, threshold, cols, scan_types)
    return df.select(*keys, F.explode(findings).alias("f")).select(*keys, "f.*")


def findings_of(
    df: DataFrame, detectors: Sequence[str] = DEFAULT_DETECTORS, threshold: float = THRESHOLD, cols: Sequence[str] | None = None, scan_types: str = "all"
) -> Column:
    """All findings of a row, as an array of (column, detector, entity_type, confidence)."""
    by_name, chosen = select_detectors(detectors)
    found: list[Column] = []

    def finding(column: str, detector: str, entity: str, confidence: Column) -> Column:
        return F.struct(
            F.lit(column).alias("column"), F.lit(detector).alias("detector"),
            F.lit(entity).alias("entity_type"), confidence.alias("confidence"),
        )

    names = df.columns if cols is None else cols
    if by_name and threshold <= NAME_CONFIDENCE:
        found += [finding(c, "column_name", name_entity(c), F.lit(NAME_CONFIDENCE)) for c in names if name_entity(c)]
    groups = [F.array(*found)] if found else []
    for column in scanned_columns(df, cols, scan_types):
        value, kind = quoted(column), df.schema[column].dataType
        scores = [(d, score(d, value, kind)) for d in chosen]
        hits = [(d, F.when(x >= F.lit(threshold), finding(column, d.name, d.entity, x))) for d, x in scores if x is not None]
        plain = [hit for d, hit in hits if not d.digits]
        numeric = [hit for d, hit in hits if d.digits]
        groups += [F.array(*plain)] if plain else []
        if numeric:
            groups += [F.when(has_digit(value), F.array(*numeric)) if isinstance(kind, StringType) else F.array(*numeric)]
    none = F.array().cast("array<struct<column:string,detector:string,entity_type:string,confidence:double>>")
    if not groups:
        return none
    some = F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull()))
    return F.coalesce(F.filter(some, lambda f: f.isNotNull()), none)


def pii_summary(df: DataFrame, row_key: Sequence[str], sample: int | None = None, **scan_options) -> DataFrame:
    """Findings per entity over the whole table, or over the first ``sample`` rows in key order."""
    if sample is not None:
        df = df.orderBy(*[quoted(k) for k in row_key]).limit(sample)
    findings = scan(df, row_key, **scan_options)
    return findings.groupBy("entity_type").agg(F.count(F.lit(1)).alias("findings"))


def content_guard(
    df: DataFrame, text_col: str, max_bytes: int = MAX_BODY_BYTES, max_emails: int = MAX_EMAILS, max_phones: int = MAX_PHONES, max_cards: int = MAX_CARDS
) -> DataFrame:
    """Adds ``accepted`` and ``reason``: text that looks like pasted data is refused, the first broken rule named.

    The defaults are the limits of the rule set.
    """
    text = F.col(text_col)
    patterns = {name: pattern for name, _, pattern in VALUE_PATTERNS}
    emails = F.regexp_count(text, F.lit(patterns["email"]))
    phones = F.regexp_count(text, F.lit(patterns["phone_us"]))
    reason = (
        F.when(F.octet_length(text) > max_bytes, "body too large")
        .when(text.contains("@") & (emails >= max_emails), "email addresses")
        .when(~has_digit(text), F.lit(None))
        .when(phones >= max_phones, "phone numbers")
        .when(F.size(card_numbers(text)) >= max_cards, "card numbers")
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def scrub(df: DataFrame, cols: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Replace known secret values and credential shapes in the named columns."""
    known = sorted({v for v in values if v}, key=len, reverse=True)
    for column in cols:
        text = quoted(column)
        if known:
            text = F.regexp_replace(text, "|".join(re.escape(v) for v in known), "[REDACTED:CREDENTIAL]")
        for pattern, replacement in SECRET_SHAPES:
            text = F.regexp_replace(text, pattern, replacement)
        df = df.withColumn(column, text)
    return df
