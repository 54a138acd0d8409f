"""Displayed numbers and the verdict on one displayed cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

_SUFFIXED = r"^([\d,.]+)\s*([kKmMbB])$"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[,$€£]", ""))


def is_suffixed(text: Column) -> Column:
    """The number is shown with a K, M or B suffix, so it has lost precision."""
    return F.regexp_replace(_bare(text), r"\s", "").rlike(_SUFFIXED)


def to_number(text: Column) -> Column:
    """Displayed number as a double: currency and separators dropped, K/M/B scaled, else null."""
    bare = _bare(text)
    base = F.regexp_extract(bare, _SUFFIXED, 1).try_cast("double")
    letter = F.lower(F.regexp_extract(bare, _SUFFIXED, 2))
    scale = F.when(letter == "k", 1e3).when(letter == "m", 1e6).otherwise(1e9)
    return F.when(bare.rlike(_SUFFIXED), base * scale).when(bare.rlike(_PLAIN), bare.try_cast("double"))


def compare(rendered: Column, truth: Column, truth_type: DataType, tolerance: float = 0.0) -> Column:
    """Severity of a displayed cell against the true value, null when they match."""
    shown = to_number(rendered)
    number = truth.cast("double") if isinstance(truth_type, NumericType) else to_number(truth.cast("string"))
    wrong = F.lit("exact_mismatch")
    far = F.abs(shown - number) / F.abs(number) > F.lit(float(tolerance))
    numeric = (
        F.when(is_suffixed(rendered), F.lit("rounded_truncation"))
        .when(number == 0, F.when(shown != 0, wrong))
        .when(far, wrong)
    )
    fold = lambda c: F.lower(F.trim(c.cast("string")))
    return (
        F.when(rendered.isNull() & truth.isNull(), F.lit(None))
        .when(rendered.isNull() | truth.isNull(), wrong)
        .when(shown.isNotNull() & number.isNotNull(), numeric)
        .when(fold(rendered) != fold(truth), F.lit("format_mismatch"))
    )
