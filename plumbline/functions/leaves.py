"""Texts and whole numbers inside a column of any type, so that nested and numeric cells can be scanned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, FractionalType, IntegralType, MapType, StringType, StructType, VariantType

from plumbline.functions.detectors import THRESHOLD, Detector

# Detectors whose patterns can match digits alone; only these are tried on numbers.
DIGITS_ALONE = ("phone_us", "credit_card")
_NONE = "array<string>"


def is_number(kind: DataType) -> bool:
    return isinstance(kind, (IntegralType, DecimalType, FractionalType))


def number_text(value: Column, kind: DataType) -> Column:
    """The digits of a whole number; null for one with a fraction."""
    if isinstance(kind, IntegralType):
        return value.cast("string")
    whole = value.try_cast("decimal(38,0)")
    return F.when(whole.cast("double") == value.cast("double"), whole.cast("string"))


def leaves(value: Column, kind: DataType, numbers: bool) -> Column | None:
    """All texts (or all whole numbers as texts) inside a cell, as an array; None if the type holds none."""
    none = F.array().cast(_NONE)
    if isinstance(kind, (StringType, BinaryType, VariantType)):
        return None if numbers else F.array(value.cast("string"))
    if is_number(kind):
        return F.array(number_text(value, kind)) if numbers else None
    if isinstance(kind, ArrayType):
        if leaves(value, kind.elementType, numbers) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x: F.coalesce(leaves(x, kind.elementType, numbers), none))), none)
    if isinstance(kind, StructType):
        found = [leaves(value[f.name], f.dataType, numbers) for f in kind.fields]
        found = [F.coalesce(x, none) for x in found if x is not None]
        return F.concat(*found) if found else None
    if isinstance(kind, MapType):
        found = [leaves(F.map_keys(value), ArrayType(kind.keyType), numbers), leaves(F.map_values(value), ArrayType(kind.valueType), numbers)]
        found = [F.coalesce(x, none) for x in found if x is not None]
        return F.concat(*found) if found else None
    return None


def on_numbers(detector: Detector) -> bool:
    """A custom detector is tried on numbers if it says that it needs digits."""
    return detector.name in DIGITS_ALONE or (detector.kind == "custom" and detector.digits)


def score(detector: Detector, value: Column, kind: DataType) -> Column | None:
    """The detector's highest confidence over the texts and numbers inside a cell; None if it has nothing to test."""
    if isinstance(kind, StringType):
        return detector.score(value)
    parts = [leaves(value, kind, False), leaves(value, kind, True) if on_numbers(detector) else None]
    if not detector.native:
        # A UDF cannot run inside an array; it sees all texts of the cell, one a line.
        known = [F.concat_ws("\n", x) for x in parts if x is not None]
        return detector.score(F.concat_ws("\n", *known)) if known else None
    scores = [F.array_max(F.transform(x, lambda t: F.coalesce(detector.score(t), F.lit(0.0)))) for x in parts if x is not None]
    if not scores:
        return None
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def fires(detector: Detector, value: Column, kind: DataType, threshold: float = THRESHOLD) -> Column | None:
    """Whether the detector reaches the threshold anywhere inside a cell; None if it has nothing to test."""
    found = score(detector, value, kind)
    return None if found is None else F.coalesce(found >= F.lit(threshold), F.lit(False))
