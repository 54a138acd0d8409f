"""Masking strategies as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
)

# Strategies from lenient to strict; the stricter of two strategies wins.
STRICTNESS = {"allow": 0, "partial": 1, "synthetic": 2, "tokenize": 3, "hash": 4, "redact": 5, "never_leaves": 6}

# Replacement pools per entity.
POOLS = {
    "PERSON": ["Alex Rivers", "Sam Patel", "Jamie Chen", "Morgan Diaz", "Robin Park", "Casey Wu", "Drew Okonkwo", "Quinn Tanaka"],
    "EMAIL": [f"user{i}@example.com" for i in range(16)],
    "PHONE": [f"+15555550{i:03d}" for i in range(16)],
    "ADDRESS": ["1 Main St, Springfield", "42 Elm Ave, Riverside", "7 Oak Ln, Lakeview"],
    "DEFAULT": [f"VAL_{i:04d}" for i in range(64)],
}


def _salted(value: Column, salt: str | None) -> Column:
    if salt is None:
        raise ValueError("hash and tokenize need a salt")
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), value.cast("string")), 256)


def redact(value: Column, entity: str, **_) -> Column:
    """``[REDACTED:ENTITY]``."""
    return F.lit(f"[REDACTED:{entity}]")


def hashed(value: Column, entity: str, salt: str | None = None, **_) -> Column:
    """``[H:16 hex digits]``, stable per salt."""
    return F.concat(F.lit("[H:"), F.left(_salted(value, salt), F.lit(16)), F.lit("]"))


def tokenize(value: Column, entity: str, salt: str | None = None, width: int = 4, **_) -> Column:
    """``ENTITY_hex``; four digits collide above some hundred values, ``width`` widens the token."""
    return F.concat(F.lit(f"{entity}_"), F.left(_salted(value, salt), F.lit(width)))


def partial(value: Column, entity: str, **_) -> Column:
    """All but the last four characters starred; short values wholly."""
    text = value.cast("string")
    hidden = F.when(F.length(text) <= 4, F.length(text)).otherwise(F.length(text) - 4)
    return F.concat(F.repeat(F.lit("*"), hidden), F.when(F.length(text) <= 4, "").otherwise(F.right(text, F.lit(4))))


def synthetic(value: Column, entity: str, **_) -> Column:
    """A stable pick from the pool of the entity."""
    pool = POOLS.get(entity, POOLS["DEFAULT"])
    draw = F.conv(F.left(F.sha2(value.cast("string"), 256), F.lit(8)), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (F.pmod(draw, F.lit(len(pool))) + 1).cast("int"))


def never_leaves(value: Column, entity: str, kind: DataType | None = None, **_) -> Column:
    """Type and length only."""
    if kind is None or isinstance(kind, StringType):
        shown = F.concat(F.lit("<TEXT len="), F.length(value.cast("string")).cast("string"), F.lit(">"))
    elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        shown = F.lit("<int>")
    elif isinstance(kind, (FloatType, DoubleType)):
        shown = F.lit("<float>")
    elif isinstance(kind, BooleanType):
        shown = F.lit("<bool>")
    else:
        length = F.length(value.cast("string")).cast("string")
        shown = F.concat(F.lit(f"<{kind.typeName()} len="), length, F.lit(">"))
    return F.when(value.isNull(), F.lit("<NULL>")).otherwise(shown)


def allow(value: Column, entity: str, **_) -> Column:
    """Unchanged, as text."""
    return value.cast("string")


STRATEGIES: dict[str, Callable[..., Column]] = {
    "redact": redact,
    "hash": hashed,
    "tokenize": tokenize,
    "partial": partial,
    "synthetic": synthetic,
    "never_leaves": never_leaves,
    "allow": allow,
}


def register_strategy(name: str, make: Callable[..., Column], strictness: int) -> None:
    """Add a strategy: a function from (column, entity) to a text column, and its rank among the others."""
    STRATEGIES[name] = make
    STRICTNESS[name] = strictness


def stricter(first: str, second: str) -> str:
    """The stricter strategy, the first one on a tie."""
    return second if STRICTNESS[second] > STRICTNESS[first] else first


def mask_value(value: Column, entity: str, strategy: str, salt: str | None = None, kind: DataType | None = None, width: int = 4) -> Column:
    """Mask one column with one strategy; null stays null except under ``never_leaves``."""
    masked = STRATEGIES[strategy](value, entity, salt=salt, kind=kind, width=width)
    return masked if strategy == "never_leaves" else F.when(value.isNotNull(), masked)
