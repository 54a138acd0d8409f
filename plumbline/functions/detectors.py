"""Detectors of personal data and secrets, as native column expressions.

A detector turns a text column into a confidence between 0 and 1. The registry keeps registration order, which is
also the order that decides a cell's label: the last detector that fires names the entity.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_CONFIDENCE = 0.95
NAME_CONFIDENCE = 0.85
THRESHOLD = 0.4

# Column-name patterns (case ignored) and the entity each one stands for, first match wins.
NAME_PATTERNS = (
    (r"\bemail(_address)?\b", "EMAIL"),
    (r"\bphone(_number)?\b", "PHONE"),
    (r"\bssn\b|\bsocial_security", "US_SSN"),
    (r"\b(date_of_birth|dob|birthdate|birth_date)\b", "DOB"),
    (r"\b(first|last|full|given|family|middle)_name\b", "PERSON"),
    (r"\b(street|address|addr|city|zip|postcode|postal_code)\b", "ADDRESS"),
    (r"\b(passport|driver_license|drivers_license|license_number)\b", "ID_DOCUMENT"),
    (r"\b(credit_card|cc_number|card_number)\b", "CREDIT_CARD"),
    (r"\b(api_key|access_token|secret|password|pwd|api_secret)\b", "CREDENTIAL"),
    (r"\b(ip_address|ipv4|ipv6)\b", "IP"),
)

# The pattern bank (name, entity, pattern), in registration order.
VALUE_PATTERNS = (
    ("us_ssn", "US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone_e164", "PHONE", r"\+\d{8,15}\b"),
    ("phone_us", "PHONE", r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ipv4", "IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("aws_access_key", "CREDENTIAL", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_pat", "CREDENTIAL", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("stripe_key", "CREDENTIAL", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{24,}\b"),
    ("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
)
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"
# What every match of a pattern contains. Finding a literal is far cheaper than running the pattern, and
# one test for any digit spares texts without one all patterns that need digits.
LITERALS = {"us_ssn": "-", "email": "@", "phone_e164": "+", "aws_access_key": "AKIA", "github_pat": "_", "stripe_key": "_"}
NEED_DIGITS = ("us_ssn", "phone_e164", "phone_us", "ipv4", "iban", "credit_card")


@dataclass(frozen=True)
class Detector:
    """A named detector; ``score`` maps a text column to a confidence column.

    ``digits`` says that texts without a digit never fire; ``native`` that the score is a built-in expression.
    """

    name: str
    entity: str
    score: Callable[[Column], Column]
    kind: str = "custom"
    digits: bool = False
    native: bool = True

    def fires(self, value: Column, threshold: float = THRESHOLD) -> Column:
        return F.coalesce(self.score(value) >= F.lit(threshold), F.lit(False))


def card_numbers(value: Column) -> Column:
    """All card-shaped runs of a text that pass the Luhn check, as digits."""
    runs = F.regexp_extract_all(value, F.lit(CARD_PATTERN), F.lit(0))
    digits = F.transform(runs, lambda run: F.regexp_replace(run, r"\D", ""))
    return F.filter(digits, lambda d: F.call_function("luhn_check", d))


def _certain(hit: Column, confidence: float = VALUE_CONFIDENCE) -> Column:
    return F.when(hit, F.lit(confidence)).otherwise(F.lit(0.0))


def _card_score(value: Column) -> Column:
    # The plain pattern test spares most texts the extraction of runs.
    return _certain(value.rlike(CARD_PATTERN) & (F.size(card_numbers(value)) > 0))


def has_digit(value: Column) -> Column:
    """The text holds at least one digit."""
    return F.coalesce(value.rlike("[0-9]"), F.lit(False))


REGISTRY: dict[str, Detector] = {}


def register_detector(
    name: str,
    entity: str,
    pattern: str | None = None,
    expr: Callable[[Column], Column] | None = None,
    udf: Callable[[Column], Column] | None = None,
    kind: str = "custom",
    literal: str | None = None,
    digits: bool = False,
) -> Detector:
    """Add a detector: a regex, a regex plus a boolean expression, an expression, or a pandas UDF giving confidences.

    ``literal`` names a text that every match of the regex contains; ``digits`` says that every match has a digit.
    """
    if pattern is not None and literal is not None:
        return register_detector(name, entity, expr=lambda v: v.contains(literal) & v.rlike(pattern) & (expr(v) if expr else F.lit(True)),
                                 kind=kind, digits=digits)
    if udf is not None:
        score = udf
    elif pattern is not None and expr is not None:
        score = lambda value: _certain(value.rlike(pattern) & expr(value))
    elif pattern is not None:
        score = lambda value: _certain(value.rlike(pattern))
    elif expr is not None:
        score = lambda value: _certain(expr(value))
    else:
        raise ValueError("a detector needs a pattern, an expression or a UDF")
    REGISTRY[name] = Detector(name, entity, score, kind, digits, udf is None)
    return REGISTRY[name]


for _name, _entity, _pattern in VALUE_PATTERNS:
    register_detector(_name, _entity, pattern=_pattern, kind="regex", literal=LITERALS.get(_name), digits=_name in NEED_DIGITS)
REGISTRY["credit_card"] = Detector("credit_card", "CREDIT_CARD", _card_score, "regex", digits=True)


def select_detectors(names: Iterable[str]) -> tuple[bool, list[Detector]]:
    """(use the column-name heuristic, value detectors in order); ``regex`` stands for the whole pattern bank."""
    by_name, chosen = False, []
    for name in names:
        if name == "column_name":
            by_name = True
        elif name == "regex":
            chosen += [d for d in REGISTRY.values() if d.kind == "regex"]
        elif name in REGISTRY:
            chosen.append(REGISTRY[name])
        else:
            raise ValueError(f"unknown detector {name!r}")
    return by_name, chosen


def name_entity(column: str) -> str | None:
    """Entity a column name stands for, or None."""
    return next((entity for pattern, entity in NAME_PATTERNS if re.search(pattern, column, re.IGNORECASE)), None)
