"""Shell-style patterns as column conditions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob: ``*``, ``?`` and ``[...]`` (``[!...]`` negates)."""
    out, i = "", 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out += ".*"
        elif char == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.escape(char)
        i += 1
    return f"(?s)^{out}$"


def matches_any(value: Column, globs: Sequence[str]) -> Column:
    """True when ``value`` matches one of the globs."""
    if "*" in globs:
        return F.lit(True)
    exact = [g for g in globs if not any(c in g for c in "*?[")]
    condition = value.isin(exact) if exact else F.lit(False)
    for glob in globs:
        if glob not in exact:
            condition = condition | value.rlike(glob_pattern(glob))
    return condition
