"""Text tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented(ranges: Iterable[range]) -> dict[str, str]:
    """Small letter with a diacritic -> its base letter, for the letters of some Unicode ranges."""
    letters = {}
    for points in ranges:
        for point in points:
            parts = unicodedata.normalize("NFD", chr(point).lower())
            if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]) and parts[0].isalpha():
                letters[chr(point).lower()] = parts[0]
    return {letter: base for letter, base in letters.items() if len(letter) == 1}


# Latin-1, Latin Extended-A and -B, Latin Extended Additional.
ACCENTED = _accented([range(0xC0, 0x250), range(0x1E00, 0x1F00)])


def folded(text: Column) -> Column:
    """Text in lower case, Latin letters without their diacritics."""
    lower = F.lower(text)
    # Text without a diacritic by its length alone is not looked at letter by letter.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, lower).otherwise(F.translate(lower, "".join(ACCENTED), "".join(ACCENTED.values())))


def terms(text: Column) -> Column:
    """Distinct folded runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(folded(text), r"[^\p{L}\p{N}]+")), "")
