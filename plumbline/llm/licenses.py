"""License scans: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small, texts_of

#: Words of a phrase and its label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known short notices as lower-case words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "creative commons attribution": "cc-by",
    "free and unencumbered software released into the public domain": "unlicense",
    "unauthorized copying of this file is strictly prohibited": "proprietary",
}
#: Every byte that is no part of a word becomes a space: words are digits, a-z and bytes from 0x80 on.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal_words(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` parts of the notice with their offsets; any match within ``errors`` edits holds one of them as it is."""
    n, parts = len(notice), errors + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class NoticeSearch:
    """Finds notices within one edit for every ``per_error`` characters of a notice."""

    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    per_error: int = 12

    def __post_init__(self) -> None:
        import ahocorasick
        import regex

        self.listed = list(self.notices)
        self.errors = [max(1, len(n) // self.per_error) for n in self.listed]
        sought = [f"(?<= )(?:{regex.escape(n, special_only=True)}){{e<={e}}}(?= )" for n, e in zip(self.listed, self.errors, strict=True)]
        self.patterns = [(regex.compile(s), regex.compile(f"(?b){s}")) for s in sought]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.listed):
            for offset, part in seeds(notice, self.errors[k]):
                found.setdefault(part, []).append((k, offset))
        self.machine = ahocorasick.Automaton()
        for part, places in found.items():
            self.machine.add_word(part, (len(part), places))
        self.machine.make_automaton()

    def search(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in a line of words with a space on either side; the fewest edits win where matches overlap.

        Seeds close to one another share one window, so a text full of seeds is still verified once.
        """
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.machine.iter(line):
            begin = last + 1 - length
            for k, offset in places:
                slack = self.errors[k] + 1
                low, high = max(0, begin - offset - slack), begin - offset + len(self.listed[k]) + slack
                held = windows.setdefault(k, [])
                if held and low <= held[-1][1]:
                    held[-1] = (min(low, held[-1][0]), max(high, held[-1][1]))
                else:
                    held.append((low, high))
        found = []
        for k, spans in windows.items():
            for low, high in spans:
                for m in self._matches(k, line, low, min(len(line), high)):
                    found.append((sum(m.fuzzy_counts), -(m.end() - m.start()), m.start(), m.end(), k))
        kept: list[tuple[int, int, int, int]] = []
        ends: list[tuple[int, int]] = []
        for edits, _, start, end, k in sorted(found):
            if all(end <= a or start >= b for a, b in ends):
                ends.append((start, end))
                kept.append((start, end, k, edits))
        return sorted(kept)

    def _matches(self, k: int, line: str, low: int, high: int) -> Iterator:
        """Matches of a notice from left to right: each one found is put into its best place, and the search goes on behind it."""
        some, best = self.patterns[k]
        slack = self.errors[k] + 1
        while m := some.search(line, low, high):
            near = best.search(line, max(low, m.start() - slack), min(high, m.end() + slack)) or m
            yield near
            low = max(near.end(), low + 1)


def phrase_places(line: str) -> list[tuple[int, str]]:
    """(character offset, label) of every place where a phrase's words stand together; places may overlap."""
    found = []
    for phrase, label in PHRASES.items():
        sought, at = f" {phrase} ", -1
        while (at := line.find(sought, at + 1)) >= 0:
            found.append((at, label))
    return sorted(found)


def words_before(line: str, offsets: list[int]) -> list[int]:
    """How many words begin before each of the ascending offsets of spaces."""
    counts, at, n = [], 0, 0
    for offset in offsets:
        n += line.count(" ", at, offset)
        at = offset
        counts.append(n)
    return counts


MATCH = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None, per_error: int = 12) -> DataFrame:
    """``(key, n_words, base, notices, score)`` of every row.

    ``base`` lists the exact phrases and ``notices`` the notices within their bounded number of edits, both with the
    first and last word (from 0) and the edits. Notices are searched in the words joined by single spaces: seeds from
    the pigeonhole split locate candidates, the regex library verifies them with bounded errors. ``score`` is 1 for an
    exact phrase, else the share of a notice's characters left as they are, at best; 0 without a match. A null or empty
    text has no words and no match; repeated rows each get a row. Texts are read whole, one at a time.
    """
    sought = dict(notices or NOTICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeSearch(sought, per_error)
        for batch in small(batches):
            out: list[dict] = []
            for text_ in texts_of(batch.column(1)):
                words = normal_words(text_)
                line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " "
                base, near = phrase_places(line), finder.search(line)
                first = words_before(line, [p for p, _ in base])
                exact = [{"label": label, "first_word": w, "last_word": w + line.count(" ", p, 1 + p + _length(label)) - 1, "edits": 0} for w, (p, label) in zip(first, base, strict=True)]
                begin = words_before(line, [s for s, _, _, _ in near])
                fuzzy = [
                    {"label": sought[finder.listed[k]], "first_word": w - 1, "last_word": w - 1 + line.count(" ", s, e), "edits": edits}
                    for w, (s, e, k, edits) in zip(begin, near, strict=True)
                ]
                sure = max([1 - edits / len(finder.listed[k]) for _, _, k, edits in near], default=0.0)
                out.append({"n_words": len(words), "base": exact, "notices": fuzzy, "score": 1.0 if exact else max(0.0, sure)})
            columns = pa.Table.from_pylist(out, _KIND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[columns.column(c).combine_chunks() for c in range(4)]], ["k", "n_words", "base", "notices", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(run, f"k {kind}, n_words long, base {MATCH}, notices {MATCH}, score double")
    return found.select(F.col("k").alias(key), "n_words", "base", "notices", "score")


def _length(label: str) -> int:
    return next(len(p) for p, x in PHRASES.items() if x == label)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
_KIND = pa.schema([("n_words", pa.int64()), ("base", _SPANS), ("notices", _SPANS), ("score", pa.float64())])
