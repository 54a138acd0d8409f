"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, materialise

#: Kinds in the order in which spans of one start are listed; pattern, group tested, least length.
PATTERNS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
}
KINDS = (*PATTERNS, "markov")
#: The characters of the models, and what is tested: runs of them of at least so many characters.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]"
SPAN = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points; ``value`` is the group, ``least`` its length.

    The pieces between matches and the matches themselves alternate, so positions are running lengths.
    """
    matches = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda w, v: F.struct(w.alias("w"), v.alias("v")),
    )
    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m["w"].alias("w"), m["v"].alias("v")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["w"])
        span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"))
        found = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), F.coalesce(found, acc["out"]).alias("out"))

    none = F.array().cast(SPAN)
    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(none)


def base_spans(text: Column) -> Column:
    """(start, order of the kind, end, value) of every match of the fixed patterns."""

    def found(kind: int, pattern: str, group: int, least: int) -> Column:
        spans = spans_of(text, pattern, group, least)
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    kinds = [found(k, *given) for k, given in enumerate(PATTERNS.values())]
    return F.concat(*kinds)


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of each pair of symbols, in thousandths, row by row of ``SYMBOLS``."""

    ratios: tuple[int, ...]


def _codes(token: Column) -> Column:
    return F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c))


def _pairs(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of symbols stands together: at most ``len(SYMBOLS) ** 2`` rows."""
    coded = tokens.select(_codes(F.col("token")).alias("c"))
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = coded.where(F.size("c") > 1).select(F.explode(pairs).alias("p")).where("p.a > 0 AND p.b > 0").groupBy("p.a", "p.b").count()
    return {(r["a"], r["b"]): r["count"] for r in counted.collect()}


def _chances(pairs: dict[tuple[int, int], int], uniform: float) -> list[float]:
    """P(b | a), counts with one added to each, mixed with a uniform share for pairs never met."""
    n = len(SYMBOLS)
    totals = [sum(pairs.get((a, b), 0) for b in range(1, n + 1)) for a in range(1, n + 1)]
    return [(1 - uniform) * (pairs.get((a, b), 0) + 1) / (totals[a - 1] + n) + uniform / n for a in range(1, n + 1) for b in range(1, n + 1)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 1_000, shortest: int = 6) -> MarkovModels:
    """Models from labelled samples: values of the fixed patterns are random, other runs of ``shortest`` symbols ordinary.

    Each label is fitted on the ``sample`` rows with the smallest hash of their key (those with a match for the random
    strings; all for the ordinary ones), so the bound holds at any size and reruns agree. Without any rows both models
    are flat and no ratio is above zero. Every row is then scored.
    """
    rows = docs.select(F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def bounded(df: DataFrame) -> DataFrame:
        last = df.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        return df.where(F.col("h") <= F.lit(last or ""))

    matched = rows.where(_any_pattern(F.col("t"))).select("h", base_spans(F.col("t"))["value"].alias("tokens")).where(F.size("tokens") > 0)
    random = bounded(materialise(matched, "matched")).select(F.explode("tokens").alias("token"))
    rest = F.col("t")
    for pattern, _, _ in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = bounded(rows).select(F.explode(F.regexp_extract_all(rest, F.lit(f"{RUN}{{{shortest},}}+"), F.lit(0))).alias("token"))
    likely, usual = _chances(_pairs(random), 0.5), _chances(_pairs(ordinary), 0.02)
    return MarkovModels(tuple(round(1000 * math.log(p / q)) for p, q in zip(likely, usual, strict=True)))


def _any_pattern(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _, _ in PATTERNS.values():
        found = found | text.rlike(pattern)
    return found


def ratio(token: Column, table: Column) -> Column:
    """Sum of the log-likelihood ratios of a token's pairs, in thousandths."""
    n = len(SYMBOLS)

    def total(c: Column) -> Column:
        each = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, (a - 1) * n + b))
        return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(_codes(token), total)


def all_spans(text: Column, models: MarkovModels, least: int = 20, threshold: float = 0.3) -> Column:
    """(start, kind's order, end) of the fixed patterns and of the runs that the models call random, sorted.

    A run of ``least`` or more symbols is random if the mean log-likelihood ratio of its pairs is ``threshold`` or
    more; runs inside a span of a fixed pattern are left out.
    """
    table = F.split(F.lit(",".join(map(str, models.ratios))), ",").cast("array<int>")
    run = f"{RUN}{{{least},}}+"

    def scored(base: Column) -> Column:
        runs = F.filter(spans_of(text, run), lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
        picked = let(table, lambda t: F.filter(runs, lambda c: ratio(c["value"], t) >= (F.length(c["value"]) - 1) * int(1000 * threshold)))
        plain = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
        added = F.transform(picked, lambda c: F.struct(c["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), c["end"].alias("end")))
        return F.sort_array(F.concat(plain, added))

    return F.when(text.rlike(run) | _any_pattern(text), let(base_spans(text), scored)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, models: MarkovModels, key: str = "doc_id", text: str = "text", least: int = 20, threshold: float = 0.3) -> DataFrame:
    """``(key, spans)`` of every row: spans as (start, kind, end) in code points, end exclusive, kinds as in ``KINDS``.

    A projection of built-in functions over whole texts: no shuffle, no Python. A null or empty text has no spans;
    repeated rows each get theirs.
    """
    return docs.select(F.col(key), all_spans(F.coalesce(F.col(text), F.lit("")), models, least, threshold).alias("spans"))


def redact(docs: DataFrame, models: MarkovModels, text: str = "text", mark: str = "[secret]", least: int = 20, threshold: float = 0.3) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one. A null text stays null."""
    value = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        kept = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(value, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.coalesce(kept, acc["out"]).alias("out"))

    def replaced(spans: Column) -> Column:
        done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
        return let(done, lambda d: F.concat(d["out"], F.substring(value, d["at"] + 1, F.length(value))))

    found = all_spans(value, models, least, threshold)
    return docs.withColumn(text, F.when(value.isNotNull(), let(found, lambda s: F.when(F.size(s) > 0, replaced(s)).otherwise(value))))
