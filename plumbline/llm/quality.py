"""Quality rules: per-document statistics, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, WORD, let, materialise
from plumbline.session import broadcast_if_small

#: Documents are dealt to so many parts when shared lines are matched back, so that no line is one task.
SALTS = 32
#: Words of the n-grams by which near copies are told from documents of their own, as in ``jaccard``; units of a count.
GRAM = 5
UNITS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    A window's hash and its place share one long, so one primitive sort brings equal windows together; neighbours of
    equal high bits are compared by their full hash. Covered words follow from the sorted places of such windows.
    """

    def hashes(w: Column) -> Column:
        places = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def flagged(h: Column) -> Column:
        # As few low bits as the places need, so that the high bits keep most of the hash.
        return let(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h).cast("long")))) - F.lit(1), lambda low: _flagged(h, low))

    def _flagged(h: Column, low: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(low).cast("int")

        def same(x: Column, y: Column) -> Column:
            return F.coalesce(F.get(h, place(x)) == F.get(h, place(y)), F.lit(False))

        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        kept = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
        return F.sort_array(F.transform(kept, place))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
        return F.aggregate(widths, F.lit(0), lambda acc, x: acc + x).cast("long")

    return let(words, lambda w: let(hashes(w), lambda h: let(flagged(h), covered)))


def normal_line(line: Column) -> Column:
    """A line as it is compared across documents: lower case, single spaces, trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))


def statistics(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per document: key, fingerprints of host and text, counts, and the hash and words of every line with a word."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    return docs.select(
        F.col(key),
        F.xxhash64(F.col(host).isNull(), F.col(host)).alias("host"),
        F.xxhash64(whole).alias("print"),
        F.regexp_count(whole, F.lit(SPACE)).alias("spaces"),
        F.length(whole).alias("chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            _words(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.transform(
                    x, lambda line: F.struct(F.xxhash64(normal_line(line)).alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words"))
                ).alias("lines"),
            ),
        ).alias("l"),
    ).select(
        key, "host", "print", F.col("w.n_words").alias("n_words"), (F.col("chars") - F.col("spaces")).cast("long").alias("word_chars"),
        "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("l.lines").alias("lines"),
    )


def _prints(text: str, host: str) -> tuple[Column, Column]:
    """The fingerprints of host and text."""
    return F.xxhash64(F.col(host).isNull(), F.col(host)).alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print")


def _gram_hashes(text: Column) -> Column:
    """Hashes of a text's different n-grams of lower-case words; a shorter text is one n-gram."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))
        return F.array_distinct(F.when(F.size(w) < GRAM, F.array(F.xxhash64(w))).otherwise(many))

    return let(_words(F.lower(text)), hashes)


def _units(docs: DataFrame, wanted: DataFrame, text: str, host: str, alike: float) -> DataFrame:
    """``(host, print, units)``: what each wanted text of a host counts, in ``UNITS``; a group of near copies counts about once.

    Texts of one size that are ``alike`` or more differ in at most (1 - alike) / (1 + alike) of their n-grams. So a text
    counts one over the number of wanted texts of its host that hold an n-gram, of the n-gram at that share of its n-grams,
    rare ones first: one if it has more than that share to itself, one over k if it has it in common with k - 1 near copies.
    """
    texts = docs.select(F.col(text).alias("text"), *_prints(text, host)).join(broadcast_if_small(wanted), ["host", "print"], "left_semi")
    texts = texts.dropDuplicates(["host", "print"])
    sets = materialise(texts.select("host", "print", _gram_hashes(F.coalesce("text", F.lit(""))).alias("grams")), "grams")
    grams = sets.select("host", "print", F.explode("grams").alias("gram"))
    held = grams.groupBy("host", "gram").agg(F.count("*").alias("holders")).where("holders > 1")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS // 4 - 1))))
    dealt = grams.withColumn("salt", F.pmod("print", F.lit(SALTS // 4)).cast("int"))
    found = dealt.join(held, ["host", "gram", "salt"]).groupBy("host", "print").agg(F.sort_array(F.collect_list("holders")).alias("holders"))
    sizes = sets.select("host", "print", F.size("grams").alias("n"))
    at = F.floor(F.col("n") * F.lit((1 - alike) / (1 + alike)) + F.lit(1e-9)).cast("int") - (F.col("n") - F.size("holders"))
    copies = F.when(F.col("holders").isNull() | (at < 0), F.lit(1)).otherwise(F.get("holders", at))
    return sizes.join(found, ["host", "print"], "left").select("host", "print", F.floor(F.lit(UNITS) / copies).cast("long").alias("units"))


def _spread(lines: DataFrame) -> DataFrame:
    """Each line of a host once for every part that documents are dealt to."""
    return lines.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = 20,
    max_share: float = 0.01, min_words_left: float = 0.3, min_words: int = 50, max_repeat: float = 0.5, alike: float | None = 0.8,
) -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, kept, host, print)``.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeat`` of them in 3-word windows found twice. The
    method: a normalised line that over ``max_documents`` different documents of a host and over ``max_share`` of the
    host's documents hold is boilerplate and removed; a document that keeps under ``min_words_left`` of its words is
    rejected. Exact copies count as one document of a host, so a text is not rejected for being copied. Nor is it for
    having near copies: where a document would be rejected, the holders of its lines are counted anew, each group of
    texts that are ``alike`` in their n-grams about once (see ``_units``), and lines that then have too few holders stay.
    Lines that cause no rejection are not counted anew. With ``alike`` None holders are just different texts.

    Null texts are empty (and fail), null hosts are one host, repeated rows each get their verdict, an empty table
    gives an empty result. ``host`` and ``print`` are fingerprints, with the key enough to find the rows again.

    Each text is read once, those that share lines with a document to be rejected once more; counts and line hashes are
    written. Lines are pre-aggregated before they move, and a line held by a third of all rows is matched back in
    ``SALTS`` parts.
    """
    stats = materialise(statistics(docs, key, text, host), "quality")
    lines = stats.select(key, "host", "print", F.posexplode("lines").alias("place", "x")).select(key, "host", "print", "place", "x.line", "x.words")
    totals = stats.groupBy("host").agg(F.countDistinct("print").alias("documents"))
    shared = lines.groupBy("host", "line").agg(F.countDistinct("print").alias("holders")).where(F.col("holders") > max_documents)
    shared = shared.join(totals, "host").where(F.col("holders") > F.col("documents") * max_share)
    salt = F.pmod(F.xxhash64("print", key), F.lit(SALTS)).cast("int")
    # Repeated rows count once: a document is its key, host and text.
    found = lines.withColumn("salt", salt).join(_spread(shared), ["host", "line", "salt"], "left_semi")
    hits = found.select(key, "host", "print", "place", "words", "line", "salt").distinct()
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    if alike is not None:
        hits = materialise(hits, "hits")
        gone = hits.groupBy(key, "host", "print").agg(F.sum("words").alias("gone")).withColumnRenamed(key, "k")
        same = stats[key].eqNullSafe(gone["k"]) & (stats["host"] == gone["host"]) & (stats["print"] == gone["print"])
        lost = stats.join(gone, same).where(~failed & (F.col("n_words") - F.col("gone") < F.col("n_words") * min_words_left))
        lost = materialise(lost.select(stats["host"], stats["print"]).distinct(), "lost")
        if not lost.isEmpty():
            doubtful = materialise(hits.join(lost, ["host", "print"], "left_semi").select("host", "line").distinct(), "doubtful")
            held = materialise(hits.join(_spread(doubtful), ["host", "line", "salt"], "left_semi").select("host", "print", "line").distinct(), "held")
            wanted = materialise(held.select("host", "print").distinct(), "wanted")
            units = held.join(_units(docs, wanted, text, host, alike), ["host", "print"]).groupBy("host", "line").agg(F.sum("units").alias("units"))
            few = (F.col("units") <= max_documents * UNITS) | (F.col("units") <= F.col("documents") * max_share * UNITS)
            stay = materialise(units.join(totals, "host").where(few).select("host", "line"), "stay")
            hits = hits.join(_spread(stay), ["host", "line", "salt"], "left_anti")
    removed = hits.groupBy(key, "host", "print").agg(F.sum("words").cast("long").alias("words_removed")).withColumnRenamed(key, "k")
    joined = stats.drop("lines").alias("s").join(
        removed.alias("r"), F.col(f"s.{key}").eqNullSafe(F.col("r.k")) & (F.col("s.host") == F.col("r.host")) & (F.col("s.print") == F.col("r.print")), "left"
    )
    gone = F.coalesce("r.words_removed", F.lit(0).cast("long"))
    left = (F.col("n_words") - gone) >= F.col("n_words") * min_words_left
    return joined.select(
        F.col(f"s.{key}").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("words_removed"), (~failed & left).alias("kept"), F.col("s.host").alias("host"), F.col("s.print").alias("print"),
    )


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns."""
    verdicts = quality_rules(docs, key, text, host, **limits)
    bad = verdicts.where(~F.col("kept")).select(F.col(key).alias("_k"), F.col("host").alias("_h"), F.col("print").alias("_p")).distinct()
    same = (
        docs[key].eqNullSafe(bad["_k"])
        & (F.xxhash64(docs[host].isNull(), docs[host]) == bad["_h"])
        & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_p"])
    )
    return docs.join(bad, same, "left_anti")
