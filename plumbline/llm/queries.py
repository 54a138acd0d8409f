"""The registered queries of this package, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import crf, extract, filters, jaccard, licenses, mixing, packing, periodic, quality, secrets, simhash, tokens, topk
from plumbline.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) c USING (doc_id)
"""


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, word_bpe(), end_id=2)
    return tokens.token_digests(spark, path)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.PATTERNS))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"))


SYMBOLS = secrets.SYMBOLS
# The same patterns for an engine without look-behind and possessive repeats: kind, pattern, group, least length.
SQL_PATTERNS = (
    (0, secrets.PATTERNS["assign"][0].replace("'", "''"), 2, 8), (1, "AKIA[A-Z0-9]{12,}", 0, 16), (2, "[0-9a-f]{32,}", 0, 32),
    (3, "[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
SQL_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS kind, {least} AS least, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS w,
        regexp_extract_all(t, '{p}', {g}) AS v FROM d WHERE regexp_matches(t, '{p}')""" for k, p, g, least in SQL_PATTERNS)
SQL_REST = "t"
for _, _pattern, _, _ in SQL_PATTERNS[:3]:
    SQL_REST = f"regexp_replace({SQL_REST}, '{_pattern}', ' ', 'g')"


def _chance_sql(label: str, uniform: float) -> str:
    n = len(SYMBOLS)
    return f"""(SELECT a.c AS a, b.c AS b, (1 - {uniform}::DOUBLE) * (coalesce(p.n, 0) + 1)::DOUBLE / (coalesce(o.n, 0) + {n}) + {uniform}::DOUBLE / {n} AS p
        FROM c a CROSS JOIN c b LEFT JOIN (SELECT * FROM pairs WHERE label = '{label}') p ON p.a = a.c AND p.b = b.c
        LEFT JOIN (SELECT a, sum(n) AS n FROM pairs WHERE label = '{label}' GROUP BY a) o ON o.a = a.c)"""


OP4_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
    m AS ({SQL_MATCHES}),
    s AS (SELECT doc_id, kind, start, start + length(w[i]) AS stop, v[i] AS value FROM (
              SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
              FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)) WHERE length(v[i]) >= least),
    tokens AS (
        SELECT 'random' AS label, value AS token FROM s JOIN d USING (doc_id) WHERE kind < 3
           AND h <= (SELECT max(h) FROM (SELECT h FROM d WHERE doc_id IN (SELECT doc_id FROM s WHERE kind < 3) ORDER BY h LIMIT 1000))
        UNION ALL
        SELECT 'usual', unnest(regexp_extract_all({SQL_REST}, '[A-Za-z0-9+/_=-]{{6,}}')) FROM d
        WHERE h <= (SELECT max(h) FROM (SELECT h FROM d ORDER BY h LIMIT 1000))),
    c AS (SELECT unnest(string_split('{SYMBOLS}', '')) AS c),
    pairs AS (SELECT label, substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b, count(*) AS n
              FROM (SELECT *, unnest(range(1, length(token))) AS i FROM tokens)
              WHERE contains('{SYMBOLS}', substr(token, i, 1)) AND contains('{SYMBOLS}', substr(token, i + 1, 1)) GROUP BY 1, 2, 3),
    ratios AS (SELECT r.a, r.b, CAST(round(1000 * ln(r.p / u.p)) AS BIGINT) AS x FROM {_chance_sql('random', 0.5)} r JOIN {_chance_sql('usual', 0.02)} u ON r.a = u.a AND r.b = u.b),
    runs AS (SELECT * FROM s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.kind < 3 AND b.doc_id = s.doc_id AND b.start <= s.start AND b.stop >= s.stop)),
    picked AS (SELECT doc_id, kind, start, stop FROM (SELECT *, unnest(range(1, length(value))) AS i FROM runs) q
               JOIN ratios ON a = substr(value, i, 1) AND b = substr(value, i + 1, 1) GROUP BY 1, 2, 3, 4, value HAVING sum(x) >= (length(value) - 1) * 300),
    every AS (SELECT doc_id, kind, start, stop FROM s WHERE kind < 3 UNION ALL SELECT * FROM picked),
    shown AS (SELECT *, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop AS x FROM every),
    o AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                 string_agg(x, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start, kind, stop) AS spans
          FROM shown GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
"""


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


OP5_SQL = """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
"""


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Holders are different texts, as the SQL below counts them.
    return quality.quality_rules(_table(spark, sf_dir, "documents"), alike=None).drop("host", "print")


OP6_SQL = r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
    t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
    l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
    m AS (SELECT doc_id, source, text, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
                 len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM m GROUP BY doc_id),
    h AS (SELECT source, count(DISTINCT text) AS documents FROM d GROUP BY source),
    f AS (SELECT source, line, count(DISTINCT text) AS holders FROM m GROUP BY source, line HAVING holders > 20),
    b AS (SELECT f.source, f.line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE f.holders > h.documents * 0.01::DOUBLE),
    x AS (SELECT doc_id, sum(words) AS n FROM m JOIN b ON m.line = b.line AND m.source IS NOT DISTINCT FROM b.source GROUP BY doc_id),
    s AS (SELECT w.doc_id, len(w.w) AS n_words, len(regexp_extract_all(w.text, '[^\x20\x09-\x0D]')) AS word_chars,
                 len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                 coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS words_removed
          FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id))
    SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= n_words * 0.3::DOUBLE AS kept
    FROM s
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))

    def labels(spans: str) -> Column:
        return F.col(spans)["label"]

    first = F.array_min(F.col("base")["first_word"])
    last = F.array_max(F.col("base")["first_word"])
    base = F.array_join(F.array_sort(F.array_distinct(labels("base"))), ",")
    every = F.array_join(F.array_sort(F.array_distinct(F.concat(labels("base"), labels("notices")))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        base.alias("base_labels"), every.alias("labels"), "score",
    )


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = crf.score(docs, crf.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe(), end_id=1, capacity=4096)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(_table(spark, sf_dir, "documents"))
    # Which shards take the row, one for each time it is drawn: dealt by the splitting tree.
    shards = F.array_join(F.transform(F.col("draws")["shard"], lambda s: s.cast("string")), ",")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents")).drop("runs")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    y AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w LEFT JOIN y USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic,
                 len(list_filter(fails, lambda x: x)) AS failing FROM d GROUP BY part, fails),
    f AS (SELECT unnest(range(1, 6)) AS f),
    o AS (SELECT [a.f, b.f, c.f, e.f, g.f] AS o, list_aggregate(list_transform([a.f, b.f, c.f, e.f, g.f], lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order
          FROM f a, f b, f c, f e, f g WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
    r AS (SELECT m.*, o.o, o.filter_order, coalesce(list_min(list_filter(range(1, 6), lambda s: fails[o[s]])), 6) AS gone FROM m, o),
    s AS (SELECT part, filter_order, f.f AS step, o[f.f] AS filter, CAST(sum(n) FILTER (gone > f.f) AS BIGINT) AS kept, CAST(sum(n) FILTER (gone = f.f) AS BIGINT) AS removed,
                 CAST(sum(n) FILTER (fails[o[f.f]] AND gone < f.f) AS BIGINT) AS redundant, CAST(sum(n) FILTER (fails[o[f.f]] AND failing = 1) AS BIGINT) AS unique_fails,
                 CAST(sum(good) FILTER (gone = f.f) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (gone = f.f) AS BIGINT) AS toxic_lost
          FROM r, f GROUP BY part, filter_order, step, filter)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
           coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM s
"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_output": op3_token_output,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_line_frequency": op6_line_frequency,
    "op7_license_scan": op7_license_scan,
    "op8_line_quality": op8_line_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_source_mixing": op10_source_mixing,
    "op11_simhash_neardup": op11_simhash_neardup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op2_ngram_jaccard": OP2_SQL, "op4_secret_scan": OP4_SQL, "op5_exact_topk": OP5_SQL, "op6_line_frequency": OP6_SQL, "op13_filter_audit": OP13_SQL}
