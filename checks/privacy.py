"""Detection, masking, sensitivity and caps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks.common import load
from plumbline.functions.detectors import register_detector
from plumbline.functions.masks import POOLS, mask_value
from plumbline.operators import mask as m
from plumbline.operators import pii
from plumbline.session import scratch_path
from plumbline.sources.files import write_jsonl

SALT = "pepper"
SECRETS = ("us_ssn", "aws_access_key", "github_pat", "stripe_key", "iban")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_US = r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
SHAPES = [
    ("us_ssn", "US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("email", "EMAIL", EMAIL),
    ("phone_e164", "PHONE", r"\+\d{8,15}\b"),
    ("phone_us", "PHONE", PHONE_US),
    ("ipv4", "IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("aws_access_key", "CREDENTIAL", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_pat", "CREDENTIAL", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("stripe_key", "CREDENTIAL", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{24,}\b"),
    ("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
]


def valid_cards(text: str) -> str:
    """DuckDB list of the Luhn-valid digit runs of a text."""
    digits = f"list_transform(regexp_extract_all({text}, '{CARD}'), lambda r: regexp_replace(r, '[^0-9]', '', 'g'))"
    doubled = "2 * CAST(substr(reverse(d), i, 1) AS INTEGER)"
    term = f"CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INTEGER) WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END"
    luhn = f"list_sum(list_transform(range(1, length(d) + 1), lambda i: {term})) % 10 = 0"
    return f"list_filter({digits}, lambda d: {luhn})"


def _findings_sql(table: str, key: str, text: str = "text") -> str:
    parts = [
        f"""SELECT {key}, '{text}' AS "column", '{name}' AS detector, '{entity}' AS entity_type, CAST(0.95 AS DOUBLE) AS confidence
            FROM {table} WHERE regexp_matches({text}, '{pattern}')"""
        for name, entity, pattern in SHAPES
    ]
    parts.append(f"""SELECT {key}, '{text}', 'credit_card', 'CREDIT_CARD', 0.95 FROM {table} WHERE len({valid_cards(text)}) > 0""")
    return " UNION ALL ".join(parts)


def _label_sql(text: str = "text") -> str:
    """Entity of a cell: the last detector of the bank that fires."""
    branches = [f"WHEN len({valid_cards(text)}) > 0 THEN 'CREDIT_CARD'"]
    branches += [f"WHEN regexp_matches({text}, '{p}') THEN '{e}'" for _, e, p in reversed(SHAPES)]
    return f"CASE {' '.join(branches)} END"


def _only(*names):
    return lambda spark, sf: pii.scan(load(spark, sf, "documents"), ["doc_id"], names, cols=["text"])


def _only_sql(*names):
    return f"SELECT * FROM ({_findings_sql('documents', 'doc_id')}) WHERE detector IN ({', '.join(repr(n) for n in names)})"


def _named(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("user_email"))


def _shaped(spark, sf):
    """Customer lines that carry one secret shape each, next to a near miss."""
    key = F.col("c_custkey")
    four = F.lpad((key % 10000).cast("string"), 4, "0")
    hexes = F.md5(key.cast("string"))
    shapes = [
        F.concat(F.lit("ssn 123-45-"), four),
        F.concat(F.lit("call +1555"), F.lit("555"), four, F.lit(" now")),
        F.concat(F.lit("key AKIA"), F.left(F.upper(hexes), F.lit(16))),
        F.concat(F.lit("ghp_"), hexes, four),
        F.concat(F.lit("sk_live_"), hexes),
        F.concat(F.lit("iban DE89"), F.lit("3704004405320"), four),
        F.concat(F.lit("near misses 12345-6789 AKIA123 gh_"), hexes),
        F.lit(None).cast("string"),
    ]
    line = F.element_at(F.array(*shapes), (key % len(shapes) + 1).cast("int"))
    return load(spark, sf, "customer").select("c_custkey", line.alias("line"))


SHAPED = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'ssn 123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
    WHEN 1 THEN 'call +1555555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' now'
    WHEN 2 THEN 'key AKIA' || left(upper(md5(CAST(c_custkey AS VARCHAR))), 16)
    WHEN 3 THEN 'ghp_' || md5(CAST(c_custkey AS VARCHAR)) || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
    WHEN 4 THEN 'sk_live_' || md5(CAST(c_custkey AS VARCHAR))
    WHEN 5 THEN 'iban DE893704004405320' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
    WHEN 6 THEN 'near misses 12345-6789 AKIA123 gh_' || md5(CAST(c_custkey AS VARCHAR)) END AS line FROM customer"""


def _name_findings(spark, sf):
    return pii.scan(_named(spark, sf), ["c_custkey"])


def _guard(spark, sf):
    return pii.content_guard(load(spark, sf, "documents"), "text").select("doc_id", "accepted", "reason")


def _packed(spark, sf):
    """Customers as notes that carry several mails, phones or cards, so every rule of the guard fires."""
    key = F.col("c_custkey")
    mails = F.concat(F.lit("m"), key.cast("string"), F.lit("@example.com "))
    phone = F.concat(F.lit("555-123-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit(" "))
    body = (
        F.when(key % 5 == 0, F.repeat(mails, F.lit(6)))
        .when(key % 5 == 1, F.repeat(phone, F.lit(5)))
        .when(key % 5 == 2, F.repeat(F.lit("4242 4242 4242 4242, "), F.lit(3)))
        .when(key % 5 == 3, F.repeat(F.col("c_name"), F.lit(1000)))
        .otherwise(F.col("c_name"))
    )
    notes = load(spark, sf, "customer").select("c_custkey", body.alias("body"))
    return pii.content_guard(notes, "body").select("c_custkey", "accepted", "reason")


def _scrub(spark, sf):
    text = F.concat(F.lit("url postgres://"), F.col("c_name"), F.lit(":pw@host Password="), F.col("c_name"), F.lit("; TOKEN="),
                    F.col("c_mktsegment"), F.lit(", "), F.col("c_mktsegment"), F.lit(" end"))
    return pii.scrub(load(spark, sf, "customer").select("c_custkey", text.alias("text")), ["text"], ["BUILDING", "MACHINERY"])


def _scrub_documents(spark, sf):
    return pii.scrub(load(spark, sf, "documents").select("doc_id", "text"), ["text"], ["the", "der"])


def _name_length(names: pd.Series) -> pd.Series:
    """Confidence that grows with the last digit of a name, as a model would give it."""
    return names.str[-1].astype(float) / 10


def _custom_detectors(spark, sf):
    """A regex, a regex with an expression, and a pandas UDF as detectors."""
    register_detector("customer_ref", "REFERENCE", pattern=r"Customer#\d+5$")
    register_detector("even_ref", "REFERENCE", pattern=r"Customer#\d+", expr=lambda v: F.right(v, F.lit(2)) == "42")
    register_detector("scored_ref", "SCORED", udf=F.pandas_udf(_name_length, "double"))
    customers = load(spark, sf, "customer").select("c_custkey", "c_name")
    return pii.scan(customers, ["c_custkey"], ("customer_ref", "even_ref", "scored_ref"), threshold=0.8)


def _sink(spark, sf):
    """Findings appended as JSON lines, partitioned by entity, and read back."""
    path = scratch_path(spark, "findings")
    findings = pii.scan(load(spark, sf, "documents"), ["doc_id"], cols=["text"])
    write_jsonl(findings, path, partition_by="entity_type")
    return spark.read.schema(findings.schema).json(path).select("doc_id", "column", "detector", "entity_type", "confidence")


def _masked_by(strategy, entity="EMAIL"):
    def run(spark, sf):
        customers = load(spark, sf, "customer")
        kind = customers.schema["c_name"].dataType
        return customers.select("c_custkey", mask_value(F.col("c_name"), entity, strategy, SALT, kind).alias("masked"))

    return run


def _never_leaves(spark, sf):
    df = load(spark, sf, "events")
    return df.select(
        "event_id", *[mask_value(F.col(f.name), "X", "never_leaves", kind=f.dataType).alias(f.name) for f in df.schema.fields if f.name in ("user_id", "event_type", "value")]
    )


def _mask_documents(spark, sf):
    return m.mask(load(spark, sf, "documents"))


def _mask_conversations(spark, sf):
    policy = m.MaskPolicy(default="hash", per_entity={"EMAIL": "redact"}, per_column={"role": "partial"}, salt=SALT)
    sensitivity = m.Sensitivity({"conversations.role": "tokenize", "*.text": "partial"})
    return m.mask(load(spark, sf, "conversations"), policy, sensitivity, "conversations")


def _mask_report(spark, sf):
    sensitivity = m.Sensitivity({"documents.source": "hash"})
    return m.mask_report(load(spark, sf, "documents"), m.MaskPolicy(salt=SALT), sensitivity, "documents")


RULES = {"supplier_1*.*": "redact", "*.part_9*": "hash", "supplier_11.part_9*": "never_leaves", "*.part_?": "partial"}


def _tiers(spark, sf):
    line = load(spark, sf, "lineitem")
    name = F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"), F.lit(".part_"), F.col("l_partkey").cast("string"))
    catalog = line.select(name.alias("qualified")).distinct()
    return m.tiers_of_catalog(catalog, "qualified", m.Sensitivity(RULES))


def _free_text(spark, sf):
    """Long text columns are declared free text by measuring them; the masked table keeps only their length."""
    df = load(spark, sf, "documents")
    tiers = m.sensitivity_tiers(df, m.Sensitivity(free_text_tier="never_leaves"), "documents", measure=True)
    explicit = m.Sensitivity({f"documents.{c}": t for c, t in tiers.items()})
    return m.mask(df, m.MaskPolicy(detectors=()), explicit, "documents")


def _mask_nested(spark, sf):
    """The texts inside an array, a struct and a map."""
    df = load(spark, sf, "documents").select(
        "doc_id", F.array("text", "lang").alias("a"), F.struct("text", F.array("text").alias("more")).alias("s"), F.create_map(F.lit("t"), "text").alias("m")
    )
    return m.mask(df, m.MaskPolicy())


def _mask_numbers(spark, sf):
    """Card numbers among keys, as whole numbers, decimals and in arrays; phone numbers as plain digits."""
    key = F.col("o_orderkey")
    number = F.when(key % 10 == 0, F.lit(4111111111111111)).when(key % 10 == 1, F.lit(4155550123)).otherwise(key)
    df = load(spark, sf, "orders").select(
        "o_orderkey", number.alias("n"), number.cast("decimal(20,0)").alias("d"), F.array(number, key).alias("a"), "o_totalprice"
    )
    return m.mask(df, m.MaskPolicy())


def _scan_nested(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", F.struct(F.array("text").alias("x")).alias("s"))
    return pii.scan(df, ["doc_id"])


def _scrub_prose(spark, sf):
    """Web addresses and mail addresses in one text are no credentials; a real one between them is."""
    text = F.concat(F.lit("see http://x.org/a for more.\n"), "text", F.lit("\nmail bob@x.org, or ftp://joe:pw@x.org/b"))
    return pii.scrub(load(spark, sf, "documents").select("doc_id", text.alias("text")), ["text"])


def _cap_rows(spark, sf):
    return m.cap(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], row_cap=500, byte_cap=32 << 20)


def _cap_bytes(spark, sf):
    return m.cap(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], row_cap=5000, byte_cap=20_000)


QUERIES = {
    "mask_nested": _mask_nested,
    "mask_numbers": _mask_numbers,
    "pii_scan_nested": _scan_nested,
    "scrub_prose": _scrub_prose,
    "pii_scan_documents": lambda s, d: pii.scan(load(s, d, "documents"), ["doc_id"], cols=["text"]),
    "pii_scan_lines": lambda s, d: pii.scan(_shaped(s, d), ["c_custkey"]),
    "pii_column_names": _name_findings,
    "pii_email": _only("email"),
    "pii_phone": _only("phone_e164", "phone_us"),
    "pii_ipv4": _only("ipv4"),
    "pii_credentials_ssn_iban": lambda s, d: pii.scan(_shaped(s, d), ["c_custkey"], SECRETS),
    "pii_credit_card": _only("credit_card"),
    "pii_custom_detectors": _custom_detectors,
    "jsonl_sink": _sink,
    "content_guard_documents": _guard,
    "content_guard_notes": _packed,
    "scrub_secrets": _scrub,
    "scrub_documents": _scrub_documents,
    "mask_redact": _masked_by("redact"),
    "mask_hash": _masked_by("hash"),
    "mask_tokenize": _masked_by("tokenize"),
    "mask_partial": _masked_by("partial"),
    "mask_synthetic": _masked_by("synthetic", "PERSON"),
    "mask_never_leaves": _never_leaves,
    "mask_allow": _masked_by("allow"),
    "mask_documents": _mask_documents,
    "mask_conversations": _mask_conversations,
    "mask_report": _mask_report,
    "sensitivity_catalog": _tiers,
    "sensitivity_free_text": _free_text,
    "cap_rows": _cap_rows,
    "cap_bytes": _cap_bytes,
}

LABEL = _label_sql()
SIZED = """SELECT *, length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS size,
    row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders"""


def _custom(value):
    return f"SELECT c_custkey, {value} AS masked FROM customer"


def _pool(entity):
    return "[" + ", ".join(f"'{p}'" for p in POOLS[entity]) + "]"


ORACLES = {
    "profile_pii_summary": f"SELECT entity_type, count(*) AS findings FROM ({_findings_sql('documents', 'doc_id')}) GROUP BY 1",
    "pii_scan_documents": _findings_sql("documents", "doc_id"),
    "pii_scan_lines": _findings_sql(f"({SHAPED})", "c_custkey", "line"),
    "pii_column_names": """SELECT c_custkey, 'full_name' AS "column", 'column_name' AS detector, 'PERSON' AS entity_type, CAST(0.85 AS DOUBLE) AS confidence FROM customer""",
    "pii_email": _only_sql("email"),
    "pii_phone": _only_sql("phone_e164", "phone_us"),
    "pii_ipv4": _only_sql("ipv4"),
    "pii_credentials_ssn_iban": f"""SELECT * FROM ({_findings_sql(f'({SHAPED})', 'c_custkey', 'line')})
        WHERE detector IN ({', '.join(repr(n) for n in SECRETS)})""",
    "pii_credit_card": _only_sql("credit_card"),
    "pii_custom_detectors": """SELECT c_custkey, 'c_name' AS "column", 'customer_ref' AS detector, 'REFERENCE' AS entity_type, CAST(0.95 AS DOUBLE) AS confidence FROM customer WHERE c_custkey % 10 = 5
        UNION ALL SELECT c_custkey, 'c_name', 'even_ref', 'REFERENCE', 0.95 FROM customer WHERE c_custkey % 100 = 42
        UNION ALL SELECT c_custkey, 'c_name', 'scored_ref', 'SCORED', c_custkey % 10 / 10 FROM customer WHERE c_custkey % 10 >= 8""",
    "jsonl_sink": _findings_sql("documents", "doc_id"),
    "content_guard_documents": f"""SELECT doc_id, reason IS NULL AS accepted, reason FROM (SELECT doc_id, CASE
        WHEN strlen(text) > 16384 THEN 'body too large'
        WHEN len(regexp_extract_all(text, '{EMAIL}')) >= 5 THEN 'email addresses'
        WHEN len(regexp_extract_all(text, '{PHONE_US}')) >= 5 THEN 'phone numbers'
        WHEN len({valid_cards('text')}) >= 3 THEN 'card numbers' END AS reason FROM documents)""",
    "content_guard_notes": """SELECT c_custkey, c_custkey % 5 = 4 AS accepted, CASE c_custkey % 5 WHEN 0 THEN 'email addresses' WHEN 1 THEN 'phone numbers'
        WHEN 2 THEN 'card numbers' WHEN 3 THEN 'body too large' END AS reason FROM customer""",
    "scrub_secrets": """SELECT c_custkey, 'url postgres://***:***@host password=***; token=***, ' ||
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '[REDACTED:CREDENTIAL]' ELSE c_mktsegment END || ' end' AS text FROM customer""",
    "scrub_documents": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'the|der', '[REDACTED:CREDENTIAL]', 'g'),
        '(?i)password=[^ ;,)]+', 'password=***', 'g'), '(?i)token=[^ ;,)]+', 'token=***', 'g'), '//[^:]+:[^@]+@', '//***:***@', 'g') AS text FROM documents""",
    "mask_redact": _custom("'[REDACTED:EMAIL]'"),
    "mask_hash": _custom(f"'[H:' || left(sha256('{SALT}|' || c_name), 16) || ']'"),
    "mask_tokenize": _custom(f"'EMAIL_' || left(sha256('{SALT}|' || c_name), 4)"),
    "mask_partial": _custom("repeat('*', length(c_name) - 4) || right(c_name, 4)"),
    "mask_synthetic": _custom(f"{_pool('PERSON')}[CAST(('0x' || left(sha256(c_name), 8)) AS BIGINT) % {len(POOLS['PERSON'])} + 1]"),
    "mask_never_leaves": "SELECT event_id, '<int>' AS user_id, '<TEXT len=' || length(event_type) || '>' AS event_type, '<float>' AS value FROM events",
    "mask_allow": _custom("c_name"),
    "mask_documents": f"""SELECT doc_id, lang, source, n_chars, CASE WHEN label IS NULL THEN text ELSE '[REDACTED:' || label || ']' END AS text
        FROM (SELECT *, {LABEL} AS label FROM documents)""",
    "mask_conversations": f"""SELECT conv_id, turn, '{'OPERATOR_DECLARED'}_' || left(sha256('{SALT}|' || role), 4) AS role,
        CASE WHEN label = 'EMAIL' THEN '[REDACTED:EMAIL]' WHEN label IS NOT NULL THEN '[H:' || left(sha256('{SALT}|' || text), 16) || ']'
             ELSE repeat('*', CASE WHEN length(text) <= 4 THEN length(text) ELSE length(text) - 4 END) || CASE WHEN length(text) <= 4 THEN '' ELSE right(text, 4) END END AS text
        FROM (SELECT *, {LABEL} AS label FROM conversations)""",
    "mask_report": f"""SELECT 'text' AS "column", label AS entity_type, 'redact' AS strategy, count(*) AS cells
        FROM (SELECT {LABEL} AS label FROM documents) WHERE label IS NOT NULL GROUP BY label
        UNION ALL SELECT 'source', 'OPERATOR_DECLARED', 'hash', count(*) FROM documents""",
    "sensitivity_catalog": r"""SELECT qualified, CASE
        WHEN regexp_full_match(qualified, 'supplier_11\.part_9.*') THEN 'never_leaves'
        WHEN regexp_full_match(qualified, 'supplier_1.*\..*') THEN 'redact'
        WHEN regexp_full_match(qualified, '.*\.part_9.*') THEN 'hash'
        WHEN regexp_full_match(qualified, '.*\.part_.') THEN 'partial' ELSE 'allow' END AS tier
        FROM (SELECT DISTINCT 'supplier_' || l_suppkey || '.part_' || l_partkey AS qualified FROM lineitem)""",
    "pii_scan_nested": f"""SELECT doc_id, 's' AS "column", detector, entity_type, confidence FROM ({_findings_sql('documents', 'doc_id')})""",
    "mask_nested": f"""SELECT doc_id, [t, lang] AS a, {{'text': t, 'more': [t]}} AS s, MAP {{'t': t}} AS m
        FROM (SELECT doc_id, lang, CASE WHEN label IS NULL THEN text ELSE '[REDACTED:' || label || ']' END AS t FROM (SELECT *, {LABEL} AS label FROM documents))""",
    "mask_numbers": """SELECT o_orderkey, n, CAST(n AS DECIMAL(20,0)) AS d, [n, o_orderkey] AS a, o_totalprice
        FROM (SELECT *, CASE WHEN o_orderkey % 10 > 1 THEN o_orderkey END AS n FROM orders)""",
    "scrub_prose": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
        'see http://x.org/a for more.' || chr(10) || text || chr(10) || 'mail bob@x.org, or ftp://joe:pw@x.org/b',
        '(?i)password=[^ ;,)]+', 'password=***', 'g'), '(?i)token=[^ ;,)]+', 'token=***', 'g'), '//[^:/@\s]+:[^/@\s]+@', '//***:***@', 'g') AS text FROM documents""",
    "sensitivity_free_text": "SELECT doc_id, '<TEXT len=' || length(text) || '>' AS text, lang, source, n_chars FROM documents",
    "cap_rows": f"SELECT o_orderkey, o_orderstatus, true AS truncated FROM ({SIZED}) WHERE rn <= 500",
    "cap_bytes": f"""SELECT o_orderkey, o_orderstatus, true AS truncated FROM (
        SELECT *, coalesce(sum(size) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({SIZED}))
        WHERE rn <= 5000 AND before < 20000""",
}
