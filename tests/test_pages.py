import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from plumbline.functions.cells import compare, to_number
from plumbline.operators import pages, verify
from plumbline.plans import runs

TABLES = [
    ("head", "<table><thead><tr><th>Day</th><th>Rev</th></tr></thead><tbody><tr><td>1</td><td> $5\n </td></tr><tr><td>2</td></tr></tbody></table>"),
    ("plain", "<TABLE><tr><td>k<td></td><tr><td>a<td>b<td>c</table>"),
    ("grid", '<div role="grid"><div role="row"><span role="columnheader">K</span><span role="columnheader">V</span></div><div role="row"><span role="gridcell">x</span><span role="cell">1</span></div></div>'),
    ("nested", "<table><tr><th>o</th></tr><tr><td>out <table><tr><th>i</th></tr><tr><td>in</td></tr></table></td></tr></table>"),
    ("none", "<p>no table</p>"), ("broken", "<table><tr><th>a</th></tr><tr><td>1</tr></div></table"), ("empty", ""), ("null", None),
]


def test_tables(spark):
    df = spark.createDataFrame(TABLES, "page_id string, html string")
    got = {}
    for r in pages.extract_tables(df).collect():
        got.setdefault((r["page_id"], r["table_no"]), []).append((r["row_no"], r["cells"]))
    assert got == {
        ("head", 0): [(0, {"Day": "1", "Rev": "$5"}), (1, {"Day": "2", "Rev": ""})],
        ("plain", 0): [(0, {"k": "a", "col_1": "b"})],
        ("grid", 0): [(0, {"K": "x", "V": "1"})],
        ("nested", 0): [(0, {"o": "out i in"})], ("nested", 1): [(0, {"i": "in"})],
        ("broken", 0): [(0, {"a": "1"})],
    }
    again = pages.extract_tables(df.where("page_id = 'head'"), header_as_row=True)
    assert rows(again.select("row_no", F.col("cells")["Day"])) == [(0, "Day"), (1, "1"), (2, "2")]


def test_text(spark):
    html = "<html><title> A &amp;\n B </title><body><p>one<br>two<script>x()</script><p>three</p><div>four</div></body>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(pages.extract_text(df, "title")) == [(1, 0, "A & B")]
    assert rows(pages.extract_text(df, "P"), "n", "text") == [(0, "one two"), (1, "three")]
    assert rows(pages.extract_text(df)) == [(1, 0, html)]


def test_forms(spark):
    html = '<button>Go</button><button></button><a role=button aria-label=x>More</a><a>no</a><input type=submit value=Send id=s><input type="button"><div role="button" data-testid="t">Div</div>'
    html += '<input name=u placeholder=p required><input type=password><input type=hidden><textarea></textarea><select multiple></select>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(pages.list_buttons(df), "index", "text", "tag", "id", "testid", "aria_label") == [
        (0, "Go", "button", None, None, None), (2, "More", "a", None, None, "x"), (3, "Send", "input", "s", None, None), (5, "Div", "div", None, "t", None)]
    fields = pages.list_inputs(df).where("type NOT IN ('submit', 'button')")
    assert rows(fields, "tag", "type", "name", "required", "is_password") == [
        ("input", "password", None, False, True), ("input", "text", "u", True, False), ("select", "select-multiple", None, False, False), ("textarea", "textarea", None, False, False)]


def test_classes_origins_canvas(spark):
    data = [
        (1, "https://a.com/Login?x", "<title>Home</title>"), (2, "https://a.com/x", "<title>Sign in to A</title>"), (3, "https://a.com/x", "<p>enter the security code</p>"),
        (4, "https://login.okta.com/", ""), (5, "HTTPS://u@b.com:8080/p", "<canvas>"), (6, "not a url", '<canvas width="0"></canvas>'), (7, "https://a.com.evil.com/", None),
    ]
    df = spark.createDataFrame(data, "page_id int, url string, html string")
    assert rows(pages.classify_pages(df), "page_id", "is_login", "is_mfa") == [
        (1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, False, False), (6, False, False), (7, False, False)]
    gated = {r["page_id"]: (r["origin"], r["allowed"], r["log"]) for r in pages.origin_gate(df, ["https://a.com", "https://u@b.com:8080"]).collect()}
    assert gated[1] == ("https://a.com", True, "https://a.com") and gated[5] == ("https://u@b.com:8080", True, "https://u@b.com:8080")
    assert gated[7] == ("https://a.com.evil.com", False, "BLOCKED:https://a.com.evil.com") and not gated[6][1]
    assert pages.origin_gate(df, []).where("NOT allowed").count() == 0
    assert [r["has_canvas"] for r in pages.has_canvas(df).orderBy("page_id").collect()] == [False, False, False, False, True, False, False]


@pytest.mark.parametrize("text,number", [
    ("$1,234.56", 1234.56), ("€10,000", 10000.0), ("£5", 5.0), ("not a number", None), ("10.5K", 10500.0), ("2 m", 2e6), ("$1.5B", 1.5e9), ("-3e2", -300.0),
    (" 7 ", 7.0), ("", None), ("1.2.3K", None), ("12d", None), (None, None),
])
def test_to_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(to_number(F.col("v"))).first()[0] == number


@pytest.mark.parametrize("shown,truth,tolerance,severity", [
    ("100", 100.0, 0, None), ("100.0", 100.5, 0.01, None), ("100", 102.0, 0.01, "exact_mismatch"), ("10.5K", 10500.56, 0.01, "rounded_truncation"),
    ("$10.5K", 10500.0, 0.01, "rounded_truncation"), ("  USD  ", "usd", 0, None), ("USD", "EUR", 0, "format_mismatch"), (None, 0.0, 0, "exact_mismatch"),
    (None, None, 0, None), ("0", 0.0, 0, None), ("0.1", 0.0, 9, "exact_mismatch"), ("$5", "5", 0, None), ("x", 5.0, 0, "format_mismatch"), ("5", None, 0, "exact_mismatch"),
])
def test_compare(spark, shown, truth, tolerance, severity):
    kind = StringType() if isinstance(truth, str) else DoubleType()
    df = spark.createDataFrame([(shown, truth)], f"r string, d {kind.simpleString()}")
    assert df.select(compare(F.col("r"), F.col("d"), kind, tolerance)).first()[0] == severity


def test_verify(spark):
    shown = spark.createDataFrame([(" a ", "1", 0), ("a", "2", 1), ("b", "3K", 2), ("c", "9", 3), ("e", "text", 4)], "k string, v string, n int")
    truth = spark.createDataFrame([("a", 2.0), ("b", 3000.0), ("d", 1.0), ("e", 1.0)], "k string, v double")
    found = verify.verify(shown, truth, "k", ["v"], 0.0, ["n"])
    assert rows(found, "key", "rendered", "severity") == [("b", "3K", "rounded_truncation"), ("e", "text", "format_mismatch")]
    assert rows(verify.unmatched(shown, truth, "k", ["v"], ["n"])) == [("a", "duplicate_rendered", 2), ("c", "only_rendered", 1), ("d", "only_db", 1)]
    assert rows(verify.verify_summary(found)) == [("format_mismatch", 1, "ticket"), ("rounded_truncation", 1, "monitor")]


def test_dashboard_run(spark):
    df = spark.createDataFrame([TABLES[0]], "page_id string, html string")
    truth = spark.createDataFrame([("1", 5.0), ("3", 1.0)], "Day string, Rev double")
    steps = {(r["step"], r["detail"]): r["ok"] for r in runs.dashboard_verify(df, truth, "Day", ["Rev"]).collect()}
    assert steps == {("extract", "2 rendered row(s)"): True, ("compare", "mismatches=0"): True, ("unmatched", "only_rendered=1"): True, ("unmatched", "only_db=1"): True}


def test_one_file_is_parsed_by_many_tasks(spark):
    """All pages in one partition: they are dealt out before they are parsed, and none is lost."""
    shown = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("page_id"), F.lit("<button>Go</button><input name=a>").alias("html"))
    for found in (pages.list_buttons(shown), pages.list_inputs(shown), pages.extract_text(shown, "button")):
        tasks = found.select("page_id", F.spark_partition_id().alias("task")).collect()
        assert len(tasks) == len({r["page_id"] for r in tasks}) == 2_000 and len({r["task"] for r in tasks}) > 8
