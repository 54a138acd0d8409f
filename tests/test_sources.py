import csv
import io
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, scratch_path, shared_dir
from plumbline.sources import documents, exports, files, manifests


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,total,currency\n1,99.50,USD\n2,15.00,EUR\n3,250.00,GBP\n")
    (tmp_path / "customers.csv").write_text("id,email,name\n1,a@b.co,Ann\n2,c@d.co,Bob\n")
    (tmp_path / "parts.tsv").write_text("id\tname\n1\tx, y\n")
    (tmp_path / "one.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "notes.txt").write_text("skip me")
    return tmp_path


def test_read_by_suffix(spark, folder):
    orders = files.read_file(spark, str(folder / "orders.csv"))
    assert rows(orders) == [(1, 99.5, "USD"), (2, 15.0, "EUR"), (3, 250.0, "GBP")]
    assert dict(orders.dtypes)["total"] == "double"
    assert dict(files.read_file(spark, str(folder / "orders.csv"), "order_id string, total string, currency string").dtypes)["total"] == "string"
    assert rows(files.read_file(spark, str(folder / "parts.tsv"))) == [(1, "x, y")]
    assert files.read_file(spark, str(folder / "one.json")).count() == 2
    assert files.read_file(spark, str(folder / "lines.jsonl")).count() == 3
    with pytest.raises(ValueError):
        files.read_file(spark, str(folder / "notes.txt"))


def test_views(spark, folder):
    spark.range(4).write.parquet(str(folder / "written.parquet"))
    assert files.register_dir(spark, str(folder)) == ["customers", "lines", "one", "orders", "parts", "written"]
    assert rows(spark.sql("SELECT currency FROM orders WHERE total > :low", args={"low": 50})) == [("GBP",), ("USD",)]
    assert spark.table("written").count() == 4
    assert files.register_dir(spark, str(folder / "orders.csv")) == ["orders"]
    (folder / "deep").mkdir()
    (folder / "deep" / "hidden.csv").write_text("a\n1\n")
    assert "hidden" not in files.register_dir(spark, str(folder))
    assert files.register_dir(spark, str(folder), {"only-this": str(folder / "orders.csv")}) == ["only-this"]
    assert spark.table("`only-this`").count() == 3
    with pytest.raises(ValueError):
        files.register_views(spark, {"bad name": str(folder / "orders.csv")})
    assert "orders" in {r["name"] for r in files.list_tables(spark).collect()}
    assert rows(files.describe(spark.table("customers")), "ordinal", "name", "type") == [(1, "id", "int"), (2, "email", "string"), (3, "name", "string")]


def test_jsonl_appends_by_date(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-01-02 10:00:00")], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    for _ in range(2):
        files.write_jsonl(df, str(tmp_path / "log"), ts_col="at")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["date=2026-01-01", "date=2026-01-02"]
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_documents(spark):
    docs = [(1, '{"a": 1, "b": "x", "n": null}'), (2, '{"a": "one", "c": true}'), (3, "not json"), (4, '{"a": 2, "d": {"e": [1]}, "it\'s": 1.5}'), (5, None)]
    df = spark.createDataFrame(docs, "id int, body string")
    types = dict(rows(documents.infer_document_schema(df, "body"), "key", "type"))
    assert types["a"] == "mixed" and types["b"] == "STRING" and types["c"] == "BOOLEAN" and types["n"] == "VOID"
    assert types["d"].startswith("OBJECT")
    found = documents.doc_find(df, "body", keep=("id",))
    assert found.columns == ["id", "a", "b", "c", "d", "it's", "n"] and found.count() == 5
    assert rows(found.where("id = 4"), "a", "d") == [("2", '{"e":[1]}')]
    assert rows(documents.doc_find(df, "body", {"c": True}, keep=("id",)), "id", "a") == [(2, "one")]
    assert rows(documents.doc_find(df, "body", {"a": 1}, keep=("id",)), "id", "b") == [(1, "x")]
    assert documents.doc_find(df, "body", limit=2, keep=("id",)).count() == 2
    assert documents.doc_count(df, "body", {"a": 2}).first()[0] == 1 and documents.doc_count(df, "body").first()[0] == 5


def test_documents_with_very_many_keys(spark):
    df = spark.range(30).select("id", F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("k"), "id"), F.lit("same")), F.array("id", F.lit(1)))).alias("doc"))
    df = df.unionByName(spark.createDataFrame([(99, '{"none": null}'), (100, "no json")], "id long, doc string"))
    with pytest.raises(ValueError, match="distinct keys"):
        documents.doc_find(df, "doc", max_keys=20)
    assert len(documents.doc_find(df, "doc").columns) == 32
    found = rows(documents.doc_members(df, "doc", keep=("id",)))
    assert len(found) == 61 and (7, "k7", "7", "BIGINT") in found and (99, "none", None, "VOID") in found
    assert rows(documents.doc_members(df, "doc", {"k3": 3})) == [("k3", "3", "BIGINT"), ("same", "1", "BIGINT")]


def test_exports(spark):
    bodies = [(1, '[{"k": 1, "v": "a"}, {"k": 2}]'), (2, ' {"data": [{"k": 3, "v": "c"}]}'), (3, '{"k": 4, "v": "d"}')]
    df = spark.createDataFrame(bodies, "id int, body string")
    assert rows(exports.parse_export(df, "body", "json", "k int, v string", ("id",))) == [(1, 1, "a"), (1, 2, None), (2, 3, "c"), (3, 4, "d")]
    text = 'v,k\r\n"x, ""y""\nz",7\r\nshort\r\n'
    df = spark.createDataFrame([(1, text), (2, "k\n5\n"), (3, ""), (4, None)], "id int, body string")
    assert rows(exports.parse_export(df, "body", "csv", "k int, v string", ("id",))) == [(1, 7, 'x, "y"\nz'), (1, None, "short"), (2, 5, None)]
    with pytest.raises(ValueError):
        exports.parse_export(df, "body", "xml", "k int")


def test_manifest(spark, tmp_path):
    manifest = {
        "metadata": {"x": 1},
        "nodes": {f"model.p.{n}": {"name": n, "resource_type": "model", "original_file_path": f"models/{n}.sql", "extra": {"y": []}} for n in "abcd"},
        "child_map": {"model.p.a": ["model.p.b", "model.p.c"], "model.p.b": ["model.p.d"], "model.p.d": []},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=2))
    nodes, edges = manifests.load_manifest(spark, str(tmp_path / "manifest.json"))
    assert rows(nodes, "name", "path") == [(n, f"models/{n}.sql") for n in "abcd"]
    assert rows(edges) == [("model.p.a", "model.p.b"), ("model.p.a", "model.p.c"), ("model.p.b", "model.p.d")]


def test_long_csv_cells(spark):
    body = 'k,v\n1,"' + "x" * 200_000 + '"\n'
    df = spark.createDataFrame([(1, body)], "id int, body string")
    assert exports.parse_export(df, "body", "csv", "k int, v string").select(F.length("v")).first()[0] == 200_000


def test_csv_exports_as_the_csv_module_reads_them(spark):
    """Quoted separators and line breaks, doubled quotes, blank lines, short and long records, odd characters: row by row as csv gives them."""
    pick = random.Random(4)
    pieces = ["a", "b c", "", '"q"', '"x,y"', '"line\nbreak"', '"say ""hi"""', '""', '"tail"x', 'in"side', "é", "1", "\ufdd0", '"\r\n"', "  ", '"""all"""']
    bodies = ["", "k", "k,v", "k,v\n", "k,v\n\n1,2\n\n", "v,k\r\n1,2\r\n", '\nk,v\n1,"open\nend', "k,k,v\n1,2,3", 'k,v\n"1","' + "x" * 1_000_000 + '"\n', "v\n" + '"' + '""' * 20_000 + '"']
    for _ in range(300):
        header = pick.choice(["k,v", "v,k", '"k",v,w', "w,v"])
        lines = [",".join(pick.choice(pieces) for _ in range(pick.randrange(1, 5))) for _ in range(pick.randrange(0, 6))]
        bodies.append(pick.choice(["\n", "\r\n"]).join([header, *lines]) + pick.choice(["", "\n", "\n\n"]))
    df = spark.createDataFrame([*enumerate(bodies), (-1, None)], "id long, body string")
    found = exports.parse_export(df, "body", "csv", "k string, v string", ("id",))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    csv.field_size_limit(2**31 - 1)
    for i, body in enumerate(bodies):
        for row in csv.DictReader(io.StringIO(body.lstrip("\n"), newline="")):
            want.append((i, row.get("k"), row.get("v")))
    assert rows(found) == sorted(want, key=repr)


def test_documents_match_by_type(spark):
    df = spark.createDataFrame([('{"k": 69}',), ('{"k": "69"}',), ('{"k": 69.4}',), ('{"k": 69.0}',), ('{"k": true}',), ('{"k": null}',)], "j string")
    counts = [documents.doc_count(df, "j", {"k": v}).first()[0] for v in (69, "69", 69.4, 69.0, True, None)]
    assert counts == [2, 1, 1, 2, 1, 1]


def test_codeowners(spark):
    lines = ["# all", "*.sql @data", "/models/marts/   @alice bob@example.com # both", "orphan/", "", "  docs/\t@@carol"]
    got = manifests.parse_codeowners(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got, "key", "owner") == [("path:*.sql", "data"), ("path:docs", "carol"), ("path:models/marts", "alice"), ("path:models/marts", "bob@example.com")]


def test_pr_digests(spark):
    prs = [{"number": 1, "title": "t", "user": {"login": "ann"}, "merged_at": "2026-01-01", "_files": ["a.sql"], "body": "b" * 600}, {"number": 2, "title": "u", "body": None}]
    df = spark.createDataFrame([(json.dumps(p),) for p in prs], "j string")
    assert manifests.ingest_prs(df, "j", F.lit("shop"), summary_chars=512)[0].agg(F.max(F.length("summary"))).first()[0] == 512
    digests, contributors = manifests.ingest_prs(df, "j", F.lit("shop"))
    assert rows(digests, "number", "author", "merged_at", "files_touched", "summary") == [(1, "ann", "2026-01-01", ["a.sql"], "b" * 600), (2, "", "", [], "")]
    assert rows(contributors, "key", "owner") == [("repo:shop", ""), ("repo:shop", "ann")]


def test_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark) and scratch_path(spark, "x").startswith(folder)
    assert cut_lineage(spark.range(3)).count() == 3


def test_shared_folder_is_the_one_the_cluster_names(monkeypatch):
    class Context:
        master, chosen = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.chosen

        def setCheckpointDir(self, path):
            self.chosen = path

    class Session:
        sparkContext = Context()

        class conf:
            named = None

            @classmethod
            def get(cls, key, default=None):
                assert key == "spark.checkpoint.dir"
                return cls.named

    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.conf.named = "s3a://bucket/checkpoints"
    assert shared_dir(Session) == "s3a://bucket/checkpoints"
