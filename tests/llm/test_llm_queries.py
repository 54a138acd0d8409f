"""The registered queries: against DuckDB where SQL expresses them, else against a brute-force version."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from checks.compare import connection, difference
from plumbline.llm import jaccard, mixing, packing, quality, queries, secrets

LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, con, name):
    assert difference(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert [re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES] == [str(k) for k in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "secret_scan", "source_mixing", "best_fit_packing"]


def test_extraction(spark, sf):
    """The fixture's pages hold their main text in one article element of headings and paragraphs."""
    import html

    found = {r["page_id"]: r for r in queries.op1_html_extraction(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner[1] if inner else "")]
        want = "\n\n".join(x for x in blocks if x)
        assert found[page["page_id"]]["text"] == want and found[page["page_id"]]["n_chars"] == len(want)


def encoded(docs, end):
    full = Tokenizer.from_file(queries.word_bpe())
    return {i: np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4") for i, r in docs.items()}


def test_tokens(spark, sf, docs):
    at, want = 0, []
    for i, ids in sorted(encoded(docs, 2).items()):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op3_token_output(spark, sf).collect())) == want


def check_packing(rows, ids):
    pieces, bins = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert max(bins.values()) <= 4096
    for (i, piece), found in pieces.items():
        part = ids[i][4096 * piece : 4096 * piece + 4096]
        assert set(found) == {(4096 * piece, len(part), zlib.crc32(part.tobytes()))}
    return pieces, bins


def test_packing(spark, sf, docs):
    ids = encoded(docs, 1)
    pieces, bins = check_packing(queries.op9_best_fit_packing(spark, sf).collect(), ids)
    assert {k: len(v) for k, v in pieces.items()} == {(i, p): 1 for i, x in ids.items() for p in range(-(-len(x) // 4096))}
    assert len(bins) <= -(-sum(map(len, ids.values())) // 4096) * 1.02 + 1


def test_mixing(spark, sf, docs):
    rows = queries.op10_source_mixing(spark, sf).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(sizes[i] for i, r in docs.items() if r["source"] == s) for s in sources}
    targets = dict(zip(sources, mixing.capped_targets([totals[s] for s in sources], [k % 3 + 1 for k in range(len(sources))], 3), strict=True))
    taken, spare = dict.fromkeys(sources, 0), {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[source] and r["target"] == pytest.approx(targets[source])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[source] += r["taken"]
        spare.setdefault(source, []).extend([r["size"]] * (r["taken"] < 3 * r["size"]))
    # What is missing is less than some document that could still be drawn.
    assert len(rows) == len(docs) and all(0 <= targets[s] + 1e-6 - taken[s] <= max(spare[s], default=0) for s in sources)
    assert sorted(rows) == sorted(queries.op10_source_mixing(spark, sf).collect())


def test_secret_scan(spark, sf, docs):
    import hashlib

    from test_llm_edges import python_spans

    for r in queries.op4_secret_scan(spark, sf).collect():
        spans = python_spans(docs[r["doc_id"]]["text"] or "")
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("markov:")] == shown


def test_license_scan(spark, sf, docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in queries.op7_license_scan(spark, sf).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[r["doc_id"]]["text"] or "").translate(LOWER))
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        labels = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) and r["labels"] == ",".join(sorted(r["labels"].split(",")))


def test_line_quality_on_held_out_documents(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_line_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    tested = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in tested if y == 1], [s for s, _, y in tested if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([p == y for _, p, y in tested]) > 0.93


def test_pipeline(spark, sf, docs):
    """Every stage against a brute-force version of its own input."""
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = at.columns, list(docs.values())
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, at, sf), "test")
        rows = after.collect()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.quality_rules(at).collect() if r["kept"]}
            assert sorted(rows) == sorted(r for r in before if r["doc_id"] in kept) and 0 < len(rows) < len(before)
        elif name == "ngram_jaccard":
            kept = {r["component_id"] for r in jaccard.ngram_components(at).collect()}
            assert sorted(rows) == sorted(r for r in before if r["doc_id"] in kept) and 0 < len(rows) < len(before)
        elif name == "secret_scan":
            spans = {r["doc_id"]: r["spans"] for r in secrets.scan(at, secrets.train(at)).collect()}
            given = {r["doc_id"]: r for r in before}
            assert {r["doc_id"] for r in rows} == set(given)
            for r in rows:
                text, end, want = given[r["doc_id"]]["text"], 0, ""
                for start, _, stop in spans[r["doc_id"]]:
                    want += text[end:start] + "[secret]" if start >= end else ""
                    end = max(end, stop)
                assert r["text"] == want + text[end:] and r["n_chars"] == len(r["text"])
        elif name == "source_mixing":
            draws = {r["doc_id"]: len(r["draws"]) for r in mixing.assign(at).collect()}
            assert sorted(rows) == sorted(r for r in before for _ in range(draws[r["doc_id"]]))
        else:
            mixed = {r["doc_id"]: r for r in before}
            times = {}
            for r in before:
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            pieces, _ = check_packing(rows, encoded(mixed, 1))
            assert {i: len(pieces[i, 0]) for i in times} == times
            return
        assert after.columns == columns
        at, before = after, rows
    assert packing
