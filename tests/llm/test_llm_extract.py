"""The extractor on ordinary layouts: wrappers with unlucky names, pages without marks, cuts that turn labels, broken pages."""

import time

import pytest

from plumbline.llm import extract
from plumbline.llm.extract import COMMENTS, MAIN, NAMED, NONE, PARTS

SENTENCES = "The river rose again in the night, and by morning the lower fields were under water. Farmers moved their animals to the hills. "
PARAGRAPHS = [f"{k}. {SENTENCES * 3}".strip() for k in range(4)]
TITLE = "Flood in the valley"
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join([TITLE, *PARAGRAPHS])
LINKS = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Contact us</a></li></ul>"
LEGAL = "<p>Copyright 2024</p>"


@pytest.fixture(scope="module")
def model(spark, sf):
    return extract.train(spark.read.parquet(f"{sf}/pages.parquet"))


WRAPPED = [
    '<div class="layout right-sidebar"><article>{body}</article><div class="sidebar">{links}</div></div>',
    '<div class="site no-sidebar"><div class="entry-content">{body}</div>{links}</div>',
    '<div class="header-sticky"><main>{body}</main>{links}</div>',
    "<form action=x><article>{body}</article>{links}</form>",
    "<form action=x><div>{body}</div><div>{links}</div></form>",
    '<body class="single comments-open"><div>{body}</div><div class="nav">{links}</div></body>',
    '<div id="search-results-page"><div class="post sidebar-left">{body}</div><div class="sidebar">{links}</div></div>',
    '<div class="ad-free"><main>{body}</main><div class="comments"><article><p>{comment}</p></article><article><p>{comment}</p></article></div></div>',
]
HOLDERS = [
    "<div>{body}</div>", '<div id="content">{body}</div>', '<div class="post-body">{body}</div>', '<div role="main">{body}</div>', "<section>{body}</section>",
    "<table><tr><td>{body}</td></tr></table>", '<div class="story"><div><div>{body}</div></div></div>', "<center>{body}</center>", '<div class="x1"><div class="x2">{body}</div></div>',
    "<blockquote>{body}</blockquote>",
]
AROUND = [
    '<header>{links}</header><div class="wrap">{holder}</div><footer>{legal}{links}</footer>',
    '<div class="top">{links}</div>{holder}<div class="bottom">{links}{legal}</div>',
]


@pytest.mark.parametrize("layout", WRAPPED)
def test_wrappers_with_unlucky_names(model, layout):
    page = f"<html><head><title>t</title></head>{layout.format(body=BODY, links=LINKS, comment=SENTENCES * 9)}</html>"
    assert extract.main_text(page, model) == WANT


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("holder", HOLDERS)
def test_layouts_without_article(model, holder, around):
    page = around.format(holder=holder.format(body=BODY), links=LINKS, legal=LEGAL)
    assert extract.main_text(f"<html><body>{page}</body></html>", model) == WANT


def test_the_cut_turns_labels(model):
    """Text alone takes a heading and a short line for boilerplate, and a long advert for content; the neighbours decide otherwise."""
    page = f"<html><body><div>{BODY}<p>So it goes.</p><p>{SENTENCES}</p></div><div>{LINKS}<ul><li><a href=x>{SENTENCES}</a></li></ul>{LINKS}</div></body></html>"
    found = extract.page_of(page)
    alone = [score > 0 for score in model.scores(found.blocks)]
    cut = extract.minimum_cut(model.scores(found.blocks), extract.edges_of(found, model))
    turned = [b.text for b, a, c in zip(found.blocks, alone, cut, strict=True) if a != c]
    assert "So it goes." in turned or TITLE in turned
    assert [b.text for b, c in zip(found.blocks, cut, strict=True) if c] == [TITLE, *PARAGRAPHS, "So it goes.", SENTENCES.strip()]
    # Marked as boilerplate by a name alone, a line amid the article stays with its neighbours.
    named = page.replace("<p>So it goes.</p>", f'<p class="related">{SENTENCES * 2}</p>')
    assert (SENTENCES * 2).strip() in extract.main_text(named, model)


def test_what_elements_say():
    page = (
        "<body><div class='a'>0</div><nav>1<main>2</main></nav><main>3<header>4</header><div class='comment'>5<article>6</article></div></main>"
        "<div class='promo'>7</div><p hidden>8</p></body>"
    )
    assert [b.evidence for b in extract.page_of(page).blocks] == [NONE, PARTS, PARTS, MAIN, MAIN, COMMENTS, COMMENTS, NAMED, PARTS]


LONG = {
    "tags that never end": "<a " * 350_000,
    "quotes that never end": '<a x="' * 170_000,
    "quotes that end with the page": '<a x="' * 170_000 + ">",
    "nested elements": "<div>" * 100_000 + "text" + "</div>" * 100_000,
    "ends of nothing": "<div>" * 50_000 + "</x>" * 100_000,
    "items in open elements": "<b>" * 100_000 + "<li>x" * 50_000,
    "comments that never end": "<!--" * 250_000,
    "scripts that never end": "<script>" * 120_000,
    "text at every depth": "<div>text " * 60_000,
    "many siblings": "<body><div>" + "<p>Some text stands here.</p><ul><li><a href=x>Link</a></li></ul>" * 16_000 + "</div></body>",
    "many bodies": "<b>" * 50_000 + "<body>" * 100_000,
    "lone signs": "<" * 1_000_000,
}


@pytest.mark.parametrize("name", LONG)
def test_broken_pages_take_time_in_proportion(model, name):
    began = time.process_time()
    extract.main_text(LONG[name], model)
    assert time.process_time() - began < 5


def test_text_behind_an_open_quote_is_kept(model):
    page = f'<html><body><article><p><a href="x>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></article></body></html>'
    assert PARAGRAPHS[1] in extract.main_text(page, model)
