"""Stored web pages as data: tables, text, form elements, page kinds and origins.

Markup is parsed on the workers, page by page, in Arrow batches; everything else is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import html as markup

_BATCH = 4096

# Markers of login and multi-factor pages.
LOGIN_URLS = (
    "/login", "/signin", "/sign-in", "/sso", "/auth", "/oauth", "/account/login", "okta.com", "auth0.com", "duo.com", "ping.com",
)
LOGIN_TITLES = ("sign in", "log in", "login", "authentication", "verify your identity")
MFA_MARKERS = (
    "duo", "duosecurity", "verify your identity", "2-step", "two-step", "two-factor", "security code", "authenticator",
    "push notification", "approve sign in", "verify it's you",
)


def _expand(batches: Iterator[pd.DataFrame], rows_of: Callable[[str], list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for page_id, html in batch.itertuples(index=False, name=None):
            rows += [(page_id, *row) for row in rows_of(html)]
            if len(rows) >= _BATCH:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _parsed(pages: DataFrame, rows_of: Callable[[str], list[tuple]], columns: str, id_col: str, html_col: str) -> DataFrame:
    schema = StructType([pages.schema[id_col], *StructType.fromDDL(columns).fields])
    walk = partial(_expand, rows_of=rows_of, names=schema.fieldNames())
    return _spread(pages.select(id_col, html_col)).mapInPandas(walk, schema)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly where they come in fewer partitions than keep the cores busy: parsing costs far more than moving them.

    A small file may hold very many short or much alike pages, and a file that is not split is one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def _table_rows(html: str, header_as_row: bool) -> list[tuple]:
    found = markup.tables(markup.parse(html), header_as_row)
    return [(t, r, cells) for t, rows in enumerate(found) for r, cells in enumerate(rows)]


def extract_tables(pages: DataFrame, header_as_row: bool = False, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows ``(page id, table_no, row_no, cells map)`` of all HTML tables and grids.

    Headers come from ``thead``, else from the first row; a blank header is ``col_i`` and a missing cell is empty.
    ``header_as_row`` also returns the header row as a data row.
    """
    rows = partial(_table_rows, header_as_row=header_as_row)
    return _parsed(pages, rows, "table_no int, row_no int, cells map<string,string>", id_col, html_col)


def _tag_texts(html: str, tag: str) -> list[tuple]:
    return list(enumerate(markup.texts(markup.parse(html), tag)))


def extract_text(pages: DataFrame, tag: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Text ``(page id, n, text)`` of every element with ``tag``; without a tag the whole page source."""
    if tag is None:
        return pages.select(id_col, F.lit(0).alias("n"), F.col(html_col).alias("text"))
    return _parsed(pages, partial(_tag_texts, tag=tag.lower()), "n int, text string", id_col, html_col)


def _buttons(html: str, max_chars: int | None) -> list[tuple]:
    return markup.buttons(markup.parse(html), max_chars)


def list_buttons(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_chars: int | None = None) -> DataFrame:
    """Buttons with text: index, text (all of it or so many characters), tag, id, test id and aria label."""
    columns = "index int, text string, tag string, id string, testid string, aria_label string"
    return _parsed(pages, partial(_buttons, max_chars=max_chars), columns, id_col, html_col)


def _inputs(html: str) -> list[tuple]:
    return markup.inputs(markup.parse(html))


def list_inputs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Form fields: index, tag, type, name, id, test id, placeholder, required, is_password; hidden fields left out."""
    columns = (
        "index int, tag string, type string, name string, id string, testid string, placeholder string, "
        "required boolean, is_password boolean"
    )
    return _parsed(pages, _inputs, columns, id_col, html_col)


def _contains_any(text: Column, markers: Sequence[str]) -> Column:
    condition = F.lit(False)
    for marker in markers:
        condition = condition | text.contains(marker)
    return condition


def page_title(html: Column) -> Column:
    """Source text of the title element."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def classify_pages(
    pages: DataFrame, url_col: str = "url", title: Column | None = None, body: Column | None = None, html_col: str = "html"
) -> DataFrame:
    """Adds ``is_login`` (markers in URL or title) and ``is_mfa`` (markers in URL, title or body)."""
    shown = F.lower(F.coalesce(title if title is not None else page_title(F.col(html_col)), F.lit("")))
    content = body if body is not None else F.regexp_replace(F.col(html_col), "<[^>]*>", " ")
    url = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    blob = F.concat_ws(" ", url, shown, F.lower(F.coalesce(content, F.lit(""))))
    return pages.withColumn("is_login", _contains_any(url, LOGIN_URLS) | _contains_any(shown, LOGIN_TITLES)).withColumn(
        "is_mfa", _contains_any(blob, MFA_MARKERS)
    )


def origin(url: Column) -> Column:
    """``scheme://authority`` of a URL."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.concat(scheme, F.lit("://"), authority), "/+$", "")


def origin_gate(pages: DataFrame, allowed: Sequence[str], url_col: str = "url") -> DataFrame:
    """Adds ``origin``, ``allowed`` and ``log``; an empty allow-list lets every origin through."""
    passes = F.lit(True) if not allowed else F.coalesce(F.col("origin").isin(list(allowed)), F.lit(False))
    gated = pages.withColumn("origin", origin(F.col(url_col))).withColumn("allowed", passes)
    return gated.withColumn("log", F.when(F.col("allowed"), F.col("origin")).otherwise(F.concat(F.lit("BLOCKED:"), F.col("origin"))))


def has_canvas(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``has_canvas``: the first canvas has a width, so charts on the page are not in the markup."""
    tag = F.regexp_extract(F.col(html_col), r"(?is)<canvas(\s[^>]*|)>", 1)
    width = F.regexp_extract(tag, r"""(?i)\bwidth\s*=\s*["']?(\d+)""", 1).try_cast("int")
    present = F.col(html_col).rlike(r"(?i)<canvas[\s>]")
    return pages.withColumn("has_canvas", F.coalesce(present & (F.coalesce(width, F.lit(300)) > 0), F.lit(False)))
