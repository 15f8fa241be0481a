"""Web pages: parsing HTML, the gates a response must pass, robots rules."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# Elements that hold no text, link schemes that lead to no page, accepted types, largest body.
SKIPPED = {"script", "style", "noscript", "template", "svg"}
NO_PAGE = ("mailto:", "javascript:", "tel:", "#")
TYPES = ("text/html", "application/xhtml+xml")
LARGEST = 10 * 1024 * 1024
THIN = 200
AGENT = "postloom"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.links: list[str] = []
        self.title: list[str] | None = None
        self.skipping: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif not self.skipping:
            if tag == "title" and self.title is None:
                self.title, self.in_title = [], True
            href = dict(attrs).get("href") if tag == "a" else None
            if href is not None and not href.startswith(NO_PAGE):
                self.links.append(href)

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.skipping:
            del self.skipping[len(self.skipping) - 1 - self.skipping[::-1].index(tag) :]
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.skipping or not data.strip():
            return
        self.texts.append(data.strip())
        if self.in_title:
            self.title.append(data.strip())


def read_page(html: str | None, base: str | None) -> dict:
    """Title, text (pieces set apart by single blanks, the title among them) and resolved links of a page."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    links = []
    for x in r.links:
        try:
            links.append(urljoin(base or "", x))
        except ValueError:
            continue
    return {"title": "".join(r.title or []), "text": " ".join(r.texts), "links": links}


_PARSED = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(StringType()))])


@F.pandas_udf(_PARSED)
def parsed(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h, b) for h, b in zip(pages, bases, strict=True)], columns=["title", "text", "links"])


parsed = parsed.asNondeterministic()  # once per page, also below an explode


def body_text(body: Column) -> Column:
    """The bytes of a body as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def gate(status: Column, content_type: Column, n_bytes: Column) -> Column:
    """Why a response is turned away, or ``ok``."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (
        F.when(status.isNull(), "failed").when(status != 200, "status").when(~kind.isin(*TYPES), "type").when(n_bytes > LARGEST, "size").otherwise("ok")
    )


@F.pandas_udf(BooleanType())
def _may_fetch(urls: pd.Series, rules: pd.Series) -> pd.Series:
    known: dict[str, RobotFileParser] = {}
    out = []
    for url, text in zip(urls, rules, strict=True):
        if text is None:
            out.append(True)
            continue
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse(text.splitlines())
        out.append(known[text].can_fetch(AGENT, url))
    return pd.Series(out, dtype=bool)


def allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """``urls`` (url) with ``host`` and ``allowed``; a host without rules (host, robots_txt) allows all.

    A host is named as in its addresses, with its port if they state one: each port has rules of its own.
    """
    from postloom.operators.skew import lookup_join

    hosts = urls.withColumn("host", F.expr("try_parse_url(url, 'AUTHORITY')"))
    return lookup_join(hosts, robots, ["host"]).withColumn("allowed", _may_fetch("url", "robots_txt")).drop("robots_txt")
