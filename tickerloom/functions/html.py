"""Fields of news pages (Arrow UDF around the standard HTML parser) and their links (column expressions)."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Class patterns of the elements that hold title, body and link grid.
TITLE_CLASS = r"title-.*block-"
BODY_CLASS = r"body-.*content-"
GRID_CLASS = r"^grid-"

ARTICLE = "struct<title: string, body: string, published: string>"


class _Page(HTMLParser):
    """Collects the text of the first matching divs and some attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.regions = {"title": TITLE_CLASS, "body": BODY_CLASS}
        self.depth: dict[str, int] = {}
        self.texts: dict[str, list[str]] = {}
        self.meta: dict[str, str] = {}
        self.times: dict[str, str | None] = {}
        self.raw = None
        self.json_ld: str | None = None

    def handle_starttag(self, tag, attrs):
        attr = dict(attrs)
        if tag == "div":
            for name, pattern in self.regions.items():
                if name in self.depth:
                    self.depth[name] += self.depth[name] > 0
                elif re.search(pattern, attr.get("class") or ""):
                    self.depth[name] = 1
                    self.texts[name] = []
        elif tag == "meta" and attr.get("property"):
            self.meta.setdefault(attr["property"], attr.get("content"))
        elif tag == "time":
            self.times.setdefault("time", attr.get("datetime"))
        elif tag == "relative-time":
            self.times.setdefault("relative", attr.get("event-time"))
        elif tag in ("script", "style"):
            self.raw = "json" if attr.get("type") == "application/ld+json" else "skip"

    def handle_endtag(self, tag):
        if tag == "div":
            for name, d in self.depth.items():
                self.depth[name] = max(0, d - 1)
        elif tag in ("script", "style"):
            self.raw = None

    def handle_data(self, data):
        if self.raw == "json" and self.json_ld is None:
            self.json_ld = data
        if self.raw is None and data.strip():
            for name, d in self.depth.items():
                if d > 0:
                    self.texts[name].append(data.strip())


def parse(html: str) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def article_fields(html: str) -> tuple[str | None, str, str | None]:
    """F-9, F-10, F-11: title, body and published time, each with its fallbacks."""
    page = parse(html)
    title = "".join(page.texts["title"]) if "title" in page.texts else page.meta.get("og:title")
    body = "\n".join(page.texts["body"]) if "body" in page.texts else page.meta.get("og:description")
    published = page.times.get("time") or page.times.get("relative")
    if not published and page.json_ld is not None:
        try:
            data = json.loads(page.json_ld)
            published = data.get("datePublished", data.get("dateCreated", ""))
        except (ValueError, AttributeError):
            published = None
    return title or None, body or "", published or None


def article(html: Column) -> Column:
    """Struct (title, body, published) of a page; the title is null where none is found."""

    @F.pandas_udf(ARTICLE)
    def fields(pages: pd.Series) -> pd.DataFrame:
        rows = [article_fields(p) for p in pages]
        return pd.DataFrame(rows, columns=["title", "body", "published"])

    return fields(html)


def article_text(fields: Column) -> Column:
    """Title and body as one text, null without a title."""
    return F.concat(fields["title"], F.lit("\n"), fields["body"])


_TAGS = r"(?is)<div\b[^>]*>|</div\s*>|<a\b[^>]*>"
_SKIPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in either quotes or none; empty if the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _unescaped(value: Column) -> Column:
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def links(html: Column, base: str, prefix: str = "/news/") -> Column:
    """F-12: absolute links of the link grid, or of the whole page if it has no grid.

    The grid is the first div with its class, up to the end tag that closes it; scripts, styles and comments are skipped.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _SKIPPED, " ")
    tags = F.regexp_extract_all(text, F.lit(_TAGS), F.lit(0))
    # 1 for a div that can be the grid, 2 for another div, 3 for an end tag, 4 for a link.
    marked = F.transform(
        tags,
        lambda t: F.struct(
            F.when(t.rlike("^</"), 3).when(t.rlike("(?i)^<a"), 4)
            .when(_attribute(t, "class").rlike(GRID_CLASS), 1).otherwise(2).alias("kind"),
            F.when(t.rlike("(?i)^<a"), _unescaped(_attribute(t, "href"))).alias("href"),
        ),
    )
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("found"), F.lit(0).alias("depth"), empty.alias("inside"), empty.alias("every"))

    def step(acc, t):
        opens = (~acc["found"] & (t["kind"] == 1)) | ((acc["depth"] > 0) & t["kind"].isin(1, 2))
        closes = (acc["depth"] > 0) & (t["kind"] == 3)
        link = t["kind"] == 4
        return F.struct(
            (acc["found"] | (t["kind"] == 1)).alias("found"),
            (acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(link & (acc["depth"] > 0), F.array_append(acc["inside"], t["href"])).otherwise(acc["inside"]).alias("inside"),
            F.when(link, F.array_append(acc["every"], t["href"])).otherwise(acc["every"]).alias("every"),
        )

    hrefs = F.aggregate(marked, start, step, lambda acc: F.when(acc["found"], acc["inside"]).otherwise(acc["every"]))
    wanted = F.filter(hrefs, lambda h: h.startswith(prefix) & (h != prefix))
    return F.transform(F.array_distinct(wanted), lambda h: F.concat(F.lit(base), h))
