"""Web pages as rows: titles, elements, attributes and tables of an html column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: elements that have no end tag
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# fixed values: elements whose end tag may be left out, what closes them, and what they may not be closed through
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": (frozenset(["li"]), frozenset(["ul", "ol"])), "p": (_BLOCKS, frozenset(["body", "div", "td", "th", "li", "button"])),
           "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
           "td": (frozenset(["td", "th", "tr"]), frozenset(["table"])), "th": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
           "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"]))}

#: for a start tag, the open elements that its end of others does not reach through
WALLS = {tag: frozenset().union(*[through for closed, through in IMPLIED.values() if tag in closed])
         for tag in frozenset().union(*[closed for closed, _ in IMPLIED.values()])}
_NONE = ((), ())


def title(html: Column) -> Column:
    """Text of the first title element, NULL without one; the usual character references are decoded."""
    text = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.nullif(text, F.lit(""))


def attribute_values(df: DataFrame, page: str, html: str, names: Sequence[str] = ("href", "src", "title")) -> DataFrame:
    """(page, attribute, value) for every attribute of the given names, quoted in either way or not at all."""
    wanted = "|".join(names)
    hit = F.explode(F.regexp_extract_all(html, F.lit(rf"""(?<=\s)(?:{wanted})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)"""), F.lit(0)))
    found = df.select(page, hit.alias("hit"))
    return found.select(
        page, F.regexp_extract("hit", r"^(\w+)", 1).alias("attribute"), F.regexp_extract("hit", r"""(?s)=\s*(["']?)(.*)\1$""", 2).alias("value"))


class _Elements(HTMLParser):
    """Collects (tag, class, text, attributes) of elements that carry a class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.titles: list[tuple[str, list[dict]]] = []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        walls = WALLS.get(tag)
        # a tag that closes nothing leaves all open elements as they are
        for depth in range(len(self.open) - 1, -1, -1) if walls is not None else ():
            if tag in IMPLIED.get(self.open[depth]["tag"], _NONE)[0]:
                del self.open[depth:]
            elif self.open[depth]["tag"] in walls:
                break
        item = {"tag": tag, "class": attrs.get("class"), "text": [], "attrs": attrs}
        if attrs.get("title"):
            self.titles.append((attrs["title"], list(self.open)))
        if item["class"] is not None:
            item["up"] = list(self.open)
            self.found.append(item)
        if tag not in VOID:
            self.open.append(item)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        for item in self.open:
            if item["class"] is not None:
                item["text"].append(data)


def titles_of_items(df: DataFrame, page: str, html: str, item: str, marks: Sequence[str]) -> DataFrame:
    """(page, title): titles inside elements of class ``item`` that hold an element with all classes of ``marks``.

    A title is the attribute of that name of an element in the item.  An item in
    an item gives its titles for each that is marked.  Null and empty pages have none.
    """
    wanted = frozenset(marks)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, source in zip(batch["page"], batch["html"]):
                parser = _Elements()
                parser.feed(source or "")
                parser.close()
                marked = {id(u) for e in parser.found if wanted <= set(e["class"].split()) for u in e["up"]
                          if item in (u["class"] or "").split()}
                rows += [(key, text) for text, up in parser.titles for u in up if id(u) in marked]
            yield pd.DataFrame(rows, columns=["page", "title"])

    kind = df.schema[page].dataType.simpleString()
    out = df.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(parse, f"page {kind}, title string")
    return out.withColumnRenamed("page", page)


def select_by_class(df: DataFrame, page: str, html: str, classes: Sequence[str] | None = None) -> DataFrame:
    """One row per element with a class: (page, n, tag, class, text, attrs).

    ``classes`` keeps elements that carry one of the given class names.
    """
    wanted = frozenset(classes) if classes else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, source in zip(batch["page"], batch["html"]):
                parser = _Elements()
                parser.feed(source or "")
                parser.close()
                for n, e in enumerate(parser.found):
                    if wanted is None or wanted & set(e["class"].split()):
                        rows.append((key, n, e["tag"], e["class"], "".join(e["text"]), e["attrs"]))
            yield pd.DataFrame(rows, columns=["page", "n", "tag", "class", "text", "attrs"])

    kind = df.schema[page].dataType.simpleString()
    out = df.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(
        parse, f"page {kind}, n int, tag string, class string, text string, attrs map<string,string>")
    return out.withColumnRenamed("page", page)


class _Tables(HTMLParser):
    """Collects the cells of all tables row by row; inner tables count on their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables = 0
        self.stack: list[dict] = []
        self.rows: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append({"no": self.tables, "row": -1, "cells": None, "cell": None})
            self.tables += 1
        elif self.stack and tag == "tr":
            self._end_row()
            top = self.stack[-1]
            top["row"] += 1
            top["cells"] = []
        elif self.stack and tag in ("td", "th") and self.stack[-1]["cells"] is not None:
            self._end_cell()
            self.stack[-1]["cell"] = []

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_row()
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"].append(data)

    def _end_cell(self):
        top = self.stack[-1]
        if top["cell"] is not None:
            top["cells"].append("".join(top["cell"]).strip())
            top["cell"] = None

    def _end_row(self):
        self._end_cell()
        top = self.stack[-1]
        if top["cells"] is not None:
            self.rows.append((top["no"], top["row"], top["cells"]))
            top["cells"] = None


def read_tables(df: DataFrame, page: str, html: str) -> DataFrame:
    """(page, table_no, row_no, cells) of all tables of each page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, source in zip(batch["page"], batch["html"]):
                parser = _Tables()
                parser.feed(source or "")
                parser.close()
                rows += [(key, *r) for r in parser.rows]
            yield pd.DataFrame(rows, columns=["page", "table_no", "row_no", "cells"])

    kind = df.schema[page].dataType.simpleString()
    out = df.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(
        parse, f"page {kind}, table_no int, row_no int, cells array<string>")
    return out.withColumnRenamed("page", page)
