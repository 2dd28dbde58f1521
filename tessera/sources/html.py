"""What a page's markup says: title, headings, paragraphs, metas and linked data, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT_TAGS = ("title", "h1", "h2", "p")
SIGNALS = "struct<title: string, headings: array<string>, paragraphs: array<string>, description: string, author: string, published: string, linked_type: string>"
#: The names of metas in use.
DESCRIPTION = ("description", "og:description", "twitter:description")
AUTHOR = ("author", "article:author", "parsely-author")
PUBLISHED = ("article:published_time", "og:article:published_time", "datepublished", "pubdate", "dc.date")


class _Events(HTMLParser):
    """The page as a flat list: +tag with attributes, -tag, or text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("+", tag, {k.lower(): v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append(("-", tag, {}))

    def handle_data(self, data):
        self.found.append(("", data, {}))


def _objects(data: object, depth: int = 0) -> list[tuple[int, dict]]:
    """The objects of linked data with how deep they lie: those of a list, and below each those of its graph."""
    if isinstance(data, list):
        return [x for item in data for x in _objects(item, depth)]
    if not isinstance(data, dict):
        return []
    graph = data.get("@graph")
    return [(depth, data), *(_objects(graph, depth + 1) if isinstance(graph, list) else [])]


def _author(value: object) -> list[str] | str | None:
    """An author's name, or the first three names of several; null where none is named."""
    named = lambda x: x["name"] if isinstance(x, dict) and x.get("name") else None
    return [n for n in map(named, value) if n][:3] or None if isinstance(value, list) else named(value)


def _linked(blocks: list[str]) -> dict:
    """Type, date and author that a page's linked data names first; items of graphs stand behind all that are not in one."""
    ordered: list[dict] = []
    for block in blocks:
        try:
            ordered += [item for _, item in sorted(_objects(json.loads(block)), key=lambda x: x[0])]
        except ValueError:
            continue
    values = {key: [item[key] for item in ordered if key in item] for key in ("@type", "datePublished")}
    values["author"] = [a for a in (_author(item.get("author")) for item in ordered) if a]
    return {key: found[0] for key, found in values.items() if found}


def _partners(found: list[tuple[str, str, dict]]) -> dict[int, int]:
    """For each opening tag that is closed the place where: a closing tag ends the latest open one, whatever their names."""
    waiting, out = [], {}
    for at, (kind, _, _) in enumerate(found):
        if kind == "+":
            waiting.append(at)
        elif kind == "-" and waiting:
            out[waiting.pop()] = at
    return out


def _elements(found: list[tuple[str, str, dict]], names: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """Name and text of the outermost elements with these names, in order; one that never ends takes the rest with it."""
    partner, behind = _partners(found), 0
    for at, (kind, what, _) in enumerate(found):
        if at < behind or kind != "+" or what not in names:
            continue
        if at not in partner:
            return
        behind = partner[at]
        yield what, " ".join("".join(text for kind, text, _ in found[at:behind] if not kind).split())


def _linked_blocks(found: list[tuple[str, str, dict]]) -> list[str]:
    """The texts of scripts that hold linked data; the parser gives a script as its tag, text and end."""
    out = []
    for at, (kind, what, attrs) in enumerate(found):
        if (kind, what) == ("+", "script") and attrs.get("type", "").strip().lower() == "application/ld+json":
            texts = list(itertools.takewhile(lambda x: not x[0], found[at + 1 :]))
            if found[at + 1 + len(texts) : at + 2 + len(texts)] == [("-", "script", {})]:
                out.append("".join(x[1] for x in texts).strip())
    return out


def signals(html: str | None) -> dict:
    """The signals of one page; damaged markup gives what could be read."""
    parser = _Events()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # the parser gives up on some broken declarations
        parser.found = []
    found = parser.found
    order = list(dict.fromkeys((name, text) for name, text in _elements(found, _TEXT_TAGS) if text))
    texts = {name: [t for n, t in order if n == name] for name in _TEXT_TAGS}
    metas = [((a.get("name") or a.get("property") or "").strip().lower(), " ".join(a.get("content", "").split())) for kind, what, a in found if (kind, what) == ("+", "meta")]
    blocks = _linked_blocks(found)
    first = lambda names: next((c for n, c in metas if n in names and c), "")
    linked = _linked([b for b in blocks if b])
    headings = list(dict.fromkeys(t for k, t in order if k in ("h1", "h2")))
    return {
        "title": texts["title"][0] if texts["title"] else "",
        "headings": headings[:6],
        "paragraphs": [p for p in texts["p"][:8] if len(p) >= 40][:3],
        "description": first(DESCRIPTION) or None,
        "author": first(AUTHOR) or str(linked.get("author", "")) or None,
        "published": first(PUBLISHED) or str(linked.get("datePublished", "")) or None,
        "linked_type": str(linked.get("@type", "")) or None,
    }


def page_signals(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) with their signals as columns."""

    @F.pandas_udf(SIGNALS)
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals(x) for x in html], columns=["title", "headings", "paragraphs", "description", "author", "published", "linked_type"])

    return pages.select("page_id", read("html").alias("s")).select("page_id", "s.*")


def summary(title: Column, description: Column, headings: Column, paragraphs: Column, most: int = 4000) -> Column:
    """Title, description, three headings and two paragraphs in one line, cut."""
    parts = F.concat(F.array(title, F.coalesce(description, F.lit(""))), F.slice(headings, 1, 3), F.slice(paragraphs, 1, 2))
    return F.substr(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(1), F.lit(most))
