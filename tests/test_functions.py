"""Worked values of text, address, entity and markup functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.sources import html


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = value(spark, T.tokens(F.lit("OpenAI released GPT-4.1 in Python 3.13.")))
    assert got == ["openai", "released", "gpt-4.1", "python", "3.13"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, T.numbers(F.lit("3.13 and 3.13.0, 1,5 v2 7."))) == ["3.13", "1", "5", "7"]


@pytest.mark.parametrize(
    ("text", "scope"),
    [("events on 2026-03-25 in Astana", "2026-03-25"), ("released on 7 October 2024", "7 October 2024"), ("in Q2 2025 sales", "Q2 2025"), ("may 3 2021", "may 3 2021"), ("since 1999", None), ("in 2031!", "2031"), ("", None)],
)
def test_time_scope(spark, text, scope):
    assert value(spark, T.time_scope(T.words(F.lit(text)))) == scope


def test_relative_days(spark):
    assert value(spark, T.relative_days(F.lit("What happened today in Astana?"), F.lit("2026-03-25"))["text"]) == "What happened 2026-03-25 in Astana?"
    assert value(spark, T.relative_days(F.lit("Tomorrow, not todayish; сегодня"), F.lit("2026-03-25"))["text"]) == "2026-03-26, not todayish; 2026-03-25"


def test_sentences(spark):
    assert value(spark, T.sentences(F.lit("It cost 1.2.3 units. Really?! Yes.No  way"))) == ["It cost 1.2.3 units.", "Really?!", "Yes.", "No way"]


def test_citations(spark):
    assert value(spark, T.citation_groups(F.lit("a [1, 2;3] b [4] c [x] d ["))) == "a [1][2][3] b [4] c [x] d ["
    assert value(spark, T.citation_indices(F.lit("[3] [1] [3] [x]"))) == [1, 3]


def test_priors(spark):
    got = lambda h: value(spark, U.source_prior(F.lit(h)))
    assert got("press.example.com")["domain_type"] == "official" and got("press.example.com")["primary_boost"] > 0
    assert got("community.example.com")["domain_type"] == "forum" and got("community.example.com")["primary_boost"] < 0
    assert got("www.apple.com")["labels"] == "official_root"
    assert got("docs.blog.example.org")["source_prior"] == pytest.approx(0.16)
    assert got(None)["source_prior"] == 0 and got("x.example.org")["domain_type"] is None


def test_addresses(spark):
    got = lambda f, u: value(spark, f(F.lit(u)))
    assert got(U.canonical, "HTTPS://WWW.Example.com/a/?utm_source=x&b=1&flag#top") == "https://example.com/a?b=1&flag="
    assert got(U.repository, "https://github.com/microsoft/vscode/tree/main/src") == "microsoft/vscode"
    assert got(U.repository, "https://github.com/topics/python") is None
    assert got(U.arxiv_id, "https://arxiv.org/pdf/2312.12345.pdf") == "2312.12345"
    assert got(U.doi, "https://doi.org/10.1000/182") == "10.1000/182"
    assert got(U.paper_id, "https://www.semanticscholar.org/paper/arxiv/2312.12345v2") == "ARXIV:2312.12345"
    assert got(U.is_thread, "https://www.reddit.com/r/a/comments/b/c") is True
    assert got(U.registered_root, "news.bbc.co.uk") == "bbc.co.uk" and got(U.last_labels, "news.bbc.co.uk") == "co.uk"


PAGE = """<html><head><title>A &amp; B</title><meta name="Description" content=" said  so "><meta property="article:published_time" content="2024-05-01">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "author": [{"name": "Ann"}, {"name": "Bo"}], "datePublished": "2020"}]}</script></head>
<body><h1>Head</h1><p>short</p><p>This is a <b>long</b> enough paragraph to be kept by the reader, surely.</p><h2>Sub</h2></body></html>"""


def test_markup():
    s = html.signals(PAGE)
    assert s["title"] == "A & B" and s["headings"] == ["Head", "Sub"] and s["description"] == "said so"
    assert s["paragraphs"] == ["This is a long enough paragraph to be kept by the reader, surely."]
    assert s["author"] == "['Ann', 'Bo']" and s["published"] == "2024-05-01" and s["linked_type"] == "Article"
    assert html.signals(None)["title"] == "" and html.signals("<p>open")["paragraphs"] == []
