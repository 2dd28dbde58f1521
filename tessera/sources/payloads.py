"""Search payloads (JSON strings as a provider sends them) as rows of results, papers and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U

_ROW = "struct<title: string, url: string, description: string, snippet: string, page_age: string, age: string>"
_WEB = f"struct<web: struct<results: array<{_ROW}>>>"
_NEWS = f"struct<results: array<{_ROW}>, news: struct<results: array<{_ROW}>>>"
_FALLBACKS = ("reference", "web", "deep")


def _rows(payloads: DataFrame, found: Column, most: int, engine: str, published: Column) -> DataFrame:
    out = payloads.select("snapshot_id", F.posexplode(F.slice(F.coalesce(found, F.array().cast(f"array<{_ROW}>")), 1, most)).alias("k", "r"))
    url = F.trim(F.coalesce("r.url", F.lit("")))
    said = F.coalesce(F.nullif(F.col("r.description"), F.lit("")), F.col("r.snippet") if engine == "web" else F.lit(None).cast("string"), F.lit(""))
    return out.where(url != "").select(
        "snapshot_id", (F.col("k") + 1).alias("position"), F.trim(F.coalesce("r.title", F.lit(""))).alias("title"), url.alias("url"), F.trim(said).alias("snippet"),
        U.canonical(url).alias("canonical_url"), U.host(url).alias("host"), F.lit(engine).alias("engine"), published.alias("published"),
    )


def web_results(payloads: DataFrame, most: int = 20) -> DataFrame:
    """Rows of web payloads (snapshot_id, payload); positions count rows without an address, which then go."""
    return _rows(payloads, F.from_json("payload", _WEB)["web"]["results"], most, "web", F.lit(None).cast("string"))


def news_results(payloads: DataFrame, most: int = 50) -> DataFrame:
    """Rows of news payloads: the top list, or the nested one only where the top one is absent."""
    parsed = F.from_json("payload", _NEWS)
    day = F.nullif(F.trim(F.coalesce(F.nullif(F.col("r.page_age"), F.lit("")), F.col("r.age"))), F.lit(""))
    return _rows(payloads, F.coalesce(parsed["results"], parsed["news"]["results"]), most, "news", day)


def is_degraded(n_results: Column, unresponsive: Column) -> Column:
    return (n_results == 0) & (F.size(unresponsive) > 0)


def with_fallback(attempts: DataFrame) -> DataFrame:
    """The snapshot that a chain of attempts stops at: the first that has results or is not degraded, else the last.

    attempts: run_id, step, profile, query, n_results, unresponsive; a repeated profile and query counts once.
    """
    once = attempts.groupBy("run_id", "profile", "query").agg(F.min_by(F.struct("step", "n_results", "unresponsive"), "step").alias("a")).select("run_id", "profile", "query", "a.*")
    degraded = F.coalesce(is_degraded(F.col("n_results"), F.col("unresponsive")), F.lit(True))
    picked = F.min_by(F.struct("step", "profile", "query", "n_results"), F.struct(degraded.alias("degraded"), F.when(degraded, -F.col("step")).otherwise(F.col("step")).alias("at")))
    return once.groupBy("run_id").agg(picked.alias("p"), F.count("*").alias("n_attempts")).select("run_id", "p.*", "n_attempts")


def fallback_profiles(profile: Column) -> Column:
    return F.filter(T.strings(_FALLBACKS), lambda p: p != profile)


def routed_query(q: Column, engines: Column) -> Column:
    """The query behind filters for the engines that have a site of their own."""
    sites = F.create_map(*[F.lit(x) for name in ("wikipedia", "wikidata", "reddit", "arxiv") for x in (name, f"site:{name}.{'com' if name == 'reddit' else 'org'}")])
    own = F.filter(F.transform(engines, lambda e: F.element_at(sites, e)), lambda s: s.isNotNull())
    prefix = F.when(F.size(own) == 1, F.get(own, F.lit(0))).when(F.size(own) > 1, F.concat(F.lit("("), F.array_join(own, " OR "), F.lit(")")))
    return F.trim(F.concat_ws(" ", prefix, q))


def time_range(span: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in (("day", "pd"), ("week", "pw"), ("month", "pm"), ("year", "py")) for x in pair]), span)


def papers(payloads: DataFrame) -> DataFrame:
    """Entries of Atom documents (snapshot_id, payload): title, url, abstract, first three authors; both texts must be there."""
    schema = "entry array<struct<id: string, title: string, summary: string, author: array<struct<name: string>>>>"
    e = payloads.select("snapshot_id", F.posexplode(F.from_xml("payload", schema)["entry"]).alias("k", "e"))
    title, abstract = T.normalized(F.col("e.title")), T.normalized(F.col("e.summary"))
    authors = F.slice(F.filter(F.transform(F.coalesce("e.author", F.array().cast("array<struct<name: string>>")), lambda a: T.normalized(a["name"])), lambda n: n != ""), 1, 3)
    return e.select("snapshot_id", (F.col("k") + 1).alias("position"), title.alias("title"), F.trim("e.id").alias("url"), abstract.alias("abstract"), authors.alias("authors")).where("title <> '' and abstract <> ''")


def first_of_each(papers: DataFrame) -> DataFrame:
    """Of the papers of a run's feeds (run_id, feed, position, title, url) the first of each address, by feed and position; with n, how often it came."""
    first = F.min(F.struct("feed", "position", "title")).alias("f")
    return papers.groupBy("run_id", "url").agg(first, F.count("*").alias("n")).select("run_id", "url", "f.feed", "f.position", "f.title", "n")


def thread_text(payload: Column, most: int = 12) -> Column:
    """A discussion thread's JSON as text: title, facts, its words and the first comments that have words."""
    thing = "struct<kind: string, data: struct<title: string, selftext: string, score: bigint, subreddit: string, body: string, author: string>>"
    listing = F.from_json(payload, f"array<struct<data: struct<children: array<{thing}>>>>")
    post = F.get(F.get(listing, F.lit(0))["data"]["children"], F.lit(0))["data"]
    gone = lambda x: F.coalesce(F.trim(x), F.lit("")).isin("", "[deleted]", "[removed]")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    said = F.slice(F.filter(F.coalesce(F.get(listing, F.lit(1))["data"]["children"], F.array().cast(f"array<{thing}>")), lambda c: (c["kind"] == "t1") & ~gone(c["data"]["body"])), 1, most)
    lines = F.transform(said, lambda c: F.concat(F.lit("**"), text(c["data"]["author"]), F.lit("** ("), F.coalesce(c["data"]["score"], F.lit(0)).cast("string"), F.lit(" pts): "), F.substr(F.trim(c["data"]["body"]), F.lit(1), F.lit(600)), F.lit("\n")))
    head = F.array(F.concat(F.lit("# "), text(post["title"])), F.concat(F.lit("*r/"), text(post["subreddit"]), F.lit(" · "), F.coalesce(post["score"], F.lit(0)).cast("string"), F.lit(" upvotes*\n")), F.when(~gone(post["selftext"]), F.substr(F.trim(post["selftext"]), F.lit(1), F.lit(1500))))
    return F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), F.array(F.lit("\n## Top Comments\n")), lines), "\n")
