"""Ingest queries: payloads made from the pages table and read again, pages' markup, entities, receipts, fetched documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.entities import entities, entities_sql, region_hint, region_hint_sql
from tessera.plans.registry import query
from tessera.session import shared_folder, table
from tessera.sources import html, payloads, receipts

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_URL = "case when page_id % 7 = 0 then '' else ' ' || url || ' ' end"


def _payloads(spark: SparkSession, sf_dir: str, news: bool) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 10).alias("snapshot_id"), "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit(" "), "url", F.lit(" "))).alias("url"), F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), F.col("page_id").cast("string"))).alias("description"),
        F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("snippet"), F.when(F.col("page_id") % 4 == 0, F.lit("2024-01-02")).alias("page_age"), F.lit("3 days").alias("age"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "title", "url", "description", "snippet", "page_age", "age"))), lambda r: r.dropFields("page_id"))
    grouped = p.groupBy("snapshot_id").agg(rows.alias("rows"))
    nested = F.to_json(F.struct(F.struct(F.col("rows").alias("results")).alias("news" if news else "web")))
    return grouped.select("snapshot_id", F.when(F.col("snapshot_id") % 2 == 0, F.to_json(F.struct(F.col("rows").alias("results")))).otherwise(nested).alias("payload") if news else nested.alias("payload"))


def _rows_sql(engine: str, most: int, snippet: str, published: str) -> str:
    return (
        f"select snapshot_id, position, title, url, {snippet} as snippet, {U.canonical_sql('url')} as canonical_url, {U.host_sql('url')} as host, '{engine}' as engine, {published} as published from ("
        f"select page_id, page_id // 10 as snapshot_id, (page_id % 10 + 1)::int as position, trim({_TITLE}) as title, trim({_URL}) as url from pages) where url <> '' and position <= {most}"
    )


@query(_rows_sql("web", 8, "case when page_id % 3 = 0 then 's' else 'd' end || page_id", "null::varchar"))
def web_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web payloads as result rows, eight of each at most."""
    return payloads.web_results(_payloads(spark, sf_dir, news=False), 8)


@query(_rows_sql("news", 10, "case when page_id % 3 = 0 then '' else 'd' || page_id end", "case when page_id % 4 = 0 then '2024-01-02' else '3 days' end"))
def news_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News payloads as result rows, the list at the top or nested."""
    return payloads.news_results(_payloads(spark, sf_dir, news=True), 10)


@query(
    "with a as (select user_id as run_id, event_id as step, event_type as profile, 'q' || (event_id % 2) as query, case when value > 12 then 3 else 0 end as n_results, event_id % 5 <> 0 as bad from events), "
    "o as (select * from (select *, row_number() over (partition by run_id, profile, query order by step) as k from a) where k = 1), s as (select *, row_number() over (partition by run_id order by n_results = 0 and bad, case when n_results = 0 and bad then -step else step end) as r, count(*) over (partition by run_id) as n_attempts from o) "
    "select run_id, step, profile, query, n_results, n_attempts from s where r = 1"
)
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as search attempts: where each user's chain stops."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return payloads.with_fallback(e.select(F.col("user_id").alias("run_id"), k.alias("step"), F.col("event_type").alias("profile"), F.concat(F.lit("q"), (k % 2).cast("string")).alias("query"), F.when(F.col("value") > 12, 3).otherwise(0).alias("n_results"), F.when(k % 5 != 0, F.array(F.lit("engine"))).otherwise(F.array().cast("array<string>")).alias("unresponsive")))




@query(
    "select page_id, case page_id % 4 when 0 then 'site:wikipedia.org ' when 1 then '(site:arxiv.org OR site:reddit.com) ' else '' end || trim(" + _TITLE + ") as routed, ['pd', 'pw', 'pm', 'py', null][(page_id % 5) + 1] as time_range, "
    "array_to_string(list_filter(['reference', 'web', 'deep'], lambda p: p <> ['web', 'deep', 'news'][(page_id % 3) + 1]), ',') as fallbacks from pages"
)
def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as queries, routed to engines, with the provider's time range and the profiles to fall back on."""
    k = F.col("page_id")
    engines = F.when(k % 4 == 0, F.array(F.lit("wikipedia"))).when(k % 4 == 1, F.array(F.lit("arxiv"), F.lit("reddit"))).when(k % 4 == 2, F.array(F.lit("google"))).otherwise(F.array().cast("array<string>"))
    pick = lambda names: F.element_at(T.strings(names), (k % len(names) + 1).cast("int"))
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", payloads.routed_query(title, engines).alias("routed"), payloads.time_range(pick(("day", "week", "month", "year", "decade"))).alias("time_range"), F.array_join(payloads.fallback_profiles(pick(("web", "deep", "news"))), ",").alias("fallbacks"))


@query(
    f"select page_id, 'doc-' || left(h, 12) as fetched_id, h as content_hash, {T.normalized_sql('html')} = '' as empty from (select page_id, html, sha1({T.normalized_sql('html')}) as h from pages)"
)
def fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched documents, named by a digest of their collapsed content."""
    content = T.normalized(F.col("html"))
    h = F.sha1(content)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("doc-"), F.substr(h, F.lit(1), F.lit(12))).alias("fetched_id"), h.alias("content_hash"), (content == "").alias("empty"))


@query()
def html_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, headings, paragraphs and metas of every page, with a summary."""
    s = html.page_signals(table(spark, sf_dir, "pages"))
    line = html.summary(F.col("title"), F.col("description"), F.col("headings"), F.col("paragraphs"))
    return s.select("page_id", "title", F.array_join("headings", "|").alias("headings"), F.size("paragraphs").alias("n_paragraphs"), "author", "published", F.md5(line).alias("summary_md5"))


_NAMED = "case (conv_id + turn) % 4 when 0 then 'What did Bank of America and \"Goldman  Sachs\" say in New York City? ' || text when 1 then 'News from the U.S. Dept. of X1 GPT-4.1, for Astana — ' || text else text end"


@query(f"select conv_id, turn, array_to_string({entities_sql(_NAMED)}, '|') as entities, {region_hint_sql(_NAMED)} as region from conversations")
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and the region of every turn; half of them get a beginning with names."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    said = F.when(k == 0, F.concat(F.lit('What did Bank of America and "Goldman  Sachs" say in New York City? '), "text")).when(k == 1, F.concat(F.lit("News from the U.S. Dept. of X1 GPT-4.1, for Astana — "), "text")).otherwise(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return c.select("conv_id", "turn", F.array_join(entities(F.col("said")), "|").alias("entities"), region_hint(F.col("said")).alias("region"))


_COUNTED = ", ".join(f"count(*) filter (where turn % 3 {op}) as {v}_claims" for op, v in (("= 0", "supported"), ("= 1", "contradicted"), ("not in (0, 1)", "insufficient_evidence")))


@query(
    f"with r as (select conv_id, arg_min(text, turn) as query, arg_max(text, turn) as answer, count(*) as claim_count, {_COUNTED}, string_agg(turn || '=' || case turn % 3 when 0 then 'supported' when 1 then 'contradicted' else 'insufficient_evidence' end, ' ' order by turn) as claims, to_timestamp(1700000000 + conv_id) at time zone 'UTC' as started from conversations group by conv_id), "
    f"n as (select *, strftime(started, '%Y%m%dT%H%M%SZ') || '-' || left(sha1(query || '|' || strftime(started, '%Y-%m-%dT%H:%M:%S')), 8) as run_id, coalesce(nullif(left(regexp_replace(regexp_replace({T.fold_sql('query')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'query') as slug from r) "
    "select run_id, strftime(started, '%Y%m%d') as day, run_id || '-' || slug as name, md5(query) as query_md5, md5(answer) as answer_md5, strftime(started, '%Y-%m-%dT%H:%M:%S') as started_at, claim_count, supported_claims, contradicted_claims, insufficient_evidence_claims, claims from n"
)
def run_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs with a receipt each, written twice to one folder and read from it."""
    c = table(spark, sf_dir, "conversations")
    started = F.timestamp_seconds(1_700_000_000 + F.col("conv_id"))
    runs = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.max_by("text", "turn").alias("answer")).select(receipts.run_id(F.col("query"), started).alias("run_id"), "conv_id", "query", "answer", started.alias("started"))
    verdict = F.when(F.col("turn") % 3 == 0, "supported").when(F.col("turn") % 3 == 1, "contradicted").otherwise("insufficient_evidence")
    claims = c.join(runs.select("conv_id", "run_id"), "conv_id").select("run_id", F.col("turn").alias("claim_id"), verdict.alias("verdict"))
    place, rows = shared_folder(spark, "receipts"), receipts.receipts(runs.drop("conv_id"), claims)
    receipts.write_receipts(rows.where("hash(run_id) % 2 = 0"), place)
    receipts.write_receipts(rows, place)
    numbers = ("claim_count", "supported_claims", "contradicted_claims", "insufficient_evidence_claims")
    payload = F.from_json("payload", f"user_query string, answer string, started_at string, summary struct<{', '.join(f'{n}: long' for n in numbers)}>, claims array<struct<claim_id: long, verdict: string>>")
    read = receipts.read_receipts(spark, place).withColumn("p", payload)
    told = F.array_join(F.transform("p.claims", lambda x: F.concat_ws("=", x["claim_id"].cast("string"), x["verdict"])), " ")
    return read.select("run_id", "day", "name", F.md5("p.user_query").alias("query_md5"), F.md5("p.answer").alias("answer_md5"), "p.started_at", *[f"p.summary.{n}" for n in numbers], told.alias("claims"))


def _feeds(pages: DataFrame) -> DataFrame:
    """Atom documents (snapshot_id, payload) of pages with a snapshot_id, in the order of page_id."""
    k, escaped = F.col("page_id"), lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    p = pages.select("snapshot_id", "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<p>([^<]{40,})", 1).alias("text"))
    names = F.slice(T.words(F.col("title")), 1, F.least(F.lit(3), k % 6).cast("int"))
    authors = F.array_join(F.transform(names, lambda n: F.concat(F.lit("<author><name> "), escaped(n), F.lit(" </name></author>"))), "")
    said = F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), escaped(F.col("text")), F.lit("\n")))
    entry = F.concat(F.lit("<entry><id> "), escaped(F.col("url")), F.lit(" </id><title>\n "), escaped(F.col("title")), F.lit("</title><summary>"), said, F.lit("</summary>"), authors, F.lit("</entry>"))
    held = p.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry")))).alias("e"))
    return held.select("snapshot_id", F.concat(F.lit("<feed>"), F.array_join(F.col("e")["entry"], ""), F.lit("</feed>")).alias("payload"))


_PAPER_TITLE, _PAPER_TEXT = T.normalized_sql(_TITLE), T.normalized_sql("regexp_extract(html, '<p>([^<]{40,})', 1)")


@query(
    f"with p as (select page_id, {_PAPER_TITLE} as title, trim(url) as url, case when page_id % 5 = 0 then '' else {_PAPER_TEXT} end as abstract, {T.words_sql(_TITLE)} as names from pages) "
    "select page_id // 10 as snapshot_id, (page_id % 10 + 1)::int as position, title, url, abstract, array_to_string(names[1:least(3, page_id % 6)], ',') as authors from p where title <> '' and abstract <> ''"
)
def paper_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom documents of ten pages each as papers, with the words of a title as authors; entries without words in both texts are left out."""
    p = table(spark, sf_dir, "pages").withColumn("snapshot_id", F.floor(F.col("page_id") / 10))
    return payloads.papers(_feeds(p)).select("snapshot_id", "position", "title", "url", "abstract", F.array_join("authors", ",").alias("authors"))


_PAPERS = f"select page_id, {_PAPER_TITLE} as title, trim(url) as url, case when page_id % 5 = 0 then '' else {_PAPER_TEXT} end as abstract, {T.tokens_sql(_PAPER_TITLE)} as tokens from pages"


@query(
    f"with p as ({_PAPERS}), f as (select *, page_id // 30 as run_id, page_id // 10 % 3 as feed from p union all select *, page_id // 30, 3 from p where page_id % 3 = 0), "
    "k as (select *, row_number() over (partition by run_id, feed order by page_id) as position from f), o as (select * from k where title <> '' and abstract <> '') "
    "select run_id, url, array_to_string(tokens, ' ') as title_key, feed::int as feed, position::int as position, n from (select *, row_number() over (partition by run_id, url order by feed, position) as r, count(*) over (partition by run_id, url) as n from o) where r = 1"
)
def research_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the four feeds of each run, of which one repeats papers of the others: the first of each address stays."""
    k = F.col("page_id")
    feeds = F.array(F.floor(k / 10) % 3, F.when(k % 3 == 0, F.lit(3).cast("long")))
    p = table(spark, sf_dir, "pages").withColumn("feed", F.explode(feeds)).where("feed is not null").withColumn("snapshot_id", F.struct(F.floor(k / 30).alias("run_id"), F.col("feed").cast("int").alias("feed")))
    found = payloads.papers(_feeds(p)).select("snapshot_id.*", "position", "title", "url")
    return payloads.first_of_each(found).select("run_id", "url", F.array_join(T.tokens(F.col("title")), " ").alias("title_key"), "feed", "position", "n")


@query(
    "with c as (select conv_id, turn, coalesce(role, '') as role, case when turn % 7 = 6 then '[removed]' else trim(coalesce(text, '')) end as said from conversations), "
    "h as (select conv_id, said from c where turn = 0), "
    "k as (select *, row_number() over (partition by conv_id order by turn) as n from c where turn > 0 and said not in ('', '[deleted]', '[removed]')) "
    "select h.conv_id, md5(concat_ws(chr(10), '# Talk ' || h.conv_id, '*r/talks · ' || (h.conv_id % 9) || ' upvotes*' || chr(10), case when h.said not in ('', '[deleted]', '[removed]') then left(h.said, 1500) end, chr(10) || '## Top Comments' || chr(10), "
    "string_agg('**' || role || '** (' || turn || ' pts): ' || left(k.said, 600) || chr(10), chr(10) order by turn) filter (where n <= 12))) as text_md5 from h left join k on h.conv_id = k.conv_id group by h.conv_id, h.said"
)
def thread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as discussion threads in JSON, read as text: the first turn is the post, the others are comments."""
    said = F.when(F.col("turn") % 7 == 6, "[removed]").otherwise(F.coalesce("text", F.lit("")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("said"))
    empty = F.trim("said").isin("", "[deleted]", "[removed]")
    kept = F.row_number().over(Window.partitionBy("conv_id", "empty").orderBy("turn")) <= 12  # of a thread's comments a text has twelve
    comment = F.struct(F.lit("t1").alias("kind"), F.struct(F.col("said").alias("body"), F.col("role").alias("author"), F.col("turn").alias("score")).alias("data"))
    listed = c.where("turn > 0").withColumn("empty", empty).withColumn("kept", kept).where("kept").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))).alias("all")).select("conv_id", F.col("all")["c"].alias("comments"))
    post = F.struct(F.lit("t3").alias("kind"), F.struct(F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.col("said").alias("selftext"), (F.col("conv_id") % 9).alias("score"), F.lit("talks").alias("subreddit")).alias("data"))
    listing = lambda children: F.concat(F.lit('{"data": {"children": '), F.coalesce(F.to_json(children), F.lit("[]")), F.lit("}}"))
    threads = c.where("turn = 0").join(listed, "conv_id", "left").select("conv_id", F.concat(F.lit("["), listing(F.array(post)), F.lit(", "), listing(F.col("comments")), F.lit("]")).alias("payload"))
    return threads.select("conv_id", F.md5(payloads.thread_text(F.col("payload"))).alias("text_md5"))
