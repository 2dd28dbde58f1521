"""Recorded data written as JSON lines from the tables, spoilt here and there, and read again; a payload archive likewise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.session import shared_folder, table
from tessera.sources import archive, records

#: Which lines are spoilt, by the row's number n: truncated, blank, no object, without what is required.
_SPOILT = "case when n % 7 = 3 then 'corrupt' when n % 11 = 4 then 'blank' when n % 13 = 6 then 'no_object' when n % 17 = 8 then 'incomplete' end"


def _written(spark: SparkSession, rows: DataFrame, line: Column, incomplete: str) -> str:
    """The rows (with a number n) as text files of lines, spoilt; returns the folder."""
    why = F.expr(_SPOILT)
    spoilt = F.when(why == "corrupt", F.left(line, F.length(line) - 2)).when(why == "blank", "  ").when(why == "no_object", "[1, 2]").when(why == "incomplete", incomplete).otherwise(line)
    place = shared_folder(spark, "lines")
    rows.select(spoilt.alias("value")).write.text(place)
    return place


def _case_lines(spark: SparkSession, sf_dir: str) -> str:
    n = F.col("n")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.left("text", F.lit(40)).alias("query"))
    head = F.to_json(F.struct(F.concat(F.lit("c"), n.cast("string")).alias("case_id"), F.when(n % 3 == 0, "dev").otherwise("test").alias("split"), "query", F.when(n % 2 == 0, "deep").alias("profile"), F.when(n % 4 == 0, n).alias("min_answer_chars")))
    route = F.when(n % 3 == 0, '"fast"').when(n % 3 == 1, '["fast", "full"]').otherwise("null")
    claims = F.concat(F.lit('[{"match": "m", "expected_verdict": "supported", "expected_route": '), route, F.lit(', "min_independent_sources": '), (n % 4).cast("string"), F.lit('}, {"match": "n", "expected_verdict": "contradicted", "requires_primary_source": true}]'))
    line = F.concat(F.left(head, F.length(head) - 1), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(', "expected_claims": '), claims)), F.lit("}"))
    return _written(spark, b, line, '{"query": "no id"}')


@query(
    "select 'c' || n as case_id, case when n % 3 = 0 then 'dev' else 'test' end as split, query, case when n % 2 = 0 then 'deep' else 'web' end as profile, case when n % 4 = 0 then n::int end as min_answer_chars, "
    "case when n % 5 = 0 then '' else 'm|supported|false|' || case n % 3 when 0 then 'fast' when 1 then 'fast,full' else '' end || '|' || (n % 4) || ';n|contradicted|true||none' end as claims "
    f"from (select item_id as n, left(text, 40) as query from benchmark) where {_SPOILT} is null"
)
def evaluation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases in JSON lines, with routes that are one or several, read again."""
    c = records.cases(spark, _case_lines(spark, sf_dir))
    told = F.transform("expected_claims", lambda x: F.concat_ws("|", x["match"], x["expected_verdict"], x["requires_primary_source"].cast("string"), F.array_join(x["expected_routes"], ","), F.coalesce(x["min_independent_sources"].cast("string"), F.lit("none"))))
    return c.select("case_id", "split", "query", "profile", "min_answer_chars", F.array_join(told, ";").alias("claims"))


@query(f"select skipped, count(*) as n from (select {_SPOILT} as skipped from (select item_id as n from benchmark)) where skipped is not null group by skipped")
def skipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of the case files are skipped, by reason."""
    return records.skipped(records.lines(spark, _case_lines(spark, sf_dir), ("case_id",)))


_SCORES = ("source_prior", "primary_source_likelihood", "freshness_score", "seo_spam_risk", "entity_match_score", "semantic_match_score", "source_score")


@query(
    "select 'r' || n as result_id, url, case when n % 3 = 0 then 'https://c.org/' || n else url end as canonical_url, case when n % 2 = 0 then 'h' || n else '' end as host, title, case when n % 4 = 1 then n::int else 0 end as position, "
    "case when n % 3 = 0 then 'official' else 'unknown' end as domain_type, round((n % 10) / 10e0, 2) as source_score, case when n % 5 = 0 then 'a,b' else '' end as reasons, case when n % 4 = 0 then 'v1,v2' else '' end as variants "
    f"from (select page_id as n, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) where {_SPOILT} is null"
)
def recorded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated results in JSON lines, nested and with fields left out, read again with defaults."""
    n, some = F.col("n"), F.array(F.lit("a"), F.lit("b"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    serp = F.struct(F.concat(F.lit("r"), n.cast("string")).alias("result_id"), "url", "title", F.when(n % 3 == 0, F.concat(F.lit("https://c.org/"), n.cast("string"))).alias("canonical_url"), F.when(n % 2 == 0, F.concat(F.lit("h"), n.cast("string"))).alias("host"), F.when(n % 4 == 1, n).alias("position"))
    own = F.struct(F.when(n % 3 == 0, "official").otherwise("unknown").alias("domain_type"), *[((n % 10) / 10).alias(c) for c in _SCORES], F.when(n % 5 == 0, some).alias("reasons"))
    line = F.to_json(F.struct(serp.alias("serp"), own.alias("assessment"), F.when(n % 4 == 0, F.array(F.lit("v1"), F.lit("v2"))).alias("matched_variant_ids")))
    g = records.gated_results(spark, _written(spark, p, line, '{"serp": {"result_id": "x"}}'))
    return g.select("serp.result_id", "serp.url", "serp.canonical_url", "serp.host", "serp.title", "serp.position", "assessment.domain_type", F.round("assessment.source_score", 2).alias("source_score"), F.array_join("assessment.reasons", ",").alias("reasons"), F.array_join("matched_variant_ids", ",").alias("variants"))


@query(
    f"with s as (select *, {_SPOILT} as why from (select page_id // 5 as n, page_id, url from pages)) select 'q ' || n as query, case when n % 2 = 0 then 'deep' end as profile_name, case when n % 3 = 0 then 'e1,e2' else '' end as unresponsive, "
    "coalesce(string_agg('r' || page_id || '@' || url, ' ' order by page_id) filter (where page_id % 6 <> 1), '') as results from s where why is null group by n"
)
def recorded_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search snapshots of five pages in JSON lines; results without an address go."""
    n, page = F.col("n"), F.col("page_id")
    p = table(spark, sf_dir, "pages").select(F.floor(page / 5).alias("n"), "page_id", "url")
    one = F.struct("page_id", F.struct(F.concat(F.lit("r"), page.cast("string")).alias("result_id"), F.when(page % 6 != 1, F.col("url")).alias("url")).alias("r"))
    held = p.groupBy("n").agg(F.array_sort(F.collect_list(one)).alias("all"))
    line = F.to_json(F.struct(F.concat(F.lit("q "), n.cast("string")).alias("query"), F.when(n % 2 == 0, "deep").alias("profile_name"), F.when(n % 3 == 0, F.array(F.lit("e1"), F.lit("e2"))).alias("unresponsive_engines"), F.col("all")["r"].alias("results")))
    s = records.snapshots(spark, _written(spark, held, line, '{"results": []}'))
    told = F.transform("results", lambda r: F.concat(r["result_id"], F.lit("@"), r["url"]))
    return s.select("query", "profile_name", F.array_join("unresponsive_engines", ",").alias("unresponsive"), F.array_join(told, " ").alias("results"))


_AUTHORS = "case when page_id % 4 = 0 then '' else 'Authors: ' || case kind when 'doi' then 'G. Family' || page_id || ', Only' else 'P' || page_id end || chr(10) || chr(10) end"


@query(
    "with p as (select page_id, ['repository', 'doi', 'paper'][(page_id % 3 + 1)::int] as kind, regexp_extract(html, '<title>([^<]*)</title>', 1) as t, regexp_extract(html, '<p>([^<]{40,})', 1) as body from pages), "
    f"n as (select page_id, kind, {T.normalized_sql('t')} as t, {T.normalized_sql('body')} as body from p), "
    "d as (select page_id, kind, case kind when 'repository' then 'o/r' || page_id when 'doi' then case when t = '' then 'Crossref work' else t end else case when t = '' then 'Semantic Scholar paper' else t end end as title, "
    "case kind when 'repository' then 'https://github.com/o/r' || page_id when 'doi' then 'https://doi.org/10.1/' || page_id else 'https://www.semanticscholar.org/paper/' || page_id end as final_url, body from n), "
    "x as (select *, case kind when 'repository' then concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), case when body <> '' then '# README' || chr(10) || chr(10) || body end, case when page_id % 2 = 0 then '# Latest release (v' || page_id || ')' || chr(10) || chr(10) || 'notes' end) "
    f"when 'doi' then '# ' || title || chr(10) || chr(10) || {_AUTHORS} || case when page_id % 2 = 0 and body <> '' then body else 'Journal - [2024, 5]' end else '# ' || title || chr(10) || chr(10) || 'Year: 2020' || chr(10) || chr(10) || {_AUTHORS} || body end as text from d) "
    "select page_id, kind, title, final_url, split_part(content, chr(10) || chr(10), 1) as first_paragraph, md5(content) as content_md5 from (select *, left(trim(text, ' ' || chr(10)), 300) as content from x) where text <> '' and kind in ('doi', 'repository')"
)
def payload_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an archive of repository, work and paper payloads, of which two kinds are read through the data source."""
    page, kinds = F.col("page_id"), F.array(F.lit("repository"), F.lit("doi"), F.lit("paper"))
    p = table(spark, sf_dir, "pages").select("page_id", F.get(kinds, (page % 3).cast("int")).alias("kind"), T.normalized(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"), T.normalized(F.regexp_extract("html", "<p>([^<]{40,})", 1)).alias("body"))
    name, authored = page.cast("string"), page % 4 != 0
    release = F.when(page % 2 == 0, F.struct(F.concat(F.lit(" v"), name).alias("tag_name"), F.lit("notes ").alias("body")))
    message = F.struct(
        F.array("t").alias("title"), F.when((page % 2 == 0) & (F.col("body") != ""), F.concat(F.lit("<jats:p>"), F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</jats:p>"))).alias("abstract"), F.array(F.lit("Journal")).alias("container-title"),
        F.struct(F.array(F.array(F.lit(2024), F.lit(5))).alias("date-parts")).alias("issued"),
        F.when(authored, F.array(F.struct(F.lit("G.").alias("given"), F.concat(F.lit("Family"), name).alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Only").alias("family")))).alias("author"),
    )
    paper = F.struct(F.col("t").alias("title"), F.lit(2020).alias("year"), F.col("body").alias("abstract"), F.when(authored, F.array(F.struct(F.concat(F.lit("P"), name).alias("name")))).alias("authors"))
    own = lambda kind, c: F.when(F.col("kind") == kind, c)
    rows = p.select(
        "kind", name.alias("url"), own("repository", F.lit("o")).alias("owner"), own("repository", F.concat(F.lit("r"), name)).alias("repo"), own("repository", F.struct(F.base64(F.encode("body", "UTF-8")).alias("content"))).alias("readme"), own("repository", release).alias("release"),
        own("doi", F.concat(F.lit("10.1/"), name)).alias("doi"), own("doi", message).alias("message"), own("paper", name).alias("paper_id"), own("paper", paper).alias("paper"),
    )
    place = shared_folder(spark, "payloads")
    rows.write.partitionBy("kind").option("compression", "gzip").json(place)
    archive.register(spark)
    read = spark.read.format("payload_archive").option("max_chars", 300).load(place).where("kind in ('doi', 'repository')")
    return read.select(F.col("url").cast("long").alias("page_id"), "kind", "title", "final_url", "first_paragraph", F.md5("content").alias("content_md5"))
