"""From questions to a numbered slate: claims from the benchmark, results from pages, passages from documents.

Every benchmark item is a claim; pages and documents are dealt to the claims by the own id modulo the number of items, which are
numbered from 0, as results belong to the question they were searched for. Everything meets by claim, by equal keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import evidence as E
from tessera.plans.addresses import HOSTS, _deal, _deal_sql
from tessera.plans.registry import query
from tessera.session import table

AS_OF = "2026-01-01"
#: In SQL, how many claims there are.
CLAIMS = "(select greatest(1, count(distinct item_id)) from benchmark)"


def n_claims(spark: SparkSession, sf_dir: str) -> int:
    """How many claims there are; one at least."""
    return max(1, table(spark, sf_dir, "benchmark").select(F.countDistinct("item_id")).first()[0])


def to_claims(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """The rows with the claim_id that their key is dealt to."""
    return rows.withColumn("claim_id", F.pmod(F.col(key), F.lit(n_claims(spark, sf_dir))))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, claim_text, tokens, entities, claim_numbers, scope, fresh."""
    b = table(spark, sf_dir, "benchmark")
    names = F.slice(F.array_distinct(F.filter(T.words(F.col("text")), lambda t: t.rlike(r"^\p{Lu}.") & ~T.fold(t).isin(*K.NO_ENTITIES))), 1, 3)
    scope = F.when(F.col("item_id") % 4 == 0, "2025-08-15")
    return b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text"), T.tokens(F.col("text")).alias("tokens"), names.alias("entities"), T.numbers(F.col("text")).alias("claim_numbers"), scope.alias("scope"), (F.col("item_id") % 2 == 1).alias("fresh"))


def asked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims with their different tokens and the keys of their entities, made once where many passages meet a claim."""
    return claims(spark, sf_dir).withColumns({"asked": F.array_distinct("tokens"), "entity_keys": S.entity_keys(F.col("entities"))})


CLAIMS_SQL = (
    f"claims as materialized (select item_id as claim_id, text as claim_text, {T.tokens_sql('text')} as tokens, {T.numbers_sql('text')} as claim_numbers, case when item_id % 4 = 0 then '2025-08-15' end as scope, item_id % 2 = 1 as fresh, "
    f"list_filter({T.words_sql('text')}, lambda t: regexp_matches(t, '^\\p{{Lu}}.') and not list_contains({T.strings_sql(K.NO_ENTITIES)}, {T.fold_sql('t')})) as names from benchmark), "
    "named as materialized (select * exclude names, list_filter(names, lambda t, i: list_position(names, t) = i)[1:3] as entities from claims)"
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search results: claim_id, seq, url, canonical_url, host, title, snippet, published."""
    p = to_claims(spark, sf_dir, table(spark, sf_dir, "pages"), "page_id")
    day = F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    return p.select(
        "claim_id", F.col("page_id").alias("seq"), "url", U.canonical(F.col("url")).alias("canonical_url"),
        F.when(F.col("page_id") % 2 == 0, _deal(HOSTS)).otherwise(U.host(F.col("url"))).alias("host"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<p>([^<]{40,})", 1).alias("snippet"), F.when(F.col("page_id") % 3 > 0, day).alias("published"),
    )


RESULTS_SQL = (
    f"results as materialized (select page_id % {CLAIMS} as claim_id, page_id as seq, url, {U.canonical_sql('url')} as canonical_url, case when page_id % 2 = 0 then {_deal_sql(HOSTS)} else {U.host_sql('url')} end as host, "
    "regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<p>([^<]{40,})', 1) as snippet, case when page_id % 3 > 0 then strftime(date '2025-06-01' + (page_id % 300)::int, '%Y-%m-%d') end as published from pages)"
)
_PRIOR = ", ".join(f"{U.source_prior_sql('host', f)} as p_{f}" for f in ("source_prior", "primary_boost", "spam_penalty", "domain_type"))
_KEYS = f"list_transform(entities, lambda e: {T.compact_sql('e')})"
_WORD_KEYS = f"list_transform(flatten(list_transform(entities, lambda e: {T.tokens_sql('e')})), lambda t: {T.compact_sql('t')})"
_LABELS = f"list_transform(list_filter(string_split(host, '.'), lambda p: p <> '' and lower(p) <> 'www'), lambda p: {T.compact_sql('p')})"
_LONG = "list_filter({}, lambda k: length(k) >= 4)"
_W = {k: S.num(v) for k, v in K.SERP_WEIGHTS.items()}
SCORED_SQL = (
    f"{CLAIMS_SQL}, {RESULTS_SQL}, known as materialized (select *, {U.domain_type_sql('host')} as kind, {T.tokens_sql('title')} as title_tokens, {T.tokens_sql('concat_ws($$ $$, title, snippet)')} as r_tokens, {_PRIOR} from results), "
    f"met as materialized (select *, case when list_has_any({_LONG.format(_KEYS)}, {_LABELS}) then 1e0 when list_has_any({_LONG.format(_WORD_KEYS)}, {_LABELS}) then 0.95e0 else 0e0 end as host_match from known join named using (claim_id)), "
    "kinds as (select *, coalesce(p_domain_type, case when kind = 'unknown' and host_match >= 0.8e0 then 'official' else kind end) as domain_type from met), "
    f"parts as materialized (select *, {S.overlap_sql('tokens', 'r_tokens')} as semantic, {S.entity_overlap_sql('entities', 'concat_ws($$ $$, title, snippet)')} as entity, {S.freshness_sql('fresh', 'published', AS_OF)} as freshness, "
    f"{S.time_alignment_sql('scope', 'title', 'snippet', 'url', 'published')} as time_match, {S.spam_risk_sql('host', 'kind', 'title', 'snippet', 'title_tokens', 'p_spam_penalty')} as spam, "
    f"{S.primary_likelihood_sql('domain_type', 'title', 'snippet', 'url', 'host_match', 'p_primary_boost')} as primary_score from kinds), "
    f"scored as (select *, {S.clamp_sql(f'''{_W['domain']} * {S.by_kind_sql('domain_type', K.DOMAIN_PRIOR)} + {_W['primary']} * primary_score + {_W['freshness']} * freshness + {_W['entity']} * entity + {_W['semantic']} * semantic + {_W['host_entity']} * host_match + {_W['time']} * time_match + p_source_prior - {_W['spam']} * spam''')} as source_score from parts)"
)
_GATED_SQL = (
    f"{SCORED_SQL}, merged as (select *, row_number() over (partition by claim_id, canonical_url order by source_score desc, seq) as r, min(seq) over (partition by claim_id, canonical_url) as slot from scored), "
    f"gated as (select * from (select *, row_number() over (partition by claim_id order by source_score desc, primary_score desc, spam, slot) as rank from merged where r = 1) where rank <= {K.GATE_LIMIT})"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_results(results(spark, sf_dir), claims(spark, sf_dir), AS_OF)


_ROUNDED = ("semantic", "entity", "freshness", "time_match", "spam", "primary_score", "host_match", "source_score")


@query(f"with {SCORED_SQL} select claim_id, seq, domain_type, {', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)} from scored")
def result_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of every result for its claim."""
    return _scored(spark, sf_dir).select("claim_id", "seq", "domain_type", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query(f"with {_GATED_SQL} select claim_id, rank, canonical_url, seq, round(source_score, 6) as source_score from gated")
def gate_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated results of every claim."""
    return E.gate(_scored(spark, sf_dir)).select("claim_id", "rank", "canonical_url", "seq", F.round("source_score", 6).alias("source_score"))


@query(
    f"with {_GATED_SQL} select claim_id, 'fast' as mode, round({S.clamp_sql('avg(source_score) filter (where rank <= 3)')}, 6) as certainty, round({S.clamp_sql('avg(semantic) filter (where rank <= 5)')}, 6) as consistency, "
    f"round({S.clamp_sql('count(*) filter (where rank <= 8 and source_score >= 0.6e0) * 0.11e0 + case when bool_or(rank <= 5 and primary_score >= 0.7e0) then 0.2e0 else 0e0 end')}, 6) as sufficiency from gated group by claim_id"
)
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each claim's retrieval is routed."""
    return E.route(E.gate(_scored(spark, sf_dir))).select("claim_id", "mode", *[F.round(c, 6).alias(c) for c in ("certainty", "consistency", "sufficiency")])


@query(
    f"with {_GATED_SQL} select claim_id, 'snip-' || (rank - 1) as passage_id, md5(trim(snippet)) as text_md5, round({S.verification_bonus_sql('domain_type', 'title', 'url', U.source_prior_sql('host', 'verification_bonus'))}, 6) as bonus from gated where length(trim(snippet)) >= 20"
)
def snippet_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of gated results as passages, with the bonus for verification."""
    g = E.gate(_scored(spark, sf_dir)).where(F.length(F.trim("snippet")) >= 20)
    bonus = S.verification_bonus(F.col("domain_type"), F.col("title"), F.col("url"), U.source_prior(F.col("host"))["verification_bonus"])
    return g.select("claim_id", F.concat(F.lit("snip-"), (F.col("rank") - 1).cast("string")).alias("passage_id"), F.md5(F.trim("snippet")).alias("text_md5"), F.round(bonus, 6).alias("bonus"))


@query(
    f"with ranked as (select page_id, page_id % {CLAIMS} as claim_id, {U.host_sql('url')} as h, length(html) as score from pages), "
    f"dealt as (select *, row_number() over (partition by claim_id, root order by score desc, page_id) as of_host from (select *, {U.registered_root_sql('h')} as root from ranked)) "
    "select page_id, claim_id, root, pick from (select *, row_number() over (partition by claim_id order by of_host > 1, score desc, page_id) as pick from dealt) where pick <= 5"
)
def fetch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each claim the five best pages, the first of each host before seconds; both windows keep five rows a task before they shuffle."""
    h = F.col("h")
    p = to_claims(spark, sf_dir, table(spark, sf_dir, "pages"), "page_id").select("page_id", "claim_id", U.host(F.col("url")).alias("h"), F.length("html").alias("score"))
    return E.fetch_order(p.withColumn("root", U.registered_root(h)), [F.desc("score"), F.col("page_id")], 5).select("page_id", "claim_id", "root", "pick")


def passages_sql(source: str, columns: str, tag: str = "") -> str:
    """CTEs, the last of them passaged{tag}, with the columns and the passages p of a table's text."""
    return (
        f"content{tag} as materialized (select {columns}, {T.normalized_sql('text')} as c from {source}), cut{tag} as materialized (select *, {T.sentences_sql('c')} as s from content{tag}), "
        f"folded{tag} as (select *, case when len(s) = 0 then null else list_reduce(s, lambda a, x: case when a.run = '' then {{'run': x, 'done': a.done}} when length(a.run || ' ' || x) <= {K.PASSAGE_CHARS} then {{'run': a.run || ' ' || x, 'done': a.done}} "
        f"else {{'run': x, 'done': list_append(a.done, a.run)}} end, {{'run': '', 'done': []::varchar[]}}) end as f from cut{tag}), "
        f"passaged{tag} as materialized (select {columns}, case when c = '' then []::varchar[] when length(c) < {K.LEAST_BLOCK_CHARS} or starts_with(c, '#') then [left(c, {K.PASSAGE_CHARS})] else list_append(f.done, f.run) end as p from folded{tag})"
    )


PASSAGES_SQL = passages_sql("documents", "doc_id, source")


@query(f"with {PASSAGES_SQL} select doc_id, len(p) as n_passages, md5(array_to_string(p, chr(10))) as passages_md5 from passaged")
def passage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's passages."""
    d = table(spark, sf_dir, "documents").select("doc_id", E.passages(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_passages"), F.md5(F.array_join("p", "\n")).alias("passages_md5"))


def passage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as rows: claim_id, doc_id, k, seq (both of these), passage_id, url, host, text, source_score."""
    d = to_claims(spark, sf_dir, table(spark, sf_dir, "documents"), "doc_id")
    host = F.concat("source", F.lit(".example.com"))
    one = d.select("claim_id", "doc_id", host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.posexplode(E.passages(F.col("text"))).alias("k", "text"))
    return one.select("claim_id", "doc_id", "k", F.struct("doc_id", "k").alias("seq"), F.concat_ws(":", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.lit("0"), F.col("k").cast("string")).alias("passage_id"), "url", "host", "text", F.round(F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101, 6).alias("source_score"))


_ROWS_SQL = (
    f"{PASSAGES_SQL}, rows as materialized (select doc_id % {CLAIMS} as claim_id, doc_id, k, {{'doc_id': doc_id, 'k': k}} as seq, 'doc-' || doc_id || ':0:' || k as passage_id, 'https://' || source || '.example.com/' || doc_id as url, source || '.example.com' as host, text, "
    "round((doc_id * 37 % 101) / 101e0, 6) as source_score from (select doc_id, source, unnest(p) as text, generate_subscripts(p, 1) - 1 as k from passaged))"
)


_SLATE_SQL = (
    f"{_ROWS_SQL}, of_url as (select *, row_number() over w as round, first_value(-source_score) over w as lead_s, first_value(seq) over w as lead_q from rows window w as (partition by claim_id, url order by source_score desc, seq)), "
    f"ranked as (select * from (select *, row_number() over (partition by claim_id order by round, lead_s, lead_q) as place from of_url) where place <= {K.TOP_PASSAGES}), "
    f"u as (select * from (select *, row_number() over (partition by claim_id, url order by place) as n from ranked) where n <= {K.SLATE_PER_URL}), "
    f"h as (select * from (select * exclude n, row_number() over (partition by claim_id, host order by place) as n from u) where n <= {K.SLATE_PER_HOST} or host = ''), "
    f"slate as (select * from (select *, row_number() over (partition by claim_id order by place) as citation from h) where citation <= {K.SLATE_TOTAL})"
)


@query(f"with {_SLATE_SQL} select claim_id, citation, passage_id, host, md5(text) as text_md5 from slate")
def prompt_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered slate of every claim: ranked by rounds over addresses, packed under caps."""
    rows = passage_rows(spark, sf_dir).withColumn("text_md5", F.md5("text")).drop("text")  # digests, not texts, are shuffled
    return E.pack_for_prompt(E.rank_for_prompt(rows)).select("claim_id", "citation", "passage_id", "host", "text_md5")


_CW = {k: S.num(v) for k, v in K.CHEAP_WEIGHTS.items()}


@query(
    f"with {CLAIMS_SQL}, {_ROWS_SQL}, tokened as materialized (select *, {T.tokens_sql('text')} as p_tokens, {T.numbers_sql('text')} as p_numbers from rows), "
    f"scored as (select claim_id, seq, passage_id, source_score, {S.clamp_sql(f'''{_CW['overlap']} * {S.overlap_sql('tokens', 'p_tokens')} + {_CW['entity']} * {S.entity_overlap_sql('entities', 'text')} + {_CW['dimension']} * case when scope is not null and contains({T.fold_sql('text')}, {T.fold_sql('scope')}) then 0.15e0 else 0e0 end + {_CW['number']} * case when list_has_any(claim_numbers, p_numbers) then 1e0 else 0e0 end + {_CW['source']} * source_score''')} as cheap_score from tokened join named using (claim_id)), "
    f"ranked as (select *, row_number() over (partition by claim_id order by cheap_score >= 0.18e0 desc, cheap_score desc, source_score desc, seq) as rank, bool_or(cheap_score >= 0.18e0) over (partition by claim_id) as has_any from scored) "
    f"select claim_id, rank, passage_id, round(cheap_score, 6) as cheap_score from ranked where rank <= {K.CHEAP_LIMIT} and (cheap_score >= 0.18e0 or not has_any)"
)
def cheap_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best passages of every claim by the cheap score."""
    scored = E.cheap_scores(E.with_words(passage_rows(spark, sf_dir)).join(asked_claims(spark, sf_dir), "claim_id"))
    kept = E.cheap_filter(scored.select("claim_id", "seq", "passage_id", "source_score", "cheap_score"))  # no text is shuffled
    return kept.select("claim_id", "rank", "passage_id", F.round("cheap_score", 6).alias("cheap_score"))


@query(
    f"with d as (select doc_id, list_distinct({T.tokens_sql('text')}) as t from documents), w as (select doc_id, unnest(t) as token from d), {CLAIMS_SQL}, c as (select claim_id, unnest(list_distinct(tokens)) as token, len(list_distinct(tokens)) as n from named), "
    "shared as (select claim_id, doc_id, count(*) / max(n) as overlap from c join w using (token) group by claim_id, doc_id) "
    "select claim_id, doc_id, rank, round(overlap, 6) as overlap from (select *, row_number() over (partition by claim_id order by overlap desc, doc_id) as rank from shared) where rank <= 25"
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 documents that share most of a claim's words; only documents with one of its rarer words are met."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return E.top_overlaps(d, claims(spark, sf_dir)).select("claim_id", "doc_id", "rank", F.round("overlap", 6).alias("overlap"))
