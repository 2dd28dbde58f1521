"""Queries of second-phase selection, bundles, component checks and plain payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import bundles as B
from tessera.operators import evidence as E
from tessera.plans.evidence import _GATED_SQL, _ROWS_SQL, CLAIMS, CLAIMS_SQL, _scored, asked_claims, claims, n_claims, passage_rows
from tessera.plans.registry import query
from tessera.session import table


_CW, _UW = ({k: S.num(v) for k, v in w.items()} for w in (K.CHEAP_WEIGHTS, B.UTILITY))
_DIMENSION = f"case when scope is not null and contains({T.fold_sql('text')}, {T.fold_sql('scope')}) then 0.15e0 else 0e0 end"
_CHEAP = S.clamp_sql(
    f"{_CW['overlap']} * {S.overlap_sql('tokens', 'p_tokens')} + {_CW['entity']} * {S.entity_overlap_sql('entities', 'text')} + {_CW['dimension']} * {_DIMENSION} + {_CW['number']} * case when list_has_any(claim_numbers, p_numbers) then 1e0 else 0e0 end + {_CW['source']} * source_score"
)
_KIND = f"coalesce({U.source_prior_sql('host', 'domain_type')}, {U.domain_type_sql('host')})"
_BONUS = S.verification_bonus_sql("kind", "passage_id", "url", U.source_prior_sql("host", "verification_bonus"))
_NEGATED = f"(list_has_any({T.tokens_sql('text')}, {T.strings_sql(K.NEGATION_TOKENS)}) or {T.any_in_sql(T.fold_sql('text'), ('debunked', 'contradict'))})"
_UTILITY = S.clamp_sql(
    f"{_UW['cheap']} * cheap_score + {_UW['dimension']} * dimension + {_UW['bonus']} * greatest({_BONUS}, 0e0) + {_UW['source']} * source_score + {_UW['contradiction']} * case when {_NEGATED} then {S.num(B.CONTRADICTION)} else 0e0 end"
)


@query(
    f"with recursive {CLAIMS_SQL}, {_ROWS_SQL}, tokened as materialized (select *, {T.tokens_sql('text')} as p_tokens, {T.numbers_sql('text')} as p_numbers from rows), "
    f"cheap as materialized (select * exclude (host), regexp_replace(host, '\\.example\\.com$', '') || (doc_id + k) // 3 % 6 || '.com' as host, {_CHEAP} as cheap_score, {_DIMENSION} as dimension from tokened join named using (claim_id)), kinds as materialized (select *, {_KIND} as kind from cheap), "
    f"scored as materialized (select claim_id, doc_id, k, passage_id, source_score, {U.registered_root_sql('host')} as root, {S.clamp_sql(f'{_UTILITY} + case when (doc_id + k) % 9 = 0 then {S.num(B.SEEN_BEFORE)} else 0e0 end')} as utility from kinds), "
    "listed as materialized (select claim_id, list({'p': passage_id, 'r': root} order by utility desc, source_score desc, doc_id, k) as all_rows from scored group by claim_id), "
    "greedy as (select claim_id, 0 as i, []::varchar[] as taken, []::varchar[] as roots from listed union all "
    "select claim_id, i + 1, case when free then list_append(taken, x.p) else taken end, case when free then list_append(roots, x.r) else roots end from "
    "(select g.claim_id, i, taken, roots, all_rows[i + 1] as x, not list_contains(roots, all_rows[i + 1].r) or len(taken) >= 4 as free from greedy g join listed using (claim_id) where i < len(all_rows) and len(taken) < 8)), "
    "final as (select claim_id, taken from greedy join listed using (claim_id) where len(taken) = 8 or i = len(all_rows)) "
    "select claim_id, unnest(taken) as passage_id, generate_subscripts(taken, 1)::int as place from final"
)
def reranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best passages of each claim by utility with different hosts first; its SQL takes them one by one in a recursion."""
    s = E.cheap_scores(E.with_words(passage_rows(spark, sf_dir)).join(asked_claims(spark, sf_dir), "claim_id")).withColumn("title", F.col("passage_id")).withColumn("seen", (F.col("doc_id") + F.col("k")) % 9 == 0)
    s = s.withColumn("host", F.concat(F.regexp_replace("host", r"\.example\.com$", ""), (F.floor((F.col("doc_id") + F.col("k")) / 3) % 6).cast("string"), F.lit(".com")))  # hosts with roots of their own
    chosen = B.rerank(B.utility_scores(s).withColumn("seq", F.struct("doc_id", "k", "passage_id")))
    return chosen.select("claim_id", F.col("seq.passage_id").alias("passage_id"), "place")


_OFFICIAL = f"{U.domain_type_sql('host')} in ('official', 'academic')"


@query(
    f"with {_GATED_SQL}, f as (select claim_id, count(*) as n_support, count(distinct {U.registered_root_sql('host')}) as sources, bool_or(primary_score >= 0.7e0 or {_OFFICIAL}) as has_primary, bool_or(published is not null) as dated from gated where rank <= claim_id % 5 group by claim_id), "
    "j as (select c.claim_id, coalesce(n_support, 0) as n_support, coalesce(sources, 0) as sources, coalesce(has_primary, false) as has_primary, coalesce(dated, false) as dated, c.claim_id % 3 = 0 as rp, c.claim_id % 4 as ls, c.fresh as fn, case c.claim_id % 2 when 0 then 'supported' else 'contradicted' end as verdict, case c.claim_id % 3 when 0 then 'overview' else 'fact' end as shape from named c left join f using (claim_id)), "
    "g as (select *, list_filter([case when rp and not has_primary then 'primary_source' end, case when sources < greatest(1, ls) then 'independent_sources' end, case when fn and not dated then 'freshness' end], lambda x: x is not null) as gaps from j) "
    "select claim_id, n_support, sources, has_primary, not fn or dated as fresh, array_to_string(gaps, ',') as gaps, len(gaps) = 0 and (verdict = 'supported' or (shape = 'overview' and n_support > 0)) as satisfied from g"
)
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's bundle from the first of its gated results."""
    k = F.col("claim_id")
    support = E.gate(_scored(spark, sf_dir)).where(F.col("rank") <= k % 5)
    c = claims(spark, sf_dir).select("claim_id", F.when(k % 2 == 0, "supported").otherwise("contradicted").alias("verdict"), F.when(k % 3 == 0, "overview").otherwise("fact").alias("shape"), (k % 3 == 0).alias("requires_primary"), (k % 4).alias("least_sources"), F.col("fresh").alias("fresh_needed"))
    return B.bundles(support.select("claim_id", "host", "primary_score", "published"), c)


@query(
    f"with {_GATED_SQL}, c as (select claim_id, ['p' || claim_id, 'p' || (claim_id + {CLAIMS})] as inc, ['p' || (claim_id + 2 * {CLAIMS})] as exc, claim_id % 6 as least from named), o as (select claim_id, list('p' || seq) as items, count(*) as n from gated where rank <= 4 group by 1), "
    "j as (select len(inc) as i, len(list_intersect(inc, coalesce(items, []))) as h, len(exc) as e, len(exc) - len(list_intersect(exc, coalesce(items, []))) as k, coalesce(n, 0) >= least as enough from c left join o using (claim_id)) "
    "select count(*) as n_cases, round(sum(h) / sum(i), 6) as include_rate, round(sum(k) / sum(e), 6) as exclude_rate, round(avg(enough::int), 6) as least_rate, round(avg((h = i and k = e and enough)::int), 6) as pass_rate from j"
)
def component_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include, exclude and pass rates of gating against expectations: of a claim's results the first two are wanted, the third is not."""
    k, n = F.col("claim_id"), n_claims(spark, sf_dir)
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    cases = claims(spark, sf_dir).select(k.alias("case_id"), F.array(name(k), name(k + n)).alias("include"), F.array(name(k + 2 * n)).alias("exclude"), (k % 6).alias("least"))
    out = E.gate(_scored(spark, sf_dir)).where("rank <= 4").select(k.alias("case_id"), name(F.col("seq")).alias("item"))
    rates = B.expectation_rates(cases, out)
    return rates.select("n_cases", *[F.round(c, 6).alias(c) for c in ("include_rate", "exclude_rate", "least_rate", "pass_rate")])


_BODY = "trim(case doc_id % 3 when 0 then '  ## Head ' || doc_id || chr(10) || chr(10) || text else text || chr(10) || chr(10) || 'short' || chr(10) || chr(10) || text end)"
_LINES = "list_filter(list_transform(string_split(b, chr(10))[1:8], lambda x: trim(x)), lambda x: starts_with(x, '#'))"


@query(
    f"select doc_id, coalesce(left(trim(regexp_replace({_LINES}[1], '^#+', '')), 400), 'hint') as title, md5(array_to_string(list_filter(list_transform(string_split(b, chr(10) || chr(10)), lambda x: trim(x)), lambda x: length(x) >= 40)[1:3], '|')) as blocks_md5, md5(left(b, 4000)) as content_md5 from (select doc_id, {_BODY} as b from documents)"
)
def plain_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain-text payloads, a third with a heading put before."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  ## Head "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text")).otherwise(F.concat("text", F.lit("\n\nshort\n\n"), "text"))
    d = table(spark, sf_dir, "documents").select("doc_id", B.plain_payload(text, F.lit("hint"), 4000).alias("p"))
    return d.select("doc_id", "p.title", F.md5(F.array_join("p.blocks", "|")).alias("blocks_md5"), F.md5("p.content").alias("content_md5"))
