"""Queries of shells, defaults after failed model calls, shared searches and provider settings, over questions of the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.entities import entities_sql
from tessera.operators import defaults as D
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import profiles

_Q = "case conv_id % 3 when 0 then 'What did Bank of America say on 12 March 2026? ' || text else text end"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("What did Bank of America say on 12 March 2026? "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q"))


@query(
    f"select conv_id, turn, 'unified-1' as claim_id, md5(q) as text_md5, array_to_string({entities_sql('q')}, '|') as entities, {T.time_scope_sql(T.words_sql('q'))} as scope, 'overview' as shape, 2 as least_sources, 'official,academic,vendor,major_media' as preferred, 'synthesis' as intent "
    f"from (select conv_id, turn, {_Q} as q from conversations where role = 'user')"
)
def run_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question as the one claim of a run, with its entities and time."""
    s = _asked(spark, sf_dir).select("conv_id", "turn", D.shell(F.col("q")).alias("s"))
    return s.select("conv_id", "turn", "s.claim_id", F.md5("s.claim_text").alias("text_md5"), F.array_join("s.entities", "|").alias("entities"), "s.scope", "s.shape", "s.least_sources", F.array_join("s.preferred", ",").alias("preferred"), "s.intent")


_GIVEN = "case (conv_id + turn) % 5 when 0 then 'supported' when 1 then 'contradicted' when 2 then 'maybe' when 3 then 'supported' end"
_SURE = "case when turn % 4 = 3 then null else ((conv_id * 7 + turn) % 120 - 10) / 100e0 end"
_FAILED = "case when conv_id % 7 = 2 then 'failed after a second try' end"


@query(
    f"with g as (select conv_id, turn, {_GIVEN} as v, least(greatest(coalesce({_SURE}, 0e0), 0e0), 1e0) as c, {_FAILED} as why, case when turn % 2 = 0 then left(text, 12) else ' ' end as m, case when conv_id % 4 = 1 then '  ' when conv_id % 4 = 2 then null else 'news_digest' end as i from conversations where role = 'user'), "
    "f as (select *, why is not null or coalesce(v not in ('supported', 'contradicted', 'insufficient_evidence'), true) as failed from g) "
    f"select conv_id, turn, case when failed then 'insufficient_evidence' else v end as verdict, case when failed then 0e0 when v = 'supported' and c < {D.FLOOR_UNDER}e0 then {D.FLOOR}e0 else c end as confidence, case when failed then 'coverage' else {T.normalized_sql('m')} end as missing, case when failed then coalesce(why, 'no verdict') end as reason, "
    f"case when why is not null then 'factual' else coalesce(nullif({T.normalized_sql('i')}, ''), 'factual') end as intent from f"
)
def model_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and intents as a model might give them for each question, some failed or no verdicts at all."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    missing = F.array(F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(12))).otherwise(" "))
    why, given = F.expr(_FAILED), F.when(F.col("conv_id") % 4 == 1, "  ").when(F.col("conv_id") % 4 == 2, F.lit(None)).otherwise("news_digest")
    v = D.verification(F.expr(_GIVEN), F.expr(_SURE), missing, why)
    told = c.select("conv_id", "turn", v.alias("v"), D.intent(given, F.lit(None).cast("string"), why.isNotNull()).alias("i"))
    return told.select("conv_id", "turn", "v.verdict", "v.confidence", F.array_join("v.missing", ",").alias("missing"), "v.reason", "i.intent")


@query(
    f"with v as (select conv_id as run_id, 'v' || turn as variant_id, {T.fold_sql(T.normalized_sql('q'))} as key from (select conv_id, turn, 'Topic  ' || conv_id || case when turn % 2 = 0 then ' A ' else ' a' end as q from conversations where role = 'user')), "
    "r as (select 'topic ' || (page_id // 10) || ' a' as key, page_id as position, url from pages) "
    "select run_id, variant_id, variant_id || ':' || position as result_id, position, url from v join r using (key)"
)
def shared_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of queries that share a search of ten pages, each with the results named for itself."""
    k = F.col("conv_id")
    q = F.concat(F.lit("Topic  "), k.cast("string"), F.when(F.col("turn") % 2 == 0, " A ").otherwise(" a"))
    variants = table(spark, sf_dir, "conversations").where("role = 'user'").select(k.alias("run_id"), F.concat(F.lit("v"), F.col("turn").cast("string")).alias("variant_id"), q.alias("query"))
    results = table(spark, sf_dir, "pages").select(F.concat(F.lit("topic "), F.floor(F.col("page_id") / 10).cast("string"), F.lit(" A")).alias("query"), F.col("page_id").alias("position"), "url")
    return D.retagged(variants, results)


@query(
    "with s as (select conv_id, turn, case conv_id % 4 when 0 then ' a ; b' || chr(10) || role || ';;a' when 1 then '[\"x\", \" \", \"' || role || '\"]' when 2 then '' end as setting, case when turn % 2 = 0 then ['b', ' ' || role || ' ', 'c'] end as own, case when turn % 3 = 0 then '' when turn % 3 = 1 then 'off' end as safe, "
    "case turn % 4 when 0 then '  ' when 1 then ' DDGS ' end as override, case conv_id % 3 when 0 then '' when 1 then ' Brave ' end as chosen from conversations), "
    "r as (select *, case conv_id % 4 when 0 then ['a', 'b', role, 'a'] when 1 then ['x', role] else []::varchar[] end as rules from (select s.*, c.role from s join conversations c using (conv_id, turn))), "
    "j as (select *, list_concat(rules, case when own is null then []::varchar[] else ['b', role, 'c'] end) as all_rules from r) "
    "select conv_id, turn, array_to_string(list_filter(all_rules, lambda x, i: list_position(all_rules, x) = i), ',') as rules, coalesce(safe, 'moderate') as safe, coalesce(nullif(lower(trim(override)), ''), case when coalesce(chosen, '') = '' then 'brave' else lower(trim(chosen)) end) as provider from j"
)
def provider_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, safe search and provider that follow from settings and profiles, a row a turn."""
    k, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    setting = F.when(k % 4 == 0, F.concat(F.lit(" a ; b\n"), role, F.lit(";;a"))).when(k % 4 == 1, F.concat(F.lit('["x", " ", "'), role, F.lit('"]'))).when(k % 4 == 2, "")
    own = F.when(t % 2 == 0, F.array(F.lit("b"), F.concat(F.lit(" "), role, F.lit(" ")), F.lit("c")))
    safe = F.when(t % 3 == 0, "").when(t % 3 == 1, "off")
    override, chosen = F.when(t % 4 == 0, "  ").when(t % 4 == 1, " DDGS "), F.when(k % 3 == 0, "").when(k % 3 == 1, " Brave ")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(profiles.merged_rules(setting, own), ",").alias("rules"), profiles.safe_search(safe, F.lit("moderate")).alias("safe"), profiles.provider(override, chosen).alias("provider"))
