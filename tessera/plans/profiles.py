"""Queries with the profile that their words suggest, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.plans.texts import _PROFILE_SQL, _SAID, _said
from tessera.session import table
from tessera.sources import payloads
from tessera.sources import profiles as P


def _values() -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else f"{T.strings_sql(v)}::varchar[]" if isinstance(v, list) else T.quoted(v)
    return ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in P.PROFILES)


_SITES = "list_transform(engines, lambda e: case e when 'reddit' then 'site:reddit.com' else 'site:' || e || '.org' end)"


@query(
    f"with q as (select conv_id, turn, q, {_PROFILE_SQL} as suggested from (select *, {T.is_cyrillic_sql('q')} as c from (select conv_id, turn, {_SAID} as q from conversations where role = 'user'))), "
    "p as (select conv_id, turn, case conv_id % 4 when 0 then 'reference' when 1 then 'arxiv' else suggested end as profile, q from q), "
    f"k(profile, categories, language, time_range, fetch_top_n, max_results, hints, engines, region) as (values {_values()}), "
    f"j as (select *, trim(array_to_string(list_concat(hints, [q]), ' ')) as hinted, {_SITES} as sites from p join k using (profile)) "
    "select conv_id, turn, profile, categories[1] = 'news' and not list_contains(categories, 'general') as news_mode, least(20, greatest(10, max_results)) as gate_limit, case when turn = 0 then 5 else 10 end as shallow, case when fetch_top_n = 0 then 0 else least(2, greatest(fetch_top_n, 4)) end as deep, "
    "case time_range when 'day' then 'd' when 'week' then 'w' end as time_limit, coalesce(region, 'wt-wt') as region, trim(case when len(sites) = 0 then '' when len(sites) = 1 then sites[1] || ' ' else '(' || array_to_string(sites, ' OR ') || ') ' end || hinted) as routed from j"
)
def profile_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's profile, its settings and the query as it is sent."""
    k = F.col("conv_id") % 4
    profile = F.when(k == 0, "reference").when(k == 1, "arxiv").otherwise(T.suggested_profile(F.col("q")))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", _said().alias("q")).withColumn("profile", profile)
    j = P.with_profile(q)
    shallow, deep = P.fetch_limits(F.col("fetch_top_n"), F.col("turn") + 1)
    hinted = F.trim(F.array_join(F.concat("hints", F.array("q")), " "))
    return j.select(
        "conv_id", "turn", "profile", P.is_news(F.col("categories")).alias("news_mode"), P.gate_limit(F.col("max_results")).alias("gate_limit"), shallow.alias("shallow"), deep.alias("deep"),
        P.time_limit(F.lit(None).cast("string"), F.col("time_range")).alias("time_limit"), F.coalesce("region", F.lit("wt-wt")).alias("region"), payloads.routed_query(hinted, F.col("engines")).alias("routed"),
    )
