"""Queries of supporting passages over the gated results; their SQL takes them one by one in a recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import evidence as E
from tessera.operators import support as P
from tessera.plans.evidence import _GATED_SQL, _scored, claims
from tessera.plans.registry import query

_LEAD = f"concat_ws(' ', title, left(snippet, {P.LEAD_CHARS}), url)"


def _select_sql(weights: dict[str, float], most: int, primary_phase: bool) -> str:
    w = {k: S.num(v) for k, v in weights.items()}
    dimension = f"case when scope is not null and contains({T.fold_sql('lead')}, {T.fold_sql('scope')}) then 0.15e0 else 0e0 end"
    bonus = S.verification_bonus_sql("domain_type", "title", "url", U.source_prior_sql("host", "verification_bonus"))
    preferred = f"case when claim_id % 2 = 0 and domain_type = 'official' then {S.num(P.PREFERRED)} else 0e0 end"
    score = (
        f"{w['semantic']} * {S.overlap_sql('tokens', T.tokens_sql('lead'))} + {w['entity']} * {S.entity_overlap_sql('entities', 'lead')} + {w['dimension']} * {dimension} + {w['own']} * greatest((seq % 7) / 10e0, source_score) + {w['bonus']} * greatest({bonus}, 0e0) "
        f"+ {w['preferred']} * {preferred} + case when claim_id % 3 = 0 then {w['product']} * {preferred} else 0e0 end"
    )
    primary = f"(primary_score >= {S.num(P.PRIMARY_FROM)} or domain_type in ('official', 'academic') or (claim_id % 3 = 0 and domain_type = 'vendor'))"
    second = f"union all select * from (select claim_id, {P.PRIMARY} as phase, score, source_score, seq, url, root, prim from scored_rows where prim and claim_id % 2 = 1 qualify row_number() over (partition by claim_id order by score desc, source_score desc, seq) = 1) " if primary_phase else ""
    return (
        f"with recursive {_GATED_SQL}, leads as materialized (select *, {_LEAD} as lead, {U.registered_root_sql('host')} as root, {primary} as prim from gated), scored_rows as materialized (select *, {score} as score from leads), "
        f"phased as (select claim_id, {P.SUPPORT} as phase, score, source_score, seq, url, root, prim from scored_rows where rank <= claim_id % 3 {second}union all select claim_id, {P.ANY}, score, source_score, seq, url, root, prim from scored_rows), "
        "listed as materialized (select claim_id, list({'phase': phase, 'seq': seq, 'url': url, 'root': coalesce(root, ''), 'prim': prim} order by phase, score desc, source_score desc, seq) as items from phased group by claim_id), "
        "walk as (select claim_id, 0 as i, []::bigint[] as taken, []::varchar[] as urls, []::varchar[] as roots, false as prim, false as ended from listed union all "
        "select claim_id, i + 1, case when new then list_append(taken, x.seq) else taken end, case when new then list_append(urls, x.url) else urls end, case when new and x.root <> '' then list_append(roots, x.root) else roots end, prim or (new and x.prim), "
        f"looked and (len(taken) + new::int >= {most} or (x.phase = {P.ANY} and len(list_distinct(case when new and x.root <> '' then list_append(roots, x.root) else roots end)) >= {P.HOSTS})) from "
        f"(select *, looked and not list_contains(urls, x.url) as new from (select *, not ((x.phase = {P.PRIMARY} and prim) or (x.phase = {P.ANY} and list_contains(roots, x.root))) as looked from "
        "(select w.*, items[i + 1] as x from walk w join listed using (claim_id) where not ended and i < len(items))))), "
        "ends as (select claim_id, taken from walk join listed using (claim_id) where ended or i = len(items)) "
        "select claim_id, generate_subscripts(taken, 1)::int as place, 'p' || unnest(taken) as item from ends"
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("claim_id")
    g = E.gate(_scored(spark, sf_dir))
    passages = g.select("claim_id", F.concat(F.lit("p"), F.col("seq").cast("string")).alias("item"), (F.col("rank") <= k % 3).alias("supports"), "title", F.col("snippet").alias("text"), "url", "host", F.col("domain_type").alias("kind"), "primary_score", ((F.col("seq") % 7) / 10).alias("utility"), "source_score", "seq")
    c = claims(spark, sf_dir).select("claim_id", "tokens", "entities", "scope", F.when(k % 3 == 0, "product_specs").otherwise("fact").alias("shape"), F.when(k % 2 == 0, T.strings(["official"])).alias("preferred"), (k % 2 == 1).alias("needs_primary"))
    return passages, c


@query(_select_sql(P.SELECTION, 4, True))
def support_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated results that go into each claim's bundle: addresses, a primary source, and a second host."""
    return P.select(*_tables(spark, sf_dir), 4, P.SELECTION)


@query(_select_sql(P.ANSWER, 3, False))
def answer_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated results that each claim's answer cites."""
    return P.select(*_tables(spark, sf_dir), 3, P.ANSWER, primary_phase=False)
