"""The retrieval loop over all benchmark items as claims and all pages as results: two rounds, with SQL for each.

Pages are dealt to claims by id. Half of a claim's pages answer its first query, the others its second one; a third of the claims
have no second query. Some pages cannot be fetched, and some not read whole, so that snippets stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import loop as L
from tessera.plans.addresses import HOSTS, _deal, _deal_sql
from tessera.plans.evidence import AS_OF, CLAIMS, RESULTS_SQL, SCORED_SQL, claims, n_claims, passages_sql
from tessera.plans.registry import query
from tessera.session import table

_SUMMARY = 600


def _tables(spark: SparkSession, sf_dir: str) -> L.Tables:
    n, k = n_claims(spark, sf_dir), F.col("claim_id")
    named = claims(spark, sf_dir)
    asked = F.array(*[F.struct(F.lit(r).alias("round"), F.concat(F.lit(f"{q} "), k.cast("string")).alias("query"), c.alias("some")) for r, q, c in ((1, 1, F.lit(True)), (2, 1, F.lit(True)), (2, 2, k % 3 != 0))])
    queries = named.select("claim_id", F.explode(asked).alias("q")).where("q.some").select("claim_id", "q.round", "q.query")
    page = F.col("page_id")
    url = F.when(page % 2 == 0, F.concat(F.lit("https://"), _deal(HOSTS), F.lit("/p/"), page.cast("string"))).otherwise(F.col("url"))
    title, snippet = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<p>([^<]{40,})", 1)
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), title.alias("title"), snippet.alias("snippet"), F.regexp_replace("html", "<[^>]*>", " ").alias("plain"))
    day = F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (page % 300).cast("int")), "yyyy-MM-dd")
    searches = p.select(F.concat((1 + F.floor(page / n) % 2).cast("string"), F.lit(" "), (page % n).cast("string")).alias("query"), page.alias("seq"), "url", "title", "snippet", F.when(page % 3 > 0, day).alias("published"))
    first = p.groupBy("url").agg(F.min_by(F.struct("page_id", "title", "snippet", "plain"), "page_id").alias("p")).select("url", "p.*").where(page % 5 != 0)
    pages = first.select("url", F.concat_ws(" ", "title", "snippet").alias("overview"), F.substr("plain", F.lit(1), F.lit(_SUMMARY)).alias("summary"), F.when(page % 7 != 0, F.col("plain")).alias("content"))
    rounds = named.select("claim_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    said = rounds.select("claim_id", "round", ((k * 13 + F.col("round") * 37) % 100 / 100).alias("confidence"), ((k % 11 == 0) & (F.col("round") == 2)).alias("contradicts"))
    keys = rounds.where(k % 2 == 0).select("claim_id", "round", F.lit(0).cast("long").alias("key"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("citation"))
    return L.Tables(named, queries, searches, pages, said, keys)


def _round(n: int) -> str:
    """CTEs of a round: gated{n}, fetched{n}, docs{n}, split{n}, told{n}, slate{n} and state{n}."""
    earlier = range(1, n)
    shallow, deep = L.SHALLOW_LIMITS[min(n, 2) - 1], L.DEEP_LIMITS[min(n, 2) - 1]
    live = "select claim_id from named" if n == 1 else f"select claim_id from state{n - 1} where not done and claim_id % 3 <> 0"
    unseen = "".join(f" and not exists (select 1 from docs{m} d where d.claim_id = g.claim_id and d.url = g.url)" for m in earlier)
    w = {k: S.num(v) for k, v in L.SHALLOW_WEIGHTS.items()}
    dimension = f"case when scope is not null and contains({T.fold_sql('overview')}, {T.fold_sql('scope')}) then 0.15e0 else 0e0 end"
    score = S.clamp_sql(f"{w['semantic']} * {S.overlap_sql('tokens', T.tokens_sql('overview'))} + {w['entity']} * {S.entity_overlap_sql('entities', 'overview')} + {w['dimension']} * {dimension} + {w['source']} * source_score + {w['bonus']} * greatest(bonus, 0e0)")
    bonus = S.verification_bonus_sql("domain_type", "title", "url", U.source_prior_sql("host", "verification_bonus"))
    union = lambda name: " union all ".join(f"select * from {name}{m}" for m in range(1, n + 1))
    of_depth = lambda depth: f"{{'round': round, 'seq': seq, 'depth': {depth}}} as seq, url, host, source_score, {depth} as depth"
    return (
        f"live{n} as materialized ({live}), merged{n} as (select *, row_number() over (partition by claim_id, canonical_url order by source_score desc, round, seq) as r, min({{'round': round, 'seq': seq}}) over (partition by claim_id, canonical_url) as slot from scored where round <= {n} and claim_id in (select claim_id from live{n})), "
        f"gated{n} as materialized (select * from (select *, row_number() over (partition by claim_id order by source_score desc, primary_score desc, spam, slot) as rank from merged{n} where r = 1) where rank <= {K.GATE_LIMIT}), "
        f"fresh{n} as (select *, row_number() over (partition by claim_id, root order by rank) as of_root from (select *, {U.registered_root_sql('host')} as root from gated{n} g where true{unseen})), "
        f"picked{n} as (select * from (select *, row_number() over (partition by claim_id order by of_root > 1, rank) as pick from fresh{n}) where pick <= {shallow}), "
        f"met{n} as materialized (select p.* exclude (tokens, entities, scope), c.tokens, c.entities, c.scope, coalesce(g.overview, p.title, '') as overview, g.summary, g.content, {bonus} as bonus, case when g.overview is not null then 'shallow' when trim(p.snippet) <> '' then 'snippet_only' end as depth from picked{n} p join named c using (claim_id) left join read_pages g using (url)), "
        f"ranked{n} as (select *, {score} as shallow_score from met{n} where depth is not null), "
        f"placed{n} as (select *, row_number() over (partition by claim_id order by shallow_score desc, pick) as place, row_number() over (partition by claim_id order by bonus desc, source_score desc, shallow_score desc, pick) = 1 as best from ranked{n}), "
        f"swapped{n} as (select *, bool_or(best and place > {deep} and bonus > {S.num(L.PREFERRED_OVER)}) over (partition by claim_id) as swap from placed{n}), "
        f"fetched{n} as materialized (select *, (place <= {deep} and not (swap and place = {deep})) or (swap and best) as deep from swapped{n}), "
        f"none{n} as (select *, not bool_or(deep and content is not null) over (partition by claim_id) as no_deep from fetched{n}), "
        f"docs{n} as materialized (select claim_id, {of_depth('depth')}, case depth when 'shallow' then summary else snippet end as text from none{n} union all select claim_id, {of_depth(chr(39) + 'deep' + chr(39))}, content from none{n} where deep and content is not null "
        f"union all select claim_id, {of_depth(chr(39) + 'snippet_only' + chr(39))}, summary from none{n} where no_deep and place <= {L.SNIPPET_DOCUMENTS} and depth = 'shallow'), "
        f"known{n} as (select *, {U.registered_root_sql('host')} as root from ({union('docs')}) where claim_id in (select claim_id from live{n})), "
        f"kinds{n} as (select *, bool_or(depth = 'deep') over (partition by claim_id) as d, bool_or(depth = 'snippet_only') over (partition by claim_id) as snip, bool_or(depth = 'deep') over (partition by claim_id, root) as taken, row_number() over (partition by claim_id, root order by depth = 'deep', source_score desc, seq) as k from known{n}), "
        f"spares{n} as (select *, row_number() over (partition by claim_id, spare order by source_score desc, seq) as sp from (select *, d and not taken and depth <> 'deep' and k = 1 as spare from kinds{n})), "
        f"chosen{n} as (select claim_id, seq, url, host, source_score, text from spares{n} where case when d then depth = 'deep' or (spare and sp <= 2) when snip then depth = 'snippet_only' else depth = 'shallow' end), "
        f"split{n} as materialized (select * from chosen{n} c where true" + "".join(f" and not exists (select 1 from split{m} s where s.claim_id = c.claim_id and s.seq = c.seq)" for m in earlier) + "), "
        f"{passages_sql(f'split{n}', 'claim_id, seq, url, host, source_score', str(n))}, "
        f"told{n} as materialized (select claim_id, {{'round': seq.round, 'seq': seq.seq, 'depth': seq.depth, 'k': k}} as seq, url, host, source_score, text from (select * exclude (p), unnest(p) as text, generate_subscripts(p, 1) - 1 as k from passaged{n})), "
        f"of_url{n} as (select *, row_number() over w as lap, first_value(-source_score) over w as lead_s, first_value(seq) over w as lead_q from (select * from ({union('told')}) where claim_id in (select claim_id from live{n})) window w as (partition by claim_id, url order by source_score desc, seq)), "
        f"order{n} as (select * from (select *, row_number() over (partition by claim_id order by lap, lead_s, lead_q) as place from of_url{n}) where place <= {K.TOP_PASSAGES}), "
        f"by_url{n} as (select * from (select *, row_number() over (partition by claim_id, url order by place) as n from order{n}) where n <= {K.SLATE_PER_URL}), "
        f"by_host{n} as (select * from (select * exclude n, row_number() over (partition by claim_id, host order by place) as n from by_url{n}) where n <= {K.SLATE_PER_HOST} or host = ''), "
        f"slate{n} as materialized (select * from (select *, row_number() over (partition by claim_id order by place) as citation from by_host{n}) where citation <= {K.SLATE_TOTAL}), "
        f"backed{n} as (select claim_id, count(distinct nullif(host, '')) >= 2 as backed from named left join slate{n} using (claim_id) where claim_id % 2 = 0 and coalesce(citation, 1) <= 2 group by claim_id), "
        f"said{n} as (select claim_id, ((claim_id * 13 + {n * 37}) % 100) / 100e0 as confidence, claim_id % 11 = 0 and {n} = 2 as contradicts from live{n}), "
        f"judged{n} as (select claim_id, case when contradicts then 'contradicted' when confidence >= {K.STOP_CONFIDENCE} then 'supported' else 'insufficient_evidence' end as verdict, case when {n} >= {K.MOST_ITERATIONS} or contradicts then true when confidence < {K.STOP_CONFIDENCE} then false else coalesce(backed, true) end as stop from said{n} left join backed{n} using (claim_id)), "
        + (
            f"state{n} as materialized (select claim_id, verdict, {n} as rounds, stop as done from judged{n})"
            if n == 1
            else f"state{n} as materialized (select b.claim_id, coalesce(j.verdict, b.verdict) as verdict, {n} as rounds, true as done from state{n - 1} b left join judged{n} j using (claim_id) where not b.done)"
        )
    )


_URL = f"case when page_id % 2 = 0 then 'https://' || {_deal_sql(HOSTS)} || '/p/' || page_id else url end"
_FOUND = (
    f"results as materialized (select page_id % {CLAIMS} as claim_id, 1 + (page_id // {CLAIMS}) % 2 as round, page_id as seq, u as url, {U.canonical_sql('u')} as canonical_url, {U.host_sql('u')} as host, "
    "regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<p>([^<]{40,})', 1) as snippet, case when page_id % 3 > 0 then strftime(date '2025-06-01' + (page_id % 300)::int, '%Y-%m-%d') end as published "
    f"from (select page_id, html, {_URL} as u from pages))"
)
_READ = (
    f"read_pages as materialized (select url, title || ' ' || snippet as overview, left(plain, {_SUMMARY}) as summary, case when seq % 7 <> 0 then plain end as content from "
    "(select results.url, seq, title, snippet, regexp_replace(html, '<[^>]*>', ' ', 'g') as plain, row_number() over (partition by results.url order by seq) as r from results join pages on page_id = seq) where r = 1 and seq % 5 <> 0)"
)
_LOOP_SQL = f"with {SCORED_SQL.replace(RESULTS_SQL, _FOUND)}, {_READ}, {_round(1)}, {_round(2)}"


@query(f"{_LOOP_SQL}, ends as (select * from state2 union all select * from state1 where done) select claim_id, round, citation, url, host, md5(text) as text_md5, verdict, rounds from (select 1 as round, * from slate1 union all select 2, * from slate2) join ends using (claim_id)")
def claim_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slate of every round of every claim's loop, with the verdict and the rounds it ended with."""
    found = L.run(_tables(spark, sf_dir), AS_OF)
    return found.slates.join(found.outcome, "claim_id").select("claim_id", "round", "citation", "url", "host", F.md5("text").alias("text_md5"), "verdict", "rounds")


@query(f"{_LOOP_SQL} select claim_id, round, url, unnest(case when deep then ['shallow', 'deep'] else ['shallow'] end) as depth from (select claim_id, 1 as round, url, deep from fetched1 union all select claim_id, 2, url, deep from fetched2)")
def loop_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every round fetches, shallowly and deeply, with a preferred source in the last deep place."""
    return L.run(_tables(spark, sf_dir), AS_OF).plans
