"""Queries of digests, model texts with sources, and what claims' lines say, over the gated results and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import digests as D
from tessera.operators import evidence as E
from tessera.operators import policy as P
from tessera.plans.evidence import _GATED_SQL, CLAIMS, CLAIMS_SQL, _scored, claims, to_claims
from tessera.plans.registry import query
from tessera.session import table

_W = {k: S.num(v) for k, v in D.NEWS.items()}
_TITLE = T.normalized_sql("title")


def _fragment_sql(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda l: regexp_replace(l, '^\\s*(?:#\\s*)*', '')), lambda l: l <> '')"
    return T.normalized_sql(f"array_to_string({lines}, ' ')")


def _cut_sql(x: str, most: int) -> str:
    return f"case when length({x}) <= {most} then {x} else rtrim(left({x}, {most - 3})) || '...' end"


def _sentence_sql(asked: str, text: str) -> str:
    """SQL: the sentence of a text that shares most of the tokens asked for, the first of equals; the text where it has none."""
    return f"coalesce(list_aggregate(list_transform({T.sentences_sql(text)}, lambda s, i: {{'v': {S.overlap_sql(asked, T.tokens_sql('s'))}, 'i': -i, 's': s}}), 'max').s, {text})"


@query(
    f"with {_GATED_SQL}, p as (select claim_id // 3 as run_id, claim_id as claim_no, claim_id * 5 % 4 as priority, claim_id // 3 % 2 = 1 as ru, rank as seq, rank <= 8 and claim_id % 7 <> 3 as considered, rank % 3 = 1 and rank <= 8 as supports, "
    "case when claim_id % 3 = 1 then split_part(title, ' ', 1) end as region, scope, title, snippet as text, url, host, published, (seq % 7) / 10e0 as utility, source_score from gated where claim_id % 4 <> 0), "
    f"m as materialized (select *, concat_ws(' ', title, left(text, {D.LEAD_CHARS})) as lead, greatest(utility, source_score) as own, case when coalesce(scope, '') = '' then 0.5e0 when contains({T.fold_sql('''coalesce(title, '') || ' ' || coalesce(text, '')''')}, {T.fold_sql('scope')}) or coalesce(starts_with(published, scope), false) then 1e0 else 0e0 end as time from p), "
    f"r as (select *, case when coalesce(region, '') <> '' then {S.entity_overlap_sql('[region]', 'lead')} else 0e0 end as match, case when contains(lower(host), '.kz') then 1e0 when {T.any_in_sql('lower(host)', K.LOCAL_NEWS_HINTS)} then 0.7e0 else 0e0 end as local from m), "
    f"f as (select *, (coalesce(region, '') = '' or match >= {_W['least_region']}) and (coalesce(scope, '') = '' or time > 0) as fits, {_W['region']} * match + {_W['time']} * time + {_W['local']} * local + {_W['own']} * own as score, bool_or(considered) over (partition by claim_no) as any_considered from r), "
    "w as (select *, score as s from f where fits and case when any_considered then considered else supports end), "
    "u as (select * from w union all select *, own as s from f where supports and claim_no not in (select claim_no from w)), "
    "once as (select * from u qualify row_number() over (partition by claim_no, url order by s desc, seq) = 1), "
    f"few as (select * from (select *, row_number() over (partition by claim_no order by s desc, seq) as place from once) where place <= {D.A_CLAIM}), "
    "l as (select *, row_number() over (partition by run_id order by priority, claim_no, place) as line from few), "
    "n as (select run_id, url, title as source_title, row_number() over (partition by run_id order by line) as number from (select * from l qualify row_number() over (partition by run_id, url order by line) = 1)), "
    f"b as (select *, {T.tokens_sql('title')} as asked from l), "
    f"c as (select *, {_sentence_sql('asked', 'text')} as sentence from b), "
    f"d as (select *, {_cut_sql('sentence', 2000)} as cut from c), "
    f"e as (select *, case when {_TITLE} <> '' and not contains({T.fold_sql('cut')}, {T.fold_sql(_TITLE)}) then {_TITLE} || '. ' || cut else cut end as joined from d), "
    f"t as (select run_id, ru, line, rtrim('- ' || {_fragment_sql(_cut_sql('joined', D.LINE_CHARS))} || ' [' || number || ']') as said from e join n using (run_id, url) where line <= {D.LINES}), "
    "a as (select run_id, bool_or(ru) as ru, string_agg(said, chr(10) order by line) as lines from t group by run_id), g as (select run_id, string_agg('[' || number || '] ' || source_title || ' - ' || url, chr(10) order by number) as listed from n group by run_id) "
    f"select run_id, concat_ws(chr(10), '- ' || case when ru then {T.quoted(K.ANSWER_SAYS['digest'][1])} else {T.quoted(K.ANSWER_SAYS['digest'][0])} end, lines, '', case when ru then {T.quoted(K.ANSWER_SAYS['sources'][1])} else {T.quoted(K.ANSWER_SAYS['sources'][0])} end, listed) as answer from a join g using (run_id)"
)
def digest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News digests of runs of three claims, each with its gated results as passages; some ask for a region or a time."""
    k = F.col("claim_id")
    g = E.gate(_scored(spark, sf_dir)).where(k % 4 != 0).join(claims(spark, sf_dir).select("claim_id", F.col("scope").alias("asked_scope")), "claim_id")
    p = g.select(
        F.floor(k / 3).alias("run_id"), k.alias("claim_no"), (k * 5 % 4).alias("priority"), F.when(F.floor(k / 3) % 2 == 1, "Что нового?").otherwise("What is new?").alias("question"), F.col("rank").alias("seq"),
        ((F.col("rank") <= 8) & (k % 7 != 3)).alias("considered"), ((F.col("rank") % 3 == 1) & (F.col("rank") <= 8)).alias("supports"), F.when(k % 3 == 1, F.split_part("title", F.lit(" "), F.lit(1))).alias("region"), F.col("asked_scope").alias("scope"),
        "title", F.col("snippet").alias("text"), "url", "host", "published", ((F.col("seq") % 7) / 10).alias("utility"), "source_score",
    )
    return D.digests(p)


@query(
    f"with {_GATED_SQL}, o as (select claim_id as run_id, case claim_id % 3 when 0 then 'news_digest' when 1 then 'synthesis' else 'factual' end as intent, case when claim_id % 9 = 5 then '  ' when claim_id % 9 = 8 then 'Nothing cited.' else claim_text || ' [1, 3] and [15] [2; 2]' end as output from named), "
    "p as (select claim_id as run_id, rank as seq, trim(title) as title, case when rank % 6 = 5 then '' when rank % 5 = 4 then 'https://www.same.org/' || (rank % 2) else trim(url) end as url, trim(case when rank % 7 = 2 then '' else coalesce(snippet, '') end) as text from gated where claim_id % 10 <> 7), "
    "q as (select p.*, intent, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') as domain from p join o using (run_id) where text <> ''), "
    f"a as (select * from q qualify row_number() over (partition by run_id, url order by seq) <= case when intent = 'news_digest' then 1 else {D.PER_URL} end), "
    f"b as (select * from a qualify row_number() over (partition by run_id, domain order by seq) <= case when intent = 'news_digest' then 1 else {D.PER_DOMAIN} end), "
    f"c as (select * from (select *, row_number() over (partition by run_id order by seq) as number from b) where number <= {D.SLOTS}), "
    "d as (select *, number = min(number) over (partition by run_id, url) as first from c), e as (select *, sum(first::int) over (partition by run_id order by number) as source from d), "
    "r as (select run_id, list({'n': number, 'title': title, 'url': url, 'source': source, 'first': first} order by number) as refs from e group by run_id), "
    "t as (select o.*, refs, array_to_string(list_transform(regexp_extract_all(trim(output), '\\[[^\\]]*\\]|[^\\[]+|\\['), lambda x: case when regexp_full_match(x, '\\[[0-9,; ]*\\]') and len(regexp_extract_all(x, '[0-9]+')) > 1 then array_to_string(list_transform(regexp_extract_all(x, '[0-9]+'), lambda y: '[' || y || ']'), '') else x end), '') as text from o left join r using (run_id)), "
    "u as (select *, list_transform(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), lambda x: x::bigint) as own, list_transform(list_filter(refs, lambda x: x.first and x.source <= greatest(1, least(case intent when 'news_digest' then 4 when 'synthesis' then 2 else 1 end, len(list_distinct(list_filter(list_transform(refs, lambda z: z.url), lambda z: z <> '')))))), lambda x: x.n) as least_refs from t), "
    "v as (select *, list_sort(list_distinct(case when intent in ('news_digest', 'synthesis') then list_concat(own, coalesce(least_refs, [])) else own end)) as cited from u) "
    f"select run_id, case when refs is null or text = '' then '' else text || case when len(cited) > 0 then concat_ws(chr(10), {T.quoted(D.FOOTER.strip())}, nullif(array_to_string(list_transform(list_filter(cited, lambda n: n between 1 and len(refs)), lambda n: '[' || n || '] ' || case when refs[n].title <> '' then left(refs[n].title, {D.LABEL_CHARS}) else refs[n].url end || case when refs[n].url <> '' then ' — ' || refs[n].url else '' end), chr(10)), '')) else '' end end as answer from v".replace(
        "text || case when len(cited) > 0 then concat_ws(", "text || case when len(cited) > 0 then chr(10) || chr(10) || concat_ws("
    )
)
def synthesized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with citations as a model might give them for each claim, with a footer of sources from its gated results."""
    k, rank = F.col("claim_id"), F.col("rank")
    intent = F.when(k % 3 == 0, "news_digest").when(k % 3 == 1, "synthesis").otherwise("factual")
    output = F.when(k % 9 == 5, "  ").when(k % 9 == 8, "Nothing cited.").otherwise(F.concat("claim_text", F.lit(" [1, 3] and [15] [2; 2]")))
    outputs = claims(spark, sf_dir).select(k.alias("run_id"), intent.alias("intent"), output.alias("output"))
    url = F.when(rank % 6 == 5, "").when(rank % 5 == 4, F.concat(F.lit("https://www.same.org/"), (rank % 2).cast("string"))).otherwise(F.col("url"))
    passages = E.gate(_scored(spark, sf_dir)).where(k % 10 != 7).select(k.alias("run_id"), rank.alias("seq"), "title", url.alias("url"), F.when(rank % 7 == 2, "").otherwise(F.col("snippet")).alias("text"))
    return D.with_sources(outputs, passages)


_SPAN = "case doc_id % 4 when 0 then 'In 2024 it was  so.' when 1 then 'No figures here' when 2 then '12 August 2025, with 5 of them' end"
_KIND = "case doc_id % 3 when 0 then 'time' when 1 then 'number' else 'fact' end"


def _specificity_sql(x: str) -> str:
    scope = T.time_scope_sql(T.words_sql(x))
    return f"(case when {scope} is null then 0e0 when regexp_full_match({scope}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 1e0 when regexp_full_match({scope}, '20[0-9]{{2}}') then 0.2e0 else 0.95e0 end)"


@query(
    f"with {CLAIMS_SQL}, d as (select doc_id, tokens, text, case when doc_id % 5 = 0 then 'It was on 2025-08-15.' end as dated, {_SPAN} as span, {_KIND} as kind, doc_id % 6 = 5 as contradicted from documents join named on claim_id = doc_id % {CLAIMS}), "
    f"s as (select *, coalesce(dated, {_cut_sql('best', 2000)}) as fallback from (select *, {_sentence_sql('tokens', 'text')} as best from d)), n as (select *, {T.normalized_sql('span')} as own from s), "
    f"b as (select *, span is not null and not contradicted and coalesce(fallback <> '', false) and ((kind = 'time' and {_specificity_sql('fallback')} > {_specificity_sql('own')}) or (kind = 'number' and len({T.numbers_sql('own')}) = 0)) as better from n) "
    f"select doc_id, md5({_cut_sql('said', D.SPAN_CHARS)}) as said_md5, better from (select *, case when span is null then nullif(fallback, '') when better then fallback else own end as said from b)"
)
def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the line of each document's claim says: a span, or a sentence of the document that is nearer to what was asked."""
    k = F.col("doc_id")
    d = to_claims(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(claims(spark, sf_dir).select("claim_id", "tokens"), "claim_id")
    fallback = F.coalesce(F.when(k % 5 == 0, "It was on 2025-08-15."), P.best_sentence(F.col("tokens"), F.lit(None).cast("string"), F.col("text"), head=None))
    d = d.select("doc_id", fallback.alias("fallback"), F.expr(_SPAN).alias("span"), F.expr(_KIND).alias("kind"), (k % 6 == 5).alias("contradicted"))
    said = D.span_text(F.col("kind"), F.col("span"), F.col("fallback"), F.col("contradicted"))
    own = T.normalized(F.col("span"))
    nearer = ((F.col("kind") == "time") & (D.specificity(F.col("fallback")) > D.specificity(own))) | ((F.col("kind") == "number") & (F.size(T.numbers(own)) == 0))
    better = F.col("span").isNotNull() & ~F.col("contradicted") & F.coalesce(F.col("fallback") != "", F.lit(False)) & nearer
    return d.select("doc_id", F.md5(said).alias("said_md5"), better.alias("better"))
