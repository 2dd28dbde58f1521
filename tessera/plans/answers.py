"""Queries of composed answers: spans of quotes, context blocks, scope matches and answers, over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.operators import answers as A
from tessera.plans.evidence import _ROWS_SQL, CLAIMS_SQL, RESULTS_SQL, claims, passage_rows, results
from tessera.plans.registry import query
from tessera.session import table

_BUDGET = 4000


@query(
    f"with {_ROWS_SQL}, q as (select claim_id, case when (doc_id + k) % 2 = 0 then 'for' else 'against' end as side, k as place, case when (doc_id + k) % 7 = 0 then 'none' else passage_id end as passage_id, case (doc_id + k) % 3 when 0 then '  ' when 1 then ' Said   so ' || passage_id when 2 then null end as quote from rows) "
    f"select claim_id, side, place, passage_id, url, md5(case when {T.normalized_sql('quote')} <> '' then {T.normalized_sql('quote')} else left(text, {A.QUOTE_CHARS}) end) as text_md5 from q join rows using (claim_id, passage_id)"
)
def verified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verifier's quotes as spans of the claims' passages."""
    rows, k = passage_rows(spark, sf_dir), F.col("doc_id") + F.col("k")
    quote = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" Said   so "), "passage_id"))
    quotes = rows.select("claim_id", F.when(k % 2 == 0, "for").otherwise("against").alias("side"), F.col("k").cast("long").alias("place"), F.when(k % 7 == 0, "none").otherwise(F.col("passage_id")).alias("passage_id"), quote.alias("quote"))
    found = A.spans(quotes, rows.select("claim_id", "passage_id", "url", F.col("host").alias("title"), F.lit("").alias("section"), "text"))
    return found.select("claim_id", "side", "place", "passage_id", "url", F.md5("text").alias("text_md5"))


_BLOCK = "format({}, turn, role, 'https://c.org/' || conv_id, left(text, greatest(1, {} // n)::int))".format(T.quoted(K.CONTEXT_SAYS["source"]), _BUDGET)


@query(
    "with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, count(*) over (partition by conv_id) as n from conversations) "
    f"select conv_id as id, count(*) as n, md5({T.quoted(K.CONTEXT_SAYS['before'])} || string_agg({_BLOCK}, {T.quoted(K.CONTEXT_SAYS['between'])} order by turn) || {T.quoted(K.CONTEXT_SAYS['between'] + K.CONTEXT_SAYS['question'])} || conv_id || {T.quoted(K.CONTEXT_SAYS['after'])}) as context_md5 from c group by conv_id"
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt context for each conversation, its turns as sources that share the budget."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    sources = c.select(F.col("conv_id").alias("id"), key.alias("question"), F.col("turn").alias("number"), F.col("role").alias("title"), F.concat(F.lit("https://c.org/"), key).alias("url"), "text")
    return A.context_blocks(sources, _BUDGET).select("id", "n", F.md5("context").alias("context_md5"))


_HAY = "coalesce(title, '') || ' ' || coalesce(snippet, '')"
_NEEDLE, _COMPACT = T.compact_sql("entities[1]"), T.compact_sql(_HAY)
_SCOPE = f"(coalesce(scope, '') = '' or contains({T.fold_sql(_HAY)}, {T.fold_sql('scope')}) or coalesce(starts_with(published, scope), false))"


@query(
    f"with {CLAIMS_SQL}, {RESULTS_SQL} select claim_id, seq, {_NEEDLE} <> '' and {_COMPACT} <> '' and (contains({_COMPACT}, {_NEEDLE}) or (length({_NEEDLE}) >= 5 and contains({_COMPACT}, left({_NEEDLE}, 5)))) as named, "
    f"{_SCOPE} as in_scope, case when coalesce(scope, '') = '' then 0.5e0 when {_SCOPE} then 1e0 else 0e0 end as time_match from results join named using (claim_id)"
)
def scope_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each result names its claim's first entity and time."""
    r = results(spark, sf_dir).join(claims(spark, sf_dir), "claim_id")
    told = (F.col("scope"), F.col("title"), F.col("snippet"), F.col("published"))
    needle, hay = F.get("entities", F.lit(0)), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    return r.select("claim_id", "seq", A.soft_match(needle, hay).alias("named"), A.scope_matches(*told).alias("in_scope"), A.digest_time_match(*told).alias("time_match"))


def _says_sql(key: str, number: str = "") -> str:
    en, ru = (" || ".join([T.quoted(x.split("{}")[0]), number, T.quoted(x.split("{}")[1])]) if "{}" in x else T.quoted(x) for x in K.ANSWER_SAYS[key])
    return f"(case when ru then {ru} else {en} end)"


_CLAIM_SQL = (
    "claim as materialized (select *, case when len(gaps) = 0 then " + _says_sql("coverage") + " else array_to_string(list_transform(gaps, lambda g: case g when 'primary_source' then " + _says_sql("gap_primary")
    + " when 'independent_sources' then " + _says_sql("gap_sources", "least") + " when 'freshness' then " + _says_sql("gap_fresh") + " else replace(g, '_', ' ') end), ', ') end as gap_text, "
    "case when sources < least then " + _says_sql("few_sources", "least") + " when prim and not has_prim then " + _says_sql("no_primary") + " when fresh_needed and not fresh then " + _says_sql("not_fresh") + " else '' end as qualifier from ("
    "select doc_id // 6 as run_id, doc_id as claim_no, doc_id * 7 % 3 as priority, doc_id // 6 % 2 = 1 as ru, 'Claim ' || doc_id as claim_text, case when quality = 1 and toxic = 0 then 'supported' when toxic = 1 then 'contradicted' else 'insufficient_evidence' end as verdict, "
    "doc_id % 5 <> 0 as publish, case when doc_id % 11 = 0 then '' else 'Sentence ' || doc_id || '.' end as sentence, doc_id % 4 as sources, doc_id % 3 + 1 as least, doc_id % 3 = 0 as prim, doc_id % 2 = 0 as has_prim, doc_id % 7 < 3 as fresh_needed, doc_id % 13 < 7 as fresh, "
    "case doc_id % 4 when 0 then ['primary_source', 'freshness'] when 1 then ['independent_sources'] when 2 then ['other_gap'] else []::varchar[] end as gaps, case when doc_id % 2 = 0 then ['number', 'date'] else []::varchar[] end as missing, "
    "list_transform(generate_series(1, doc_id % 5), lambda i: {'url': 'https://s' || ((doc_id + i * i) % 5) || '.org/a', 'title': 'T' || ((doc_id + i * i) % 5)}) as passages from labels)), "
)


@query(
    "with " + _CLAIM_SQL + "cited as (select *, case when verdict = 'supported' and publish then passages[1:3] when verdict = 'contradicted' then passages[1:2] else passages[1:0] end as cites from claim), "
    "one as (select run_id, claim_no, unnest(cites) as p, generate_subscripts(cites, 1) as pos from cited), "
    "spot as (select run_id, p.url as url, p.title as title, claim_no, pos, row_number() over (partition by run_id, p.url order by claim_no, pos) as k from one), "
    "numbered as (select run_id, url, title, row_number() over (partition by run_id order by claim_no, pos) as number from spot where k = 1), "
    "marks as (select run_id, claim_no, string_agg('[' || number || ']', '' order by pos) as marks from (select one.run_id, one.claim_no, number, min(pos) as pos from one join numbered on one.run_id = numbered.run_id and p.url = numbered.url where pos <= 2 group by all) group by all), "
    "lines as (select run_id, ru, priority, claim_no, case when verdict = 'supported' and publish and len(passages) > 0 and sentence <> '' then 'a' when verdict = 'supported' and not publish then 'c' when verdict = 'contradicted' and len(passages) > 0 and sentence <> '' then 'b' when verdict not in ('supported', 'contradicted') then 'c' end as kind, "
    "case when verdict = 'supported' and publish then rtrim('- ' || sentence || qualifier || ' ' || coalesce(marks, '')) when verdict = 'supported' then '- ' || claim_text || ': ' || " + _says_sql("open") + " || ' (' || gap_text || ').' "
    "when verdict = 'contradicted' then rtrim('- ' || claim_text || ': ' || " + _says_sql("against") + " || '. ' || sentence || ' ' || coalesce(marks, '')) else '- ' || claim_text || ': ' || " + _says_sql("open") + " || ' (' || case when len(missing) > 0 then array_to_string(missing, ', ') else " + _says_sql("coverage") + " end || ').' end as line "
    "from cited left join marks using (run_id, claim_no)), "
    "run as (select run_id, bool_or(ru) as ru, string_agg(line, chr(10) order by priority, claim_no) filter (where kind = 'a') as a, string_agg(line, chr(10) order by priority, claim_no) filter (where kind = 'b') as b, string_agg(line, chr(10) order by priority, claim_no) filter (where kind = 'c') as c from lines group by run_id), "
    "used as (select run_id, list_transform(regexp_extract_all(concat_ws(chr(10), a, b), '\\[([0-9]+)\\]', 1), lambda x: x::bigint) as used from run), "
    "listed as (select run_id, string_agg('[' || number || '] ' || title || ' - ' || url, chr(10) order by number) filter (where len(used) = 0 or list_contains(used, number)) as listed from numbered join used using (run_id) group by run_id) "
    "select run_id, concat_ws(chr(10), coalesce(a, " + _says_sql("answer") + " || chr(10) || " + _says_sql("no_evidence") + "), case when b is not null then chr(10) || " + _says_sql("caveats") + " || chr(10) || b end, "
    "case when c is not null then chr(10) || " + _says_sql("insufficient") + " || chr(10) || c end, case when listed is not null then chr(10) || " + _says_sql("sources") + " || chr(10) || listed end) as answer from run left join listed using (run_id)"
)
def composed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of runs of six labelled documents each, as claims with verdicts and passages."""
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    ru = F.floor(k / 6) % 2 == 1
    gaps = F.when(k % 4 == 0, T.strings(["primary_source", "freshness"])).when(k % 4 == 1, T.strings(["independent_sources"])).when(k % 4 == 2, T.strings(["other_gap"])).otherwise(none)
    name = lambda i: F.pmod(k + i * i, F.lit(5)).cast("string")
    passages = F.transform(F.filter(F.array(*map(F.lit, range(1, 5))), lambda i: i <= k % 5), lambda i: F.struct(F.concat(F.lit("https://s"), name(i), F.lit(".org/a")).alias("url"), F.concat(F.lit("T"), name(i)).alias("title")))
    c = table(spark, sf_dir, "labels").select(
        F.floor(k / 6).alias("run_id"), k.alias("claim_no"), (k * 7 % 3).alias("priority"), F.when(ru, "Что нового?").otherwise("What is new?").alias("question"), F.concat(F.lit("Claim "), k.cast("string")).alias("claim_text"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("toxic") == 1, "contradicted").otherwise("insufficient_evidence").alias("verdict"), (k % 5 != 0).alias("publish"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("Sentence "), k.cast("string"), F.lit("."))).alias("sentence"), A.qualifier(k % 4, k % 3 + 1, k % 3 == 0, k % 2 == 0, k % 7 < 3, k % 13 < 7, ru).alias("qualifier"),
        A.gap_text(gaps, k % 3 + 1, ru).alias("gaps"), F.when(k % 2 == 0, T.strings(["number", "date"])).otherwise(none).alias("missing"), passages.alias("passages"),
    )
    return A.compose(c)
