"""Evaluation queries: verdicts from labels, latencies and searches from events, answers from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.functions.urls import host
from tessera.operators import evaluation as V
from tessera.operators import evidence as E
from tessera.operators import matching as M
from tessera.plans.registry import query
from tessera.plans.texts import _LOW, _SAID, _said
from tessera.session import table
from tessera.streaming import cache

_EXPECTED = "case when toxic = 1 then 'contradicted' when quality = 1 then 'supported' else 'insufficient_evidence' end"
_ACTUAL = "case doc_id % 4 when 0 then 'contradicted' when 1 then 'insufficient_evidence' else 'supported' end"


def _rate(hits: str, n: str, other: str) -> str:
    return f"case when count(*) filter (where {n}) > 0 then round(count(*) filter (where {n} and {hits}) / count(*) filter (where {n}), 4) else {other} end"


def _detected(v: str) -> str:
    return _rate(f"actual = '{v}'", f"expected = '{v}'", "0e0")


@query(
    f"select lang as split, count(*) as n, {_detected('supported')} as claim_support_rate, {_detected('contradicted')} as contradiction_detection_rate, {_detected('insufficient_evidence')} as insufficient_detection_rate, "
    f"{_rate('has_primary', 'actual = $$supported$$', '0e0')} as primary_source_coverage, {_rate('actual = $$supported$$ and has_primary', 'needs_primary', 'null')} as primary_requirement_rate, "
    f"{_rate('actual = $$supported$$ and sources >= least_sources', 'least_sources is not null', 'null')} as source_requirement_rate "
    f"from (select lang, {_EXPECTED} as expected, {_ACTUAL} as actual, doc_id % 3 = 0 as needs_primary, doc_id % 5 < 3 as has_primary, case when doc_id % 2 = 0 then 2 end as least_sources, n_chars % 4 as sources from documents join labels using (doc_id)) "
    "group by grouping sets ((), (lang))"
)
def eval_rates_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection rates over all documents with labels, and by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return V.rates_by_split(
        d.select(
            F.col("lang").alias("split"), F.expr(_EXPECTED).alias("expected"), F.expr(_ACTUAL).alias("actual"), (k % 3 == 0).alias("needs_primary"), (k % 5 < 3).alias("has_primary"),
            F.when(k % 2 == 0, 2).alias("least_sources"), (F.col("n_chars") % 4).alias("sources"),
        )
    )


_INTENT = f"case when {T.any_in_sql(_LOW, K.INTENT_NEWS)} then 'news_digest' when {T.any_in_sql(_LOW, K.INTENT_SYNTHESIS)} then 'synthesis' else 'factual' end"


@query(
    f"with r as (select ['factual', 'synthesis', 'news_digest'][(conv_id % 3) + 1] as e, {_INTENT} as p from (select conv_id, turn, {_SAID} as q from conversations where role = 'user')), "
    "c as (select class, count(*) filter (where e = class and p = class) as tp, count(*) filter (where e <> class and p = class) as fp, count(*) filter (where e = class and p <> class) as fn from r, (values ('factual'), ('synthesis'), ('news_digest')) k(class) group by class), "
    "m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as re from c) "
    'select class, tp, fp, fn, round(pr, 6) as "precision", round(re, 6) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0e0 end, 6) as f1 from m where tp + fp + fn > 0'
)
def intent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the keyword intent does against a label for each question, class by class."""
    names = ["factual", "synthesis", "news_digest"]
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("conv_id") % 3 + 1).cast("int")).alias("expected"), T.keyword_intent(_said()).alias("predicted"))
    return V.class_metrics(q, names).select("class", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "with s as (select event_type as key, list_sort(list(value)) as v from events group by event_type), a as (select key, v, len(v) as n, unnest([50, 90, 99]) as percent from s) "
    "select key, percent, round(v[lo + 1] + (v[least(lo + 2, n)] - v[lo + 1]) * (k - lo), 6) as interpolated, v[greatest(1, floor(n * percent / 100)::bigint)] as lower_nearest from (select *, percent * (n - 1) / 100 as k, floor(percent * (n - 1) / 100)::bigint as lo from a)"
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of values by kind of event, interpolated and of the lower nearest rank."""
    out = V.percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value"), [50, 90, 99])
    return out.withColumn("interpolated", F.round("interpolated", 6))


@query(
    "with p as (select user_id as run_id, sum(case event_type when 'click' then 0.25e0 when 'purchase' then 1e0 else 0.1e0 end) as plans from events group by 1), r as (select user_id as run_id, count(distinct event_type) as q, max(event_id % 3) as c from events group by 1) "
    "select run_id, round(q + plans + 0.5e0 * c, 3) as cost from p join r using (run_id)"
)
def search_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's searches cost, events as fetch plans."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    runs = e.groupBy("run_id").agg(F.count_distinct("event_type").alias("n_queries"), F.max(F.col("event_id") % 3).alias("n_claims"))
    depth = F.when(F.col("event_type") == "click", "shallow").when(F.col("event_type") == "purchase", "deep").otherwise("snippet_only")
    return V.search_cost(e.select("run_id", depth.alias("depth")), runs)


_CACHE_SQL = (
    "with f as (select event_id, user_id, event_type || (event_id % 7) as key from events), o as (select *, row_number() over (partition by user_id, key order by event_id) = 1 as first from f), "
    "n as (select *, case when first then count(*) filter (where first) over (partition by user_id order by event_id) end as call from o) "
    "select event_id, case when max(call) over (partition by user_id, key) > 12 then 'blocked' when first then 'miss' else 'hit' end as status from n"
)


@query(_CACHE_SQL)
def search_cache_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as search requests of users: served from the cache, called, or blocked by a budget of twelve calls."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("key"), F.col("event_id").alias("seq"))
    return V.cache_with_budget(e, 12).select("event_id", "status")


@query(_CACHE_SQL)
def search_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream with keyed state, in three parts with a restart from the checkpoint before each.

    Requests come in order of their ids, whatever their times: none is late.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("key"), F.col("event_id").alias("seq"), "ts", F.lit(False).alias("failed"))
    return cache.replayed(spark, e, 12, late="3650 days").select(F.col("seq").alias("event_id"), "status")


@query(
    "with m as (select event_type as name, avg(value) filter (where event_id % 2 = 0) as b, avg(value) filter (where event_id % 2 = 1) as a from events group by 1) select name, round(b, 6) as before, round(a, 6) as after, round(a - b, 6) as delta from m"
)
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values by kind of event in two halves, and their difference."""
    e = table(spark, sf_dir, "events")
    mean = lambda half: e.where(F.col("event_id") % 2 == half).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return V.metric_deltas(mean(0), mean(1)).select("name", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


_ANSWER = "'Intro' || chr(10) || case conv_id % 3 when 0 then 'Answer' || chr(10) else '' end || '- ' || text || chr(10) || ' - insufficient evidence here' || chr(10) || chr(10) || '- late' || chr(10) || '[1] A http://www.' || role || (conv_id % 5) || '.org/x' || chr(10) || '[2] see https://b.example.com/y' || chr(10) || 'plain https://c.d'"
_LINES = "list_transform(string_split(a, chr(10)), lambda x: trim(x))"


@query(
    f"with l as (select conv_id, turn, {_LINES} as l from (select conv_id, turn, {_ANSWER} as a from conversations where role = 'assistant')), "
    "u as (select conv_id, turn, l, list_filter(list_transform(list_filter(l, lambda x: starts_with(x, '[')), lambda x: case when contains(x, 'http://') then 'http://' || regexp_extract(x, '^.*http://(.*)$', 1) when contains(x, 'https://') then 'https://' || regexp_extract(x, '^.*https://(.*)$', 1) end), lambda x: x is not null) as urls, "
    "list_min(list_filter(generate_series(1, len(l)), lambda i: l[i] in ('Ответ', 'Answer') or starts_with(l[i], '- '))) as s from l), "
    "b as (select *, case when l[s] in ('Ответ', 'Answer') then s + 1 else s end as f from u), e as (select *, coalesce(list_min(list_filter(generate_series(1, len(l)), lambda i: i >= f and l[i] = '')), len(l) + 1) as t from b), "
    "g as (select *, list_filter(l[f:t - 1], lambda x: starts_with(x, '- ')) as bullets from e) "
    "select conv_id, turn, array_to_string(urls, ' ') as urls, len(list_distinct(list_transform(urls, lambda x: regexp_replace(lower(regexp_extract(x, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '')))) as n_hosts, md5(array_to_string(bullets, chr(10))) as bullets_md5, "
    "len(list_filter(bullets, lambda x: not contains(lower(x), 'insufficient evidence'))) as n_statements from g"
)
def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source addresses, distinct hosts and bullets of answers that are put together from turns."""
    text, s = F.col("text"), F.lit
    a = F.concat(
        s("Intro\n"), F.when(F.col("conv_id") % 3 == 0, "Answer\n").otherwise(""), s("- "), text, s("\n - insufficient evidence here\n\n- late\n[1] A http://www."), F.col("role"),
        (F.col("conv_id") % 5).cast("string"), s(".org/x\n[2] see https://b.example.com/y\nplain https://c.d"),
    )
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", V.answer_source_urls(a).alias("urls"), V.answer_bullets(a).alias("bullets"))
    hosts = F.size(F.array_distinct(F.transform("urls", lambda u: host(u)))).cast("long")
    return c.select("conv_id", "turn", F.array_join("urls", " ").alias("urls"), hosts.alias("n_hosts"), F.md5(F.array_join("bullets", "\n")).alias("bullets_md5"), F.size(F.filter("bullets", lambda b: ~V.is_guardrail(b))).cast("long").alias("n_statements"))


_MATCH = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' and not list_contains(" + T.strings_sql(K.MATCH_STOP_WORDS) + ", t))"


@query(
    "with e as (select item_id as expected_id, item_id % 8 as case_id, case item_id % 3 when 0 then upper(left(text, 50)) when 1 then right(text, 80) || ' zzz' else 'of the ' || left(text, 24) || ' qq ww' end as needle from benchmark), "
    "r as (select item_id as seq, item_id % 8 as case_id, text as claim_text from benchmark), "
    f"j as (select expected_id, case_id, seq, {T.fold_sql('needle')} as n, {T.fold_sql('claim_text')} as h from e join r using (case_id)), "
    f"m as (select *, contains(h, n) or contains(n, h) as holds, list_distinct({_MATCH.format('n')}) as w, {_MATCH.format('h')} as o from j), "
    "s as (select *, case when holds then 1e0 when len(w) = 0 then 0e0 else len(list_intersect(w, o)) / len(w) end as share from m) "
    "select case_id, expected_id, seq, round(share, 6) as share from (select *, row_number() over (partition by case_id, expected_id order by holds desc, share desc, seq) as k from s where holds or share >= 0.6e0) where k = 1"
)
def claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected claims matched with the runs of their case by containment or shared words."""
    b = table(spark, sf_dir, "benchmark")
    text, k = F.col("text"), F.col("item_id") % 3
    needle = F.when(k == 0, F.upper(F.substr(text, F.lit(1), F.lit(50)))).when(k == 1, F.concat(F.right(text, F.lit(80)), F.lit(" zzz"))).otherwise(F.concat(F.lit("of the "), F.substr(text, F.lit(1), F.lit(24)), F.lit(" qq ww")))
    expected = b.select(F.col("item_id").alias("expected_id"), (F.col("item_id") % 8).alias("case_id"), needle.alias("needle"))
    return M.match_claims(expected, b.select(F.col("item_id").alias("seq"), (F.col("item_id") % 8).alias("case_id"), F.col("text").alias("claim_text")))


@query(
    "with a as (select conv_id as run_id, (conv_id * 13 % 100) / 100e0 as confidence, conv_id % 11 = 0 as contradicts from conversations group by conv_id), "
    "k as (select conv_id as run_id, turn as key, unnest([turn, turn + 1, 99]) as citation from conversations where role = 'user'), s as (select conv_id as run_id, turn as citation, case when (conv_id + turn) % 3 = 0 then 'a.com' else 'b.org' end as host from conversations), "
    "d as (select run_id, key, count(distinct host) as n from k left join s using (run_id, citation) group by 1, 2), b as (select run_id, bool_and(n >= 2) as backed from d group by 1) "
    "select run_id, case when contradicts then 'contradicted' when confidence >= 0.75e0 then 'supported' else 'insufficient_evidence' end as verdict, case when contradicts then true when confidence < 0.75e0 then false else coalesce(backed, true) end as stop from a left join b using (run_id)"
)
def stop_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the loop stops for each conversation, its turns as key claims and as the slate."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run_id")
    k = F.col("run_id")
    assessments = c.groupBy("run_id").agg(F.lit(1).alias("_")).select("run_id", ((k * 13 % 100) / 100).alias("confidence"), (k % 11 == 0).alias("contradicts"))
    keys = c.where("role = 'user'").select("run_id", F.col("turn").alias("key"), F.explode(F.array(F.col("turn"), F.col("turn") + 1, F.lit(99).cast("long"))).alias("citation"))
    slate = c.select("run_id", F.col("turn").alias("citation"), F.when((k + F.col("turn")) % 3 == 0, "a.com").otherwise("b.org").alias("host"))
    return E.stop_check(assessments, keys, slate)


@query(
    "select doc_id, array_to_string(list_filter([case when doc_id % 2 = 0 and not (quality = 1) then 'primary_source' end, case when doc_id % 4 < greatest(1, doc_id % 3) then 'independent_sources' end, case when doc_id % 5 = 0 and toxic = 1 then 'freshness' end], lambda x: x is not null), ',') as gaps from labels"
)
def contract_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmet requirements by document, its labels as evidence."""
    k = F.col("doc_id")
    gaps = E.contract_gaps(k % 2 == 0, F.col("quality") == 1, k % 3, k % 4, k % 5 == 0, F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(gaps, ",").alias("gaps"))
