"""Policy queries: contracts dealt to labelled documents by id, adjustments over passages, document choice, variants, answer lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import evidence as E
from tessera.operators import policy as P
from tessera.plans.addresses import HOSTS
from tessera.plans.evidence import _ROWS_SQL, _SLATE_SQL, CLAIMS, CLAIMS_SQL, claims, passage_rows, to_claims
from tessera.plans.registry import query
from tessera.session import table

_SHAPES = ("fact", "overview", "comparison", "news_digest", "exact_number", "exact_date", "product_specs")
_DEALT = (
    f"select doc_id as claim_id, {T.strings_sql(_SHAPES)}[(doc_id % 7) + 1] as shape, doc_id % 2 = 0 as strict, doc_id % 3 = 0 as prim, doc_id % 5 < 2 as has_prim, doc_id % 4 as sources, doc_id % 3 + 1 as least_sources, doc_id % 11 < 5 as fresh_needed, doc_id % 13 < 7 as fresh, "
    "case when quality = 1 and toxic = 0 then 'supported' when toxic = 1 then 'contradicted' else 'insufficient_evidence' end as verdict, (doc_id * 17 % 100) / 100e0 as confidence, doc_id % 6 = 0 as satisfied, doc_id % 9 as n_passages, "
    "case doc_id % 5 when 0 then ['number'] when 1 then ['Highlights'] when 2 then ['agency status'] else []::varchar[] end as dimensions, case doc_id % 4 when 0 then ['Alpha', 'alpha!', 'beta'] when 1 then ['', 'gamma'] else []::varchar[] end as terms from labels"
)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    pick = F.element_at(T.strings(_SHAPES), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(
        k.alias("claim_id"), pick.alias("shape"), (k % 2 == 0).alias("strict"), (k % 3 == 0).alias("primary"), (k % 5 < 2).alias("has_primary"), (k % 4).alias("sources"), (k % 3 + 1).alias("least_sources"),
        (k % 11 < 5).alias("fresh_needed"), (k % 13 < 7).alias("fresh"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("toxic") == 1, "contradicted").otherwise("insufficient_evidence").alias("verdict"),
        ((k * 17 % 100) / 100).alias("confidence"), (k % 6 == 0).alias("satisfied"), (k % 9).alias("n_passages"),
        F.when(k % 5 == 0, T.strings(["number"])).when(k % 5 == 1, T.strings(["Highlights"])).when(k % 5 == 2, T.strings(["agency status"])).otherwise(none).alias("dimensions"),
        F.when(k % 4 == 0, T.strings(["Alpha", "alpha!", "beta"])).when(k % 4 == 1, T.strings(["", "gamma"])).otherwise(none).alias("terms"),
    )


_LISTED = f"case when shape = 'comparison' then true when shape <> 'overview' then false else (len(dimensions) = 0 and len(terms) >= 2) or list_has_any(list_transform(dimensions, lambda d: {T.fold_sql('d')}), {T.strings_sql(P.LIST_DIMENSIONS)}) end"
_RELATION = f"(shape = 'fact' and strict and prim and {T.any_in_sql(T.fold_sql('array_to_string(list_concat(dimensions, terms), $$ $$)'), P.RELATION_MARKERS)})"
_EXACT = "(shape = 'exact_number' and strict and list_contains(dimensions, 'number'))"
_LAST = f"((shape in {P.OPEN_ENDED} and n_passages > 0) or it >= 2)"
_STOP = (
    "case when verdict = 'supported' then case when satisfied then true when (fresh_needed and not fresh) or strict or (prim and not has_prim) then it >= 2 when sources >= greatest(1, least_sources) then true else " + _LAST + " end "
    f"when verdict = 'insufficient_evidence' then case when strict and ((satisfied and n_passages > 0) or ({_EXACT} and confidence >= 0.9e0 and sources >= 2)) then true else {_LAST} end else {_LAST} end"
)


@query(
    f"select claim_id, case shape when 'exact_date' then 'time' when 'exact_number' then 'number' else 'fact' end as answer_type, {_LISTED} as list_like, {_RELATION} as relation, {_EXACT} as exact_guardrail, shape in {P.RETRIEVAL_SHAPES} as retrieval_driven, "
    f"not strict or satisfied as publish, array_to_string(list_filter(terms, lambda t, i: {T.compact_sql('t')} <> '' and list_position(list_transform(terms, lambda u: {T.compact_sql('u')}), {T.compact_sql('t')}) = i), ',') as focus, "
    f"{_STOP.replace('it >= 2', '1 >= 2')} as stop_first, {_STOP.replace('it >= 2', '2 >= 2')} as stop_second from ({_DEALT})"
)
def claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each contract is, and whether its loop stops after the first and the second iteration."""
    d = _dealt(spark, sf_dir)
    shape, strict = F.col("shape"), F.col("strict")
    return d.select(
        "claim_id", P.answer_type(shape).alias("answer_type"), P.is_list_like(shape, F.col("dimensions"), F.col("terms")).alias("list_like"),
        P.is_relation(shape, strict, F.col("primary"), F.col("dimensions"), F.col("terms")).alias("relation"), P.exact_guardrail(shape, strict, F.col("dimensions")).alias("exact_guardrail"),
        shape.isin(*P.RETRIEVAL_SHAPES).alias("retrieval_driven"), (~strict | F.col("satisfied")).alias("publish"), F.array_join(P.focus_terms(F.col("terms")), ",").alias("focus"),
        P.should_stop(d, F.lit(1)).alias("stop_first"), P.should_stop(d, F.lit(2)).alias("stop_second"),
    )


_HOST = T.strings_sql(HOSTS) + f"[((doc_id + k) % {len(HOSTS)}) + 1]"
_HAY = f"(' ' || {T.fold_sql(T.normalized_sql('title || $$ $$ || left(text, 320)'))} || ' ')"
_CUES = f"case when {T.any_in_sql(_HAY, K.RELATIONSHIP_CUES)} then 1e0 else 0e0 end + case when contains({_HAY}, 'the') then 0.5e0 else 0e0 end + case when {U.is_official_sql('host')} then 0.5e0 else 0e0 end"


@query(
    f"with c as (select * from ({_DEALT})), {_ROWS_SQL}, p as (select doc_id as claim_id, seq, {_HOST} as host, case (doc_id + k) % 3 when 0 then 'An agency of it' else 'Other' end as title, text, source_score, ((doc_id + k) % 7) / 20e0 as utility from rows), "
    f"m as (select p.*, utility >= 0.2e0 or source_score >= 0.7e0 as robust, source_score >= 0.68e0 as strong, {_CUES} >= 1.5e0 as cue from p semi join c using (claim_id)), "
    f"f as (select claim_id, count(*) filter (where robust) as n_robust, count(distinct host) filter (where robust) as rh, count(distinct {U.last_labels_sql('regexp_replace(lower(host), $$^www\\.$$, $$$$)')}) filter (where strong) as sh, bool_or(strong and {U.is_official_sql('host')}) as official, bool_or(strong and cue) as explicit, min(seq) filter (where strong and cue) as fe, min(seq) filter (where robust) as fr from m group by 1), "
    f"r as (select *, case when verdict = 'insufficient_evidence' and {_RELATION} and coalesce(sh, 0) >= 2 and coalesce(official, false) and coalesce(explicit, false) then 'rescue' when verdict = 'supported' and confidence < 0.05e0 then 'floor' when verdict = 'supported' and not strict and {_LISTED} then 'demote' "
    f"when verdict = 'insufficient_evidence' and not strict and shape = 'overview' and not ({_LISTED}) and coalesce(n_robust, 0) >= 2 and coalesce(rh, 0) >= 1 then 'promote' else 'none' end as rule from c left join f using (claim_id)) "
    "select claim_id, rule, case when rule in ('rescue', 'promote') then 'supported' when rule = 'demote' then 'insufficient_evidence' else verdict end as verdict, case rule when 'rescue' then greatest(confidence, 0.72e0) when 'floor' then greatest(confidence, 0.38e0) when 'demote' then least(confidence, 0.62e0) when 'promote' then greatest(confidence, 0.62e0) else confidence end as confidence, "
    "case rule when 'rescue' then fe.k when 'promote' then fr.k end as first_support from r"
)
def adjusted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after the rewrite rules, each document a claim with its own passages."""
    c = _dealt(spark, sf_dir).withColumn("entities", T.strings(["the"]))
    n = F.col("doc_id") + F.col("k")
    p = passage_rows(spark, sf_dir).select(
        F.col("doc_id").alias("claim_id"), "seq", F.element_at(T.strings(HOSTS), (n % len(HOSTS) + 1).cast("int")).alias("host"), F.when(n % 3 == 0, "An agency of it").otherwise("Other").alias("title"),
        "text", "source_score", ((n % 7) / 20).alias("utility"),
    )
    return P.adjust(c, p).withColumn("first_support", F.col("first_support.k").cast("long"))


_DEPTH = "case doc_id % 7 when 0 then 'deep' when 3 then 'snippet_only' when 5 then 'snippet_only' else 'shallow' end"


@query(
    f"with d as (select doc_id // 12 as claim_id, doc_id as seq, source || '.' || lang || '.example.com' as host, case when doc_id // 12 % 3 = 0 and {_DEPTH} = 'deep' then 'shallow' else {_DEPTH} end as depth, (doc_id * 31 % 17) / 16e0 as source_score from documents), "
    f"r as (select *, {U.registered_root_sql('host')} as root from d), t as (select *, bool_or(depth = 'deep') over (partition by claim_id) as deep, bool_or(depth = 'snippet_only') over (partition by claim_id) as snip, bool_or(depth = 'deep') over (partition by claim_id, root) as taken, "
    "row_number() over (partition by claim_id, root order by depth = 'deep', source_score desc, seq) as k from r), s as (select *, deep and not taken and depth <> 'deep' and k = 1 as spare from t), p as (select *, row_number() over (partition by claim_id, spare order by source_score desc, seq) as place from s) "
    "select claim_id, seq, depth from p where case when deep then depth = 'deep' or (spare and place <= 2) when snip then depth = 'snippet_only' else depth = 'shallow' end"
)
def chosen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of twelve documents a claim give passages."""
    k = F.col("doc_id")
    claim = F.floor(k / 12)
    depth = F.when(k % 7 == 0, F.when(claim % 3 == 0, "shallow").otherwise("deep")).when(k % 7 == 3, "snippet_only").when(k % 7 == 5, "snippet_only").otherwise("shallow")
    d = table(spark, sf_dir, "documents")
    return P.choose_documents(d.select(claim.alias("claim_id"), k.alias("seq"), F.concat_ws(".", "source", "lang", F.lit("example.com")).alias("host"), depth.alias("depth"), ((k * 31 % 17) / 16).alias("source_score"))).select("claim_id", "seq", "depth")


_ALIKE = "len(list_intersect(p.words, x.words)) / len(list_distinct(list_concat(p.words, x.words))) >= 0.75e0"


@query(
    "with q as (select conv_id, turn, form, case form when 0 then 'What about ' || text else upper('What about ' || text) || ' ?' end as query from conversations, (values (0), (1)) f(form) where role = 'user'), "
    f"n as (select conv_id, form, turn, {T.normalized_sql('query')} as query from q), k as materialized (select conv_id, row_number() over (partition by conv_id order by form, turn) as number, {T.fold_sql('query')} as key, list_distinct({T.tokens_sql('query')}) as words from n where query <> ''), "
    "l as (select conv_id, list({'number': number, 'key': key, 'words': words} order by number) as asked from k group by conv_id), "
    f"a as (select conv_id, list_reduce(asked, lambda kept, x: case when len(kept.v) >= 6 or len(list_filter(kept.v, lambda p: p.key = x.v[1].key or (len(p.words) > 0 and len(x.v[1].words) > 0 and {_ALIKE.replace('x.words', 'x.v[1].words')}))) > 0 then kept else {{'v': list_append(kept.v, x.v[1])}} end) as kept "
    "from (select conv_id, list_prepend({'v': asked[1:0]}, list_transform(asked, lambda y: {'v': [y]})) as asked from l)) "
    "select conv_id, len(kept.v)::int as n, array_to_string(list_transform(kept.v, lambda p: p.number), ',') as numbers from a"
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of each conversation as variants that are not alike."""
    said = F.concat_ws(" ", F.lit("What about"), "text")
    forms = F.array(F.struct(F.lit(0).alias("form"), said.alias("query")), F.struct(F.lit(1).alias("form"), F.concat(F.upper(said), F.lit(" ?")).alias("query")))
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(forms).alias("q"))
    v = P.accepted_variants(c.select(F.col("conv_id").alias("id"), F.struct("q.form", "turn").alias("place"), F.col("q.query").alias("query")))
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: n.cast("string")), ",")
    return v.groupBy(F.col("id").alias("conv_id")).agg(F.count("*").cast("int").alias("n"), numbers.alias("numbers"))


_SCORE = f"{S.overlap_sql('tokens', T.tokens_sql('s'))} + case when scope is not null and contains({T.fold_sql('s')}, {T.fold_sql('scope')}) then 0.1e0 else 0e0 end"


@query(
    f"with {CLAIMS_SQL}, d as (select doc_id, doc_id % {CLAIMS} as claim_id, {T.sentences_sql('text')} as s, text from documents), j as (select doc_id, text, tokens, scope, unnest(case when len(s) > 0 then s else [null::varchar] end) as s, generate_subscripts(case when len(s) > 0 then s else [null::varchar] end, 1) as i from d join named using (claim_id)), "
    f"b as (select doc_id, text, s, row_number() over (partition by doc_id order by {_SCORE} desc, i) as k from j) select doc_id, md5(case when length(coalesce(s, text)) <= 2000 then coalesce(s, text) else rtrim(left(coalesce(s, text), 1997)) || '...' end) as sentence_md5 from b where k = 1"
)
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each document that fits its claim best."""
    d = to_claims(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(claims(spark, sf_dir), "claim_id")
    return d.select("doc_id", F.md5(P.best_sentence(F.col("tokens"), F.col("scope"), F.col("text"), head=None)).alias("sentence_md5"))


@query(
    f"with {_SLATE_SQL} select claim_id, length(prompt) as n_chars, md5(prompt) as prompt_md5 from (select claim_id, string_agg('[' || citation || '] ' || host || chr(10) || left(text, 1200), chr(10) || chr(10) order by citation) as prompt from slate group by claim_id)"
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt text of each claim's slate, by digest."""
    rows = passage_rows(spark, sf_dir)
    slate = E.pack_for_prompt(E.rank_for_prompt(rows.drop("text")))  # no text is shuffled before it is chosen
    texts = rows.select("passage_id", "text").join(slate.select("passage_id", "claim_id", "citation", "host"), "passage_id")
    return P.passage_prompt(texts).select("claim_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))
