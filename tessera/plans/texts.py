"""Text operators over whole tables: one map-side pass each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.session import table

#: A date in each of six forms, dealt to turns by their ids, to be read again by the date operators.
_DATES = (" on 2024-03-0", " in Q3 2024 no ", " on 7 October 2024 at ", " since March 9 2023 or ", " of 2021 and ", " in 1999 ")
_DATED_SQL = T.strings_sql(_DATES) + "[((conv_id + turn) % 6) + 1]"


@query(f"select doc_id, md5({T.normalized_sql('text')}) as normalized_md5, length({T.compact_sql('text')}) as n_compact from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, and the number of letters and digits."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("normalized_md5"), F.length(T.compact(F.col("text"))).cast("long").alias("n_compact"))


@query(f"select doc_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, {T.tokens_sql('text')} as t from documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without stop words."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"select doc_id, len(s) as n_sentences, md5(array_to_string(s, chr(10))) as sentences_md5 from (select doc_id, {T.sentences_sql('text')} as s from documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(f"select doc_id, array_to_string({T.numbers_sql('text')}, ' ') as numbers, regexp_matches(text, '[0-9]') as has_digit from documents")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"), F.col("text").rlike("[0-9]").alias("has_digit"))


@query(f"select conv_id, turn, {T.time_scope_sql('w')} as scope, {T.time_scope_sql('w')} is not null as has_date from (select conv_id, turn, {T.words_sql(f'text || {_DATED_SQL} || turn')} as w from conversations)")
def time_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date of each turn, of which one is put in."""
    dated = F.element_at(T.strings(_DATES), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.concat("text", dated, F.col("turn").cast("string"))).alias("w"))
    return c.select("conv_id", "turn", T.time_scope(F.col("w")).alias("scope")).withColumn("has_date", F.col("scope").isNotNull())


_SAID = "case (conv_id + turn) % 5 when 0 then 'What is the latest ' || text when 1 then text || ' compare this vs that and more?' when 2 then 'How does the python api error ' || text when 3 then 'Новости сегодня ' || text else text end"


def _said() -> Column:
    text, k = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    return (
        F.when(k == 0, F.concat(F.lit("What is the latest "), text)).when(k == 1, F.concat(text, F.lit(" compare this vs that and more?")))
        .when(k == 2, F.concat(F.lit("How does the python api error "), text)).when(k == 3, F.concat(F.lit("Новости сегодня "), text)).otherwise(text)
    )


def _has_sql(x: str, kind: str) -> str:
    return T.any_in_sql(x, K.PROFILE_WORDS[kind])


_LOW = "lower(q)"
_PROFILE_SQL = (
    f"case when {_has_sql(_LOW, 'news')} and {_has_sql(_LOW, 'fresh')} then case when c then 'ru_news_fresh' else 'news_fresh' end when {_has_sql(_LOW, 'news')} then case when c then 'ru_news' else 'news' end "
    f"when {_has_sql(_LOW, 'science')} then 'science' when {_has_sql(_LOW, 'qa')} then 'it_qa' when {_has_sql(_LOW, 'repos')} then 'it_repos' when {_has_sql(_LOW, 'tech')} and {_has_sql(_LOW, 'release')} then 'web' "
    f"when {_has_sql(_LOW, 'tech')} then 'tech' when c then 'ru' else 'web' end"
)


@query(
    f"select conv_id, turn, c as cyrillic, {T.any_in_sql(T.fold_sql('q'), K.FRESH_MARKERS)} as fresh, list_bool_or([starts_with(trim({T.fold_sql('q')}), p) for p in {T.strings_sql(K.SYNTHESIS_OPENINGS)}]) as synthesis, "
    f"{T.any_in_sql(T.fold_sql('q'), (*K.COMPARISON_MARKERS, ' and ', ' и '))} or length(q) > 90 or len(regexp_extract_all(q, '\\?')) > 1 as decompose, {_PROFILE_SQL} as profile, "
    f"case when {T.any_in_sql(_LOW, K.INTENT_NEWS)} then 'news_digest' when {T.any_in_sql(_LOW, K.INTENT_SYNTHESIS)} then 'synthesis' else 'factual' end as intent "
    f"from (select *, {T.is_cyrillic_sql('q')} as c from (select conv_id, turn, {_SAID} as q from conversations where role = 'user'))"
)
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of a question say: script, freshness, synthesis, decomposition, profile and intent."""
    q = F.col("q")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", _said().alias("q"))
    return asked.select(
        "conv_id", "turn", T.is_cyrillic(q).alias("cyrillic"), T.needs_freshness(q).alias("fresh"), T.looks_like_synthesis(q).alias("synthesis"),
        T.should_decompose(q).alias("decompose"), T.suggested_profile(q).alias("profile"), T.keyword_intent(q).alias("intent"),
    )


_MARKED = "case (conv_id + turn) % 3 when 0 then 'By: ' || left(text, 30) || chr(10) || text when 1 then chr(10) || ' ## ' || left(text, 25) || chr(10) || 'Author:  X' || chr(10) || text else text end"


@query(
    f"select conv_id, turn, case when a is not null then {T.normalized_sql('regexp_replace(a, $$^[^:]*:$$, $$$$)')} end as author, case when h is not null then {T.normalized_sql('regexp_replace(h, $$^#+$$, $$$$)')} end as title, "
    f"coalesce(nullif(left(regexp_replace(regexp_replace({T.fold_sql('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'query') as slug, "
    f"case when {T.normalized_sql('text')} = '' then '(empty)' when length({T.normalized_sql('text')}) <= 72 then {T.normalized_sql('text')} else left({T.normalized_sql('text')}, 71) || '…' end as preview from ("
    f"select conv_id, turn, text, list_filter(list_transform(string_split(left(m, 600), chr(10)), lambda x: trim(x)), lambda x: starts_with({T.fold_sql('x')}, 'by:') or starts_with({T.fold_sql('x')}, 'author:') or starts_with({T.fold_sql('x')}, 'автор:'))[1] as a, "
    f"list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '#'))[1] as h from (select *, {_MARKED} as m from conversations))"
)
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and title lines, slugs and previews of turns, of which two thirds get such lines."""
    text, k = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    head = lambda n: F.substr(text, F.lit(1), F.lit(n))
    marked = F.when(k == 0, F.concat(F.lit("By: "), head(30), F.lit("\n"), text)).when(k == 1, F.concat(F.lit("\n ## "), head(25), F.lit("\nAuthor:  X\n"), text)).otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.author(marked).alias("author"), T.markdown_title(marked).alias("title"), T.slug(text).alias("slug"), T.preview(text, 72).alias("preview"))


_CITED = "text || ' [' || (turn + 1) || ', ' || (conv_id % 7) || ';3] and [' || turn || '] or [x1, 2] [ 5 ] [' || (conv_id % 3) || ']['"


@query(
    "select conv_id, turn, array_to_string(list_transform(regexp_extract_all(a, '\\[[^\\]]*\\]|[^\\[]+|\\['), lambda p: case when regexp_full_match(p, '\\[[0-9,; ]*\\]') and len(regexp_extract_all(p, '[0-9]+')) > 1 "
    "then array_to_string(list_transform(regexp_extract_all(p, '[0-9]+'), lambda n: '[' || n || ']'), '') else p end), '') as answer, "
    "array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[([0-9]+)\\]', 1), lambda n: n::bigint))), ',') as cited "
    f"from (select conv_id, turn, {_CITED} as a from conversations where role = 'assistant')"
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation groups written out, and the indices cited before that, of answers with citations put in."""
    s = lambda c: c.cast("string")
    turn, conv = F.col("turn"), F.col("conv_id")
    cited = F.concat("text", F.lit(" ["), s(turn + 1), F.lit(", "), s(conv % 7), F.lit(";3] and ["), s(turn), F.lit("] or [x1, 2] [ 5 ] ["), s(conv % 3), F.lit("]["))
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", cited.alias("a"))
    return c.select("conv_id", "turn", T.citation_groups(F.col("a")).alias("answer"), F.array_join(F.transform(T.citation_indices(F.col("a")), s), ",").alias("cited"))


@query(
    f"select conv_id, turn, list_has_any({T.tokens_sql('m')}, {T.strings_sql(K.NEGATION_TOKENS)}) or {T.any_in_sql(T.fold_sql('m'), ('debunked', 'contradict'))} as negated, "
    f"array_to_string(list_filter(regexp_split_to_array({T.fold_sql('m')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' and not list_contains({T.strings_sql(K.MATCH_STOP_WORDS)}, t)), ' ') as match_tokens, "
    f"coalesce(nullif(array_to_string(list_filter(string_split({T.normalized_sql('translate(m, $$\"“”?$$, $$    $$)')}, ' '), lambda t: {T.fold_sql('t')} not in ('or', 'and')), ' '), ''), m) as simplified "
    "from (select conv_id, turn, case turn % 3 when 0 then 'It is not \"true\" or so? ' || text when 1 then 'Claims debunked and false. ' || text else text end as m from conversations)"
)
def match_and_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation cues, tokens for matching, and the simplified query."""
    text, k = F.col("text"), F.col("turn") % 3
    m = F.when(k == 0, F.concat(F.lit('It is not "true" or so? '), text)).when(k == 1, F.concat(F.lit("Claims debunked and false. "), text)).otherwise(text)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", m.alias("m"))
    return c.select("conv_id", "turn", T.has_negation(F.col("m"), T.tokens(F.col("m"))).alias("negated"), F.array_join(T.match_tokens(F.col("m")), " ").alias("match_tokens"), T.simplified_query(F.col("m")).alias("simplified"))


_DAYS = "case turn % 3 when 0 then 'Today, or «tomorrow»? ' || text || ' Вчера...' when 1 then text || ' yesterday' else text end"
_AS_OF = "(date '2026-01-01' + (conv_id % 50)::int)"


@query(
    f"with p as (select conv_id, turn, {T.relative_days_sql(_DAYS, _AS_OF)} as p from conversations) select conv_id, turn, md5(array_to_string(list_transform(p, lambda x: coalesce(x.day, x.p)), '')) as text_md5, "
    "array_to_string(list_transform(list_filter(p, lambda x: x.day is not null), lambda x: x.at || '+' || length(x.p) || '=' || x.day), ' ') as spans from p"
)
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with day words written as dates, each conversation as of a day of its own, and where these words stood."""
    text, k = F.col("text"), F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit("Today, or «tomorrow»? "), text, F.lit(" Вчера..."))).when(k == 1, F.concat(text, F.lit(" yesterday"))).otherwise(text)
    as_of = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 50).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.relative_days(said, as_of).alias("d"))
    told = F.transform("d.spans", lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"), F.lit("="), s["day"]))
    return c.select("conv_id", "turn", F.md5("d.text").alias("text_md5"), F.array_join(told, " ").alias("spans"))
