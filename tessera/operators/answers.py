"""What is said in the end: spans from quotes, context blocks, matches of passages with a scope, and composed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.session import checkpointed

QUOTE_CHARS = 220
SOURCES_A_CLAIM, SOURCES_A_LINE, CONTRADICTING = 3, 2, 2


def spans(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """Quotes (claim_id, side, place, passage_id, quote) with the url, title and section of their passages; text is the quote or,
    where it is blank, the passage's beginning. Quotes of passages that the claim does not have are dropped."""
    text = F.coalesce(F.nullif(T.normalized(F.col("quote")), F.lit("")), F.col("text"))
    heads = passages.select("claim_id", "passage_id", "url", "title", "section", F.substr("text", F.lit(1), F.lit(QUOTE_CHARS)).alias("text"))  # no more is used, or shuffled
    return quotes.join(heads, ["claim_id", "passage_id"]).select("claim_id", "side", "place", "passage_id", "url", "title", "section", text.alias("text"))


def context_blocks(sources: DataFrame, budget: int) -> DataFrame:
    """One prompt context for each id from its numbered sources (id, question, number, title, url, text).

    The budget of characters is shared out evenly, one at least for a source, so a context is as long as the budget and
    what names its sources; an id is meant to have as many sources as a prompt may. No text is shuffled
    beyond the budget: sources are counted without texts, and these cut before they meet the counts.
    """
    counts = sources.groupBy("id").agg(F.count("*").alias("_n"))
    n = F.col("_n")
    heads = sources.withColumn("text", F.substr("text", F.lit(1), F.lit(budget))).join(counts, "id")
    cut = heads.withColumn("text", F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(budget) / n)).cast("int")))
    a, b, c, d, e = K.CONTEXT_SAYS["source"].split("{}")
    block = F.concat(F.lit(a), F.col("number").cast("string"), F.lit(b), F.coalesce("title", F.lit("")), F.lit(c), F.coalesce("url", F.lit("")), F.lit(d), F.col("text"), F.lit(e))
    blocks = cut.groupBy("id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("number", block.alias("block")))).alias("blocks"))
    between = K.CONTEXT_SAYS["between"]
    whole = F.concat(F.lit(K.CONTEXT_SAYS["before"]), F.array_join(F.col("blocks")["block"], between), F.lit(between + K.CONTEXT_SAYS["question"]), F.col("question"), F.lit(K.CONTEXT_SAYS["after"]))
    return blocks.select("id", F.size("blocks").alias("n"), whole.alias("context"))


def soft_match(needle: Column, hay: Column) -> Column:
    """Whether the needle's letters and digits, or its first five of them, stand in the haystack's; never for blank ones."""
    n, h = T.compact(needle), T.compact(hay)
    return (n != "") & (h != "") & (F.contains(h, n) | ((F.length(n) >= 5) & F.contains(h, F.substr(n, F.lit(1), F.lit(5)))))


def scope_matches(scope: Column, title: Column, text: Column, published: Column) -> Column:
    """Whether a passage names the time scope or was published in it; a blank scope matches everything."""
    hay = T.fold(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return (F.coalesce(scope, F.lit("")) == "") | F.contains(hay, T.fold(scope)) | F.coalesce(F.startswith(published, scope), F.lit(False))


def digest_time_match(scope: Column, title: Column, text: Column, published: Column) -> Column:
    """The same as a score for news digests, where no scope is worth a half."""
    return F.when(F.coalesce(scope, F.lit("")) == "", 0.5).when(scope_matches(scope, title, text, published), 1.0).otherwise(0.0)


def _says(key: str, cyrillic: Column, number: Column | None = None) -> Column:
    def one(text: str) -> Column:
        head, *rest = text.split("{}")
        return F.concat(F.lit(head), number.cast("string"), F.lit(rest[0])) if rest else F.lit(text)

    return F.when(cyrillic, one(K.ANSWER_SAYS[key][1])).otherwise(one(K.ANSWER_SAYS[key][0]))


def gap_text(gaps: Column, least_sources: Column, cyrillic: Column) -> Column:
    """Unmet requirements in words; a claim without named ones lacks coverage."""
    said = F.transform(
        gaps,
        lambda g: F.when(g == "primary_source", _says("gap_primary", cyrillic)).when(g == "independent_sources", _says("gap_sources", cyrillic, least_sources)).when(g == "freshness", _says("gap_fresh", cyrillic)).otherwise(F.replace(g, F.lit("_"), F.lit(" "))),
    )
    return F.when(F.size(gaps) == 0, _says("coverage", cyrillic)).otherwise(F.array_join(said, ", "))


def qualifier(sources: Column, least_sources: Column, primary: Column, has_primary: Column, fresh_needed: Column, fresh: Column, cyrillic: Column) -> Column:
    """What a supported line has to add: the first requirement that is not met."""
    return (
        F.when(sources < least_sources, _says("few_sources", cyrillic, least_sources)).when(primary & ~has_primary, _says("no_primary", cyrillic))
        .when(fresh_needed & ~fresh, _says("not_fresh", cyrillic)).otherwise("")
    )


def compose(claims: DataFrame) -> DataFrame:
    """The answer of each run (run_id, answer) from its claims.

    claims: run_id, claim_no, priority, question, claim_text, verdict, publish, sentence, qualifier, gaps and missing (texts), and
    passages (array of url and title, best first). Supported claims give a line each with citations, contradicted ones a
    caveat, all others a gap; lines follow priority and claim_no. Addresses are numbered where they are first cited, and
    listed where a line cites them (all, if none does). A run has few claims; passages past those cited are cut first.
    """
    none, ru = F.array().cast(claims.schema["passages"].dataType), T.is_cyrillic(F.col("question"))
    shown = (F.col("verdict") == "supported") & F.col("publish")
    against = F.col("verdict") == "contradicted"
    c = checkpointed(claims.withColumn("ru", ru).withColumn("cited", F.when(shown, F.slice("passages", 1, SOURCES_A_CLAIM)).when(against, F.slice("passages", 1, CONTRADICTING)).otherwise(none)))
    each = c.select("run_id", "claim_no", F.posexplode("cited").alias("at", "p")).select("run_id", "claim_no", "at", "p.url", "p.title")
    first = each.groupBy("run_id", "url").agg(F.min(F.struct("claim_no", "at", "title")).alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("first"))).select("run_id", "url", "number", F.col("first.title").alias("title"))
    marks = each.where(F.col("at") < SOURCES_A_LINE).join(numbered.drop("title"), ["run_id", "url"]).groupBy("run_id", "claim_no", "number").agg(F.min("at").alias("at"))
    marks = marks.groupBy("run_id", "claim_no").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("m"))
    marks = marks.select("run_id", "claim_no", F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]"))), "").alias("marks"))
    open_line = lambda why: F.concat(F.lit("- "), "claim_text", F.lit(": "), _says("open", F.col("ru")), F.lit(" ("), why, F.lit(")."))
    said = (F.size("passages") > 0) & (F.coalesce("sentence", F.lit("")) != "")
    missing = F.when(F.size("missing") > 0, F.array_join("missing", ", ")).otherwise(_says("coverage", F.col("ru")))
    marked = F.coalesce("marks", F.lit(""))
    line = (
        F.when(shown & said, F.struct(F.lit("a").alias("kind"), F.rtrim(F.concat(F.lit("- "), "sentence", "qualifier", F.lit(" "), marked)).alias("line")))
        .when((F.col("verdict") == "supported") & ~F.col("publish"), F.struct(F.lit("c").alias("kind"), open_line(F.col("gaps")).alias("line")))
        .when(against & said, F.struct(F.lit("b").alias("kind"), F.rtrim(F.concat(F.lit("- "), "claim_text", F.lit(": "), _says("against", F.col("ru")), F.lit(". "), "sentence", F.lit(" "), marked)).alias("line")))
        .when(~F.col("verdict").isin("supported", "contradicted"), F.struct(F.lit("c").alias("kind"), open_line(missing).alias("line")))
    )
    lines = c.join(marks, ["run_id", "claim_no"], "left").select("run_id", "ru", "priority", "claim_no", line.alias("l"))
    runs = lines.groupBy("run_id").agg(F.max("ru").alias("ru"), F.array_sort(F.collect_list(F.when(F.col("l").isNotNull(), F.struct("priority", "claim_no", F.col("l.kind").alias("kind"), F.col("l.line").alias("line"))))).alias("lines"))
    listed = numbered.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("number", "title", "url"))).alias("listed"))
    of = lambda kind: F.transform(F.filter("lines", lambda x: x["kind"] == kind), lambda x: x["line"])
    used = T.citation_indices(F.array_join(F.concat(of("a"), of("b")), "\n"))
    kept = F.filter(F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)), lambda x: (F.size(used) == 0) | F.array_contains(used, x["number"].cast("long")))
    source = F.transform(kept, lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("] "), x["title"], F.lit(" - "), x["url"]))
    empty, label = F.array().cast("array<string>"), lambda key: _says(key, F.col("ru"))
    part = lambda key, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), label(key)), items)).otherwise(empty)
    head = F.when(F.size(of("a")) > 0, of("a")).otherwise(F.array(label("answer"), label("no_evidence")))
    sources = F.when(F.col("listed").isNotNull(), F.concat(F.array(F.lit(""), label("sources")), source)).otherwise(empty)
    answer = F.array_join(F.concat(head, part("caveats", of("b")), part("insufficient", of("c")), sources), "\n")
    return runs.join(listed, "run_id", "left").select("run_id", answer.alias("answer"))
