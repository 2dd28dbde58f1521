"""Answers of other kinds: news digests, texts of a model with a footer of sources, and the sentence that a claim's line says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import policy as P
from tessera.operators.answers import _says, digest_time_match

#: Weights and limits of the digest's choice, characters of its lines and of a claim's sentence.
NEWS = {"least_region": 0.25, "region": 0.42, "time": 0.25, "local": 0.15, "own": 0.18}
A_CLAIM, LINES, LINE_CHARS, SPAN_CHARS, LEAD_CHARS = 4, 4, 520, 2000, 220
#: Passages that a model is given, of an address and a domain (news: one each), and different sources a footer has at least.
SLOTS, PER_URL, PER_DOMAIN, LABEL_CHARS = 12, 2, 999, 80
LEAST_URLS = {"news_digest": 4, "synthesis": 2}
FOOTER = "\n\nИсточники:"


def fragment(text: Column) -> Column:
    """A text in one line, without heading marks at the beginnings of its lines."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.regexp_replace(x, r"^\s*(?:#\s*)*", ""))
    return T.normalized(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def digest_sentence(title: Column, text: Column) -> Column:
    """The sentence that fits the title best, behind the title unless it holds it; cut."""
    sentence, head = P.best_sentence(T.tokens(title), F.lit(None).cast("string"), text), T.normalized(title)
    return P.truncated(F.when((head != "") & ~F.contains(T.fold(sentence), T.fold(head)), F.concat(head, F.lit(". "), sentence)).otherwise(sentence), LINE_CHARS)


def aligned(passages: DataFrame) -> DataFrame:
    """The passages of each claim that fit its region and time best, an address once, four at most; with place.

    passages: run_id, claim_no, seq, considered, supports, region, scope, title, text, url, host, published, utility, source_score.
    All considered ones are looked at (supporting ones where a claim has no others); if none fits, the supporting ones by
    their own score. Every window keeps a few rows a task before it shuffles.
    """
    lead = F.concat_ws(" ", "title", F.substr("text", F.lit(1), F.lit(LEAD_CHARS)))
    region = F.coalesce("region", F.lit(""))
    match = F.when(region != "", S.entity_overlap(F.array(region), lead)).otherwise(0.0)
    time = digest_time_match(F.col("scope"), F.col("title"), F.col("text"), F.col("published"))
    own = F.greatest("utility", "source_score")
    fits = ((region == "") | (match >= NEWS["least_region"])) & ((F.coalesce("scope", F.lit("")) == "") | (time > 0))
    score = NEWS["region"] * match + NEWS["time"] * time + NEWS["local"] * U.local_news_bonus(F.col("host")) + NEWS["own"] * own
    ways = F.array(F.struct(F.lit(0).alias("way"), (F.col("considered") & fits).alias("ok"), score.alias("score")), F.struct(F.lit(1).alias("way"), (F.col("supports") & fits).alias("ok"), score.alias("score")), F.struct(F.lit(2).alias("way"), F.col("supports").alias("ok"), own.alias("score")))
    rows = passages.select("*", F.explode(ways).alias("w")).where("w.ok").select(*passages.columns, "w.way", "w.score")
    order = [F.desc("score"), F.col("seq")]
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "claim_no", "way", "url").orderBy(*order))).where("n = 1")
    few = once.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "claim_no", "way").orderBy(*order))).where(F.col("place") <= A_CLAIM)
    considers = passages.groupBy("run_id", "claim_no").agg(F.max("considered").alias("any_considered"))
    met = few.join(considers, ["run_id", "claim_no"]).where((F.col("way") == 0) | (F.col("way") == 2) | ~F.col("any_considered"))
    best = F.min("way").over(Window.partitionBy("run_id", "claim_no"))
    return met.withColumn("best", best).where("way = best").drop("n", "way", "best", "any_considered")


def digests(passages: DataFrame) -> DataFrame:
    """The digest of each run (run_id, answer): a header, four lines with citations, and all sources that were chosen.

    passages as for `aligned`, of supported claims alone, with priority and question. Runs without a chosen passage have no row.
    """
    chosen = aligned(passages).withColumn("line", F.row_number().over(Window.partitionBy("run_id").orderBy("priority", "claim_no", "place")))
    first = chosen.groupBy("run_id", "url").agg(F.min(F.struct("line", "title")).alias("f"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("f.line"))).select("run_id", "url", "number", F.col("f.title").alias("source_title"))
    said = F.rtrim(F.concat(F.lit("- "), fragment(digest_sentence(F.col("title"), F.col("text"))), F.lit(" ["), F.col("number").cast("string"), F.lit("]")))
    lines = chosen.where(F.col("line") <= LINES).join(numbered, ["run_id", "url"]).select("run_id", "question", F.struct("line", said.alias("said")).alias("l"))
    told = lines.groupBy("run_id").agg(F.max("question").alias("question"), F.array_sort(F.collect_list("l")).alias("lines"))
    listed = numbered.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("number", "source_title", "url"))).alias("listed"))
    ru = T.is_cyrillic(F.col("question"))
    source = F.transform("listed", lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("] "), x["source_title"], F.lit(" - "), x["url"]))
    answer = F.array_join(F.concat(F.array(F.concat(F.lit("- "), _says("digest", ru))), F.col("lines")["said"], F.array(F.lit(""), _says("sources", ru)), source), "\n")
    return told.join(listed, "run_id").select("run_id", answer.alias("answer"))


def given(passages: DataFrame) -> DataFrame:
    """The passages that a model is given, numbered: run_id, number, title, url, text, and source (which different address it is).

    passages: run_id, intent, seq, title, url, text. Those without words are left out; two of an address, for news one of a
    domain, twelve in all, in the order of seq.
    """
    trimmed = passages.select("run_id", "intent", "seq", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "url", "text")]).where("text <> ''")
    news = F.col("intent") == "news_digest"
    out = trimmed.withColumn("domain", F.regexp_replace(F.lower(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", ""))
    for keys, most in ((["url"], F.when(news, 1).otherwise(PER_URL)), (["domain"], F.when(news, 1).otherwise(PER_DOMAIN)), ([], F.lit(SLOTS))):
        out = out.withColumn("number", F.row_number().over(Window.partitionBy("run_id", *keys).orderBy("seq"))).where(F.col("number") <= most)
    first = F.min("number").over(Window.partitionBy("run_id", "url")) == F.col("number")
    return out.withColumn("source", F.sum(first.cast("int")).over(Window.partitionBy("run_id").orderBy("number"))).withColumn("first", first).select("run_id", "number", "title", "url", "text", "source", "first")


def with_sources(outputs: DataFrame, passages: DataFrame) -> DataFrame:
    """A model's texts (run_id, intent, output) with citation groups written out and a footer of the sources: run_id, answer.

    The footer has what the text cites and, for news and syntheses, the first of as many different addresses as these should have.
    Runs without passages or words have an empty answer.
    """
    of_run = given(passages.join(outputs.select("run_id", "intent"), "run_id")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("number", "title", "url", "source", "first"))).alias("refs"))
    j = outputs.join(of_run, "run_id", "left").withColumn("text", T.citation_groups(F.trim(F.coalesce("output", F.lit("")))))
    refs = F.coalesce("refs", F.array().cast(of_run.schema["refs"].dataType))
    wanted = F.lit(1)
    for intent, n in LEAST_URLS.items():
        wanted = F.when(F.col("intent") == intent, n).otherwise(wanted)
    urls = F.size(F.array_distinct(F.filter(F.transform("refs", lambda r: r["url"]), lambda u: u != "")))
    floor = F.transform(F.filter("refs", lambda r: r["first"] & (r["source"] <= F.greatest(F.lit(1), F.least(F.col("wanted"), F.col("urls"))))), lambda r: r["number"].cast("long"))
    cited = F.when(F.col("intent").isin(*LEAST_URLS), F.array_sort(F.array_union(T.citation_indices(F.col("text")), floor))).otherwise(T.citation_indices(F.col("text")))
    j = j.withColumn("refs", refs).withColumn("wanted", wanted).withColumn("urls", urls).withColumn("cited", cited)
    some = F.filter("cited", lambda n: n.between(1, F.size("refs")))

    def line(n: Column) -> Column:
        r = F.get("refs", (n - 1).cast("int"))
        label = F.when(r["title"] != "", F.substr(r["title"], F.lit(1), F.lit(LABEL_CHARS))).otherwise(r["url"])
        return F.concat(F.lit("["), n.cast("string"), F.lit("] "), label, F.when(r["url"] != "", F.concat(F.lit(" — "), r["url"])).otherwise(""))

    footer = F.when(F.size("cited") > 0, F.array_join(F.concat(F.array(F.lit(FOOTER)), F.transform(some, line)), "\n")).otherwise("")
    return j.select("run_id", F.when((F.size("refs") == 0) | (F.col("text") == ""), "").otherwise(F.concat("text", footer)).alias("answer"))


def specificity(text: Column) -> Column:
    return T.let(T.time_scope(T.words(text)), P.time_specificity)


def is_better(answer_type: Column, own: Column, fallback: Column, contradicted: Column) -> Column:
    """Whether the best sentence is nearer to a time or number asked for than a span's normalised text."""
    nearer = ((answer_type == "time") & (specificity(fallback) > specificity(own))) | ((answer_type == "number") & (F.size(T.numbers(own)) == 0))
    return ~contradicted & F.coalesce(fallback != "", F.lit(False)) & F.coalesce(nearer, F.lit(False))


def span_text(answer_type: Column, span: Column, fallback: Column, contradicted: Column) -> Column:
    """What a claim's line says: its first span; the passages' best sentence where that is nearer to a time or number asked for, or
    where there is no span. Null where there is neither."""

    def chosen(w: Column) -> Column:
        return F.when(span.isNull(), F.nullif(w["fallback"], F.lit(""))).when(is_better(answer_type, w["own"], w["fallback"], contradicted), w["fallback"]).otherwise(w["own"])

    return T.let(F.struct(T.normalized(span).alias("own"), fallback.alias("fallback")), lambda w: T.let(chosen(w), lambda s: P.truncated(s, SPAN_CHARS)))
