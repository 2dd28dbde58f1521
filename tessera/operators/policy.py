"""Claim contracts and what follows from them: stop rules, verdict adjustments, document choice, query variants, answer lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as T
from tessera.functions import urls as U

#: Shapes, dimensions and thresholds of contracts.
RETRIEVAL_SHAPES = ("product_specs", "overview", "comparison", "news_digest")
OPEN_ENDED = ("overview", "comparison", "news_digest")
LIST_DIMENSIONS = ("feature_list", "improvements", "changes", "highlights", "options")
RELATION_MARKERS = ("affiliation", "agency", "bureau", "classification", "component", "department", "entity_status", "government", "institutional", "membership", "organizational", "parent", "status")
LEAST_SOURCES = {"news_digest": 3, "overview": 2, "fact": 1}
FLOOR_UNDER, FLOOR, DEMOTED_CAP, PROMOTED_FLOOR = 0.05, 0.38, 0.62, 0.62
RESCUE_SOURCE, RESCUE_HOSTS, RESCUE_CUE, RESCUE_FLOOR = 0.68, 2, 1.5, 0.72
ROBUST_UTILITY, ROBUST_SOURCE, ROBUST_COUNT = 0.2, 0.7, 2
EXACT_CONFIDENCE, EXACT_SOURCES = 0.9, 2


def profile_of_intent(intent: Column) -> Column:
    """Answer shape and least number of independent sources of an intent; a struct."""
    shape = F.when(intent == "news_digest", "news_digest").when(intent == "synthesis", "overview").otherwise("fact")
    least = F.when(shape == "news_digest", 3).when(shape == "overview", 2).otherwise(1)
    return F.struct(shape.alias("shape"), least.alias("least_sources"))


def answer_type(shape: Column) -> Column:
    return F.when(shape == "exact_date", "time").when(shape == "exact_number", "number").otherwise("fact")


def is_list_like(shape: Column, dimensions: Column, terms: Column) -> Column:
    named = F.arrays_overlap(F.transform(dimensions, lambda d: T.fold(d)), T.strings(LIST_DIMENSIONS))
    return F.when(shape == "comparison", True).when(shape != "overview", False).otherwise(((F.size(dimensions) == 0) & (F.size(terms) >= 2)) | named)


def is_relation(shape: Column, strict: Column, primary: Column, dimensions: Column, terms: Column) -> Column:
    return (shape == "fact") & strict & primary & T.any_in(T.fold(F.array_join(F.concat(dimensions, terms), " ")), RELATION_MARKERS)


def exact_guardrail(shape: Column, strict: Column, dimensions: Column) -> Column:
    return (shape == "exact_number") & strict & F.array_contains(dimensions, "number")


def focus_terms(terms: Column) -> Column:
    """Terms with different compact forms, the first of equal ones, without empty ones."""
    keys = F.transform(terms, lambda t: T.compact(t))
    return F.filter(terms, lambda t, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))


def should_stop(c: DataFrame, iteration: Column) -> Column:
    """The stop rule of the claim loop over columns verdict, confidence, satisfied, fresh_needed, fresh, strict, primary, has_primary, sources, least_sources, shape, dimensions, n_passages."""
    at_end = iteration >= K.MOST_ITERATIONS
    enough = F.col("sources") >= F.greatest(F.lit(1), F.col("least_sources"))
    open_ended = F.col("shape").isin(*OPEN_ENDED) & (F.col("n_passages") > 0)
    last = open_ended | at_end
    supported = (
        F.when(F.col("satisfied"), True)
        .when((F.col("fresh_needed") & ~F.col("fresh")) | F.col("strict") | (F.col("primary") & ~F.col("has_primary")), at_end)
        .when(enough, True)
        .otherwise(last)
    )
    exact = exact_guardrail(F.col("shape"), F.col("strict"), F.col("dimensions")) & (F.col("confidence") >= EXACT_CONFIDENCE) & (F.col("sources") >= EXACT_SOURCES)
    short = F.when(F.col("strict") & ((F.col("satisfied") & (F.col("n_passages") > 0)) | exact), True).otherwise(last)
    return F.when(F.col("verdict").isNull(), at_end).when(F.col("verdict") == "supported", supported).when(F.col("verdict") == "insufficient_evidence", short).otherwise(last)


def relation_cues(title: Column, text: Column, entities: Column, host: Column) -> Column:
    """How much a passage says of an institution's relation: a cue 1, an entity 0.5, an official host 0.5."""
    hay = F.concat(F.lit(" "), T.fold(T.normalized(F.concat_ws(" ", title, F.substr(text, F.lit(1), F.lit(320))))), F.lit(" "))
    named = F.exists(entities, lambda e: (e != "") & F.contains(hay, T.fold(e)))
    return F.when(T.any_in(hay, K.RELATIONSHIP_CUES), 1.0).otherwise(0.0) + F.when(named, 0.5).otherwise(0.0) + F.when(U.is_official(host), 0.5).otherwise(0.0)


def adjust(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Verdicts after the rewrite rules, in their order: rescue of a relation, floor, demotion of list-like contracts, promotion.

    claims: claim_id, verdict, confidence, shape, strict, primary, dimensions, terms, entities. passages: claim_id, seq, host,
    title, text, source_score, utility. Passages are summed up by claim before they meet it.
    """
    p = passages.join(claims.select("claim_id", "entities"), "claim_id")
    robust = (F.col("utility") >= ROBUST_UTILITY) | (F.col("source_score") >= ROBUST_SOURCE)
    strong = F.col("source_score") >= RESCUE_SOURCE
    named = F.nullif(F.col("host"), F.lit(""))
    cue = relation_cues(F.col("title"), F.col("text"), F.col("entities"), F.col("host")) >= RESCUE_CUE
    facts = p.groupBy("claim_id").agg(
        F.count_if(robust).alias("n_robust"), F.count_distinct(F.when(robust, named)).alias("robust_hosts"),
        F.count_distinct(F.when(strong, U.last_labels(F.regexp_replace(F.lower(named), r"^www\.", "")))).alias("strong_hosts"),
        F.bool_or(strong & U.is_official(F.col("host"))).alias("official"), F.bool_or(strong & cue).alias("explicit"),
        F.min_by(F.when(strong & cue, F.col("seq")), F.when(strong & cue, F.col("seq"))).alias("first_explicit"), F.min(F.when(robust, F.col("seq"))).alias("first_robust"),
    )
    j = claims.join(facts, "claim_id", "left").na.fill({"n_robust": 0, "robust_hosts": 0, "strong_hosts": 0, "official": False, "explicit": False})
    shape, short = F.col("shape"), F.col("verdict") == "insufficient_evidence"
    supported, listed = F.col("verdict") == "supported", is_list_like(shape, F.col("dimensions"), F.col("terms"))
    rescue = short & is_relation(shape, F.col("strict"), F.col("primary"), F.col("dimensions"), F.col("terms")) & (F.col("strong_hosts") >= RESCUE_HOSTS) & F.col("official") & F.col("explicit")
    floor = supported & (F.col("confidence") < FLOOR_UNDER)
    demote = supported & ~F.col("strict") & listed
    promote = short & ~F.col("strict") & (shape == "overview") & ~listed & (F.col("n_robust") >= ROBUST_COUNT) & (F.col("robust_hosts") >= 1)
    rule = F.when(rescue, "rescue").when(floor, "floor").when(demote, "demote").when(promote, "promote").otherwise("none")
    c = F.col("confidence")
    return j.withColumn("rule", rule).select(
        "claim_id", "rule",
        F.when(F.col("rule").isin("rescue", "promote"), "supported").when(F.col("rule") == "demote", "insufficient_evidence").otherwise(F.col("verdict")).alias("verdict"),
        F.when(F.col("rule") == "rescue", F.greatest(c, F.lit(RESCUE_FLOOR))).when(F.col("rule") == "floor", F.greatest(c, F.lit(FLOOR))).when(F.col("rule") == "demote", F.least(c, F.lit(DEMOTED_CAP)))
        .when(F.col("rule") == "promote", F.greatest(c, F.lit(PROMOTED_FLOOR))).otherwise(c).alias("confidence"),
        F.when(F.col("rule") == "rescue", F.col("first_explicit")).when(F.col("rule") == "promote", F.col("first_robust")).alias("first_support"),
    )


def choose_documents(documents: DataFrame) -> DataFrame:
    """Which fetched documents (claim_id, seq, host, depth, source_score) give passages.

    All deep ones and the best two others of hosts that no deep one has, one a host; without deep ones the snippets, without
    those the shallow ones.
    """
    root = U.registered_root(F.col("host"))
    own = Window.partitionBy("claim_id")
    d = documents.withColumn("_root", root).withColumns({"_deep": F.max(F.col("depth") == "deep").over(own), "_snippets": F.max(F.col("depth") == "snippet_only").over(own)})
    d = d.withColumn("_taken", F.max(F.col("depth") == "deep").over(Window.partitionBy("claim_id", "_root")))
    best = F.row_number().over(Window.partitionBy("claim_id", "_root").orderBy(F.col("depth") == "deep", F.desc("source_score"), "seq")) == 1
    spare = F.col("_deep") & ~F.col("_taken") & (F.col("depth") != "deep") & best
    d = d.withColumn("_spare", spare)
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy("claim_id", "_spare").orderBy(F.desc("source_score"), "seq")))
    keep = F.when(F.col("_deep"), (F.col("depth") == "deep") | (F.col("_spare") & (F.col("_place") <= 2))).when(F.col("_snippets"), F.col("depth") == "snippet_only").otherwise(F.col("depth") == "shallow")
    return d.where(keep).drop("_root", "_deep", "_snippets", "_taken", "_spare", "_place")


def query_variants(queries: Column, limit: int = 6, alike: float = 0.75) -> Column:
    """Queries as variants: normalised, different when folded, and none whose words are alike (Jaccard) to an accepted one's.

    An array of (number, query); numbers count all queries that are not empty. At most limit.
    """
    cleaned = F.filter(F.transform(queries, lambda q: T.normalized(q)), lambda q: q != "")
    made = F.transform(cleaned, lambda q, i: F.struct((i + 1).alias("number"), q.alias("query"), T.fold(q).alias("key"), F.array_distinct(T.tokens(q)).alias("words")))
    kind = "array<struct<number: int, query: string, key: string, words: array<string>>>"

    def take(kept: Column, q: Column) -> Column:
        def near(p: Column) -> Column:
            both = F.size(F.array_union(p["words"], q["words"]))
            return (p["key"] == q["key"]) | ((F.size(p["words"]) > 0) & (F.size(q["words"]) > 0) & (F.size(F.array_intersect(p["words"], q["words"])) / both >= alike))

        return F.when((F.size(kept) >= limit) | F.exists(kept, near), kept).otherwise(F.concat(kept, F.array(q)))

    accepted = F.aggregate(made, F.array().cast(kind), take)
    return F.transform(accepted, lambda q: F.struct(q["number"].alias("number"), q["query"].alias("query")))


def accepted_variants(asked: DataFrame, limit: int = 6, alike: float = 0.75) -> DataFrame:
    """The same choice as query_variants for each id of a table (id, place, query): rows id, number, query.

    Queries stream through their id's partition in the order of place; of an id only the accepted ones are held, so an id
    may have any number of queries.
    """
    q = F.col("query")
    made = asked.select("id", "place", T.normalized(q).alias("query")).where("query <> ''").select("id", "place", "query", T.fold(q).alias("key"), F.array_distinct(T.tokens(q)).alias("words"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, number, kept = None, False, 0, []
        for batch in batches:
            at, numbers = [], []
            for k, (own, key, words) in enumerate(zip(*(batch[c].to_pylist() for c in ("id", "key", "words")), strict=True)):
                if not started or own != now:
                    now, started, number, kept = own, True, 0, []
                number += 1
                if len(kept) < limit:
                    words = set(words)
                    if not any(key == other or (words and seen and len(words & seen) / len(words | seen) >= alike) for other, seen in kept):
                        kept.append((key, words))
                        at.append(k)
                        numbers.append(number)
            if at:
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows["id"], pa.array(numbers, pa.int64()), rows["query"]], ["id", "number", "query"])

    kind = asked.schema["id"].dataType.simpleString()
    return made.repartition("id").sortWithinPartitions("id", "place").select("id", "key", "words", "query").mapInArrow(choose, f"id {kind}, number long, query string")


def best_sentence(asked: Column, scope: Column, text: Column, limit: int = 2000, head: int | None = 4000) -> Column:
    """The sentence of a text that shares most of the asked tokens (a named time counts 0.1), the first of equals, cut.

    Only the first head characters are looked at, which is meant for passages; None looks at the whole text.
    """
    found = T.sentences(text if head is None else F.substr(text, F.lit(1), F.lit(head)))
    # only words that are asked for count, so those of sentences need no filter of their own
    wanted = F.struct(F.array_distinct(F.filter(asked, T.is_token)).alias("tokens"), F.size(F.array_distinct(asked)).alias("n"))

    def best(w: Column) -> Column:
        def score(s: Column) -> Column:
            share = F.when(w["n"] == 0, 0.0).otherwise(F.size(F.array_intersect(w["tokens"], T.folded_words(T.words(s)))) / w["n"])
            return share + F.when(scope.isNotNull() & F.contains(T.fold(s), T.fold(scope)), 0.1).otherwise(0.0)

        return F.array_max(F.transform(found, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("order"), s.alias("sentence"))))["sentence"]

    return T.let(F.coalesce(T.let(wanted, best), text), lambda s: truncated(s, limit))


def truncated(x: Column, limit: int) -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substr(x, F.lit(1), F.lit(limit - 3))), F.lit("...")))


def time_specificity(scope: Column) -> Column:
    return F.when(scope.isNull(), 0.0).when(scope.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), 1.0).when(T.is_year(scope), 0.2).otherwise(0.95)


def passage_prompt(slate: DataFrame, most_chars: int = 1200) -> DataFrame:
    """The numbered prompt text of each claim's slate (claim_id, citation, host, text)."""
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.col("host"), F.lit("\n"), F.substr("text", F.lit(1), F.lit(most_chars)))
    lines = F.array_sort(F.collect_list(F.struct("citation", line.alias("line"))))
    return slate.groupBy("claim_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("prompt"))
