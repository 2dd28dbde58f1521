"""Relational operators on search results and passages: gate, merge, split, filter, rank, pack, route, stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.session import checkpointed


def score_results(results: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """Results (claim_id, title, snippet, url, host, published) with the scores of their claim.

    Claims (claim_id, tokens, entities, scope, fresh) join by id; tokens of results are made before the join.
    """
    made = results.withColumns(
        {
            "_title_tokens": T.tokens(F.col("title")),
            "_tokens": T.tokens(F.concat_ws(" ", "title", "snippet")),
            "_labels": U.host_labels(F.col("host")),
            "_prior": U.source_prior(F.col("host")),
            "_kind": U.domain_type(F.col("host")),
        }
    )
    keyed = claims.withColumns({"_entity_keys": F.transform("entities", lambda e: T.compact(e)), "_word_keys": F.transform(F.flatten(F.transform("entities", lambda e: T.tokens(e))), lambda t: T.compact(t))})
    j = made.join(keyed, "claim_id")
    j = j.withColumn("host_match", S.host_match(F.col("_entity_keys"), F.col("_word_keys"), F.col("_labels")))
    kind = F.coalesce(F.col("_prior.domain_type"), F.when((F.col("_kind") == "unknown") & (F.col("host_match") >= 0.8), "official").otherwise(F.col("_kind")))
    j = j.withColumn("domain_type", kind).withColumns(
        {
            "semantic": S.overlap(F.col("tokens"), F.col("_tokens")),
            "entity": S.entity_overlap(F.col("entities"), F.concat_ws(" ", "title", "snippet")),
            "freshness": S.freshness(F.col("fresh"), F.col("published"), as_of),
            "time_match": S.time_alignment(F.col("scope"), F.col("title"), F.col("snippet"), F.col("url"), F.col("published")),
            "spam": S.spam_risk(F.col("host"), F.col("_kind"), F.col("title"), F.col("snippet"), F.col("_title_tokens"), F.col("_prior.spam_penalty")),
            "primary_score": S.primary_likelihood(F.col("domain_type"), F.col("title"), F.col("snippet"), F.col("url"), F.col("host_match"), F.col("_prior.primary_boost")),
        }
    )
    w = K.SERP_WEIGHTS
    score = (
        w["domain"] * S.by_kind(F.col("domain_type"), K.DOMAIN_PRIOR) + w["primary"] * F.col("primary_score") + w["freshness"] * F.col("freshness") + w["entity"] * F.col("entity")
        + w["semantic"] * F.col("semantic") + w["host_entity"] * F.col("host_match") + w["time"] * F.col("time_match") + F.col("_prior.source_prior") - w["spam"] * F.col("spam")
    )
    return j.withColumn("source_score", S.clamp(score)).drop("_title_tokens", "_tokens", "_labels", "_prior", "_kind", "_entity_keys", "_word_keys")


def gate(scored: DataFrame, limit: int = K.GATE_LIMIT) -> DataFrame:
    """The best results of each claim: one for each canonical address (first of equal ones), at most limit, with rank.

    Needs claim_id, canonical_url, seq (of any orderable type), source_score, primary_score and spam; the merge is a partial aggregate, the limit a
    window that keeps limit rows a task before it shuffles.
    """
    rest = [c for c in scored.columns if c not in ("claim_id", "canonical_url")]
    merged = scored.groupBy("claim_id", "canonical_url").agg(F.min_by(F.struct(*rest), F.struct(F.col("source_score").isNull(), -F.col("source_score"), "seq")).alias("_best"), F.min("seq").alias("_slot"))
    flat = merged.select("claim_id", "canonical_url", "_best.*", "_slot")
    order = Window.partitionBy("claim_id").orderBy(F.desc("source_score"), F.desc("primary_score"), "spam", "_slot")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_slot")


def fetch_order(candidates: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` candidates of each claim (claim_id, root): the best of each root in the order given, then all others; with pick."""
    of_root = F.row_number().over(Window.partitionBy("claim_id", "root").orderBy(*order))
    few = candidates.withColumn("_of_root", of_root).where(F.col("_of_root") <= limit)
    pick = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("_of_root") > 1, *order))
    return few.withColumn("pick", pick).where(F.col("pick") <= limit).drop("_of_root")


def passages(text: Column) -> Column:
    """A document's text as passages of whole sentences, up to 420 characters where sentences allow.

    White space is collapsed first, so a text is one block. Blocks under 60 characters and texts that begin with a heading
    mark give their first 420 characters as one passage; empty texts give none.
    """
    start = F.struct(F.lit("").alias("run"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, s: Column) -> Column:
        longer = F.concat(a["run"], F.lit(" "), s)
        return (
            F.when(a["run"] == "", F.struct(s.alias("run"), a["out"].alias("out")))
            .when(F.length(longer) <= K.PASSAGE_CHARS, F.struct(longer.alias("run"), a["out"].alias("out")))
            .otherwise(F.struct(s.alias("run"), F.concat(a["out"], F.array(a["run"])).alias("out")))
        )

    def split(content: Column) -> Column:
        packed = F.aggregate(T.sentences(content, collapsed=True), start, put, lambda a: F.when(a["run"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["run"]))))
        whole = F.array(F.substr(content, F.lit(1), F.lit(K.PASSAGE_CHARS)))
        return F.when(content == "", F.array().cast("array<string>")).when((F.length(content) < K.LEAST_BLOCK_CHARS) | F.startswith(content, F.lit("#")), whole).otherwise(packed)

    return T.let(T.normalized(text), split)


def with_words(passages: DataFrame) -> DataFrame:
    """Passages with p_tokens and p_numbers, both from one reading of their words."""
    w = passages.withColumn("_words", T.words(F.col("text")))
    return w.withColumns({"p_tokens": T.tokens_of(F.col("_words")), "p_numbers": T.numbers_of(F.col("_words"))}).drop("_words")


def cheap_scores(pairs: DataFrame) -> DataFrame:
    """Passages beside their claim (tokens, entities, scope, claim_numbers; p_tokens, p_numbers, text, source_score) with a score.

    A claim's columns asked (its different tokens) and entity_keys are used where they have been made before the join.
    """
    w = K.CHEAP_WEIGHTS
    keys = F.col("entity_keys") if "entity_keys" in pairs.columns else None
    if "asked" in pairs.columns:
        share = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "p_tokens")) / F.size("asked"))
    else:
        share = S.overlap(F.col("tokens"), F.col("p_tokens"))
    made = pairs.withColumns({"_low": T.fold(F.col("text")), "_tight": T.compact(F.col("text"))})
    dimension = F.when(F.col("scope").isNotNull() & F.contains(F.col("_low"), T.fold(F.col("scope"))), 0.15).otherwise(0.0)
    number = F.when(F.arrays_overlap("claim_numbers", "p_numbers"), 1.0).otherwise(0.0)
    score = w["overlap"] * share + w["entity"] * S.entity_overlap(F.col("entities"), F.col("text"), F.col("_low"), F.col("_tight"), keys) + w["dimension"] * dimension + w["number"] * number + w["source"] * F.col("source_score")
    return made.withColumn("cheap_score", S.clamp(score)).drop("_low", "_tight")


def cheap_filter(scored: DataFrame, limit: int = K.CHEAP_LIMIT, threshold: float = K.CHEAP_THRESHOLD) -> DataFrame:
    """The best passages of each claim at or over the threshold; where none is, the best of all."""
    passed = F.col("cheap_score") >= threshold
    order = Window.partitionBy("claim_id").orderBy(F.desc(passed), F.desc("cheap_score"), F.desc("source_score"), "seq")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    any_passed = F.max(passed).over(Window.partitionBy("claim_id"))
    return top.withColumn("_any", any_passed).where(passed | ~F.col("_any")).drop("_any")


def rank_for_prompt(p: DataFrame, top: int = K.TOP_PASSAGES) -> DataFrame:
    """Round-robin over addresses: first the best passage of every address, best address first, then the seconds; top rows.

    No window sees more than an address's passages of a claim until limits have cut them: at most top of an address
    can be among the first top, and the last window keeps top rows a task before it shuffles.
    """
    of_url = Window.partitionBy("claim_id", "url").orderBy(F.desc("source_score"), "seq")
    r = p.withColumn("_round", F.row_number().over(of_url)).withColumn("_lead", F.first(F.struct((-F.col("source_score")).alias("s"), F.col("seq"))).over(of_url)).where(F.col("_round") <= top)
    order = Window.partitionBy("claim_id").orderBy("_round", "_lead")
    return r.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("_round", "_lead")


def pack_for_prompt(ranked: DataFrame) -> DataFrame:
    """The slate: in order of place at most two of an address, four of a host, fourteen in all; numbered from 1.

    Caps are taken one behind the other, which is what taking passages one by one gives, as an address has one host.
    """
    out = ranked
    for keys, most in ((["url"], K.SLATE_PER_URL), (["host"], K.SLATE_PER_HOST), ([], K.SLATE_TOTAL)):
        n = F.row_number().over(Window.partitionBy("claim_id", *keys).orderBy("place"))
        free = F.lit(False) if keys != ["host"] else F.col("host") == ""
        out = out.withColumn("_n", n).where((F.col("_n") <= most) | free)
    return out.withColumnRenamed("_n", "citation")


def route(gated: DataFrame) -> DataFrame:
    """Certainty, consistency and sufficiency of each claim's gated results."""
    top = lambda n: F.col("rank") <= n
    out = gated.groupBy("claim_id").agg(
        F.avg(F.when(top(3), F.col("source_score"))).alias("certainty"),
        F.avg(F.when(top(5), F.col("semantic"))).alias("consistency"),
        (F.count_if(top(8) & (F.col("source_score") >= 0.6)) * 0.11 + F.when(F.bool_or(top(5) & (F.col("primary_score") >= 0.7)), 0.2).otherwise(0.0)).alias("sufficiency"),
    )
    return out.select("claim_id", F.lit("fast").alias("mode"), *[S.clamp(F.col(c)).alias(c) for c in ("certainty", "consistency", "sufficiency")])


def verdict(confidence: Column, contradicts: Column) -> Column:
    return F.when(contradicts, "contradicted").when(confidence >= K.STOP_CONFIDENCE, "supported").otherwise("insufficient_evidence")


def stop_check(assessments: DataFrame, key_claims: DataFrame, slate: DataFrame, iteration: int = 1) -> DataFrame:
    """Whether each run (run_id, confidence, contradicts) stops: key_claims (run_id, key, citation) join the slate (run_id, citation, host)."""
    domains = key_claims.join(slate, ["run_id", "citation"], "left").groupBy("run_id", "key").agg(F.count_distinct(F.nullif("host", F.lit(""))).alias("n"))
    backed = domains.groupBy("run_id").agg(F.bool_and(F.col("n") >= 2).alias("backed"))
    joined = assessments.join(backed, "run_id", "left")
    stop = F.when(F.lit(iteration >= K.MOST_ITERATIONS) | F.col("contradicts"), True).when(F.col("confidence") < K.STOP_CONFIDENCE, False).otherwise(F.coalesce("backed", F.lit(True)))
    return joined.select("run_id", verdict(F.col("confidence"), F.col("contradicts")).alias("verdict"), stop.alias("stop"))


def contract_gaps(requires_primary: Column, has_primary: Column, least_sources: Column, n_sources: Column, needs_fresh: Column, fresh: Column) -> Column:
    """Names of unmet requirements, in a fixed order."""
    named = F.array(
        F.when(requires_primary & ~has_primary, "primary_source"), F.when(n_sources < F.greatest(F.lit(1), least_sources), "independent_sources"), F.when(needs_fresh & ~fresh, "freshness")
    )
    return F.filter(named, lambda g: g.isNotNull())


#: Rows up to which a table of claims' words is sent to every task; beyond that the same rows come from shuffled joins.
FEW_ROWS = 200_000


def _small(rows: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def top_overlaps(documents: DataFrame, claims: DataFrame, most: int = 25) -> DataFrame:
    """The documents (doc_id, tokens) that share most of a claim's different tokens (claim_id, tokens): claim_id, doc_id, rank, overlap.

    A claim's words are numbered from the rarest on. Documents of its first words show how many words the last kept one shares
    at least; whoever shares so many of m words has one of the first m - bound + 1, so only these are probed and frequent
    words bring no pairs. Ties go by doc_id; documents without a shared word have no row.

    A document is one row with the numbers of its asked words, written once. Probes with their claim's words come to these rows,
    so only pairs are shuffled, no document's words.
    """
    asked = claims.select("claim_id", F.array_distinct("tokens").alias("asked"))
    wanted = checkpointed(asked.select("claim_id", F.size("asked").alias("n"), F.explode("asked").alias("token")))
    words = checkpointed(wanted.select("token").distinct().withColumn("word", F.monotonically_increasing_id()))
    found = documents.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token")).join(_small(words), "token")
    known = checkpointed(found.groupBy("doc_id").agg(F.collect_list("word").alias("known")))
    often = known.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    numbered = wanted.join(words, "token")
    from_rare = Window.partitionBy("claim_id").orderBy("often", "token")
    places = {"place": F.row_number().over(from_rare), "so_far": F.sum("often").over(from_rare), "m": F.count("*").over(Window.partitionBy("claim_id"))}
    placed = checkpointed(numbered.join(often, "word").withColumns(places))
    of_claim = numbered.groupBy("claim_id").agg(F.collect_list("word").alias("asked"), F.first("n").alias("n"))

    def best(probes: DataFrame) -> DataFrame:
        asking = checkpointed(probes.select("claim_id", "word").join(of_claim, "claim_id"))
        met = known.select("doc_id", "known", F.explode("known").alias("word")).join(_small(asking), "word")
        pairs = met.select("claim_id", "doc_id", F.size(F.array_intersect("known", "asked")).alias("shared"), "n")
        once = pairs.groupBy("claim_id", "doc_id").agg(F.max("shared").alias("shared"), F.max("n").alias("n"))
        order = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("shared"), "doc_id"))
        return once.withColumn("rank", order).where(F.col("rank") <= most)

    first = best(placed.where((F.col("place") == 1) | (F.col("so_far") <= 100 * most)))
    bound = first.groupBy("claim_id").agg(F.when(F.count("*") == most, F.min("shared")).otherwise(1).alias("bound"))
    probes = placed.join(bound, "claim_id").where(F.col("place") <= F.col("m") - F.col("bound") + 1)
    return best(probes).select("claim_id", "doc_id", "rank", (F.col("shared") / F.col("n")).alias("overlap"))
