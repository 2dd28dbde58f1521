"""The retrieval loop: search, gate, fetch, split, rank, assess, stop; for all runs at once, round by round.

Searches, pages and assessments are tables (what a provider or a model has given), so a loop can be run again and checked.
A round joins only what is new: queries that the claim has not used, results of these, addresses it has not seen, documents
that were not split yet. All that earlier rounds found stays in append-only tables, a checkpoint a round, so neither a
round's plan nor its work grows with the rounds before; only limits by claim (gate, choice, slate) look at all of it, without texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import evidence as E
from tessera.operators.policy import choose_documents
from tessera.session import checkpointed

#: How many results are fetched shallowly and deeply in the first and later rounds, how many shallow documents stand in
#: as snippets, the weights of a shallow document's score, and the bonus over which a preferred source takes a deep place.
SHALLOW_LIMITS, DEEP_LIMITS, SNIPPET_DOCUMENTS = (5, 10), (2, 2), 2
SHALLOW_WEIGHTS = {"semantic": 0.30, "entity": 0.22, "dimension": 0.18, "source": 0.18, "bonus": 0.12}
PREFERRED_OVER = 0.18


@dataclass
class Tables:
    """claims: claim_id, tokens, entities, scope, fresh. queries: claim_id, round, query. searches: query, seq, url, title,
    snippet, published. pages, a row an address: url, overview, summary, content (null where it cannot be read whole).
    assessments: claim_id, round, confidence, contradicts. key_claims: claim_id, round, key, citation."""

    claims: DataFrame
    queries: DataFrame
    searches: DataFrame
    pages: DataFrame
    assessments: DataFrame
    key_claims: DataFrame


@dataclass
class Found:
    """slates: claim_id, round, citation, url, host, text. plans: claim_id, round, url, depth. outcome: claim_id, verdict, rounds."""

    slates: DataFrame
    plans: DataFrame
    outcome: DataFrame


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shallow_scores(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Documents (claim_id, overview, title, url, host, domain_type, source_score) with the bonus of their source and a shallow score."""
    d = documents.join(claims.select("claim_id", "tokens", "entities", "scope"), "claim_id")
    bonus = S.verification_bonus(F.col("domain_type"), F.col("title"), F.col("url"), U.source_prior(F.col("host"))["verification_bonus"])
    dimension = F.when(F.col("scope").isNotNull() & F.contains(T.fold(F.col("overview")), T.fold(F.col("scope"))), 0.15).otherwise(0.0)
    w = SHALLOW_WEIGHTS
    score = (
        w["semantic"] * S.overlap(F.col("tokens"), T.tokens(F.col("overview"))) + w["entity"] * S.entity_overlap(F.col("entities"), F.col("overview"))
        + w["dimension"] * dimension + w["source"] * F.col("source_score") + w["bonus"] * F.greatest(F.col("bonus"), F.lit(0.0))
    )
    return d.withColumn("bonus", bonus).withColumn("shallow_score", S.clamp(score)).drop("tokens", "entities", "scope")


def deep_places(ranked: DataFrame, limit: int) -> DataFrame:
    """Shallow documents (claim_id, pick, shallow_score, source_score, bonus) with their place and whether they are fetched deeply.

    The best `limit` by shallow score are. The best source by bonus, source and shallow score takes the last place of these
    where it has none and its bonus is over `PREFERRED_OVER`. Ties go by pick.
    """
    own = Window.partitionBy("claim_id")
    score = F.desc("shallow_score")
    r = ranked.withColumn("place", F.row_number().over(own.orderBy(score, "pick"))).withColumn("_best", F.row_number().over(own.orderBy(F.desc("bonus"), F.desc("source_score"), score, "pick")) == 1)
    taker = F.col("_best") & (F.col("place") > limit) & (F.col("bonus") > PREFERRED_OVER) & F.lit(limit > 0)
    r = r.withColumn("_swap", F.max(taker).over(own))
    deep = ((F.col("place") <= limit) & ~(F.col("_swap") & (F.col("place") == limit))) | (F.col("_swap") & F.col("_best"))
    return r.withColumn("deep", deep).drop("_best", "_swap")


def _fetched(gated: DataFrame, seen: DataFrame | None, t: Tables, turn: int) -> DataFrame:
    """The round's shallow documents with the place that each has and whether it is fetched deeply, from the best unseen results."""
    limit, at = min(turn, len(SHALLOW_LIMITS)) - 1, min(turn, len(DEEP_LIMITS)) - 1
    fresh = gated if seen is None else gated.join(seen, ["claim_id", "url"], "left_anti")
    chosen = E.fetch_order(fresh.withColumn("root", U.registered_root(F.col("host"))), [F.col("rank")], SHALLOW_LIMITS[limit])
    met = chosen.join(t.pages, "url", "left").withColumn("depth", F.when(F.col("overview").isNotNull(), "shallow").when(F.trim("snippet") != "", "snippet_only"))
    told = met.withColumn("text", F.when(F.col("depth") == "shallow", F.col("summary")).otherwise(F.col("snippet"))).withColumn("overview", F.coalesce("overview", "title", F.lit("")))
    return deep_places(shallow_scores(told.where("depth is not null"), t.claims), DEEP_LIMITS[at])


def _documents(fetched: DataFrame) -> DataFrame:
    """A round's documents by depth: shallow ones, deep ones that could be read, and snippets where a claim has none of these."""

    def rows(df: DataFrame, depth: Column, text: str) -> DataFrame:
        return df.select("claim_id", F.struct(F.col("seq.round").alias("round"), F.col("seq.seq").alias("seq"), depth.alias("depth")).alias("seq"), "url", "host", "source_score", depth.alias("depth"), F.col(text).alias("text"))

    deep = F.col("deep") & F.col("content").isNotNull()
    none = ~F.max(deep).over(Window.partitionBy("claim_id"))
    stand_in = fetched.withColumn("_none", none).where(F.col("_none") & (F.col("place") <= SNIPPET_DOCUMENTS) & (F.col("depth") == "shallow"))
    return _all([rows(fetched, F.col("depth"), "text"), rows(fetched.where(deep), F.lit("deep"), "content"), rows(stand_in, F.lit("snippet_only"), "text")])


def run(t: Tables, as_of: str, rounds: int = K.MOST_ITERATIONS) -> Found:
    """All rounds of all claims: each round's slate, the fetch plans, and the verdict with the number of rounds.

    Queries meet searches, and those that a claim has used, by their normalised and folded text; a claim without a new query ends with its last verdict. A
    claim that was never assessed has too little evidence. An address is fetched once a claim.
    """
    spark = t.claims.sparkSession
    active = t.claims.select("claim_id")
    used = spark.createDataFrame([], "claim_id long, _key string")
    verdicts = spark.createDataFrame([], "claim_id long, verdict string")
    scored, documents, split, passages, slates, plans, outcomes = [], [], [], [], [], [], []
    for turn in range(1, rounds + 1):
        asked = t.queries.where(F.col("round") == turn).join(active, "claim_id", "left_semi").withColumn("_key", T.fold(T.normalized(F.col("query"))))
        new = checkpointed(asked.where("_key <> ''").join(used, ["claim_id", "_key"], "left_anti").select("claim_id", "_key").distinct())
        used = used.union(new.select("claim_id", "_key"))
        live = checkpointed(new.select("claim_id").distinct())
        found = new.join(t.searches.withColumn("_key", T.fold(T.normalized(F.col("query")))), "_key").withColumn("seq", F.struct(F.lit(turn).alias("round"), F.col("seq").alias("seq")))
        found = found.select("claim_id", "seq", "url", U.canonical(F.col("url")).alias("canonical_url"), U.host(F.col("url")).alias("host"), "title", "snippet", "published")
        scored.append(checkpointed(E.score_results(found, t.claims, as_of).select("claim_id", "seq", "url", "canonical_url", "host", "title", "snippet", "domain_type", "source_score", "primary_score", "spam")))
        gated = E.gate(_all(scored).join(live, "claim_id", "left_semi"))
        seen = _all([d.select("claim_id", "url") for d in documents]).distinct() if documents else None
        fetched = checkpointed(_fetched(gated, seen, t, turn))
        plans.append(fetched.select("claim_id", F.lit(turn).alias("round"), "url", F.explode(F.when(F.col("deep"), F.array(F.lit("shallow"), F.lit("deep"))).otherwise(F.array(F.lit("shallow")))).alias("depth")))
        documents.append(checkpointed(_documents(fetched)))
        narrow = _all([d.drop("text") for d in documents]).join(live, "claim_id", "left_semi")
        chosen = choose_documents(narrow).select("claim_id", "seq")
        fresh = chosen if not split else chosen.join(_all(split), ["claim_id", "seq"], "left_anti")
        split.append(checkpointed(fresh))
        cut = split[-1].join(_all(documents), ["claim_id", "seq"]).select("claim_id", "seq", "url", "host", "source_score", F.posexplode(E.passages(F.col("text"))).alias("k", "text"))
        passages.append(checkpointed(cut.withColumn("seq", F.struct(F.col("seq.round"), F.col("seq.seq"), F.col("seq.depth"), "k")).drop("k")))
        known = _all(passages).join(live, "claim_id", "left_semi")
        places = E.pack_for_prompt(E.rank_for_prompt(known.drop("text"))).select("claim_id", "seq", "citation")
        slate = checkpointed(places.join(known, ["claim_id", "seq"]).select("claim_id", F.lit(turn).alias("round"), "citation", "url", "host", "text"))
        slates.append(slate)
        said = t.assessments.where(F.col("round") == turn).join(live, "claim_id", "left_semi").withColumnRenamed("claim_id", "run_id")
        keys = t.key_claims.where(F.col("round") == turn).select(F.col("claim_id").alias("run_id"), "key", "citation")
        judged = E.stop_check(said, keys, slate.select(F.col("claim_id").alias("run_id"), "citation", "host"), turn).withColumnRenamed("run_id", "claim_id")
        state = active.join(judged, "claim_id", "left").join(live.withColumn("live", F.lit(True)), "claim_id", "left").join(verdicts.withColumnRenamed("verdict", "before"), "claim_id", "left")
        done = F.col("live").isNull() | F.coalesce("stop", F.lit(False)) | F.lit(turn == rounds)
        state = checkpointed(state.select("claim_id", F.coalesce("verdict", "before", F.lit("insufficient_evidence")).alias("verdict"), F.lit(turn).alias("rounds"), done.alias("done")))
        outcomes.append(state.where("done").drop("done"))
        verdicts, active = state.select("claim_id", "verdict"), state.where("not done").select("claim_id")
        if active.isEmpty():
            break
    return Found(_all(slates), _all(plans), _all(outcomes))
