"""Second-phase passage scores, greedy selections with host diversity, and evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators.evidence import contract_gaps
from tessera.session import checkpointed

#: Weights of the second phase and of support, and the boost of passages seen before.
UTILITY = {"cheap": 0.30, "dimension": 0.20, "bonus": 0.12, "source": 0.08, "contradiction": 0.05}
CONTRADICTION, SEEN_BEFORE, PRIMARY_FROM = 0.15, 0.12, 0.7


def utility_scores(scored: DataFrame) -> DataFrame:
    """Passages with cheap_score, p_tokens, text, title, url, host, scope and seen (in an earlier round), and a utility."""
    made = scored.withColumn("_prior", U.source_prior(F.col("host")))  # columns of their own: each is named often below
    made = made.withColumn("_kind", F.coalesce("_prior.domain_type", U.domain_type(F.col("host"))))
    bonus = F.greatest(S.verification_bonus(F.col("_kind"), F.col("title"), F.col("url"), F.col("_prior.verification_bonus")), F.lit(0.0))
    dimension = F.when(F.col("scope").isNotNull() & F.contains(T.fold(F.col("text")), T.fold(F.col("scope"))), 0.15).otherwise(0.0)
    against = F.when(T.has_negation(F.col("text"), F.col("p_tokens")), CONTRADICTION).otherwise(0.0)
    w = UTILITY
    score = S.clamp(w["cheap"] * F.col("cheap_score") + w["dimension"] * dimension + w["bonus"] * bonus + w["source"] * F.col("source_score") + w["contradiction"] * against)
    return made.withColumn("utility", S.clamp(score + F.when(F.col("seen"), SEEN_BEFORE).otherwise(0.0))).drop("_prior", "_kind")


def rerank(passages: DataFrame, limit: int = 8) -> DataFrame:
    """The passages of each claim by utility, hosts repeated only behind the first half: claim_id, seq, place.

    passages: claim_id, seq (orderable), host, utility, source_score. Taking one by one means: the first of each of the first
    limit / 2 hosts (two at least), and behind the last of these whatever comes next, up to the limit; with fewer hosts only
    the first of each. So hosts are summed up by a partial aggregate, and both windows keep a few rows a task. Keys are written
    once, without texts, as they are gone through twice.
    """
    half, own = max(2, limit // 2), Window.partitionBy("claim_id").orderBy("_order")
    order = F.struct((-F.col("utility")).alias("u"), (-F.col("source_score")).alias("s"), "seq")
    narrow = checkpointed(passages.select("claim_id", order.alias("_order"), U.registered_root(F.col("host")).alias("root")))
    firsts = narrow.groupBy("claim_id", "root").agg(F.min("_order").alias("_order"))
    leads = firsts.withColumn("place", F.row_number().over(own)).where(F.col("place") <= half).select("claim_id", "_order", "place")
    last = leads.where(F.col("place") == half).select("claim_id", F.col("_order").alias("_last"))
    rest = narrow.join(last, "claim_id").where(F.col("_order") > F.col("_last")).withColumn("place", F.row_number().over(own) + half).where(F.col("place") <= limit)
    return leads.union(rest.select("claim_id", "_order", "place")).select("claim_id", F.col("_order.seq").alias("seq"), "place")


def bundles(support: DataFrame, claims: DataFrame) -> DataFrame:
    """What the chosen support of each claim amounts to: distinct roots, a primary source, freshness, gaps, satisfaction.

    support: claim_id, host, primary_score, published. claims: claim_id, verdict, shape, requires_primary, least_sources, fresh_needed.
    """
    primary = (F.col("primary_score") >= PRIMARY_FROM) | U.domain_type(F.col("host")).isin("official", "academic")
    facts = support.groupBy("claim_id").agg(F.count("*").alias("n_support"), F.count_distinct(U.registered_root(F.col("host"))).alias("sources"), F.bool_or(primary).alias("has_primary"), F.bool_or(F.col("published").isNotNull()).alias("dated"))
    j = claims.join(facts, "claim_id", "left").na.fill({"n_support": 0, "sources": 0, "has_primary": False, "dated": False})
    gaps = contract_gaps(F.col("requires_primary"), F.col("has_primary"), F.col("least_sources"), F.col("sources"), F.col("fresh_needed"), F.col("dated"))
    drives = F.col("shape").isin("product_specs", "overview", "comparison", "news_digest") & (F.col("n_support") > 0)
    return j.select("claim_id", "n_support", "sources", "has_primary", (~F.col("fresh_needed") | F.col("dated")).alias("fresh"), F.array_join(gaps, ",").alias("gaps"), ((F.size(gaps) == 0) & ((F.col("verdict") == "supported") | drives)).alias("satisfied"))


def expectation_rates(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Component checks: shares of expected items that came out and of unwanted ones that did not, and cases that passed.

    cases: case_id, include and exclude (arrays), least; outputs: case_id, item. One row over all cases.
    """
    out = outputs.groupBy("case_id").agg(F.collect_set("item").alias("items"), F.count("*").alias("n"))
    j = cases.join(out, "case_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).na.fill({"n": 0})
    hit, kept = F.size(F.array_intersect("include", "items")), F.size(F.array_except("exclude", "items"))
    rows = j.select(F.size("include").alias("i"), hit.alias("h"), F.size("exclude").alias("e"), kept.alias("k"), (F.col("n") >= F.col("least")).alias("enough"))
    share = lambda a, b, other: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(other)
    return rows.agg(
        F.count("*").alias("n_cases"), share("h", "i", 0.0).alias("include_rate"), share("k", "e", 1.0).alias("exclude_rate"),
        F.avg(F.col("enough").cast("double")).alias("least_rate"), F.avg(((F.col("h") == F.col("i")) & (F.col("k") == F.col("e")) & F.col("enough")).cast("double")).alias("pass_rate"),
    )


def plain_payload(text: Column, title_hint: Column, most: int) -> Column:
    """A plain text as a page's payload: a title from its first lines' heading, three long blocks, the text cut; a struct."""
    body = F.trim(text)
    heads = F.filter(F.transform(F.slice(F.split(body, "\n"), 1, 8), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("#")))
    title = F.substr(F.trim(F.regexp_replace(F.get(heads, F.lit(0)), "^#+", "")), F.lit(1), F.lit(400))
    blocks = F.slice(F.filter(F.transform(F.split(body, "\n\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 40), 1, 3)
    return F.struct(F.coalesce(title, title_hint).alias("title"), blocks.alias("blocks"), F.substr(body, F.lit(1), F.lit(most)).alias("content"))
