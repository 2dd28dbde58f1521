"""Which passages support a claim: the best by score first, then a primary source if one is asked for, then another host.

The choice is made one passage after the other, so it is a table function: Spark deals the candidates out by claim, sorts
them by phase and score, and the function reads a claim's rows once, holding no more than what it has taken. What can never be
taken (a second row of an address, rows past a host's first few) is left out by windows before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import urls as U

#: Weights for bundles and for answers, what a preferred kind of source adds, also for product claims, and how much of
#: a passage is looked at.
SELECTION = {"semantic": 0.36, "entity": 0.16, "dimension": 0.16, "own": 0.16, "bonus": 0.10, "preferred": 0.06, "product": 0.14}
ANSWER = {"semantic": 0.45, "entity": 0.20, "dimension": 0.20, "own": 0.07, "bonus": 0.08, "preferred": 0.0, "product": 0.18}
PREFERRED, PRIMARY_FROM, LEAD_CHARS, HOSTS = 0.08, 0.7, 320, 2
#: Phases: supporting passages, the best primary one, all passages.
SUPPORT, PRIMARY, ANY = 1, 2, 3


def primary_types(shape: Column) -> Column:
    """The kinds of host that count as primary for a claim of this shape."""
    return F.when(shape == "product_specs", T.strings(["official", "academic", "vendor"])).otherwise(T.strings(["official", "academic"]))


def is_primary(primary_score: Column, kind: Column, shape: Column) -> Column:
    return (F.coalesce(primary_score, F.lit(0.0)) >= PRIMARY_FROM) | F.coalesce(F.array_contains(primary_types(shape), kind), F.lit(False))


def support_score(weights: dict[str, float]) -> Column:
    """The score of a passage (title, text, url, host, kind, utility, source_score) for its claim (tokens, entities, scope, shape, preferred)."""
    lead = F.concat_ws(" ", "title", F.substr("text", F.lit(1), F.lit(LEAD_CHARS)), "url")
    dimension = F.when(F.col("scope").isNotNull() & F.contains(T.fold(lead), T.fold(F.col("scope"))), 0.15).otherwise(0.0)
    bonus = F.greatest(S.verification_bonus(F.col("kind"), F.col("title"), F.col("url"), U.source_prior(F.col("host"))["verification_bonus"]), F.lit(0.0))
    preferred = F.when(F.coalesce(F.array_contains("preferred", F.col("kind")), F.lit(False)), PREFERRED).otherwise(0.0)
    w = weights
    return (
        w["semantic"] * S.overlap(F.col("tokens"), T.tokens(lead)) + w["entity"] * S.entity_overlap(F.col("entities"), lead) + w["dimension"] * dimension
        + w["own"] * F.greatest("utility", "source_score") + w["bonus"] * bonus + w["preferred"] * preferred + F.when(F.col("shape") == "product_specs", w["product"] * preferred).otherwise(0.0)
    )


@F.udtf(returnType="claim_id bigint, place int, item string")
class Cover:
    """Reads a claim's candidates by phase and score (claim_id, phase, url, root, primary, needs_primary, most, item) and takes what covers it."""

    def __init__(self) -> None:
        self.urls: set[str] = set()
        self.roots: set[str] = set()
        self.taken = 0
        self.primary = False

    def eval(self, row: Any) -> Iterator[tuple]:
        phase = row["phase"]
        if (phase == PRIMARY and (self.primary or not row["needs_primary"])) or (phase == ANY and row["root"] in self.roots):
            return
        new = row["url"] not in self.urls
        if new:
            self.urls.add(row["url"])
            self.roots.update([row["root"]] if row["root"] else [])
            self.taken += 1
            self.primary = self.primary or row["primary"]
            yield row["claim_id"], self.taken, row["item"]
        if self.taken >= row["most"] or (phase == ANY and len(self.roots) >= HOSTS):
            raise SkipRestOfInputTableException

    def terminate(self) -> Iterator[tuple]:
        yield from ()


def select(passages: DataFrame, claims: DataFrame, most: int, weights: dict[str, float], primary_phase: bool = True) -> DataFrame:
    """The passages that support each claim: claim_id, place, item.

    passages: claim_id, item (its name, unique in the claim), supports, title, text, url, host, kind, primary_score, utility,
    source_score, seq. claims: claim_id, tokens, entities, scope, shape, preferred (kinds), needs_primary. Supporting passages
    come first, an address once; then, if the claim needs a primary source and has none, the best primary passage; then the best of
    hosts that are not there yet until two are. At most `most`. Claims without passages have no row.
    """
    score = F.struct((-support_score(weights)).alias("s"), (-F.col("source_score")).alias("o"), "seq")
    p = passages.join(claims, "claim_id").select("claim_id", "item", "supports", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(U.registered_root(F.col("host")), F.lit("")).alias("root"), is_primary(F.col("primary_score"), F.col("kind"), F.col("shape")).alias("primary"), F.coalesce("needs_primary", F.lit(False)).alias("needs_primary"), score.alias("order"))
    phases = [F.when(F.col("supports"), SUPPORT), *([F.when(F.col("primary") & F.col("needs_primary"), PRIMARY)] if primary_phase else []), F.lit(ANY)]
    rows = p.withColumn("phase", F.explode(F.array(*phases))).where("phase is not null")
    first = lambda *keys: F.row_number().over(Window.partitionBy("claim_id", "phase", *keys).orderBy("order"))
    rows = rows.withColumn("n", first()).where((F.col("phase") != PRIMARY) | (F.col("n") == 1)) if primary_phase else rows
    few = rows.withColumn("n", first("url")).where("n = 1").withColumn("n", first("root")).where(F.col("n") <= most + 1)
    asked = few.select("claim_id", "phase", "url", "root", "primary", "needs_primary", F.lit(most).alias("most"), "item", "order")
    return Cover(asked.asTable().partitionBy("claim_id").orderBy("phase", "order"))
