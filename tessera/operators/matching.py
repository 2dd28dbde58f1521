"""Matching expected claims with the claims of runs by indices, so that only texts with a rare thing in common meet.

One text can hold another only if it has each of the other's q-gram minimizers, so a text is looked up by its rarest one. A text
can share a given part of another's words only if it has one of the first of them, from the rarest on; positions and sizes
rule out more before any texts are compared. Candidates are a few for each claim, whatever the number of claims, and
are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Characters of a gram, and grams of which the least hash is kept, for texts of at least so many characters.
GRAMS = ((15, 8, 8), (3, 3, 1), (1, 1, 1))
#: The part of an expected claim's words that a run's claim has to share.
LEAST_SHARE = 0.6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _minimizers(text: Column, q: int, w: int) -> Column:
    """The least hashes of w neighbouring q-grams, each once; none for texts with fewer. Linear in the text: its characters
    and the grams' hashes are arrays that are made once."""

    def grams(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - q + 1), lambda i: F.xxhash64(F.array_join(F.slice(chars, i, F.lit(q)), "")))

    def least(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - w + 1), lambda i: F.array_min(F.slice(hashes, i, F.lit(w))))

    found = _let(F.split(text, ""), lambda chars: _let(grams(chars), least) if w > 1 else grams(chars))
    return F.when(F.length(text) >= q + w - 1, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def held_in(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (case_id, part, whole) of one case where the part's text stands in the whole's; both have case_id, an id and text.

    Columns are case_id, part, text and case_id, whole, text. Empty parts have no pairs: they stand in every text, and the caller
    knows which one is wanted. Null texts have none.
    """
    size = F.length("text")
    kind = F.when(size >= GRAMS[0][0], 0).when(size >= GRAMS[1][0], 1).otherwise(2)
    named = [F.when(kind == k, _minimizers(F.col("text"), q, w)) for k, (_, q, w) in enumerate(GRAMS)]
    asked = parts.where(size >= 1).select("case_id", "part", kind.alias("kind"), F.explode(F.coalesce(*named)).alias("key"))
    there = {r["kind"] for r in parts.where(size >= 1).select(kind.alias("kind")).distinct().collect()}  # three at most
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _minimizers(F.col("text"), q, w).alias("keys")) for k, (_, q, w) in enumerate(GRAMS) if k in there or not there])
    index = wholes.select("case_id", "whole", F.explode(kinds).alias("g")).select("case_id", "whole", "g.kind", F.explode("g.keys").alias("key"))
    known = index.join(asked.select("case_id", "kind", "key").distinct(), ["case_id", "kind", "key"], "left_semi")
    often = known.groupBy("case_id", "kind", "key").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["case_id", "kind", "key"], "left").groupBy("case_id", "part", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r"))
    probes = rarest.where("r.n > 0").select("case_id", "part", "kind", F.col("r.key").alias("key"))
    pairs = known.join(probes, ["case_id", "kind", "key"]).select("case_id", "part", "whole")
    met = pairs.join(parts.withColumnRenamed("text", "_part"), ["case_id", "part"]).join(wholes.withColumnRenamed("text", "_whole"), ["case_id", "whole"])
    return met.where(F.contains("_whole", F.col("_part"))).select("case_id", "part", "whole")


def sharing(asked: DataFrame, found: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Pairs (case_id, expected_id, seq, share): the part of the distinct words asked for that is found, if it is the least or more.

    asked: case_id, expected_id, words; found: case_id, seq, words (arrays without repeats).
    """
    own = found.select("case_id", "seq", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = own.groupBy("case_id", "word").agg(F.count("*").alias("often"))
    wanted = asked.select("case_id", "expected_id", F.size("words").alias("m"), F.explode("words").alias("word")).join(often, ["case_id", "word"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    need = F.ceil(F.col("m") * least - 1e-9)

    def placed(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id", name).orderBy("often", "word")))

    probes = placed(wanted, "expected_id").where(F.col("place") <= F.col("m") - need + 1).select("case_id", "word", "expected_id", "m", F.col("place").alias("i"))
    index = placed(own.join(often, ["case_id", "word"]), "seq").select("case_id", "word", "seq", "n", F.col("place").alias("j"))
    rest = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    pairs = probes.join(index, ["case_id", "word"]).where(rest + 1 >= need - F.least(F.col("i"), F.col("j")) + 1).select("case_id", "expected_id", "seq").distinct()
    met = pairs.join(asked.withColumnRenamed("words", "_asked"), ["case_id", "expected_id"]).join(found.withColumnRenamed("words", "_found"), ["case_id", "seq"])
    share = F.size(F.array_intersect("_asked", "_found")) / F.size("_asked")
    return met.select("case_id", "expected_id", "seq", share.alias("share")).where(F.col("share") >= least)


def match_claims(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """For each expected claim (case_id, expected_id, needle) the run (case_id, seq, claim_text) of its case that matches.

    The first run whose text holds the needle or stands in it; else the run that shares most of the needle's distinct
    words, the first of equals, if that share is 0.6 or more. Claims without such a run have no row. Ids have any orderable type.
    """
    e = expected.select("case_id", "expected_id", T.fold(F.col("needle")).alias("text"), F.array_distinct(T.match_tokens(F.col("needle"))).alias("words"))
    r = runs.select("case_id", "seq", T.fold(F.col("claim_text")).alias("text"), F.array_distinct(T.match_tokens(F.col("claim_text"))).alias("words"))
    needles, hays = e.select("case_id", F.col("expected_id").alias("part"), "text"), r.select("case_id", F.col("seq").alias("part"), "text")
    inside = held_in(needles, hays.withColumnRenamed("part", "whole")).select("case_id", F.col("part").alias("expected_id"), F.col("whole").alias("seq"))
    around = held_in(hays, needles.withColumnRenamed("part", "whole")).select("case_id", F.col("whole").alias("expected_id"), F.col("part").alias("seq"))
    blank = F.col("text") == ""
    anything = r.where("text is not null").groupBy("case_id").agg(F.min("seq").alias("seq"))
    nothing = r.where(blank).groupBy("case_id").agg(F.min("seq").alias("seq"))
    by_blank = e.where(blank).select("case_id", "expected_id").join(anything, "case_id").unionByName(e.where("text is not null").select("case_id", "expected_id").join(nothing, "case_id"))
    holds = inside.union(around).union(by_blank.select("case_id", "expected_id", "seq")).withColumn("share", F.lit(1.0)).withColumn("holds", F.lit(True))
    shares = sharing(e.where(F.size("words") > 0).select("case_id", "expected_id", "words"), r.where(F.size("words") > 0).select("case_id", "seq", "words")).withColumn("holds", F.lit(False))
    best = F.min(F.struct((~F.col("holds")).alias("a"), (-F.col("share")).alias("b"), "seq")).alias("m")
    return holds.unionByName(shares).groupBy("case_id", "expected_id").agg(best).select("case_id", "expected_id", F.col("m.seq").alias("seq"), F.round(-F.col("m.b"), 6).alias("share"))
