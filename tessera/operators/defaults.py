"""What stands in where a model is not asked or has failed: shells of runs, verdicts, intents; and results shared by query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.entities import entities

#: The claim that stands for a whole question, and what a failed model call gives.
SHELL = {"claim_id": "unified-1", "shape": "overview", "least_sources": 2}
PREFERRED = ("official", "academic", "vendor", "major_media")
NO_VERDICT = {"verdict": "insufficient_evidence", "confidence": 0.0, "missing": "coverage"}
NO_INTENT = {"intent": "factual", "complexity": "single_hop"}
VERDICTS, FLOOR_UNDER, FLOOR = ("supported", "contradicted", "insufficient_evidence"), 0.05, 0.38


def shell(question: Column) -> Column:
    """The claim and classification of a question that is handled as one claim; a struct."""
    return F.struct(
        F.lit(SHELL["claim_id"]).alias("claim_id"), question.alias("claim_text"), F.lit(1).alias("priority"), F.lit(False).alias("needs_freshness"), entities(question).alias("entities"), T.time_scope(T.words(question)).alias("scope"),
        F.lit(SHELL["shape"]).alias("shape"), F.lit(SHELL["least_sources"]).alias("least_sources"), T.strings(PREFERRED).alias("preferred"), F.lit("synthesis").alias("intent"), F.lit("single_hop").alias("complexity"),
    )


def verification(verdict: Column, confidence: Column, missing: Column, why_failed: Column) -> Column:
    """A verifier's output as a struct: confidence between 0 and 1, a supported one's not near 0, blank dimensions left out. Where the call
    failed, or gave a verdict that is none, the default with the reason."""
    own = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    floored = F.when((verdict == "supported") & (own < FLOOR_UNDER), F.greatest(own, F.lit(FLOOR))).otherwise(own)
    named = F.filter(F.transform(F.coalesce(missing, F.array().cast("array<string>")), T.normalized), lambda x: x != "")
    failed = why_failed.isNotNull() | ~F.coalesce(verdict.isin(*VERDICTS), F.lit(False))
    none = F.struct(F.lit(NO_VERDICT["verdict"]).alias("verdict"), F.lit(NO_VERDICT["confidence"]).alias("confidence"), T.strings([NO_VERDICT["missing"]]).alias("missing"), F.coalesce(why_failed, F.lit("no verdict")).alias("reason"))
    return F.when(failed, none).otherwise(F.struct(verdict.alias("verdict"), floored.alias("confidence"), named.alias("missing"), F.lit(None).cast("string").alias("reason")))


def intent(given: Column, complexity: Column, failed: Column) -> Column:
    """A classifier's output as a struct, or the default where the call failed or gave nothing."""
    out = lambda x, name: F.when(failed, F.lit(NO_INTENT[name])).otherwise(F.coalesce(F.nullif(T.normalized(x), F.lit("")), F.lit(NO_INTENT[name])))
    return F.struct(out(given, "intent").alias("intent"), out(complexity, "complexity").alias("complexity"))


def retagged(variants: DataFrame, results: DataFrame) -> DataFrame:
    """The results of one search for each variant that asked it: variants (run_id, variant_id, query) meet results (query, position, url) by
    folded query, and each result is named by its variant and position. A search is kept once, however many variants share it."""
    key = lambda q: T.fold(T.normalized(F.col(q)))
    asked = variants.select("run_id", "variant_id", key("query").alias("key"))
    found = results.withColumn("key", key("query")).drop("query")
    return asked.join(found, "key").select("run_id", "variant_id", F.concat_ws(":", "variant_id", F.col("position").cast("string")).alias("result_id"), "position", "url")
