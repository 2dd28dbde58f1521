"""Recorded evaluation data in JSON lines: cases, examples, results, passages, snapshots and runs, with the lines that are skipped.

A line is read as a VARIANT, so a field may be a value or a list, absent or null, without a schema that fits only one of them.
What a record lacks gets the default that its kind has. Lines that are no records are kept apart with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each kind of record its fields with their types and defaults (None: null); `=x` is the value of another field.
FIELDS: dict[str, dict[str, tuple[str, object]]] = {
    "claim": {"claim_id": ("string", None), "claim_text": ("string", None), "priority": ("int", 1), "needs_freshness": ("boolean", False), "entity_set": ("array<string>", ()), "time_scope": ("string", None)},
    "passage": {
        "passage_id": ("string", None), "url": ("string", None), "canonical_url": ("string", "=url"), "host": ("string", ""), "title": ("string", ""), "section": ("string", None), "published_at": ("string", None),
        "author": ("string", None), "extracted_at": ("string", ""), "chunk_id": ("string", ""), "text": ("string", None), "source_score": ("double", 0.5), "utility_score": ("double", 0.0),
    },
    "result": {
        "result_id": ("string", None), "query_variant_id": ("string", ""), "title": ("string", ""), "url": ("string", None), "snippet": ("string", ""), "canonical_url": ("string", "=url"), "host": ("string", ""),
        "position": ("int", 0), "score": ("double", None), "engine": ("string", None), "published_at": ("string", None), "raw": ("map<string, string>", ()),
    },
    "assessment": {
        **{name: ("double", None) for name in ("source_prior", "primary_source_likelihood", "freshness_score", "seo_spam_risk", "entity_match_score", "semantic_match_score", "source_score")},
        "domain_type": ("string", None), "duplicate_of": ("string", None), "reasons": ("array<string>", ()),
    },
    "snapshot": {"query": ("string", None), "suggestions": ("array<string>", ()), "retrieved_at": ("string", ""), "profile_name": ("string", None), "unresponsive_engines": ("array<string>", ())},
    "example": {"query": ("string", None), "expected_intent": ("string", None)},
}
#: What has to be there, at least as a null.
REQUIRED = {
    "claim": ("claim_id", "claim_text"), "passage": ("passage_id", "url", "text"), "result": ("result_id", "url"), "snapshot": ("query",), "example": ("query", "expected_intent"),
    "assessment": ("domain_type", "source_prior", "primary_source_likelihood", "freshness_score", "seo_spam_risk", "entity_match_score", "semantic_match_score", "source_score"),
}


def lines(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Each line of text files as line, v (its VARIANT) and skipped: null, or blank, corrupt, no_object or incomplete.

    Parsing ends with the first value of a line; an object with more behind it is corrupt unless that, too, ends with a brace.
    """
    raw = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).withColumn("v", F.try_parse_json("line"))
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | F.try_variant_get("v", f"$.{name}", "variant").isNull()
    why = (
        F.when(F.col("line") == "", "blank").when(F.col("v").isNull(), "corrupt").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "no_object")
        .when(~F.endswith("line", F.lit("}")), "corrupt").when(lacks, "incomplete")
    )
    return raw.withColumn("skipped", why)


def skipped(read: DataFrame) -> DataFrame:
    """How many lines were skipped, by reason: skipped, n."""
    return read.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


def record(v: Column, kind: str) -> Column:
    """A VARIANT object as a struct of its kind's fields. A field of another type than its own counts as absent."""
    fields = FIELDS[kind]

    def value(name: str) -> Column:
        type_, default = fields[name]
        got = F.try_variant_get(v, f"$.{name}", type_)
        if isinstance(default, str) and default.startswith("="):
            return F.coalesce(got, value(default[1:]))
        if default == ():
            return F.coalesce(got, F.array().cast(type_) if type_.startswith("array") else F.create_map().cast(type_))
        return got if default is None else F.coalesce(got, F.lit(default).cast(type_))

    return F.struct(*[value(name).alias(name) for name in fields])


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of a kind in JSON lines; lines that are none are left out (see `lines` and `skipped`)."""
    return lines(spark, path, REQUIRED[kind]).where("skipped is null").select(record(F.col("v"), kind).alias("r")).select("r.*")


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _has(v: Column, kind: str) -> Column:
    out = F.lit(True)
    for name in REQUIRED[kind]:
        out = out & F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    return out


def gated_results(spark: SparkSession, path: str) -> DataFrame:
    """Gated results: serp and assessment as structs, and matched_variant_ids. Lines without either, or with incomplete ones, are left out."""
    read = lines(spark, path, ("serp", "assessment")).where("skipped is null").select(*[F.try_variant_get("v", f"$.{c}", "variant").alias(c) for c in ("serp", "assessment")], F.coalesce(F.try_variant_get("v", "$.matched_variant_ids", "array<string>"), F.array().cast("array<string>")).alias("matched_variant_ids"))
    whole = read.where(_has(F.col("serp"), "result") & _has(F.col("assessment"), "assessment"))
    return whole.select(record(F.col("serp"), "result").alias("serp"), record(F.col("assessment"), "assessment").alias("assessment"), "matched_variant_ids")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Search snapshots with their results as structs; results that lack an id or an address are left out."""
    read = lines(spark, path, REQUIRED["snapshot"]).where("skipped is null")
    found = F.transform(F.filter(_list(F.col("v"), "results"), lambda r: _has(r, "result")), lambda r: record(r, "result"))
    return read.select(record(F.col("v"), "snapshot").alias("s"), found.alias("results")).select("s.*", "results")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: the profile is web where none is named, and an expected route may be one or a list of them."""

    def text(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    def routes(c: Column) -> Column:
        one = F.try_variant_get(c, "$.expected_route", "variant")
        return F.when(F.schema_of_variant(one) == "STRING", F.array(F.try_variant_get(one, "$", "string"))).otherwise(F.coalesce(F.try_variant_get(one, "$", "array<string>"), F.array().cast("array<string>")))

    claim = F.transform(
        _list(F.col("v"), "expected_claims"),
        lambda c: F.struct(
            text(c, "match").alias("match"), text(c, "expected_verdict").alias("expected_verdict"), F.coalesce(F.try_variant_get(c, "$.requires_primary_source", "boolean"), F.lit(False)).alias("requires_primary_source"),
            routes(c).alias("expected_routes"), F.try_variant_get(c, "$.min_independent_sources", "int").alias("min_independent_sources"),
        ),
    )
    v = F.col("v")
    whole = [F.try_variant_get(v, f"$.{c}", "int").alias(c) for c in ("min_answer_chars", "min_unique_sources")]
    read = lines(spark, path, ("case_id",)).where("skipped is null")
    return read.select(*[text(v, c).alias(c) for c in ("case_id", "split", "query")], F.coalesce(text(v, "profile"), F.lit("web")).alias("profile"), *whole, claim.alias("expected_claims")).where("case_id is not null")


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Top-level metrics of run files, a JSON document a file: file, name, value; values that are no numbers are null."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    metrics = spark.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.metrics", "variant"))
    return read.lateralJoin(metrics).where("key is not null").select("file", F.col("key").alias("name"), F.try_variant_get("value", "$", "double").alias("value"))
