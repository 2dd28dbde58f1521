"""The corpus operators as queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontam, divergence, licenses, lm, ogg, packing, quality, repair, simhash, suffixes, toxicity, wavelet
from tessera.llm.common import documents, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.license_scan(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score and decision for every document, learnt from heuristic votes."""
    return quality.scored(documents(spark, sf_dir))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet matrices and read back from the files."""
    return wavelet.token_digests(documents(spark, sf_dir))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items, scores and places."""
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learnt from those outside the held-out fold."""
    return lm.scored(documents(spark, sf_dir))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored in Ogg containers, read back and described."""
    return ogg.media_features(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed_documents(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels outside the held-out fold."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with one that holds control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return chat.formatted_conversations(turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's distance to the other sources of its language, and the terms it has most above the language."""
    return divergence.audit(documents(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and the cheapest edits that mend its structure."""
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the strings of 100 bytes that started earlier."""
    return suffixes.removals(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_wavelet": op4_wavelet,
    "op5_decontam": op5_decontam,
    "op6_lm": op6_lm,
    "op7_ogg": op7_ogg,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_divergence": op11_divergence,
    "op12_repair": op12_repair,
    "op13_suffixes": op13_suffixes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_repair": repair.ORACLE_SQL,
}
