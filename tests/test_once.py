"""What is said of a text often is worked out once: long texts and many rows cost no more than their length."""

import pytest
from pyspark.sql import functions as F

from tessera.catalog import QUERIES
from tessera.functions import text as T
from tessera.operators import policy as P

SF = "/root/testdata/sf0.001"


def said(spark, column):
    frame = spark.createDataFrame([("",)], "x string").select(column(F.col("x")).alias("y"))
    return frame._jdf.queryExecution().optimizedPlan().toString()


def plan(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_run_shells_reads_the_words_of_a_question_once_for_its_time(spark):
    assert said(spark, lambda x: T.time_scope(T.words(x))).count("regexp_extract_all(") == 1


def test_relative_dates_goes_through_day_words_only(spark):
    long = "word, " * 3000 + "(Today... or ВЧЕРА) " + "x " * 3000
    d = spark.createDataFrame([(long,)], "x string").select(T.relative_days(F.col("x"), F.lit("2026-01-01")).alias("d")).first().d
    at = long.index("Today")
    assert [tuple(s) for s in d.spans] == [(at, len("Today..."), "2026-01-01"), (long.index("ВЧЕРА"), 5, "2025-12-31")]
    assert d.text == long.replace("Today...", "2026-01-01").replace("ВЧЕРА", "2025-12-31")
    first = said(spark, lambda x: T.relative_days(x, F.lit("2026-01-01"))).split("date_format", 1)[0]
    assert "filter(transform(" in first  # before dates are made, pieces that are none have gone


def test_cheap_passages_reads_the_words_of_a_passage_once(spark):
    assert plan(spark, "cheap_passages").count("regexp_extract_all(coalesce(text") <= 4  # a passage's, and three times a claim's


def test_reranked_passages_scores_each_passage_once(spark):
    assert plan(spark, "reranked_passages").count("array_intersect(") == 0  # both steps of the selection read what has been written


@pytest.mark.parametrize("most", [12])
def test_span_texts_reads_fallback_and_span_a_few_times(spark, most):
    assert plan(spark, "span_texts").count("regexp_extract_all(") <= most


def test_best_sentence_counts_no_stop_words_and_keeps_its_measure(spark):
    asked = F.array(*[F.lit(t) for t in ("the", "a", "spark", "joins", "joins")])
    text = "The a the a. Spark here. Spark joins the tables"
    got = spark.range(1).select(P.best_sentence(asked, F.lit(None).cast("string"), F.lit(text)).alias("s")).first().s
    assert got == "Spark joins the tables"


def test_pieces_of_a_collapsed_text_are_trimmed_of_spaces_alone(spark):
    text = "0 a. 1 b! 2 c? 3 d \u0001 4 e"
    want = ["0 a.", "1 b!", "2 c?", "3 d", "4 e"]
    got = spark.range(1).select(T.sentences(F.lit(text), collapsed=True).alias("c"), T.sentences(F.lit(text)).alias("s"), T.normalized(F.lit(" a\t\tb \n c  d e  ")).alias("n")).first()
    assert (got.c, got.s, got.n) == (want, want, "a b c d e")
