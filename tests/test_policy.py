"""Contract rules on worked values."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import policy as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_query_variants(spark):
    q = T.strings(["latest spark release", "Latest  spark release", "", "spark release latest notes", "kafka streams lag", "latest spark release notes"])
    got = [(r["number"], r["query"]) for r in one(spark, P.query_variants(q))]
    assert got == [(1, "latest spark release"), (3, "spark release latest notes"), (4, "kafka streams lag")] or got == [(1, "latest spark release"), (4, "kafka streams lag")]
    assert one(spark, P.query_variants(F.array().cast("array<string>"))) == []
    assert len(one(spark, P.query_variants(T.strings([f"word{k} other{k} third{k}" for k in range(9)])))) == 6


def _claims(spark, rows):
    return spark.createDataFrame(rows, "claim_id long, verdict string, confidence double, shape string, strict boolean, primary boolean, dimensions array<string>, terms array<string>, entities array<string>")


def test_demotion_promotion_rescue_and_floor(spark):
    c = _claims(
        spark,
        [
            (1, "supported", 0.91, "overview", False, False, [], ["a", "b"], []),
            (2, "insufficient_evidence", 0.12, "overview", False, False, [], [], []),
            (3, "insufficient_evidence", 0.3, "fact", True, True, ["institutional"], [], ["Bureau X"]),
            (4, "supported", 0.01, "fact", False, False, [], [], []),
            (5, "insufficient_evidence", 0.5, "overview", False, False, [], [], []),
        ],
    )
    p = spark.createDataFrame(
        [(2, 1, "a.com", "t", "x", 0.8, 0.0), (2, 2, "b.com", "t", "x", 0.0, 0.3), (3, 1, "www.treasury.gov", "Bureau X", "is a bureau within the Treasury", 0.9, 0.0), (3, 2, "news.org", "t", "x", 0.7, 0.0), (5, 1, "", "t", "x", 0.9, 0.0)],
        "claim_id long, seq long, host string, title string, text string, source_score double, utility double",
    )
    got = {r.claim_id: (r.rule, r.verdict, r.confidence, r.first_support) for r in P.adjust(c, p).collect()}
    assert got == {1: ("demote", "insufficient_evidence", 0.62, None), 2: ("promote", "supported", 0.62, 1), 3: ("rescue", "supported", 0.72, 1), 4: ("floor", "supported", 0.38, None), 5: ("none", "insufficient_evidence", 0.5, None)}


def test_choose_documents(spark):
    d = spark.createDataFrame(
        [(1, 1, "a.com", "deep", 0.1), (1, 2, "www.a.com", "shallow", 0.9), (1, 3, "b.com", "shallow", 0.2), (1, 4, "c.com", "snippet_only", 0.3), (1, 5, "c.com", "shallow", 0.2), (1, 6, "d.com", "shallow", 0.1), (2, 1, "a.com", "shallow", 0.1), (2, 2, "b.com", "snippet_only", 0.1), (3, 1, "a.com", "shallow", 0.5)],
        "claim_id long, seq long, host string, depth string, source_score double",
    )
    got = sorted((r.claim_id, r.seq) for r in P.choose_documents(d).collect())
    assert got == [(1, 1), (1, 3), (1, 4), (2, 2), (3, 1)]


def test_best_sentence_and_truncation(spark):
    text = "Nothing here. Spark joins tables fast! Spark joins. The end"
    assert one(spark, P.best_sentence(T.tokens(F.lit("spark joins tables")), F.lit(None).cast("string"), F.lit(text))) == "Spark joins tables fast!"
    assert one(spark, P.truncated(F.lit("abcdef  ghij"), 10)) == "abcdef..."


def test_variants_in_a_stream_are_those_of_an_array(spark):
    from tessera.operators import policy as P

    rows = [(k % 5, k, q) for k, q in enumerate(["a b c", " A  b c ", "", "x y z", "x y z w", "a b c d", "e f", "g h", "i j", "k l", "m n", None] * 12)]
    asked = spark.createDataFrame(rows, "id long, place long, query string")
    streamed = {}
    for r in P.accepted_variants(asked).collect():
        streamed.setdefault(r.id, []).append((r.number, r.query))
    arrays = asked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "query"))).alias("q")).select("id", P.query_variants(F.col("q")["query"]).alias("v")).collect()
    assert {r.id: [(x.number, x.query) for x in r.v] for r in arrays} == {k: sorted(v) for k, v in streamed.items()}
