"""Claim matching by indices against all pairs of a case."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching as M


def brute(spark, expected, runs):
    """Every pair of a case, by the rule."""
    e = expected.withColumn("n", T.fold(F.col("needle"))).withColumn("w", F.array_distinct(T.match_tokens(F.col("needle")))).collect()
    r = runs.withColumn("h", T.fold(F.col("claim_text"))).withColumn("o", T.match_tokens(F.col("claim_text"))).collect()
    out = {}
    for x in e:
        best = None
        for y in r:
            if x.case_id == y.case_id and x.n is not None and y.h is not None:
                holds = x.n in y.h or y.h in x.n
                share = 1.0 if holds else len(set(x.w) & set(y.o)) / len(x.w) if x.w else 0.0
                if holds or share >= 0.6:
                    key = (not holds, -share, y.seq)
                    best = min(best, key) if best else key
        if best:
            out[x.case_id, x.expected_id] = (best[2], round(-best[1], 6))
    return out


def made(spark, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgß") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    runs = [(k % 3, k, r.choice([say(r.randint(0, 9)), say(r.randint(5, 30)), say(2).upper()])) for k in range(n)]
    expected = []
    for k in range(n):
        text = r.choice(runs)[2]
        a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
        expected.append((r.randint(0, 3), k, r.choice([text[a:b], f"{say(1)} {text} {say(2)}", say(4), " ".join(r.sample(text.split(), len(text.split()))), "", "a", "the of"])))
    return spark.createDataFrame([*expected, (0, 9_000, None)], "case_id long, expected_id long, needle string"), spark.createDataFrame([*runs, (0, 9_000, None)], "case_id long, seq long, claim_text string")


def test_against_all_pairs(spark):
    for seed in (1, 2):
        expected, runs = made(spark, 150, seed)
        got = {(r.case_id, r.expected_id): (r.seq, r.share) for r in M.match_claims(expected, runs).collect()}
        assert got == brute(spark, expected, runs) and len(got) > 60


def test_without_blank_runs_and_with_short_texts(spark):
    expected = spark.createDataFrame([(1, 1, "ab"), (1, 2, "zz"), (1, 3, "long enough needle text"), (1, 4, ""), (2, 5, "")], "case_id long, expected_id long, needle string")
    runs = spark.createDataFrame([(1, 7, "x ab y"), (1, 8, "the long enough needle text here"), (1, 9, "z")], "case_id long, seq long, claim_text string")
    got = {r.expected_id: (r.seq, r.share) for r in M.match_claims(expected, runs).collect()}
    assert got == {1: (7, 1.0), 2: (9, 1.0), 3: (8, 1.0), 4: (7, 1.0)}


def test_candidates_grow_with_the_claims_not_their_square(spark):
    """Ten times the claims in one case give about ten times the candidates."""

    def candidates(n):
        rows = spark.range(n).selectExpr("0L as case_id", "id as part", "concat('claim ', md5(string(id)), ' about ', md5(string(id * 7))) as text")
        return M.held_in(rows, rows.withColumnRenamed("part", "whole")).count()

    assert candidates(200) == 200 and candidates(2000) == 2000
