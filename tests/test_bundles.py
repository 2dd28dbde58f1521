import random

from pyspark.sql import functions as F

from tessera.operators import bundles as B


def test_rerank_is_the_greedy_choice(spark):
    rng = random.Random(8)
    rows = [(c, s, f"x.h{rng.randint(0, c % 7)}.com", rng.randint(0, 6) / 6, rng.randint(0, 3) / 3) for c in range(30) for s in range(rng.randint(1, 70))]
    df = spark.createDataFrame(rows, "claim_id long, seq long, host string, utility double, source_score double")
    got = {}
    for r in B.rerank(df, 6).orderBy("claim_id", "place").collect():
        got.setdefault(r.claim_id, []).append(r.seq)
    for c in range(30):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[3], -r[4], r[1]))
        taken, hosts = [], set()
        for r in own:
            if r[2] in hosts and len(taken) < 3:
                continue
            taken.append(r[1])
            hosts.add(r[2])
            if len(taken) >= 6:
                break
        if len(hosts) < 2:
            taken += [r[1] for r in own if r[2] not in hosts][:1]
        assert got[c] == taken


def test_bundles_and_rates(spark):
    support = spark.createDataFrame([(1, "a.gov", 0.1, "2024-01-01"), (1, "b.com", 0.2, None), (2, "c.com", 0.1, None)], "claim_id long, host string, primary_score double, published string")
    claims = spark.createDataFrame([(1, "supported", "fact", True, 2, True), (2, "supported", "fact", True, 2, True), (3, "supported", "overview", False, 0, False)], "claim_id long, verdict string, shape string, requires_primary boolean, least_sources int, fresh_needed boolean")
    got = {r.claim_id: (r.sources, r.gaps, r.satisfied) for r in B.bundles(support, claims).collect()}
    assert got == {1: (2, "", True), 2: (1, "primary_source,independent_sources,freshness", False), 3: (0, "independent_sources", False)}
    cases = spark.createDataFrame([("a", ["x"], ["y"], 1), ("b", ["x", "z"], [], 3)], "case_id string, include array<string>, exclude array<string>, least int")
    out = spark.createDataFrame([("a", "x"), ("b", "z"), ("b", "y")], "case_id string, item string")
    r = B.expectation_rates(cases, out).first()
    assert (r.n_cases, round(r.include_rate, 6), r.exclude_rate, r.least_rate, r.pass_rate) == (2, 0.666667, 1.0, 0.5, 0.5)


def test_plain_payload(spark):
    text = "\n# A title #\n\n" + "x" * 50 + "\n\nshort"
    p = spark.range(1).select(B.plain_payload(F.trim(F.lit(text)), F.lit("hint"), 20).alias("p"), B.plain_payload(F.lit("plain"), F.lit("hint"), 20).alias("q")).first()
    assert p.p.title == "A title #" and p.p.blocks == ["x" * 50] and p.q.title == "hint" and p.q.blocks == []
