"""Operators against plain loops on random rows, and the sources and sinks on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as V
from tessera.operators import evidence as E
from tessera.operators import matching as M
from tessera.sources import payloads, receipts, records


def test_slate_is_what_taking_one_by_one_gives(spark):
    rng = random.Random(3)
    rows = []
    for claim in range(25):
        for seq in range(rng.randint(0, 60)):
            host = f"h{rng.randint(0, 5)}"
            rows.append((claim, seq, f"{host}/{rng.randint(0, 3)}", host, rng.randint(0, 4) / 4))
    df = spark.createDataFrame(rows, "claim_id long, seq long, url string, host string, source_score double")
    got = {}
    for r in E.pack_for_prompt(E.rank_for_prompt(df)).orderBy("claim_id", "citation").collect():
        got.setdefault(r.claim_id, []).append(r.seq)
    for claim in range(25):
        own = sorted((r for r in rows if r[0] == claim), key=lambda r: (-r[4], r[1]))
        urls = {}
        for r in own:
            urls.setdefault(r[2], []).append(r)
        ranked = [b[k] for k in range(60) for b in urls.values() if k < len(b)][:25]
        kept, per_url, per_host = [], {}, {}
        for r in ranked:
            if len(kept) < 14 and per_url.get(r[2], 0) < 2 and per_host.get(r[3], 0) < 4:
                kept.append(r[1])
                per_url[r[2]] = per_url.get(r[2], 0) + 1
                per_host[r[3]] = per_host.get(r[3], 0) + 1
        assert got.get(claim, []) == kept


def test_gate_keeps_first_of_equal_and_best_of_all(spark):
    rows = [(0, "u", 1, 0.5, 0.1, 0.0), (0, "u", 2, 0.5, 0.9, 0.0), (0, "v", 3, 0.5, 0.5, 0.0), (0, "w", 4, 0.9, 0.0, 1.0), (1, "u", 5, 0.1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "claim_id long, canonical_url string, seq long, source_score double, primary_score double, spam double")
    got = [(r.claim_id, r.rank, r.seq) for r in E.gate(df, 2).orderBy("claim_id", "rank").collect()]
    assert got == [(0, 1, 4), (0, 2, 3), (1, 1, 5)]
    assert E.gate(df.limit(0)).count() == 0


def test_passages(spark):
    text = "First sentence is here. " * 30
    p = spark.range(1).select(E.passages(F.lit(text)).alias("a"), E.passages(F.lit("short")).alias("b"), E.passages(F.lit(None).cast("string")).alias("c"), E.passages(F.lit("# Head " + text)).alias("d")).first()
    assert all(len(x) <= 420 for x in p.a) and " ".join(p.a) == text.strip()
    assert p.b == ["short"] and p.c == [] and p.d == [("# Head " + text)[:420]]


def test_percentiles(spark):
    rng = random.Random(1)
    data = {k: [rng.randint(0, 20) / 2 for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 57))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "key string, value double")
    for r in V.percentiles(df, [0, 50, 95, 100]).collect():
        s = sorted(data[r.key])
        k = (len(s) - 1) * r.percent / 100
        assert r.interpolated == pytest.approx(s[int(k)] + (s[min(int(k) + 1, len(s) - 1)] - s[int(k)]) * (k - int(k)))
        assert r.lower_nearest == s[max(0, int(len(s) * r.percent / 100) - 1)]


def test_percentiles_are_selected_by_refined_ranges(spark):
    """Skewed, repeated and huge values under one key, with so few rows allowed between bounds that ranges are refined."""
    rng = random.Random(2)
    data = {
        "skew": [rng.lognormvariate(0, 6) for _ in range(3000)], "one": [7.0] * 2000, "steps": [float(rng.randint(0, 5)) for _ in range(2500)], "signs": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(1500)], "few": [3.0, 1.0],
        "far": [0.0] * 1000 + [1e300, -1e300, 5.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None)], "key string, value double").repartition(5)
    got = {(r.key, r.percent): r for r in V.percentiles(df, [0, 1, 50, 90, 99, 100], few=20).collect()}
    assert len(got) == 6 * len(data)
    for (key, percent), r in got.items():
        s = sorted(data[key])
        k = (len(s) - 1) * percent / 100
        assert r.interpolated == pytest.approx(s[int(k)] + (s[min(int(k) + 1, len(s) - 1)] - s[int(k)]) * (k - int(k)), rel=1e-12), (key, percent)
        assert r.lower_nearest == s[max(0, int(len(s) * percent / 100) - 1)]


def test_cache_and_budget(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "b", 4), (2, "b", 1)], "run_id long, key string, seq long")
    got = {(r.run_id, r.seq): r.status for r in V.cache_with_budget(df, 1).collect()}
    assert got == {(1, 1): "miss", (1, 2): "hit", (1, 3): "blocked", (1, 4): "blocked", (2, 1): "miss"}
    assert {r.status for r in V.cache_with_budget(df, 0).collect()} == {"miss", "hit"}


def test_cases_file(spark, tmp_path):
    lines = ['{"case_id": "a", "split": "s", "query": "q", "expected_claims": [{"match": "m", "expected_verdict": "supported", "expected_route": ["fast", "full"]}, {"match": "n", "expected_verdict": "supported", "expected_route": "fast"}]}', "no json", '{"query": "x"}', '{"case_id": "b", "profile": "deep"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    got = {r.case_id: r for r in records.cases(spark, str(tmp_path / "c.jsonl")).collect()}
    assert set(got) == {"a", "b"} and got["a"].profile == "web" and got["b"].profile == "deep" and got["b"].expected_claims == []
    assert [c.expected_routes for c in got["a"].expected_claims] == [["fast", "full"], ["fast"]]
    assert got["a"].expected_claims[0].requires_primary_source is False


def test_papers_and_threads(spark):
    atom = '<feed><entry><id> u1 </id><title>A\n b</title><summary>text</summary><author><name>X</name></author><author><name>Y</name></author></entry><entry><id>u2</id><title>no summary</title></entry></feed>'
    df = spark.createDataFrame([(1, atom)], "snapshot_id long, payload string")
    assert [(r.title, r.url, r.authors) for r in payloads.papers(df).collect()] == [("A b", "u1", ["X", "Y"])]
    thread = [{"data": {"children": [{"kind": "t3", "data": {"title": "T", "selftext": "[removed]", "score": 5, "subreddit": "s"}}]}}, {"data": {"children": [{"kind": "t1", "data": {"body": " hi ", "score": 2, "author": "u"}}, {"kind": "more", "data": {}}, {"kind": "t1", "data": {"body": "[deleted]"}}]}}]
    got = spark.createDataFrame([(json.dumps(thread),)], "p string").select(payloads.thread_text(F.col("p")).alias("t")).first().t
    assert got == "# T\n*r/s · 5 upvotes*\n\n\n## Top Comments\n\n**u** (2 pts): hi\n"


def test_receipts(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "What is É?", "yes"), ("r2", None, None)], "run_id string, query string, answer string").withColumn("started", F.timestamp_seconds(F.lit(1_700_000_000)))
    claims = spark.createDataFrame([("r1", "c1", "supported"), ("r1", "c2", "contradicted")], "run_id string, claim_id string, verdict string")
    rows = receipts.receipts(runs, claims)
    receipts.write_receipts(rows, str(tmp_path / "out"))
    back = {r["name"]: json.loads(r["payload"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["r1-what-is"]["summary"] == {"claim_count": 2, "supported_claims": 1, "contradicted_claims": 1, "insufficient_evidence_claims": 0}
    assert back["r2-query"]["summary"]["claim_count"] == 0


def test_stop_and_match(spark):
    a = spark.createDataFrame([(1, 0.9, False), (2, 0.9, False), (3, 0.2, False), (4, 0.1, True), (5, 0.8, False)], "run_id long, confidence double, contradicts boolean")
    k = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (2, 0, 1), (3, 0, 1), (4, 0, 1)], "run_id long, key long, citation long")
    s = spark.createDataFrame([(r, c, h) for r in (1, 2, 3, 4) for c, h in ((1, "a.com"), (2, "b.com"))], "run_id long, citation long, host string")
    got = {r.run_id: (r.verdict, r.stop) for r in E.stop_check(a, k, s).collect()}
    assert got == {1: ("supported", True), 2: ("supported", False), 3: ("insufficient_evidence", False), 4: ("contradicted", True), 5: ("supported", True)}
    assert all(r.stop for r in E.stop_check(a, k, s, iteration=2).collect())
    expected = spark.createDataFrame([(1, 1, "Python 3.13.0 released")], "case_id long, expected_id long, needle string")
    runs = spark.createDataFrame([(1, 0, "other"), (1, 1, "Python 3.13.0 was released on October 7, 2024.")], "case_id long, seq long, claim_text string")
    assert [r.seq for r in M.match_claims(expected, runs).collect()] == [1]


def test_every_benchmark_item_is_a_claim(spark):
    from tessera.plans import evaluation, evidence

    sf = "/root/testdata/sf0.1"
    ids = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    assert len(ids) > 40
    assert {r.claim_id for r in evidence.claims(spark, sf).select("claim_id").collect()} == ids
    for rows in (evidence.results(spark, sf), evidence.passage_rows(spark, sf)):
        assert {r.claim_id for r in rows.select("claim_id").distinct().collect()} == ids
    assert max(r.expected_id for r in evaluation.claim_match(spark, sf).collect()) >= 40


def test_top_overlaps_prunes_and_keeps_ties(spark):
    """Against all pairs: frequent words, ties by id, a claim whose words no document has, one with fewer documents than asked for."""
    import random

    from tessera.operators import evidence as E

    rnd = random.Random(3)
    texts = {i: ["the", "of"] + rnd.choices([f"w{j}" for j in range(30)], k=rnd.randrange(0, 9)) for i in range(200)}
    asked = {0: ["the", "of", "w1", "w2", "w2"], 1: ["nowhere"], 2: ["w3"], 3: [f"w{j}" for j in range(12)] + ["the", "nowhere"], 4: []}
    got = E.top_overlaps(spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>"), spark.createDataFrame(list(asked.items()), "claim_id long, tokens array<string>"), most=7)
    want = set()
    for c, words in asked.items():
        scored = sorted(((-len(set(words) & set(t)) / len(set(words)), d) for d, t in texts.items() if set(words) & set(t)) if words else [])
        want |= {(c, d, r, -o) for r, (o, d) in enumerate(scored[:7], 1)}
    assert {(r.claim_id, r.doc_id, r["rank"], r.overlap) for r in got.collect()} == want


@pytest.mark.parametrize("few", [0, 1000])
def test_top_overlaps_holds_documents_as_rows_and_not_their_words(spark, monkeypatch, few):
    """200 documents of 40 asked words each: no table that is written has more rows than there are documents; the same with shuffled joins."""
    from tessera.operators import evidence as E

    keep, rows = E.checkpointed, []

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(E, "checkpointed", counted)
    monkeypatch.setattr(E, "FEW_ROWS", few, raising=False)
    docs = [(i, [f"w{j}" for j in range(i % 40, i % 40 + 40)]) for i in range(200)]
    asked = [(c, [f"w{j}" for j in range(c, c + 50)]) for c in (0, 20)]
    got = E.top_overlaps(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), spark.createDataFrame(asked, "claim_id long, tokens array<string>"))
    want = {(c, d, r) for c, w in asked for r, (_, d) in enumerate(sorted((-len(set(w) & set(t)), d) for d, t in docs)[:25], 1)}
    assert {(r.claim_id, r.doc_id, r["rank"]) for r in got.collect()} == want
    assert max(rows) <= 200


@pytest.mark.parametrize("shift", [0, 600_000, 5_000_000])
def test_fallback_chain_stops_at_the_first_good_attempt_whatever_its_number(spark, shift):
    rows = [(1, shift + 1, "a", "q", 0, ["e"]), (1, shift + 2, "b", "q", 3, ["e"]), (1, shift + 3, "c", "q", 0, ["e"]), (2, shift + 4, "a", "q", 0, ["e"]), (2, shift + 5, "b", "q", 0, ["e"]), (3, shift + 6, "a", "q", 0, [])]
    df = spark.createDataFrame(rows, "run_id long, step long, profile string, query string, n_results int, unresponsive array<string>")
    assert sorted((r.run_id, r.step - shift, r.n_attempts) for r in payloads.with_fallback(df).collect()) == [(1, 2, 3), (2, 5, 2), (3, 6, 1)]
