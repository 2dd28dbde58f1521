from tessera.operators.loop import Tables, deep_places, run


def _tables(spark):
    long = "Spark joins tables by keys in many ways and places. " * 12
    claims = spark.createDataFrame([(1, ["spark", "joins"], ["Spark"], None, False), (2, ["other"], [], None, False), (3, ["dry"], [], None, False)], "claim_id long, tokens array<string>, entities array<string>, scope string, fresh boolean")
    queries = spark.createDataFrame([(1, 1, "spark joins"), (1, 1, "Spark  joins"), (2, 1, "other"), (2, 2, "other"), (2, 2, "more"), (3, 1, "dry"), (3, 2, "Dry")], "claim_id long, round int, query string")
    searches = spark.createDataFrame([(q, s, f"https://{h}/{s}", "Spark joins", "spark joins here", None) for s, (q, h) in enumerate([("spark joins", "a.com"), ("spark joins", "b.org"), ("other", "c.com"), ("more", "d.com"), ("more", "c.com"), ("dry", "e.com")])], "query string, seq long, url string, title string, snippet string, published string")
    pages = searches.selectExpr("url", f"concat(url, ' {long}') as content").distinct().selectExpr("url", "left(content, 50) as overview", "left(content, 300) as summary", "content")
    assessments = spark.createDataFrame([(1, 1, 0.9, False), (2, 1, 0.5, False), (2, 2, 0.2, True), (3, 1, 0.1, False)], "claim_id long, round int, confidence double, contradicts boolean")
    keys = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 0, 2)], "claim_id long, round int, key long, citation long")
    return Tables(claims, queries, searches, pages, assessments, keys)


def test_rounds_stop_and_keep_state(spark):
    found = run(_tables(spark), "2026-01-01")
    got = {r.claim_id: (r.verdict, r.rounds) for r in found.outcome.collect()}
    assert got == {1: ("supported", 1), 2: ("contradicted", 2), 3: ("insufficient_evidence", 2)}
    hosts = {}
    rows = found.slates.collect()
    for r in rows:
        hosts.setdefault((r.claim_id, r.round), set()).add(r.host)
    assert hosts == {(1, 1): {"a.com", "b.org"}, (2, 1): {"c.com"}, (2, 2): {"c.com", "d.com"}, (3, 1): {"e.com"}}
    assert all(len(r.text) <= 420 for r in rows)
    fetched = sorted((r.claim_id, r.round, r.depth) for r in found.plans.collect())
    assert fetched == [(1, 1, "deep"), (1, 1, "deep"), (1, 1, "shallow"), (1, 1, "shallow"), (2, 1, "deep"), (2, 1, "shallow"), (2, 2, "deep"), (2, 2, "deep"), (2, 2, "shallow"), (2, 2, "shallow"), (3, 1, "deep"), (3, 1, "shallow")]


def test_a_preferred_source_takes_the_last_deep_place(spark):
    """By score places 1 and 2 are deep; a source of a higher bonus takes place 2, but not for a small bonus or without places."""
    rows = [(1, 1, 0.9, 0.1, 0.0), (1, 2, 0.8, 0.1, 0.1), (1, 3, 0.7, 0.1, 0.5), (1, 4, 0.6, 0.1, 0.5), (2, 1, 0.9, 0.1, 0.0), (2, 2, 0.9, 0.1, 0.0), (2, 3, 0.1, 0.1, 0.18), (3, 1, 0.5, 0.2, 0.9), (4, 1, 0.5, 0.2, 0.1), (4, 2, 0.6, 0.2, 0.3), (4, 3, 0.4, 0.9, 0.3)]
    df = spark.createDataFrame(rows, "claim_id long, pick long, shallow_score double, source_score double, bonus double")
    deep = lambda n: sorted((r.claim_id, r.pick) for r in deep_places(df, n).where("deep").collect())
    assert deep(2) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1), (4, 2), (4, 3)]
    assert deep(0) == [] and deep(1) == [(1, 3), (2, 1), (3, 1), (4, 3)]
