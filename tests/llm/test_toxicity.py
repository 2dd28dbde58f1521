import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.25, 0.5, 1.0, 2.0]), max_size=14))
def test_segments_against_brute_force(scores):
    """The first of the best segments is among the maximal ones, they do not overlap, and each is as good as any part of it."""
    drift = 0.25
    scored = [(k, s) for k, s in enumerate(scores) if s > 0]
    values = [s if s > 0 else -drift for s in scores]
    found = toxicity.maximal_segments(scored, drift)
    for (_, b, _), (c, _, _) in zip(found, found[1:]):
        assert b <= c
    best = max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0)
    assert abs(max((s for *_, s in found), default=0) - max(best, 0)) < 1e-9
    for a, b, s in found:
        assert abs(s - sum(values[a:b])) < 1e-9
        assert all(sum(values[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(values[k:b]) > 0 for k in range(a, b))


def _corpus(spark, schema):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    bad, rows, labels = ["nastyword", "uglyterm", "vilething"], [], []
    for k in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if k % 7 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad).capitalize() + ",")
        rows.append((k, " ".join(text), 0.0, 0, ""))
        if k % 3:
            labels.append((k, 1, int(k % 7 == 0)))
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_keeps_clean(spark, edge_docs):
    docs, labels = _corpus(spark, edge_docs.schema)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert [k for k, r in got.items() if r.predicted != int(k % 7 == 0)] == []
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in range(400) if k % 7}


def test_edges(spark, edge_docs, no_docs):
    docs, labels = _corpus(spark, edge_docs.schema)
    rows = toxicity.toxicity_scores(docs.union(edge_docs), labels).collect()
    assert len(rows) == 400 + edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in toxicity.toxicity_scores(edge_docs, labels.limit(0)).collect())
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    doubtful = labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic").union(labels).union(labels)
    assert toxicity.toxicity_scores(docs, doubtful).where("predicted = 1").count() == 58


def test_held_out_accuracy_on_shared_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    rows = toxicity.toxicity_scores(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit / max(1, sum(r.toxic for r in rows)) > 0.8 and hit / max(1, sum(r.predicted for r in rows)) > 0.9


def test_names_may_clash(spark, edge_docs):
    docs, labels = _corpus(spark, edge_docs.schema)
    odd = docs.selectExpr("doc_id", "text", "1 as _judged", "2 as toxicity", "3 as _toxicity", "4 as judged", "5 as own", "6 as passages")
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(1 for k in range(400) if k % 7)
    assert {r.own for r in kept.collect()} == {5}
    found = toxicity.scored(odd, toxicity.learn(docs, labels))
    assert found.columns == ["doc_id", "text", "_judged", "_toxicity", "judged", "own", "toxicity", "passages"]


def test_weights_against_brute_force(spark, edge_docs):
    """The odds of each kept word from plain counts of the labelled documents."""
    docs, labels = _corpus(spark, edge_docs.schema)
    model = toxicity.learn(docs, labels)
    told = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    rows = [(told[d.doc_id], toxicity.tokens(d.text)) for d in docs.collect() if d.doc_id in told]
    a_all, b_all = (sum(len(set(t)) for y, t in rows if y == k) for k in (1, 0))
    for word in (b"nastyword", b"uglyterm", b"vilething"):
        a, b = (sum(word in t for y, t in rows if y == k) for k in (1, 0))
        sides = []
        for step in (-1, 1):
            near = {}
            for y, t in rows:
                for k, w in enumerate(t):
                    if y and w == word:
                        n = t[k + step] if 0 <= k + step < len(t) else b""
                        near[n] = near.get(n, 0) + 1
            sides.append(sum(near.values()) ** 2 / sum(n * n for n in near.values()))
        a = min(a, *sides)
        prior = [toxicity.PRIOR * n * (a + b) / (a_all + b_all) for n in (a_all, b_all)]
        odds = np.log((a + prior[0]) / (a_all * (1 + toxicity.PRIOR))) - np.log((b + prior[1]) / (b_all * (1 + toxicity.PRIOR)))
        assert abs(model.weights[word] - min(toxicity.MOST, odds)) < 1e-9


def test_score_against_brute_force(spark, edge_docs):
    """Weights, rate, scale, curve and scores again, over plain lists of the labelled texts."""
    docs, labels = _corpus(spark, edge_docs.schema)
    repeated = docs.union(docs.where("doc_id < 50"))  # rows that repeat teach once
    model = toxicity.learn(repeated, labels)
    told = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    rows = [(told[d.doc_id], toxicity.tokens(d.text)) for d in docs.collect() if d.doc_id in told]
    key = lambda w: w[: toxicity.OPENING] + b"*"

    def names(words):
        return [*words, *(key(w) for w in words if len(w) > toxicity.OPENING)]

    count = [Counter(), Counter()]
    for y, t in rows:
        count[y].update(set(names(t)))
    sums = [{star: sum(n for w, n in count[y].items() if w.endswith(b"*") == star) for star in (False, True)} for y in (0, 1)]
    near = {}
    for y, t in rows:
        for k, w in enumerate(t if y else []):
            for name in names([w]):
                for side, n in ((0, t[k - 1] if k else b""), (1, t[k + 1] if k + 1 < len(t) else b"")):
                    near.setdefault((name, side), Counter())[n] += 1
    weights, other = {}, {}
    for w, n in count[1].items():
        star = w.endswith(b"*")
        a = min(n, *(sum(c.values()) ** 2 / sum(x * x for x in c.values()) for c in (near[w, 0], near[w, 1])))
        b, a_all, b_all = count[0][w], sums[1][star], sums[0][star]
        pa, pb = (toxicity.PRIOR * z * (a + b) / (a_all + b_all) for z in (a_all, b_all))
        odds = np.log((a + pa) / (a_all * (1 + toxicity.PRIOR))) - np.log((b + pb) / (b_all * (1 + toxicity.PRIOR)))
        if odds >= 1 and odds / np.sqrt(1 / (a + pa) + 1 / (b + pb)) >= toxicity.LEAST_Z:
            weights[w], other[w] = min(toxicity.MOST, odds), b
    assert weights.keys() == model.weights.keys() and all(abs(weights[w] - x) < 1e-9 for w, x in model.weights.items())

    shares = {w: (other[w] + 0.05) / sum(len(t) for y, t in rows if not y) for w in weights}
    thin = max(1.0, 2 * sum(shares.values()))
    moment = lambda r: sum(s / thin * np.exp(r * weights[w]) for w, s in shares.items()) + (1 - sum(shares.values()) / thin) * np.exp(-r * toxicity.DRIFT) - 1
    assert model.rate > 1e-3 and abs(moment(model.rate)) < 1e-6

    def segments(t):
        values = [weights.get(w, weights.get(key(w), -toxicity.DRIFT) if len(w) > toxicity.OPENING else -toxicity.DRIFT) for w in t]
        out = []

        def part(a, b):
            best = max(((sum(values[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 1e-12:
                i, j = -best[1], -best[2]
                part(a, i)
                out.append(best[0])
                part(j, b)

        part(0, len(t))
        return out

    found = [(y, len(t), segments(t)) for y, t in rows]
    x0 = np.median(list(weights.values()))
    scale = min(1.0, (sum(max(s, default=0) >= x0 for y, _, s in found if not y) + 1) / (sum(n for y, n, _ in found if not y) * np.exp(-model.rate * x0)))
    assert abs(scale - model.scale) < 1e-9
    evidence = lambda n, s: sum(max(0.0, model.rate * x - np.log(scale * n)) for x in s)
    x, y = np.array([np.rint(64 * np.log1p(evidence(n, s))) / 64 for _, n, s in found]), np.array([y for y, *_ in found])
    p = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * x)))
    assert abs((y - p).sum() - 1e-3 * model.curve[0]) < 1e-5 and abs(((y - p) * x).sum() - 1e-3 * model.curve[1]) < 1e-5
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(repeated, labels).collect()}
    for d in docs.where("doc_id < 60").collect():
        t = toxicity.tokens(d.text)
        assert abs(scores[d.doc_id] - 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log1p(evidence(len(t), segments(t))))))) < 1e-6


def test_an_id_of_many_rows_stays_within_the_bound(spark, edge_docs):
    """100,000 rows under one labelled id, most of them the same text: the bound holds, whatever the partitions."""
    many = spark.range(100_000).selectExpr("1L as doc_id", "if(id % 4 = 0, concat('text ', id), 'the same text') as text")
    docs = many.union(spark.createDataFrame([(k, f"other {k}") for k in (2, 3, 4, 6, 7)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 0, int(k == 1)) for k in (1, 2, 3, 4, 6, 7)], "doc_id long, quality int, toxic int")
    one, other = ([r.text for r in toxicity._labelled(docs.repartition(n), labels, 0, 500).collect()] for n in (3, 8))
    assert len(one) == 500 and sorted(one) == sorted(other)
    assert toxicity._labelled(docs, labels, 0, 40_000).count() == 25_001 + sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in (2, 3, 4, 6, 7))
