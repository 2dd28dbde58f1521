import zlib
from collections import Counter

import numpy as np

from tessera.llm import quality

PROSE = "The river ran past the old mill, and nobody spoke of it again. Later that year they came back. "


def _corpus(spark, schema):
    rows = []
    for k in range(300):
        words = [f"w{(k * 7 + j) % 97}x" for j in range(40)]
        clean = PROSE + " ".join(words) + ". " + PROSE
        junk = [" ".join(w + "***" for w in words), " ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 40)][k % 4]
        rows.append((k, junk if k % 6 == 0 else clean, 0.0, 0, ""))
    return spark.createDataFrame(rows, schema)


def test_finds_junk_and_keeps_clean(spark, edge_docs):
    docs = _corpus(spark, edge_docs.schema)
    got = {r.doc_id: r.keep for r in quality.scored(docs).collect()}
    assert [k for k, keep in got.items() if keep != (k % 6 != 0)] == []
    kept = quality.without_junk(docs)
    assert kept.columns == docs.columns and kept.count() == 250


def test_edges(spark, edge_docs, no_docs):
    docs = _corpus(spark, edge_docs.schema).union(edge_docs)
    rows = quality.scored(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    twice = [r.score for r in rows if r.doc_id == 8]
    assert len(set(twice[-2:])) == 1
    assert quality.scored(no_docs).count() == 0


def test_em_trusts_detectors():
    patterns = [("-0", 50), ("0+", 900), ("00", 50)]
    names = dict(quality.LABELLERS)
    quality.LABELLERS.clear()
    quality.LABELLERS.update({"a": None, "b": None})
    try:
        p = quality.posteriors(patterns)
    finally:
        quality.LABELLERS.clear()
        quality.LABELLERS.update(names)
    assert p["-0"] < 0.1 < 0.9 < p["0+"]


def test_held_out_accuracy_on_shared_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.scored(docs).join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) / len(rows) > 0.97


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, other = ({r.doc_id: r.score for r in quality.scored(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == other
    few, again = (quality.learn(d, 100) for d in (docs, docs.repartition(5, "text")))
    assert np.array_equal(few.weights, again.weights)


def test_posteriors_against_em_over_rows():
    """The same model fitted row by row, without counts of patterns."""
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.8
    rows = []
    for clean in truth:
        own = ["+" if rng.random() < (0.8 if clean else 0.1) else "0", "-" if rng.random() < (0.05 if clean else 0.7) else "0", rng.choice(["+", "0", "-"], p=(0.5, 0.4, 0.1) if clean else (0.1, 0.4, 0.5))]
        rows.append("".join(own))
    counts = sorted({p: rows.count(p) for p in rows}.items())
    got = quality.posteriors(counts)
    belief = np.array([1 / (1 + np.exp(-(p.count("+") - 2 * p.count("-")))) for p in rows])
    for _ in range(200):
        chance = {}
        for k, weight in (("clean", belief), ("junk", 1 - belief)):
            for j in range(3):
                for v in "0+-":
                    chance[k, j, v] = (sum(w for w, p in zip(weight, rows) if p[j] == v) + 1) / (weight.sum() + 3)
        share = belief.mean()
        clean = np.array([share * np.prod([chance["clean", j, p[j]] for j in range(3)]) for p in rows])
        junk = np.array([(1 - share) * np.prod([chance["junk", j, p[j]] for j in range(3)]) for p in rows])
        belief = clean / (clean + junk)
    assert max(abs(got[p] - b) for p, b in zip(rows, belief)) < 1e-6
    assert np.mean([(got[p] > 0.5) == t for p, t in zip(rows, truth)]) > 0.9


def test_scores_against_brute_force(spark, edge_docs):
    """Features by loops over bytes, labels by the pattern counts, and the regression over a dense matrix; then every score."""
    docs = _corpus(spark, edge_docs.schema).where("doc_id < 120").union(edge_docs)
    rows = [(r.doc_id, (r.text or "").encode("utf-8", "surrogatepass")) for r in docs.collect()]

    def dense(data):
        classes = [int(quality._CLASS[b]) for b in data]
        x, grams = np.zeros(quality.DIMENSIONS), Counter(zip(classes, classes[1:], classes[2:]))
        for (a, b, c), n in grams.items():
            x[quality._TRIGRAM[a * 256 + b * 16 + c]] += np.sqrt(n / sum(grams.values()))
        places = Counter(quality._TRIGRAM[a * 256 + b * 16 + c] for a, b, c in grams)
        f = quality.facts(data)
        for k in ("symbols", "bars", "shouts", "capitals", "repeats", "variety", "lines", "letters"):
            at = zlib.crc32(f"{k}={min(20, int(20 * f[k]))}".encode()) % quality.DIMENSIONS
            x[at] += 0.5
            places[at] += 1
        single = sum(n / sum(grams.values()) for n in grams.values()) + 8 * 0.25  # of each feature by itself, before places meet
        return x / np.sqrt(single)

    found = [quality.votes(quality.facts(d)) for _, d in rows]
    clean = quality.posteriors(sorted(Counter(found).items()))
    x, y = np.stack([dense(d) for _, d in rows]), np.array([clean[p] for p in found])
    weights = last = np.zeros(quality.DIMENSIONS)
    bias = last_bias = 0.0
    for turn in range(250):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        new, new_bias = weights - 4 * (x.T @ (p - y) / len(y) + 1e-6 * weights), bias - 2 * (p - y).mean()
        pull = turn / (turn + 3)
        weights, bias = new + pull * (new - last), new_bias + pull * (new_bias - last_bias)
        last, last_bias = new, new_bias
    want = sorted((str(i), s) for (i, _), s in zip(rows, 1 / (1 + np.exp(-np.clip(x @ last + last_bias, -30, 30)))))
    got = sorted((str(r.doc_id), r.score) for r in quality.scored(docs).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-4
