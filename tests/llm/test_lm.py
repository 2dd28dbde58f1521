import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import lm


def _fold(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 5


def _base(docs):
    train = [w for d in docs if _fold(d.doc_id) != 1 for w in (*lm.words(d.text), None)]
    c = Counter(train)
    n, v = len(train), len(c)
    return n, {id(d): (len(own := [*lm.words(d.text), None]), sum(c[w] > 0 for w in own), sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for d in docs}


def test_base_score_against_brute_force(spark, edge_docs):
    more = spark.createDataFrame([(200 + k, f"alpha beta w{k % 7} gamma w{k}", 0.0, 0, "") for k in range(60)], edge_docs.schema)
    docs = edge_docs.union(more)
    given = docs.collect()
    n, want = _base(given)
    rows = lm.scored(docs).collect()
    assert len(rows) == len(given) and {r.train_tokens for r in rows} == {n}
    key = lambda i, t, k, b: (i if i is not None else -1, t, k, round(float(b), 6))
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in rows) == sorted(key(d.doc_id, *want[id(d)]) for d in given)
    assert all(r.score < 0 and r.held_out == (_fold(r.doc_id) == 1) for r in rows)


class Brute:
    """Deleted interpolation with dictionaries: exact ratios, one bucket list for each order."""

    def __init__(self, docs, held_ids):
        self.parts = [Counter() for _ in range(2)]
        self.docs = [0, 0]
        held = []
        for doc_id, text in docs:
            if _fold(doc_id) == 1:
                continue
            part = doc_id in held_ids
            self.docs[part] += 1
            own = ["<<", "<<", *lm.words(text), None]
            for k in range(2, len(own)):
                for n in (1, 2, 3):
                    self.parts[part][tuple(own[k + 1 - n : k + 1])] += 1
                if part:
                    held.append(tuple(own[k - 2 : k + 1]))
        self.use(self.parts[0], self.docs[0])
        seen = [t for t in held if self.c[t[2:]]]
        whole = (len(seen) + 1) / (len(held) + 2)
        own = self.em([self.c[t[2:]] / self.n * self.v for t in seen], [1] * len(seen))[1]
        self.first = whole * own, whole * (1 - own), 1 - whole
        self.shares = []
        for order in (2, 3):
            lower = [self.p(t) for t in held]
            context = [self.context(t[3 - order : 2]) for t in held]
            self.shares.append(self.em([self.c[t[3 - order :]] / max(m, 1) / p for t, m, p in zip(held, context, lower)], [int(np.log2(m + 1)) for m in context]))
        self.use(self.parts[0] + self.parts[1], sum(self.docs))

    def use(self, counts, n_docs):
        self.c, self.n_docs = counts, n_docs
        self.n = sum(x for k, x in counts.items() if len(k) == 1)
        self.v = sum(len(k) == 1 for k in counts)

    def context(self, history):
        return self.n_docs if history[-1] == "<<" else self.c[history]

    @staticmethod
    def em(ratios, buckets):
        out = {}
        for b in range(lm.BUCKETS):
            own, a = np.array([r for r, k in zip(ratios, buckets) if k == b]), 0.5
            for _ in range(200):
                a = ((a * own / (a * own + 1 - a)).sum() + 0.1) / (len(own) + 0.2)
            out[b] = a if b else 0.0
        return out

    def p(self, t):
        c = self.c[t[2:]]
        p = self.first[0] * c / self.n + self.first[1] / self.v if c else self.first[2]
        for order, share in zip((2, 3), self.shares):
            m = self.context(t[3 - order : 2])
            a = share[int(np.log2(m + 1))]
            p = a * self.c[t[3 - order :]] / max(m, 1) + (1 - a) * p
        return p

    def score(self, text):
        own = ["<<", "<<", *lm.words(text), None]
        return sum(np.log10(self.p(tuple(own[k - 2 : k + 1]))) for k in range(2, len(own)))


def _corpus(spark, blocks=None):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(1200):
        text, at = [], rng.randrange(60)
        for _ in range(rng.randint(0, 25)):
            at = (at * 7 + rng.choice((1, 1, 1, 2, 3, 50))) % 60
            text.append(vocabulary[at] if rng.random() < 0.97 else f"odd{rng.randrange(400)}")
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r[0] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {lm.HELD_OUT}) as h").where("h = 0").collect()}
    return docs, rows, Brute(rows, held)


def test_score_against_brute_force(spark, monkeypatch):
    docs, rows, brute = _corpus(spark)
    got = {r.doc_id: r.score for r in lm.scored(docs).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[i] - brute.score(t)) / (1 + len(t.split())) for i, t in rows) < 2e-3
    monkeypatch.setattr(lm, "BLOCK", 2000)  # many small blocks, other partitions: the same scores
    monkeypatch.setattr(lm, "SHARE", 3000)
    again = {r.doc_id: r.score for r in lm.scored(docs.repartition(3)).collect()}
    assert max(abs(again[i] - got[i]) for i in got) < 1e-9


def test_probabilities_sum_to_one(spark):
    _, _, brute = _corpus(spark)
    types = [k[0] for k in brute.c if len(k) == 1] + ["never seen"]
    for history in (("<<", "<<"), ("<<", "w1"), ("w1", "w8"), ("never", "w3"), ("no", "never")):
        assert abs(sum(brute.p((*history, w)) for w in types) - 1) < 1e-9


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for x in (np.array([], np.uint64), np.array([0]), rng.integers(0, 1 << 62, 50).astype(np.uint64), np.array([255, 256])):
        assert np.array_equal(lm.wide(lm.small(x)), x)


def test_hot_words_and_repeated_documents(spark):
    """A third of all rows hold one passage; another text stands twice: its n-grams count twice."""
    hot = "the same passage over and over " * 20
    rows = [(k, hot + f"x{k}") for k in range(300)] + [(1000 + k, f"a{k} b{k} c{k} d{k}") for k in range(600)]
    one, other, single = [i for i in range(1000, 1600) if _fold(i) != 1][:3]
    rows[300 + other - 1000] = (other, rows[300 + one - 1000][1])
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[one].score - got[other].score) < 1e-9 and got[one].score > got[single].score + 0.25  # twice as likely a first word


def test_better_than_base_on_held_out(spark):
    rows = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_ids_stay_exact_beside_nulls(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    got = {r.doc_id for r in lm.scored(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1)).collect()}
    assert got == set(ids)


def test_empty(spark, no_docs):
    assert lm.scored(no_docs).count() == 0


def test_rows_sent_are_bounded(spark, monkeypatch):
    """A block sends no more rows than n-grams, and no more than three a bucket; results do not depend on blocks and buckets."""
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(k % 40))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in lm.scored(docs).collect())
    for buckets, block in ((5, 2000), (60, 700)):
        monkeypatch.setattr(lm, "number", lambda *_, n=buckets: n)
        monkeypatch.setattr(lm, "BLOCK", block)
        blocks = lm._blocks(docs, lm.F.lit(lm.OTHER), block)
        n_blocks, size = blocks.count(), blocks.agg(lm.F.sum("bytes")).first()[0]
        answers = lm._answers(blocks, buckets, 50).where("block is not null")
        sent = answers.count()
        assert n_blocks > 4 and sent <= 3 * buckets * n_blocks and sent <= 3 * size
        assert sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in lm.scored(docs).collect()) == want
    monkeypatch.setattr(lm, "MOST_BUCKETS", 3)
    assert sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in lm.scored(docs).collect()) == want
