import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    out = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if bin(fps[a] ^ fps[b]).count("1") <= radius and out[a] < out[b]:
                    out[b], changed = out[a], True
    return out


def test_fingerprints_and_components(spark, edge_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    given = edge_docs.collect()
    assert len(rows) == len(given)
    fps = [brute_fingerprint(r.text) for r in given]
    groups = brute_components([r.doc_id for r in given], fps)
    want = sorted(((r.doc_id or -1), f"{fp:016x}", min(x.doc_id for x, h in zip(given, groups) if h == g and x.doc_id is not None) if any(x.doc_id is not None for x, h in zip(given, groups) if h == g) else None) for r, fp, g in zip(given, fps, groups))
    got = sorted(((r.doc_id or -1), r.fingerprint, r.component_id) for r in rows)
    assert str(got) == str(want)


def test_links_meet_brute_force_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for c in centre:
        for _ in range(60):
            x = int(c)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = {r.node & 0xFFFFFFFFFFFFFFFF: r.component for r in components(simhash.links(df)).collect()}
    groups = brute_components(fps, fps)
    for a in range(len(fps)):
        for b in range(a):
            assert (found.get(fps[a], fps[a]) == found.get(fps[b], fps[b])) == (groups[a] == groups[b])


def test_one_of_each_and_empty(spark, edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 8, 9, 10, 11]
    twice = edge_docs.union(spark.createDataFrame([(8, "another text under the same number, clean", 0.5, 7, "x")], edge_docs.schema))
    assert sorted(r.doc_id for r in simhash.one_of_each(twice).collect() if r.doc_id is not None) == [1, 4, 5, 6, 8, 8, 9, 10, 11]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


def test_components_chain(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_against_brute_force(spark, edge_docs, monkeypatch):
    """Copies at many similarities, texts that share a passage, and a large group of near copies over several tiles."""
    monkeypatch.setattr(simhash, "TILE", 32)
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    texts, passage = [], prose(60)
    for _ in range(60):
        own = prose(rng.randint(40, 300)).split()
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 3)):
            other = list(own)
            for _ in range(rng.randint(1, max(1, len(own) // 40))):
                other[rng.randrange(len(own))] = prose(1)
            texts.append(" ".join(other))
    texts += [f"{passage} {prose(60)}" for _ in range(30)]
    group = prose(200).split()
    texts += [" ".join([*group[:k], prose(1), *group[k + 1 :]]) for k in range(100)]
    docs = spark.createDataFrame([(k, t, 0.0, 0, "") for k, t in enumerate(texts)], edge_docs.schema)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(label)
        for a in range(len(texts)):
            for b in range(a):
                if label[a] != label[b] and jaccard(texts[a], texts[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    want = sorted({k for k, x in enumerate(label) if x == k})
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == want


def test_recall_of_similar_pairs():
    """Pairs at 0.8 to 0.85 meet in a band and keep the radius."""
    rng = random.Random(12)
    found = total = 0
    while total < 300:
        own = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(80, 250))]
        other = list(own)
        for _ in range(max(1, len(own) // 48)):
            other[rng.randrange(len(own))] = "changed"
        a, b = " ".join(own), " ".join(other)
        if 0.8 <= jaccard(a, b) <= 0.85:
            (x, k), (y, m) = simhash.sketch(a), simhash.sketch(b)
            apart = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
            found += any(p == q for p, q in zip(k, m)) and apart <= simhash.WIDE_RADIUS
            total += 1
    assert found / total > 0.97, found / total


def test_hot_component_is_dealt_out(spark):
    """A node that all edges hold: its component is whole, and each key's least value reaches rows in all salts."""
    from tessera.llm import components as C

    edges = spark.range(1, 3000).selectExpr("id as u", "0L as v").union(spark.range(5000, 5100).selectExpr("id as u", "id + 1 as v"))
    got = {r.node: r.component for r in C.components(edges).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5101), 5000)}
    rows = spark.createDataFrame([(1, None, 1), (1, 7, 2), (1, 4, 3), (2, None, 4), (None, 3, 5)], "k long, x long, at long")
    assert {(r.k, r.x, r.at, r.m) for r in C.with_least(rows, "k", "x", "m", by="at").collect()} == {(1, None, 1, 4), (1, 7, 2, 4), (1, 4, 3, 4), (2, None, 4, None)}


def test_repeated_rows_with_other_columns_are_chosen_alike(spark):
    rows = [(1, "some text of five words", k, {"a": k}) for k in range(50)] + [(2, "some other text of six words", 7, None), (None, "some text of five words", 8, {}), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, own map<string, long>")
    found = [sorted(map(str, simhash.one_of_each(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 4


def test_hot_copies_are_dealt_out(spark):
    """Equal texts under many ids meet their component by key and salt."""
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the one text', concat('text of its own ', id)) as text")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).where("doc_id % 3 = 0").collect()}
    assert got == dict.fromkeys(range(0, 5000, 3), 0)
