import random

import numpy as np

from tessera.llm import decontam

BENCH = "item_id long, text string, doc_id long"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def brute_align(item, passage):
    best, table = 0, [[0] * (len(passage) + 1)]
    for a in item:
        row = [0]
        for k, b in enumerate(passage):
            row.append(max(0, table[-1][k] + (2 if a == b else -1), table[-1][k + 1] - 1, row[-1] - 1))
        best = max(best, *row)
        table.append(row)
    return best


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontam.align(np.array(a), np.array(b))[0] == brute_align(a, b)
    assert decontam.align(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (6, 1, 4)


def _case(spark, edge_docs):
    rng = random.Random(2)
    items = [_prose(rng, 30) for _ in range(12)]
    docs, held = [], set()
    for k in range(60):
        words = _prose(rng, 80).split()
        if k % 3 == 0:
            own = items[k % 12].split()
            if k % 2:
                for at in range(4, len(own), 9):
                    own[at] = "changed"
                del own[14]
            words[40:40] = own
            held.add((100 + k, k % 12))
        docs.append((100 + k, " ".join(words).capitalize() + ".", 0.0, 0, ""))
    bench = [(k, t, 0) for k, t in enumerate(items)] + [(50, None, 0), (51, "", 0), (52, "zebra quagga", 0)]
    return spark.createDataFrame(docs, edge_docs.schema).union(edge_docs), spark.createDataFrame(bench, BENCH), held


def test_exact_and_edited_copies_are_found_and_clean_documents_stay(spark, edge_docs):
    docs, bench, held = _case(spark, edge_docs)
    docs = docs.union(spark.createDataFrame([(300, "a Zebra, Quagga b", 0.0, 0, "")], docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == held | {(300, 52)}
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(held) - 1


def test_parts_of_items(spark, edge_docs):
    rng = random.Random(6)
    item, other = _prose(rng, 40), _prose(rng, 60)
    docs = [(1, f"{other} {' '.join(item.split()[10:30])} {other}"), (2, f"{other} {' '.join(item.split()[10:16])} {other}")]
    df = spark.createDataFrame([(i, t, 0.0, 0, "") for i, t in docs], edge_docs.schema)
    (found,) = decontam.leaks(df, spark.createDataFrame([(1, item, 0)], BENCH)).collect()
    assert (found.doc_id, found.first_word, found.behind_word) == (1, 60, 80) and abs(found.score - 0.5) < 1e-9


def test_large_benchmarks_and_empty_tables(spark, edge_docs, no_docs, monkeypatch):
    docs, bench, held = _case(spark, edge_docs)
    monkeypatch.setattr(decontam, "KNOWN", 20)  # nothing goes to all tasks: words and n-grams are shuffled
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == held
    assert decontam.leaks(no_docs, bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()


def _edited(rng, text, share):
    out = []
    for w in text.split():
        kind = rng.random()
        if kind >= share:
            out.append(w)
        elif kind < share / 2:
            out.append(_prose(rng, 1))
        elif kind < 3 * share / 4:
            out += [w, _prose(rng, 1)]
    return " ".join(out)


def test_recall_of_edited_copies(spark, edge_docs):
    """Words replaced, put in or taken out at these rates; documents without copies stay."""
    rng = random.Random(8)
    items = [_prose(rng, rng.randint(20, 60)) for _ in range(60)]
    rows, planted = [(k, f"{_prose(rng, 150)}") for k in range(300)], {}
    for share in (0.05, 0.1, 0.2, 0.3):
        planted[share] = set()
        for k, item in enumerate(items):
            rows.append((len(rows), f"{_prose(rng, 60)} {_edited(rng, item, share)} {_prose(rng, 60)}"))
            planted[share].add((len(rows) - 1, k))
    docs = spark.createDataFrame([(i, t, 0.0, 0, "") for i, t in rows], edge_docs.schema)
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)], BENCH)).collect()}
    recall = {share: len(got & some) / len(some) for share, some in planted.items()}
    assert min(recall[s] for s in (0.05, 0.1, 0.2)) == 1 and recall[0.3] >= 0.9, recall
    assert not got - set().union(*planted.values())


def test_against_brute_force(spark, edge_docs):
    """Every document aligned with every item: the same pairs and scores where a seed stands."""
    docs, bench, _ = _case(spark, edge_docs)
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()}
    want = {}
    for d in docs.collect():
        for b in bench.collect():
            t, item = decontam.hashed(d.text)[:3000], decontam.hashed(b.text)
            if len(t) and len(item):
                share = brute_align(item.tolist(), t.tolist()) / (2 * len(item)) if len(t) < 400 else 0
                if share >= max(0.4, min(0.7, 8 / len(item))):
                    want[d.doc_id, b.item_id] = share
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ids_stay_exact_and_names_may_clash(spark):
    rng = random.Random(9)
    item, ids = _prose(rng, 30), [(1 << 60) + 1, (1 << 60) + 3, None]
    docs = spark.createDataFrame([(i, item, 1) for i in ids] + [(5, "clean text", 1)], "doc_id long, text string, _held int").coalesce(1)
    bench = spark.createDataFrame([((1 << 61) + 1, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(i, (1 << 61) + 1) for i in ids}
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5]
