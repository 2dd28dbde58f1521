import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tessera.llm import divergence


def brute(rows, least):
    """The audit of (text, lang, source) rows, densely."""
    met = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {m[0] for m in met}:
        df = Counter(t for m in met if m[0] == lang for t in set(m[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for la, s, _ in met if la == lang}
        for la, s, found in met:
            if la == lang:
                counts[s].update(t for t in found if t in set(kept))
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = share(total)
        for s, c in counts.items():
            p = share(c)
            pairs = [(o, sum(abs(p[t] - x) for t, x in share(d).items())) for o, d in counts.items() if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if c[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, la, s, 0, "x") for k, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string")


def some(n=240):
    words = ["größe", "the", "of", "zebra", "日本", "and", "quick", "été", "x", "Émile"]
    return [(" ".join(words[(k * j + j * j) % len(words)].upper() if j % 3 else words[(k + j) % len(words)] + "-" + words[j % 3] for j in range(k % 17)), [None, "en", "de"][k % 3], ["", "s1", "s2", None, "s3"][k * k % 5]) for k in range(n)] + [("only one", "xx", "lone"), (None, "xx", "other"), ("", "yy", "lone")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """Small blocks, tiles and cells give the same rows."""
    if small:
        for name, value in (("BLOCK", 300), ("TILE", 2), ("CELL", 3)):
            monkeypatch.setattr(divergence, name, value)
    rows = some()
    got = sorted(map(tuple, divergence.audit(docs_of(spark, rows).repartition(3)).collect()))
    assert got == brute(rows, 30) and {r[2] for r in got} == {"pair", "term"}


def test_sql(spark):
    rows = some()
    documents = pd.DataFrame(rows, columns=["text", "lang", "source"])  # noqa: F841  (the SQL reads it)
    assert sorted(duckdb.sql(divergence.ORACLE_SQL).fetchall()) == brute(rows, 30)


def test_one_source_holds_most_and_one_word_is_everywhere(spark):
    rows = [("the same text again and again", "en", "hot")] * 400 + [("the other", "en", f"s{k % 9}") for k in range(90)] + [("rare " * (k + 1), "en", "hot") for k in range(31)]
    assert sorted(map(tuple, divergence.audit(docs_of(spark, rows)).collect())) == brute(rows, 30)


def test_empty_and_without_terms(spark):
    empty = docs_of(spark, [("a", "b", "c")]).where("false")
    assert divergence.audit(empty).count() == 0
    rows = [(None, None, None), (None, None, "s"), ("few words", None, "t"), ("12 34 !", "en", "s")]
    assert sorted(map(tuple, divergence.audit(docs_of(spark, rows)).collect())) == brute(rows, 30)


def test_long_texts(spark):
    rows = [("word " * 60_000 + f"end{'x' * (k % 2)}", "en", f"s{k % 3}") for k in range(33)]
    assert sorted(map(tuple, divergence.audit(docs_of(spark, rows)).collect())) == brute(rows, 30)


def test_automaton_finds_whole_terms():
    machine = divergence.automaton([b"a", b"ab", "é".encode()])
    assert Counter(t for _, t in machine.iter(" " + " ".join(["a", "ab", "a", "ba", "é".encode().decode("latin-1"), "a"]) + " ")) == {b"a": 3, b"ab": 1, "é".encode(): 1}
