import re

import duckdb
import pandas as pd

from tessera.llm import licenses


def brute(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    places, labels, best = {}, set(), 0.0
    for number, label, own, need, at, length, base in licenses._templates():
        for start in range(1 - len(own), len(words)):
            same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(own)]
            if sum(same) >= need and all(same[at : at + length]):
                labels.add(label)
                best = max(best, sum(same) / len(own))
                if base:
                    places.setdefault(label, []).append(start)
    starts = [s for found in places.values() for s in found]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)), ",".join(sorted(labels)), round(best, 9))


TEXTS = [
    "MIT License MIT license mit  LICENSE", "the GNU General Public License, version 3. Apache-License", "permission is hereby granted, free of charge, to every person obtaining one copy of this software and associated documentation files",
    "redistribution and use in source and binary forms, with or without any modification are permitted", "Licensed under the Apache License, Version 2.0. " * 30, "general public general public license license", "lesser general public license of gnu", "éMIT license mit.license",
]


def test_scan_against_brute_force(spark, edge_docs):
    more = spark.createDataFrame([(100 + k, t, 0.0, 0, "") for k, t in enumerate(TEXTS)], edge_docs.schema)
    docs = edge_docs.union(more)
    got = sorted(((r.doc_id or -1), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.license_scan(docs).collect())
    want = sorted(((r.doc_id or -1), *brute(r.text)) for r in docs.collect())
    assert str(got) == str(want)


def test_empty_and_sql(spark, no_docs):
    assert licenses.license_scan(no_docs).count() == 0
    documents = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})  # noqa: F841  (the SQL reads it)
    rows = duckdb.sql(f"select * from ({licenses.ORACLE_SQL}) order by doc_id").fetchall()
    assert [(r[1], r[2], r[5], r[6]) for r in rows] == [(b[0], b[1], b[4], b[5]) for b in map(brute, TEXTS)]


def test_native_plan(spark, edge_docs):
    plan = licenses.license_scan(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_matches_are_spans_of_words(spark):
    rows = [(1, "x y Licensed under the Apache License, Version 2.0 z"), (2, "nothing here"), (3, "... either version 3 of the License")]
    got = {(r.doc_id, r.label, r.first_word, r.behind_word) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, "apache-2.0", 2, 10) in got and (1, "apache", 5, 7) in got and {i for i, *_ in got} == {1}


def test_every_template_finds_its_own_words(spark):
    rows = [(n, "before " + " ".join(words) + " after") for n, _, words, *_ in licenses._templates()]
    got = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[n] for n, label, *_ in licenses._templates())
    assert "gpl-3.0" not in got[next(n for n, label, *_ in licenses._templates() if label == "agpl-3.0")]
