"""Loaders of recorded data with spoilt lines, receipts that are written twice or broken off, and the payload archive."""

import base64
import gzip
import json
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.sources import archive, receipts, records


def written(tmp_path, name, lines):
    place = tmp_path / name
    place.write_text("\n".join(lines))
    return str(place)


def test_skipped_lines_have_reasons(spark, tmp_path):
    path = written(tmp_path, "d.jsonl", ['﻿{"query": "q", "expected_intent": "factual"}', "", "   ", "{bad", '{"query": "q", "expected_intent": "x"} more', "[1]", "3", "null", '"text"', '{"query": "only"}', '{"query": null, "expected_intent": "x", "more": [1, {"a": 2}]}'])
    read = records.lines(spark, path, records.REQUIRED["example"])
    assert {r.skipped: r.n for r in records.skipped(read).collect()} == {"blank": 2, "corrupt": 2, "no_object": 4, "incomplete": 1}
    assert sorted((r.query or "", r.expected_intent) for r in records.records(spark, path, "example").collect()) == [("", "x"), ("q", "factual")]


def test_defaults_and_other_types(spark, tmp_path):
    path = written(tmp_path, "p.jsonl", ['{"passage_id": "p", "url": "u", "text": "t"}', '{"passage_id": "q", "url": "u", "text": "t", "source_score": "no number", "canonical_url": "c", "author": null, "utility_score": 1}', '{"passage_id": "r", "url": "u"}'])
    got = {r.passage_id: r for r in records.records(spark, path, "passage").collect()}
    assert set(got) == {"p", "q"} and (got["p"].canonical_url, got["p"].source_score, got["p"].host, got["p"].section) == ("u", 0.5, "", None)
    assert (got["q"].canonical_url, got["q"].source_score, got["q"].utility_score, got["q"].author) == ("c", 0.5, 1.0, None)
    path = written(tmp_path, "c.jsonl", ['{"claim_id": "a", "claim_text": "x", "entity_set": ["e"], "priority": 3}', '{"claim_id": "b", "claim_text": "y", "entity_set": null}'])
    got = {r.claim_id: r for r in records.records(spark, path, "claim").collect()}
    assert got["a"].entity_set == ["e"] and got["a"].priority == 3 and got["b"].entity_set == [] and got["b"].priority == 1 and got["b"].needs_freshness is False


def test_nested_records(spark, tmp_path):
    own = {name: 0.5 for name in records.REQUIRED["assessment"]} | {"domain_type": "official"}
    good = {"serp": {"result_id": "r", "url": "u", "raw": {"k": "v"}}, "assessment": own, "matched_variant_ids": ["v"]}
    path = written(tmp_path, "g.jsonl", [json.dumps(good), json.dumps(good | {"serp": {"url": "u"}}), json.dumps({"serp": good["serp"]}), json.dumps(good | {"assessment": {"domain_type": "x"}})])
    rows = records.gated_results(spark, path).collect()
    assert len(rows) == 1 and rows[0].serp.raw == {"k": "v"} and rows[0].assessment.source_score == 0.5 and rows[0].assessment.reasons == []
    path = written(tmp_path, "s.jsonl", [json.dumps({"query": "q", "results": [{"result_id": "a", "url": "u"}, {"result_id": "b"}, 3]}), json.dumps({"query": "r", "results": None}), "{}"])
    assert sorted((r.query, [x.result_id for x in r.results]) for r in records.snapshots(spark, path).collect()) == [("q", ["a"]), ("r", [])]
    written(tmp_path, "run.json", [json.dumps({"metrics": {"a": 1, "b": "x", "c": None}}, indent=2)])
    assert sorted((r.name, r.value) for r in records.run_metrics(spark, str(tmp_path / "run.json")).collect()) == [("a", 1.0), ("b", None), ("c", None)]


def rows_of(spark, ids):
    runs = spark.createDataFrame([(f"r{k}", f"query {k}", "yes", 1_700_000_000 + 50_000 * k) for k in ids], "run_id string, query string, answer string, at long").withColumn("started", F.timestamp_seconds("at")).drop("at")
    return receipts.receipts(runs, spark.createDataFrame([(f"r{k}", "c", "supported") for k in ids], "run_id string, claim_id string, verdict string"))


def test_receipts_are_written_once(spark, tmp_path):
    place = str(tmp_path / "out")
    assert receipts.read_receipts(spark, place).count() == 0
    first = receipts.write_receipts(rows_of(spark, range(20)), place)
    again = receipts.write_receipts(rows_of(spark, range(20)).repartition(5), place)
    receipts.write_receipts(rows_of(spark, range(10, 30)).union(rows_of(spark, range(10, 30))), place)
    got = sorted(r.run_id for r in receipts.read_receipts(spark, place).collect())
    assert first == again and got == sorted(f"r{k}" for k in range(30))


def test_a_write_that_breaks_off_and_is_repeated(spark, tmp_path):
    """A job that dies in its tasks leaves nothing to read; one that dies while it commits leaves whole days; both are made up for."""
    place, rows = str(tmp_path / "out"), rows_of(spark, range(20))

    @F.udf("string")
    def dies(x):
        raise RuntimeError("lost") if x == "r13" else ValueError if x is None else None

    broken = rows.withColumn("payload", F.when(F.col("run_id") == "r13", dies("run_id")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        receipts.write_receipts(broken, place)
    assert receipts.read_receipts(spark, place).count() == 0
    batch = receipts.write_receipts(rows, place)
    days = sorted((tmp_path / "out").glob("day=*"))
    shutil.rmtree(days[1])  # as if the driver had died before it moved this day
    shutil.rmtree(days[3] / f"batch={batch}")
    (tmp_path / "out" / ".spark-staging-1" / "day=20231114").mkdir(parents=True)
    (tmp_path / "out" / ".spark-staging-1" / "day=20231114" / "part-0.json").write_text('{"run_id": "half"}')
    assert receipts.write_receipts(rows, place) == batch
    assert sorted(r.run_id for r in receipts.read_receipts(spark, place).collect()) == sorted(f"r{k}" for k in range(20))


def test_payload_archive(spark, tmp_path):
    repo = {"url": "a", "owner": "o", "repo": "r", "readme": {"content": base64.b64encode("# Hé\n\ntext ".encode()).decode()}, "release": {"tag_name": "v1", "body": " notes "}}
    work = {"url": "b", "doi": "10.1/x", "message": {"title": ["T"], "abstract": "<jats:p>One &amp; two</jats:p>", "author": [{"given": "G", "family": "F"}, {"family": "H"}]}}
    bare = {"url": "c", "doi": "10.1/y", "message": {"container-title": ["J"], "issued": {"date-parts": [[2024, 1]]}}}
    paper = {"url": "d", "paper_id": "p", "paper": {"title": " P ", "year": 2020, "authors": [{"name": "A"}, {}], "abstract": "words"}}
    for kind, found in (("repository", [repo, {"url": "e", "owner": "o", "repo": "s", "readme": {"content": "*"}}]), ("doi", [work, bare]), ("paper", [paper])):
        (tmp_path / f"kind={kind}").mkdir()
        with gzip.open(tmp_path / f"kind={kind}" / "part-0.json.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, found)) + "\n\n")
    archive.register(spark)
    read = spark.read.format("payload_archive").option("max_chars", 60).load(str(tmp_path))
    got = {r.url: (r.title, r.final_url, r.first_paragraph, r.content) for r in read.collect()}
    assert got["a"] == ("o/r", "https://github.com/o/r", "# README", "# README\n\n# Hé\n\ntext\n\n---\n\n# Latest release (v1)\n\nnotes")
    assert got["b"] == ("T", "https://doi.org/10.1/x", "# T", "# T\n\nAuthors: G F, H\n\nOne & two")
    assert got["c"][3] == "# Crossref work\n\nJ - [2024, 1]" and got["d"][1:] == ("https://www.semanticscholar.org/paper/p", "# P", "# P\n\nYear: 2020\n\nAuthors: A\n\nwords") and set(got) == set("abcd")
    (tmp_path / "kind=paper" / "part-1.json").write_text("not json\n")  # never opened for other kinds
    some = read.where("kind = 'doi' and length(content) > 0")
    assert sorted(r.url for r in some.collect()) == ["b", "c"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "kind" not in "".join(line for line in plan.splitlines() if line.lstrip(" +-*()0123456789").startswith("Filter"))
