"""Ids that a double cannot hold stay exact beside a null in the same partition (op4 to op8 and op10: in their own files)."""

from tessera.llm import licenses, quality, simhash, toxicity

IDS = [(1 << 60) + 1, (1 << 60) + 3, None]


def test_ids_stay_exact(spark):
    docs = spark.createDataFrame([(i, f"some text {i} of five words or more", "x") for i in IDS], "doc_id long, text string, _held string").coalesce(1)
    labels = spark.createDataFrame([(IDS[0], 1, 0), (IDS[1], 1, 1)], "doc_id long, quality int, toxic int")
    for found in (simhash.near_duplicates(docs), simhash.one_of_each(docs), licenses.license_scan(docs), quality.scored(docs), quality.without_junk(docs.where("true")), toxicity.toxicity_scores(docs, labels), toxicity.without_toxic(docs, labels)):
        assert {r.doc_id for r in found.collect()} <= set(IDS)
    for found in (simhash.near_duplicates(docs), simhash.one_of_each(docs), licenses.license_scan(docs), quality.scored(docs), toxicity.toxicity_scores(docs, labels)):
        assert {r.doc_id for r in found.collect()} == set(IDS)
