import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.tokens import default_vocabulary


def test_best_fit_and_bounds():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 800), rng.integers(1, 300, 800), rng.integers(700, 1100, 500), np.array([2048] * 5), np.array([1])):
        bins, offsets, room = packing.best_fit_decreasing(lengths)
        used = np.bincount(bins, lengths)
        assert (2048 - used == room).all() and room.min() >= 0
        for b in range(len(room)):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        assert packing.lower_bound(np.bincount(lengths, minlength=2049)) <= len(room)
    assert packing.lower_bound(np.bincount([1100] * 7, minlength=2049)) == 7


def test_partitions_exchange_until_certified(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(rng.integers(1, 900, 3000))], "k long, length long")
    packed = packing.pack(rows, per_partition=300).toPandas()
    assert sorted(packed.k) == list(range(3000))
    sizes = packed.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048
    least = packing.lower_bound(np.bincount(packed.length, minlength=2049))
    assert len(sizes) <= least + 1
    assert set(packed.n_sequences) == {len(sizes)} and set(packed.least_sequences) == {least}
    assert (packed.partition_bins >= packed.partition_bound).all()
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_turns_that_save_nothing_end(spark):
    """No two pieces fit together and no bin is full; and pieces whose partitions all have gaps."""
    for lengths in ([1100] * 900, [700] * 900, [683, 1366] * 300):
        packed = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), per_partition=100).toPandas()
        assert len(packed) == len(lengths) and packed.groupby("sequence_id").length.sum().max() <= 2048
        assert packed.sequence_id.nunique() == packed.n_sequences[0] >= packed.least_sequences[0]


def test_ids_are_those_of_the_library_and_exact(spark):
    """Strings of added tokens, and ids that a double cannot hold beside a null."""
    own = Tokenizer.from_file(default_vocabulary())
    texts = {(1 << 60) + 1: "<|endoftext|> x", (1 << 60) + 3: "a <|endoftext|>", None: "no id", 4: "plain text, twice  spaced"}
    rows = packing.packed_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_documents(spark, edge_docs, no_docs):
    rows = packing.packed_documents(edge_docs).toPandas()
    own = Tokenizer.from_file(default_vocabulary())
    want = []
    for d in edge_docs.collect():
        ids = np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        n = len(ids) // 4
        cuts = [0, *range(n % 2048 or 2048, n, 2048), n]
        want += [(d.doc_id or -1, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()]
    assert sorted(got) == sorted(want)
    assert packing.packed_documents(no_docs).count() == 0
