import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import wavelet
from tessera.llm.common import new_folder
from tessera.llm.tokens import default_vocabulary, encoder


def test_matrix_operations():
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 50257, 3000), rng.integers(0, 9, 512), rng.integers(0, 9, 1024), rng.integers(0, 3, 200), np.zeros(70, int), np.array([], int), np.array([5])):
        doc_ids, lengths, w = wavelet.unpack(wavelet.pack([1, None], [len(x), 0], x))
        assert doc_ids == [1, None] and lengths.tolist() == [len(x), 0]
        assert np.array_equal(w.tokens(), x) and np.array_equal(w.access(np.arange(len(x))), x)
        for t in {*x[:5].tolist(), 49999}:
            places = np.flatnonzero(x == t).tolist()
            assert w.occurrences(t).tolist() == places and w.count(t) == len(places) and w.select(t, [len(places), -1]).tolist() == [-1, -1]
            assert w.rank(t, len(x) // 2) == sum(p < len(x) // 2 for p in places)


def test_pieces_give_the_ids_of_whole_texts():
    own = Tokenizer.from_file(default_vocabulary())
    for text in ["<|endoftext|>", "a <|endoftext|> <|endoftext|>b c", "a b", " a", "a ", "  a", "a  b", "a \n b", "x\n\ny z", "it's 'S we're!", "é ü", "a\t b", "a \tb", "\u00a0 b", "1,234.5 x", "<|endoftext|> y", "foo, bar. baz?! \"q\"", "日本 語", "a.b c,d e'"]:
        assert np.frombuffer(encoder(default_vocabulary())(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '.,!?|*<\n\t\r\x1c\x0b12sltdrvemAZé\u00df×÷日½²ⅷ\u00a0\u2003\u0301ǅ\U0001f600")), max_size=14) | st.text(max_size=8))
def test_words_cut_as_the_library_does(text):
    e = encoder(default_vocabulary())
    assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_vocabularies_of_another_kind_encode_whole():
    import public_tokenizers

    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.words is None and np.frombuffer(e("Some Words,  here"), "<u4").tolist() == e.tokenizer.encode("Some Words,  here", add_special_tokens=False).ids


def test_shards_of_several_matrices(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(wavelet, "MATRIX", 50)
    folder = new_folder(spark, "t")
    wavelet.write_tokens(edge_docs, folder, shards=1)
    assert spark.read.parquet(folder).count() > 3
    rows = sorted(wavelet.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert len(rows) == edge_docs.count() and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_ids_are_those_of_the_library_and_exact(spark):
    own = Tokenizer.from_file(default_vocabulary())
    texts = {(1 << 60) + 1: "<|endoftext|> x", (1 << 60) + 3: "plain text, twice  spaced", None: "no id"}
    rows = wavelet.token_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    want = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_files_round_trip(spark, edge_docs, no_docs, monkeypatch):
    folder = new_folder(spark, "t")
    wavelet.write_tokens(edge_docs, folder, shards=3)
    rows = wavelet.read_tokens(spark, folder).collect()
    encode, given = encoder(default_vocabulary()), edge_docs.collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in rows) == sorted((g.doc_id or -1, (*np.frombuffer(encode(g.text), "<u4").tolist(), 2)) for g in given)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    at = {}
    for r in rows:
        for k, t in enumerate(r.ids):
            at.setdefault(t, []).append((r.doc_id or -1, k))
    for t in (2, 13, rows[0].ids[0], 49999):
        assert sorted((r.doc_id or -1, r.at) for r in wavelet.occurrences(spark, folder, t).collect()) == sorted(at.get(t, []))
    assert {r.token: r.n for r in wavelet.token_counts(spark, folder, [2, 13, 13, 49999]).collect()} == {t: len(at.get(t, [])) for t in (2, 13, 49999)}
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert wavelet.token_digests(no_docs).count() == 0
