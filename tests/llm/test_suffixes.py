import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import buckets, suffixes

SCHEMA = "doc_id long, text string, block long, low string"


def brute(rows):
    """Every string of every text, by its least (doc_id, start); nulls first."""
    data, least = [(i, (t or "").encode()) for i, t in rows], {}
    order = lambda i: (i is not None, i or 0)
    for i, t in data:
        for s in range(len(t) - 99):
            key = (order(i), s)
            if key < least.get(t[s : s + 100], ((9,), 0)):
                least[t[s : s + 100]] = key
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if least[t[s : s + 100]] < (order(i), s):
                gone[s : s + 100] = b"\1" * 100
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)


def found(spark, rows, parts=3):
    return sorted(str(tuple(r)) for r in suffixes.removals(frame(spark, rows).repartition(parts)).collect())


def noise(r, n, letters="abcdefgh ü日"):
    return "".join(r.choice(letters) for _ in range(n))


def some(seed):
    """Texts made of shared pieces of all lengths around the limit, at all shifts, edited copies, and copies of copies."""
    r = random.Random(seed)
    pieces = [noise(r, n) for n in (30, 44, 56, 57, 90, 99, 100, 101, 130, 156, 157, 400)]
    texts = ["".join(r.choice([r.choice(pieces), noise(r, r.randint(0, 60))]) for _ in range(r.randint(1, 8))) for _ in range(60)]
    for t in r.sample(texts, 15):
        at = r.randint(0, len(t))
        texts += [t[:at] + noise(r, r.randint(0, 4)) + t[at:], t, t[at:]]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    return [*rows, (None, texts[3]), (None, texts[4] + "!"), (500, None), (501, ""), (502, "short"), (3, texts[5]), rows[7], rows[7]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(suffixes, "BLOCK", 700)
        monkeypatch.setattr(suffixes, "SHARE", 500)
    rows = some(seed)
    assert found(spark, rows) == brute(rows)


def test_repeats_within_a_text(spark):
    r = random.Random(5)
    piece = noise(r, 120)
    rows = [(1, "a" * 300), (2, "ab" * 200 + "c" + "ab" * 60), (3, piece + "x" + piece + piece[:110] + piece), (4, "a" * 99), (5, "b" * 100), (6, "b" * 100), (-4, piece[3:] + "a" * 101)]
    assert found(spark, rows, 1) == brute(rows) == found(spark, rows, 4)


def test_a_copied_text_and_a_passage_that_most_rows_hold(spark):
    r = random.Random(6)
    passage, text = noise(r, 170), noise(r, 900)
    rows = [(k, noise(r, k % 23) + passage + noise(r, k % 13)) for k in range(200)] + [(1000 + k, text) for k in range(150)] + [(9, text)] * 30
    assert found(spark, rows) == brute(rows)


def test_long_text_over_many_samples(spark):
    r = random.Random(8)
    base = noise(r, 20_000, "etaoin shrdlu")
    rows = [(1, base), (2, base[5_003:9_000] + "|" + base[1_000:5_050]), (3, base[:60] + base[100:])]
    assert found(spark, rows) == brute(rows)


def test_empty_and_exact_ids(spark):
    assert suffixes.removals(frame(spark, [(1, "x")]).where("false")).count() == 0
    r = random.Random(9)
    text = noise(r, 150)
    rows = [((1 << 60) + k, text) for k in (1, 3, 2)] + [(None, "n" * 120), (-(1 << 60), "n" * 121), (None, None)]
    assert found(spark, rows, 1) == brute(rows)


def test_cover_meets_every_shift():
    for x in range(suffixes.PERIOD):
        for y in range(suffixes.PERIOD):
            assert any((x + d) % suffixes.PERIOD in suffixes.COVER and (y + d) % suffixes.PERIOD in suffixes.COVER for d in range(suffixes.PERIOD))


def test_names_of_equal_strings_are_equal():
    r = random.Random(2)
    text = noise(r, 300, "abc").encode()
    block = suffixes.Block(len(text) * 2 + 16, [1, 2], [len(text)] * 2, pa.compress(text + bytes(8) + text + bytes(8), codec="zstd", asbytes=True))
    for length in (8, 44, 99, 100, 156):
        names = block.names(np.arange(2 * len(text) + 16 - length), length)
        strings = [block.data[k : k + length] for k in range(len(names))]
        assert len(set(names.tolist())) == len(set(strings)) and len({*zip(names.tolist(), strings, strict=True)}) == len(set(strings))


def test_numbers_are_packed_and_read_again():
    for x in ([], [0], [255, 256, 1 << 40], [(1 << 64) - 1, 0]):
        assert buckets.wide(buckets.small(np.array(x, np.uint64))).tolist() == x


def test_texts_are_dealt_out_once(spark):
    rows = some(3)
    plan = suffixes.removals(frame(spark, rows))._jdf.queryExecution().toString()
    assert "texts" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert before == "true"
