import hashlib
import os
import zlib

import pytest

from tessera.llm import ogg


def slow_crc(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum():
    for data in (b"", b"a", os.urandom(500)):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1020, 8192, 8193, 65025, 200_000])
def test_round_trip(n):
    data = os.urandom(n)
    streams, damaged = ogg.decode(ogg.encode(data))
    head, *packets = streams[ogg.SAMPLES].packets
    payload = b"".join(packets)
    assert damaged == 0 and payload[:n] == data and not payload[n:].strip(b"\0") and len(payload) % 64 == 0 < len(payload)
    ends = streams[ogg.SAMPLES].ends[1:]
    assert ends[-1] == len(payload) and all(e - len(p) == (ends[k - 1] if k else 0) for k, (e, p) in enumerate(zip(ends, packets)))
    assert streams[ogg.FACTS].closed and streams[ogg.SAMPLES].opened


def test_damage_is_passed_over():
    media = bytearray(ogg.encode(os.urandom(300_000)))
    media[100_000] ^= 1
    streams, damaged = ogg.decode(bytes(media))
    assert damaged >= 1 and streams[ogg.SAMPLES].lost == 1 and streams[ogg.SAMPLES].packets
    assert ogg.decode(b"no media")[0] == {}


def test_columns(spark, edge_docs, no_docs):
    rows = ogg.media_features(edge_docs).collect()
    given = edge_docs.collect()
    assert len(rows) == len(given)

    def want(d):
        data = (d.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = ogg.encode(data)
        return (d.doc_id or -1, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())

    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(map(want, given))
    assert len({r.feature for r in rows if r.doc_id in (6, 7)}) == 1
    assert ogg.media_features(no_docs).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert {r.feature for r in ogg.describe(bad).collect()} == {"unreadable"}


def test_headers_have_pages_of_their_own():
    media = ogg.encode(os.urandom(100_000))
    places = [k for k in range(len(media) - 4) if media[k : k + 4] == b"OggS"]
    serials = [int.from_bytes(media[k + 14 : k + 18], "little") for k in places]
    assert serials[:3] == [ogg.SAMPLES, ogg.FACTS, ogg.SAMPLES] and media[places[0] + 5] == 2 and media[places[0] + 26] == 1
    assert [media[k + 5] & 4 for k, s in zip(places, serials) if s == ogg.SAMPLES][-1] == 4


def test_ids_stay_exact_beside_nulls(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    assert {r.doc_id for r in ogg.media_features(spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string").coalesce(1)).collect()} == set(ids)
