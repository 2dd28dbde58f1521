"""Token ids on disk as wavelet matrices: succinct bit planes with rank and select, one matrix and one file a shard.

`write_tokens` orders documents by doc_id, encodes each whole text, appends an end id and writes one file for each
range of ids. A file is Parquet written by Spark's own committed writer (so it may be in any store Spark knows, and
tasks of lost executors are run again). A shard of up to `MATRIX` ids is one matrix, one row of its file; a larger one is
several, so that no task holds more. `read_tokens` gives the documents back; `token_counts` and `occurrences` answer from
the planes, without the ids.

A matrix's bytes: the magic; n, planes and documents as little-endian 64-bit numbers; the documents' ids (with a leading mark
byte for each: 0 for null) and lengths, each as its length (64 bits) and zstd-compressed bytes; then for each plane, from the
highest bit, its 64-bit words and its rank directory (32 bits for each eight words: the ones before them). A plane holds one
bit for each id, zeros of the plane before ones in the next plane's order. Planes are as they lie in memory, so that a look-up
touches only the words it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_task, new_folder
from tessera.llm.tokens import default_vocabulary, encoded

MAGIC = b"WAVELET2"
END_ID = 2
#: Ids in a matrix, unless one document has more.
MATRIX = 1 << 22
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


class WaveletMatrix:
    """A sequence of unsigned numbers as bit planes; access, rank, select, count and occurrences read planes only."""

    def __init__(self, planes: list[tuple[np.ndarray, np.ndarray]], n: int):
        """planes: words and rank directory of each, as build gives them."""
        self.n, self.words, self.before = n, [p[0] for p in planes], [p[1] for p in planes]
        self.zeros = [n - int(d[-1]) for d in self.before]

    @staticmethod
    def build(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The planes of a sequence, lowest bit first in each word; none for an empty sequence or only zeros."""
        levels, planes = int(ids.max()).bit_length() if len(ids) else 0, []
        x = np.ascontiguousarray(ids, np.uint16 if levels <= 16 else np.uint32)
        for level in reversed(range(levels)):
            bit = (x & x.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)]).view("<u8")
            planes.append((words, np.append(0, np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.int64))).astype("<u4")))
            x = x.take(np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)]))
        return planes

    def _rank1(self, level: int, at) -> np.ndarray:
        """Ones before the positions: the directory, whole words behind its entry, and the bits of one word."""
        at = np.asarray(at, np.int64)
        words, word = self.words[level], at >> 6
        eight = at >> 9
        out = self.before[level][eight].astype(np.int64)
        last = len(words) - 1
        for k in range(8):
            one = (eight << 3) + k
            kept = np.where(one < word, np.uint64(0xFFFFFFFFFFFFFFFF), np.where(one == word, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
            out += np.bitwise_count(words[np.minimum(one, last)] & kept)
        return out

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits of this kind: by the directory, then among eight words, then in one."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = (np.arange(len(before), dtype=np.int64) << 9) - before
        eight = np.searchsorted(before, k, side="right") - 1
        left = k - before[eight]
        words = self.words[level][(eight[:, None] << 3) + np.arange(8)]
        words = words if bit else ~words
        ends = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        one = (ends <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(one > 0, ends[row, one - 1], 0)
        bits = np.cumsum((words[row, one][:, None] & _POWERS) != 0, axis=1)
        return (eight << 9) + (one << 6) + (bits <= left[:, None]).sum(1)

    def access(self, at) -> np.ndarray:
        """The numbers at the given positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.uint32)
        for level in range(len(self.words)):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._rank1(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes' stable partitions undone one by one from the lowest bit."""
        kind = np.uint16 if len(self.words) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for shift, (words, zeros) in enumerate(zip(reversed(self.words), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: self.n].view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~bits)] = out[:zeros]
            back[np.flatnonzero(bits)] = out[zeros:] | kind(1 << shift)
            out = back
        return out.astype(np.uint32, copy=False)

    def _range(self, token: int, upto: int | None = None) -> tuple[int, int]:
        a, b = 0, self.n if upto is None else max(0, min(upto, self.n))
        if token < 0 or token >> len(self.words):
            return 0, 0
        for level in range(len(self.words)):
            one_a, one_b = self._rank1(level, [a, b]).tolist()
            if (token >> (len(self.words) - 1 - level)) & 1:
                a, b = self.zeros[level] + one_a, self.zeros[level] + one_b
            else:
                a, b = a - one_a, b - one_b
        return a, b

    def rank(self, token: int, upto: int) -> int:
        """How often token stands before position upto."""
        a, b = self._range(token, upto)
        return b - a

    def count(self, token: int) -> int:
        a, b = self._range(token)
        return b - a

    def select(self, token: int, k) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of token; -1 where there are not so many."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        a, b = self._range(token)
        there = (k >= 0) & (k < b - a)
        at = a + k[there]
        for level in reversed(range(len(self.words))):
            bit = (token >> (len(self.words) - 1 - level)) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        out = np.full(len(k), -1, np.int64)
        out[there] = at
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of token in ascending order."""
        return self.select(token, np.arange(self.count(token)))


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A matrix's bytes."""
    planes = WaveletMatrix.build(ids)
    marks = np.array([i is not None for i in doc_ids], np.uint8).tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    sections = [pa.compress(x, codec="zstd", asbytes=True) for x in (marks, np.asarray(lengths, "<i8").tobytes())]
    head = np.array([len(ids), len(planes), len(doc_ids)], "<i8").tobytes()
    return b"".join([MAGIC, head, *(len(s).to_bytes(8, "little") + s for s in sections), *(x.tobytes() for p in planes for x in p)])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids, their lengths and the matrix, whose planes are views of data."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix")
    n, n_planes, n_docs = np.frombuffer(data, "<i8", 3, 8).tolist()
    at, sections = 32, []
    for size in (9 * n_docs, 8 * n_docs):
        length = int.from_bytes(data[at : at + 8], "little")
        sections.append(pa.decompress(data[at + 8 : at + 8 + length], decompressed_size=size, codec="zstd", asbytes=True))
        at += 8 + length
    marks, values = np.frombuffer(sections[0], np.uint8, n_docs), np.frombuffer(sections[0], "<i8", n_docs, n_docs)
    doc_ids = [int(v) if m else None for m, v in zip(marks, values, strict=True)]
    planes, eights = [], -(-n // 512)
    for _ in range(n_planes):
        planes.append((np.frombuffer(data, "<u8", 8 * eights, at), np.frombuffer(data, "<u4", eights + 1, at + 64 * eights)))
        at += 64 * eights + 4 * (eights + 1)
    return doc_ids, np.frombuffer(sections[1], "<i8"), WaveletMatrix(planes, n)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write all documents' ids to folder, one file for each range of doc_id.

    A null text is an empty one (its ids are the end id alone). Null doc_ids come first; rows that repeat a doc_id all
    stay, ordered by a hash of their text. An empty table writes a folder without blocks. Other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, doc_ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack(doc_ids, np.array([len(p) // 4 for p in parts]), np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "n_tokens": [size], "data": [data]}, schema)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded((t.as_py() for t in batch["text"]), vocabulary, end_id), strict=True):
                if parts and size + len(ids) // 4 > MATRIX:
                    yield flush()
                    block, doc_ids, parts, size = block + 1, [], [], 0
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids) // 4
        if parts:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards or by_task(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(blocks, "shard int, block int, n_tokens long, data binary").write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """For each document of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""
    kinds = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, data in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["data"], strict=True):
                doc_ids, lengths, matrix = unpack(data.as_py())
                flat = matrix.tokens().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([shard] * len(ends), pa.int32()), pa.array([block] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    stored = spark.read.schema("shard int, block int, n_tokens long, data binary").parquet(folder)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = totals.select("shard", before(Window.orderBy("shard")).alias("shard_at"))
    of_blocks = stored.select("shard", "block", F.col("n_tokens").alias("n")).withColumn("block_at", before(Window.partitionBy("shard").orderBy("block")))
    places = of_blocks.join(shards, "shard").select("shard", "block", (F.col("shard_at") + F.col("block_at")).alias("base"))
    rows = stored.mapInArrow(documents_of, kinds)
    return rows.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _matrices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("data binary").parquet(folder)


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token and n: how often each of the given ids (each once) stands in the files, by rank on the planes."""
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                matrix = unpack(data.as_py())[2]
                yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([matrix.count(t) for t in wanted], pa.int64())})

    found = _matrices(spark, folder).mapInArrow(count, "token long, n long")
    zeros = spark.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return found.union(zeros).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id and at (position in the document, from 0) of each place where an id stands, by select on the planes."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                doc_ids, lengths, matrix = unpack(data.as_py())
                ends, ids = np.cumsum(lengths), pa.array(doc_ids, pa.int64())
                total = matrix.count(token)
                for k in range(0, total, 1 << 16):
                    at = matrix.select(token, np.arange(k, min(k + (1 << 16), total)))
                    doc = np.searchsorted(ends, at, side="right")
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(at - (ends - lengths)[doc])], ["doc_id", "at"])

    return _matrices(spark, folder).mapInArrow(places, "doc_id long, at long")


def token_digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the documents' ids, read the files back and return doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "wavelet")
    write_tokens(docs, folder)
    return read_tokens(spark, folder, with_ids=False)
