"""Removal of repeated strings: each byte that a string of `LENGTH` bytes covers which also starts earlier.

All suffixes would be far more than the corpus, so only a difference cover of positions is named. `COVER` holds for any
two positions x and y a shift below `PERIOD` that brings both onto the cover; two equal strings of `LENGTH` bytes at x and y
therefore share a cover sample whose next `CORE` bytes are equal too. So

1. cover samples are named by their core. A sample whose core occurs nowhere else settles that no string around it repeats;
2. the others are ranked: within a core, samples are classed by all they can reach, up to `PERIOD` - 1 bytes before the
   sample and `LENGTH` bytes from it. What a class's first member has had, in the order of (doc_id, start), all its others
   repeat, so their whole reach goes. These are the long ties, settled by the samples' ranks alone;
3. only the first members of classes that share a core with another class are left, the places where a repeat begins or
   ends. Their strings are named one by one, and each that has an earlier equal goes.

Each step sorts one bucket of names at a time (`buckets.py`), so memory is bounded by a bucket and by a block of documents.
Names are fingerprints and not ranks in the order of bytes, since only equality is asked for. Names that merely say "occurs nowhere
else" have `SPARE` bits more than the binary logarithm of the corpus' bytes (an accident costs work, not results); those that decide
have at least twice that logarithm and 20 bits more, so that a wrong byte in a whole corpus has a chance of some 2**-20.

Documents are packed into blocks that are dealt out and checkpointed once, by block; what a step tells a block meets it where
it lies, so texts are shuffled once. A string or document that a third of all rows hold is one name in each block and one
entry of each answer; no group is gathered, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.buckets import laid_out, met, number, of, one_by_one, released, small, wide
from tessera.llm.common import cut

LENGTH = 100
#: A perfect difference set. Every number from 1 to 56 is the difference of one pair of its numbers modulo 57.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
CORE = LENGTH - PERIOD + 1
#: Bytes of text in a block, unless one document has more; and bytes of text whose names meet in one bucket, about.
BLOCK, SHARE = 4 << 20, 16 << 20
SPARE = 8
#: The order of a null doc_id: before all others.
_FIRST = np.iinfo(np.int64).min
_PAD = bytes(8)


def _blocks(docs: DataFrame) -> DataFrame:
    """All documents packed by block: block, size, doc_ids, lengths, texts (UTF-8 bytes, each text with eight zero bytes behind it, compressed)."""
    names = ["block", "size", "doc_ids", "lengths", "texts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def told() -> pa.RecordBatch:
            data = _PAD.join([*texts, b""])
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, [len(t) for t in texts])]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(data)], pa.int64()), *lists, pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())], names)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), pc.fill_null(batch["text"].cast(pa.binary()), b"").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield told()
                    block, size, ids, texts = block + 1, 0, [], []
        if ids:
            yield told()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = named.mapInArrow(deal, "block long, size long, doc_ids array<long>, lengths array<long>, texts binary")
    return laid_out(packed, "block")


class Block:
    """A block's texts in one buffer, with where each begins."""

    def __init__(self, size: int, doc_ids: list, lengths: list[int], texts: bytes) -> None:
        self.data = pa.decompress(texts, decompressed_size=size, codec="zstd", asbytes=True)
        self.ids = doc_ids
        self.order = np.array([_FIRST if i is None else i for i in doc_ids], np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths + len(_PAD)) - self.lengths - len(_PAD)

    def samples(self) -> np.ndarray:
        """Where the cover's samples are that have a core, in texts that are long enough to repeat anything."""
        most = max(0, int(self.lengths.max(initial=0)) - CORE + 1)
        cover = (np.arange(0, most + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        n = np.where(self.lengths >= LENGTH, np.searchsorted(cover, self.lengths - CORE, side="right"), 0)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return cover[within] + np.repeat(self.starts, n)

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def names(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        """64-bit fingerprints of the strings of a length (8 at least) that start there."""
        view = np.ndarray((max(0, len(self.data) - 7),), "<u8", self.data, 0, (1,))
        out = np.full(len(at), seed * 2 + 1, np.uint64)
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            out ^= view[at + k]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xD1B54A32D192ED03)

    def reaches(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where each sample's strings can lie."""
        text = self.texts_of(at)
        return np.maximum(self.starts[text], at - PERIOD + 1), np.minimum(self.starts[text] + self.lengths[text], at + LENGTH)

    def strings(self, samples: np.ndarray) -> np.ndarray:
        """Where the strings start that hold one of the samples' cores, ascending."""
        low, high = self.reaches(samples)
        last = np.minimum(samples, high - LENGTH)
        some = last >= low
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, low[some], 1)
        np.add.at(marks, last[some] + 1, -1)
        return np.flatnonzero(np.cumsum(marks) > 0)


def _block_of(rows: pa.Table) -> Block:
    return Block(*(rows[c][0].as_py() for c in ("size", "doc_ids", "lengths", "texts")))


_NAMES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
_ROWS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("keys", pa.binary()), *((c, pa.binary()) for c in ("tails", "docs", "starts", "places")), ("least", pa.int64())])


def _told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _dealt(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """The buckets of ascending keys, with where each begins and ends."""
    home = of(keys << np.uint64(64 - bits), buckets)
    cuts = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
    return [(int(home[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False)]


def _distinct(block: int, keys: np.ndarray, buckets: int, bits: int) -> list[tuple]:
    """Rows for the buckets: a block's distinct keys and how often it has them (1, or 2 for more)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    times, keys = np.minimum(np.diff(first, append=len(keys)), 2), keys[first]
    return [(home, block, int(keys[a]), small(np.diff(keys[a:b])), small(times[a:b])) for home, a, b in _dealt(keys, buckets, bits)]


def _ascending(low: int, steps: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.uint64(low), wide(steps)), dtype=np.uint64)


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of distinct keys a mask of those that occur more than once in all rows."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary())])
    for rows in one_by_one(batches):
        keys = [_ascending(low, steps) for low, steps in zip(rows["low"].to_pylist(), rows["keys"].to_pylist(), strict=True)]
        times = np.concatenate([wide(t) for t in rows["times"].to_pylist()])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        often = (np.bincount(which, times, len(distinct)) >= 2)[which]
        ends = np.cumsum([len(k) for k in keys])
        masks = [np.packbits(often[b - len(k) : b]).tobytes() for k, b in zip(keys, ends, strict=True)]
        yield _told(list(zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), masks, strict=True)), schema)


def _often(keys: np.ndarray, answers: pa.Table, buckets: int, bits: int) -> np.ndarray:
    """Which of a block's keys occur more than once, as its masks say."""
    distinct, which = np.unique(keys, return_inverse=True)
    told = {}
    for bucket, mask in zip(answers["bucket"].to_pylist(), answers["mask"].to_pylist(), strict=True):
        if mask is not None:
            told[bucket] = mask
    parts = [np.unpackbits(np.frombuffer(told[home], np.uint8), count=b - a) for home, a, b in _dealt(distinct, buckets, bits)]
    return np.concatenate(parts).astype(bool)[which] if parts else np.zeros(len(keys), bool)


def _records(number_of: int, block: Block, keys: np.ndarray, tails: np.ndarray, at: np.ndarray, buckets: int, bits: int) -> list[tuple]:
    """Rows for the buckets: names in two parts with document, start in it and place in the block."""
    order = np.argsort(keys, kind="stable")
    keys, tails, at = keys[order], tails[order], at[order]
    text = block.texts_of(at)
    docs, starts, out = block.order[text], at - block.starts[text], []
    for home, a, b in _dealt(keys, buckets, bits):
        least = int(docs[a:b].min())
        shifted = docs[a:b].astype(np.uint64) - np.array([least]).astype(np.uint64)
        out.append((home, number_of, int(keys[a : a + 1].view(np.int64)[0]), small(np.diff(keys[a:b])), small(tails[a:b]), small(shifted), small(starts[a:b]), small(at[a:b]), least))
    return out


def _sorted_names(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """A bucket's records in the order of key, tail, document and start: where a key begins, where a name begins, which are later than the
    name's first one, and each one's row and place."""
    lists = rows.to_pydict()
    keys = [_ascending(low % (1 << 64), steps) for low, steps in zip(lists["low"], lists["keys"], strict=True)]
    whose = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    docs = np.concatenate([(wide(d) + np.array([least]).astype(np.uint64)).view(np.int64) for d, least in zip(lists["docs"], lists["least"], strict=True)])
    keys, (tails, starts, places) = np.concatenate(keys), (np.concatenate([wide(x) for x in lists[c]]) for c in ("tails", "starts", "places"))
    order = np.lexsort((starts, docs, tails, keys))
    keys, tails, docs, starts = keys[order], tails[order], docs[order], starts[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    new_name = new_key | np.append(True, tails[1:] != tails[:-1])
    first = np.flatnonzero(new_name)[np.cumsum(new_name) - 1]
    later = (docs != docs[first]) | (starts != starts[first])
    return new_key, new_name, later, whose[order], places[order]


def _placed(rows: pa.Table, whose: np.ndarray, places: np.ndarray, *which: np.ndarray) -> list[tuple]:
    """For each row of a bucket its block and, for each selection, the places, ascending and packed."""
    blocks, out = np.array(rows["block"].to_pylist(), np.int64), []
    numbers, at = np.unique(blocks, return_inverse=True)
    lists = []
    for w in which:
        of_block, chosen = at[whose[w]], places[w]
        order = np.lexsort((chosen, of_block))
        cuts = np.searchsorted(of_block[order], np.arange(len(numbers) + 1))
        lists.append([chosen[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    for k, block in enumerate(numbers.tolist()):
        if any(len(x[k]) for x in lists):
            out.append((block, *(small(np.diff(x[k], prepend=np.uint64(0))) for x in lists)))
    return out


def _all_places(packed: list[bytes | None]) -> np.ndarray:
    found = [np.cumsum(wide(x), dtype=np.uint64).astype(np.int64) for x in packed if x is not None]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where samples are that repeat all they reach (later), and where first members lie whose core has more than one class (mixed)."""
    for rows in one_by_one(batches):
        new_key, new_name, later, whose, places = _sorted_names(rows)
        core = np.cumsum(new_key) - 1
        mixed = (np.bincount(core, new_name) > 1)[core] & ~later
        yield _told(_placed(rows, whose, places, later, mixed), pa.schema([("block", pa.int64()), ("later", pa.binary()), ("mixed", pa.binary())]))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where strings start that started earlier, too."""
    for rows in one_by_one(batches):
        _, _, later, whose, places = _sorted_names(rows)
        yield _told(_placed(rows, whose, places, later), pa.schema([("block", pa.int64()), ("strings", pa.binary())]))


def _for_blocks(blocks: DataFrame, answers: DataFrame, tell: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell, schema)


def _steps(blocks: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """What blocks are told in the end: samples that repeat their reach, and strings that started earlier."""
    spark, buckets, bits = blocks.sparkSession, number(blocks, size, SHARE), min(60, max(40, size.bit_length() + SPARE))
    more = max(0, 2 * size.bit_length() + 20 - 64)  # bits that a string's name has behind its first 64
    small_name = np.uint64(64 - bits)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["size"], row["doc_ids"], row["lengths"], row["texts"])
                yield _told(_distinct(row["block"], block.names(block.samples(), CORE) >> small_name, buckets, bits), _NAMES)

    recurring = met(blocks.mapInArrow(cores, _ddl(_NAMES)), buckets).mapInArrow(_recurring, "block long, bucket long, mask binary")

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            block = _block_of(left)
            at = block.samples()
            keys = block.names(at, CORE) >> small_name
            often = _often(keys, right, buckets, bits)
            at, keys = at[often], keys[often]
            low, high = block.reaches(at)
            reach, tails = high - low, np.empty(len(at), np.uint64)
            for length in np.unique(reach).tolist():
                own = np.flatnonzero(reach == length)
                tails[own] = block.names(low[own], length, seed=1) + (at - low)[own].astype(np.uint64)
            rows = _records(left["block"][0].as_py(), block, keys, tails, at, buckets, bits)
        return pa.Table.from_batches([_told(rows, _ROWS)])

    ranked = cut(met(_for_blocks(blocks, recurring, contexts, _ddl(_ROWS)), buckets).mapInArrow(_ranked, "block long, later binary, mixed binary"))
    released(spark)
    left_over = ranked.select("block", "mixed")

    def names(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at = block.strings(_all_places(answers["mixed"].to_pylist()))
        return at, block.names(at, LENGTH, seed=2)

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            rows = _distinct(left["block"][0].as_py(), names(_block_of(left), right)[1] >> small_name, buckets, bits)
        return pa.Table.from_batches([_told(rows, _NAMES)])

    again = met(_for_blocks(blocks, left_over, strings, _ddl(_NAMES)), buckets).mapInArrow(_recurring, "block long, bucket long, mask binary")

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            block = _block_of(left)
            at, found = names(block, right)
            often = _often(found >> small_name, right, buckets, bits)
            at, found = at[often], found[often]
            tails = block.names(at, LENGTH, seed=3) >> np.uint64(64 - more) if more else np.zeros(len(at), np.uint64)
            rows = _records(left["block"][0].as_py(), block, found, tails, at, buckets, 64)
        return pa.Table.from_batches([_told(rows, _ROWS)])

    both = left_over.withColumns({"bucket": F.lit(None).cast("long"), "mask": F.lit(None).cast("binary")}).unionByName(again.withColumn("mixed", F.lit(None).cast("binary")))
    named = cut(met(_for_blocks(blocks, both, whole, _ddl(_ROWS)), buckets).mapInArrow(_named, "block long, strings binary"))
    released(spark)
    return ranked.select("block", "later"), named


def removals(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept_sha256 of the bytes that stay.

    A string starts earlier in a smaller doc_id, or in the same at a smaller start; nulls count as the least doc_id. So rows
    that repeat id and text have equal results and remove nothing from each other, and of texts that repeat under other ids the
    least id's stays. Null texts are empty; strings never cross documents, and are judged on the input. An empty table gives
    no rows. doc_id is an integer; only doc_id and text are read, other columns may have any name.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs)
    released(spark)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    later, strings = _steps(blocks, size)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            block = _block_of(left)
            marks = np.zeros(len(block.data) + 1, np.int32)
            low, high = block.reaches(_all_places(right["later"].to_pylist()))
            far, at = high - low >= LENGTH, _all_places(right["strings"].to_pylist())
            for ends, step in ((low[far], 1), (high[far], -1), (at, 1), (at + LENGTH, -1)):
                np.add.at(marks, ends, step)
            gone = np.cumsum(marks)[:-1] > 0
            data = np.frombuffer(block.data, np.uint8)
            for doc_id, a, n in zip(block.ids, block.starts.tolist(), block.lengths.tolist(), strict=True):
                own = gone[a : a + n]
                spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if n else 0
                rows.append((doc_id, n, int(np.count_nonzero(own)), spans, hashlib.sha256(data[a : a + n][~own].tobytes()).hexdigest()))
        return pa.Table.from_batches([_told(rows, out)])

    none = F.lit(None).cast("binary")
    told = later.withColumn("strings", none).unionByName(strings.withColumn("later", none))
    return _for_blocks(blocks, told, settle, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
