"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

An item's word n-grams are seeds where they are rare: where words as frequent as theirs are over all documents would meet by
chance in at most `RARE` of documents (each item keeps its least likely n-gram at least). A passage that a third of the
corpus copies so keeps its seeds, however often it occurs. Documents' n-grams join the seeds by their hash; a document and
the items that it shares seeds with meet once, and each item is aligned with the passages around its seeds. The best score of a
document and an item counts, as a share of the item's own score.

The corpus is read twice whatever the benchmark's size: once to count the benchmark's words, once for seeds. Up to `KNOWN` words
or seeds go to all tasks, which then send on only what will meet one; beyond that all words or n-grams are shuffled. The
rows are the same both ways. Words and n-grams are 64-bit hashes in the joins; alignment compares words by them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_folder

SEED = 3
#: Share of documents in which a seed may be expected by chance.
RARE = 1e-4
#: A document holds an item from this share of the item's own score on, but never for less than what some words score:
#: `LEAST_WORDS`, or `SHORT_SHARE` of a shorter item.
LEAST_SCORE = 0.4
LEAST_WORDS, SHORT_SHARE = 8, 0.7
#: Words or seeds that may go to all tasks, eight bytes each there and some forty in a joined row.
KNOWN = 1_000_000
#: Words whose counts a task holds at a time.
HELD = 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
_WORDS = bytes(b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; null gives none."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def hashed(text: str | None) -> np.ndarray:
    """A text's words as 64-bit hashes."""
    own = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


def grams(t: np.ndarray, n: int = SEED) -> np.ndarray:
    """Keys of the n-grams at each place; none for shorter texts."""
    if len(t) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(t) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ t[k : len(t) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word numbers: its score, and first and behind-last place in passage.

    Words that neither share are -1 in passage and match nothing. Ties go to the alignment that ends first.
    """
    n = len(passage)
    steps = GAP * np.arange(n + 1)
    above, from_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        score = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        came = np.where(above[:-1] + np.where(passage == word, MATCH, MISMATCH) >= above[1:] + GAP, from_above[:-1], from_above[1:])
        fresh = score <= 0
        row = np.concatenate([[0], np.where(fresh, 0, score)])
        came = np.concatenate([[0], np.where(fresh, np.arange(1, n + 1), came)])
        lifted = row - steps  # gaps in the item: a running maximum after taking the gap's cost out
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        along = top + steps
        keep = along > row
        above, from_above = np.where(keep, along, row), np.where(keep, came[where], came)
        k = int(above.argmax())
        if above[k] > best[0]:
            best = (int(above[k]), int(from_above[k]), k)
    return best


def seeds_of(t: np.ndarray, counts: np.ndarray, total: int, n_documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of an item's rare n-grams, from how often its words stand in all documents; a shorter item is one n-gram."""
    n = min(len(t), SEED)
    chance = np.log((counts + 1) / max(1, total))
    likely = np.lib.stride_tricks.sliding_window_view(chance, n).sum(1) + np.log(max(1, total))
    at = np.flatnonzero(likely <= max(np.log(RARE * max(1, n_documents)), likely.min()))
    return grams(t, n)[at], at


def found_in(t: np.ndarray, item: np.ndarray, starts: list[int]) -> tuple[float, int, int] | None:
    """Score share, first word and behind the last word of an item in a document, from where its seeds would put its start."""
    n, pad = len(item), max(4, len(item) // 2)
    least = max(LEAST_SCORE, min(SHORT_SHARE, LEAST_WORDS / n)) * MATCH * n
    own, best, covered = np.isin(t, item), (0, 0, 0), -1
    for start in sorted(starts):
        if start + n <= covered - pad // 2:
            continue
        a, covered = max(0, start - pad), start + n + pad
        if MATCH * int(own[a:covered].sum()) < max(least, best[0] + 1):
            continue  # not even if each of its words were matched
        score, first, behind = align(item, t[a:covered])
        if score > best[0]:
            best = (score, a + first, a + behind)
    return (best[0] / (MATCH * n), best[1], best[2]) if best[0] >= least - 1e-9 else None


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a hash of id and text), item_id and words (hashes) of each different item that has words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashed(t.as_py()).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["item"], batch["item_id"], pa.array(own, pa.list_(pa.int64()))], ["item", "item_id", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    return cut(rows.mapInArrow(read, f"item long, item_id {kind}, words array<long>").where(F.size("words") > 0))


def _known(keys: DataFrame) -> np.ndarray | None:
    """Distinct keys (one column) in order, where at most KNOWN are distinct."""
    keys = keys.distinct()
    if keys.count() > KNOWN:
        return None
    return np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64))


def _among(keys: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Places of the keys that are known; all where that cannot be told."""
    if known is None:
        return np.arange(len(keys))
    if not len(known):
        return np.empty(0, np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.flatnonzero(known[at] == keys)


def _word_counts(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """word and n over all documents; under a null word all words' number, and that of documents in docs."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_words, n_docs = [], 0, 0, 0

        def told(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], ["word", "n", "docs"])

        for batch in batches:
            n_docs += batch.num_rows
            for text in batch["text"]:
                own = hashed(text.as_py())
                n_words += len(own)
                held.append(own[_among(own, vocabulary.value)])
                size += len(held[-1])
                if size > HELD:
                    yield told(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield told(*np.unique(np.concatenate(held), return_counts=True))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_words], pa.int64()), pa.array([n_docs], pa.int64())], ["word", "n", "docs"])

    return cut(docs.select("text").mapInArrow(count, "word long, n long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _seeds(items: DataFrame, counts: DataFrame) -> DataFrame:
    """key, item and place of every seed."""
    total, n_documents = (x or 0 for x in counts.where("word is null").select("n", "docs").first() or (0, 0))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, rows in zip(batch["item"].to_pylist(), batch["rows"].to_pylist(), strict=True):
                t, n = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
                keys, at = seeds_of(t, n, total, n_documents)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([item] * len(at), pa.int64()), pa.array(at, pa.int32())], ["key", "item", "place"])

    spread = items.select("item", F.posexplode("words").alias("at", "word")).join(counts.select("word", "n"), "word", "left")
    rows = spread.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("rows"))
    return cut(rows.mapInArrow(choose, "key long, item long, place int"))


def _hits(docs: DataFrame, known: np.ndarray | None, sizes: list[int]) -> DataFrame:
    """Documents with n-grams that may be seeds, as a table in the shared folder: row, doc_id, words (hashes), hits (key and place)."""
    seeds = docs.sparkSession.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                took, own, hits, ends = [], [], [], [0]
                for k, text in enumerate(part["text"]):
                    t = hashed(text.as_py())
                    keys = [grams(t, n) for n in sizes]
                    at = [_among(x, seeds.value) for x in keys]
                    if any(map(len, at)):
                        took.append(k)
                        own.append(t.tobytes())
                        hits.append((np.concatenate([x[a] for x, a in zip(keys, at, strict=True)]), np.concatenate(at)))
                        ends.append(ends[-1] + len(hits[-1][0]))
                if took:
                    both = pa.StructArray.from_arrays([pa.array(np.concatenate([h[0] for h in hits]).view(np.int64)), pa.array(np.concatenate([h[1] for h in hits]), pa.int32())], ["key", "at"])
                    rows = part.take(pa.array(took))
                    yield pa.RecordBatch.from_arrays([rows["row"], rows["doc_id"], pa.array(own, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)], ["row", "doc_id", "words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema, place = f"row long, doc_id {kind}, words binary, hits array<struct<key: long, at: int>>", new_folder(docs.sparkSession, "seed-hits")
    docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(search, schema).write.parquet(place)
    return docs.sparkSession.read.schema(schema).parquet(place)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (share of the item's own score), first_word, behind_word for each leak.

    Null and empty texts and items hold nothing. Rows that repeat a doc_id give rows each; items that repeat an id with another
    text count as items of their own. Empty tables give no rows. Only doc_id and text, item_id and text are read.
    """
    narrow, items = docs.select("doc_id", "text"), _items(benchmark)
    kinds = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, first_word long, behind_word long"
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(SEED))).distinct().collect()]
    if not sizes:
        return docs.sparkSession.createDataFrame([], kinds)
    seeds = _seeds(items, _word_counts(narrow, _known(items.select(F.explode("words")))))
    known = _known(seeds.select("key"))
    stored = _hits(narrow, known, sorted(sizes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, out = [], []
            for k, (data, met) in enumerate(zip(batch["words"], batch["met"], strict=True)):
                t = np.frombuffer(data.as_py(), np.uint64)
                for item in met:
                    found = found_in(t, item["words"].values.to_numpy().view(np.uint64), item["starts"].as_py())
                    if found:
                        took.append(k)
                        out.append((item["item_id"].as_py(), *found))
            if took:
                rest = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((batch.schema.field("met").type.value_type.field("item_id").type, pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(took)), *rest], ["doc_id", "item_id", "score", "first_word", "behind_word"])

    hits = stored.select("row", F.explode("hits").alias("hit")).select("row", F.col("hit.key").alias("key"), F.col("hit.at").alias("at"))
    small = known is not None and seeds.count() <= KNOWN
    met = hits.join(F.broadcast(seeds) if small else seeds, "key").groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    by_row = met.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("met"))
    return stored.select("row", "doc_id", "words").join(by_row, "row").select("doc_id", "words", "met").mapInArrow(judge, kinds)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns; rows with a null id and a leak go too, by their text."""
    held = leaks(docs.select(key_of(docs).alias("doc_id"), "text"), benchmark).select("doc_id").distinct()
    return docs.join(held, key_of(docs) == held["doc_id"], "left_anti")


def key_of(docs: DataFrame):
    """The hash of a row's doc_id and text, as a column of docs."""
    return F.xxhash64(F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h")))
