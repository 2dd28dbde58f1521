"""Language-model scores: deleted interpolation of word n-grams of order three.

Every n-gram of all training documents is counted. The probability of a word after two others is

    P3(w|u v) = a(b) c(u v w) / c(u v) + (1 - a(b)) P2(w|v)
    P2(w|v)   = a(b) c(v w) / c(v)     + (1 - a(b)) P1(w)
    P1(w)     = k c(w) / N + f / V      for the V words that were seen; what remains of one for the unknown word

where b is the bucket (binary logarithm) of how often the context was seen in each order. Weights are learnt by
expectation-maximisation on held-out counts: documents of one part of the training fold give the estimates, those of the other
part are predicted. Final counts are those of both parts. A text begins behind two start marks and ends with an end
mark, which is a word. As in the base score, all unknown words are one type; all types together sum to one.

How it runs. Documents are written as blocks of text, each of one part; blocks grow with the corpus from `BLOCK` to `MOST_BLOCK`
bytes. A block's n-grams are counted within the block, and each distinct one goes once, as part of a packed sorted array, to the
bucket of its key (`buckets.py`): at most one row a bucket and order, never more rows than n-grams, and for `MOST_BUCKETS`
buckets at most a fixed number a block. So a word, pair or passage that a third of all rows hold arrives once a block, and no
key is hot. Tasks hold one bucket at a time, add up its n-grams over all blocks and answer each block with the counts in the
block's own order. Blocks meet their answers (a co-group by block) and score their documents. Tables of n-grams are never in
one task or on the driver; the driver sees histograms of at most `BUCKETS` x 2 `LEVELS` cells and some totals.

Keys are hashes. Those of words have 62 bits: among n distinct words two share one with a chance of some n * n / 2**63. Those of
pairs and triples have `SPARE` bits more than the binary logarithm of the corpus' bytes, 62 at most, so whatever the size
fewer than one in 2**`SPARE` of them is counted together with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.buckets import met, number, of, one_by_one, small, wide
from tessera.llm.common import fold_of, new_folder

#: Bytes of text in a block, unless one document has more: the least, the most, and how many blocks there are before they grow.
BLOCK, MOST_BLOCK, BLOCKS = 4 << 20, 64 << 20, 1 << 16
#: Bytes of text whose n-grams meet in one bucket, about; and how many buckets there are before these grow.
SHARE, MOST_BUCKETS = 8 << 20, 1 << 20
SPARE = 20
BUCKETS = 40
#: Sixteenths of a power of two that are kept apart on each side when an estimate is held against the lower order's.
LEVELS = 1024
#: One in so many training documents, by a hash of the id, is held out for the weights.
HELD_OUT = 20
ESTIMATE, HELD, OTHER = 0, 1, 2
TOTALS = ("types", "tokens", "early_types", "early_tokens")
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null gives none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Keys spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[bytes], bits: int = 62) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token, an array for each order; and how many tokens each text has."""
    digest, parts, lengths = xxhash.xxh64_intdigest, [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split()
        lengths[k] = len(own) + 1
        parts += [np.fromiter(map(digest, own), np.uint64, len(own)), END[None]]
    first = np.concatenate([np.empty(0, np.uint64), *parts])
    starts = np.cumsum(lengths) - lengths

    def before(x: np.ndarray) -> np.ndarray:
        out = np.concatenate([START[None], x])[:-1]
        out[starts] = START
        return out

    second = _mixed(before(first) * np.uint64(0xC2B2AE3D27D4EB4F) + first)
    third = _mixed(before(second) * np.uint64(0x165667B19E3779F9) + first)
    return [_mixed(first) >> np.uint64(2), second >> np.uint64(64 - bits), third >> np.uint64(64 - bits)], lengths


def _blocks(docs: DataFrame, part: Column, most: int) -> DataFrame:
    """All documents in blocks of one part and at most `most` bytes each, as a table in the shared folder: block, part, bytes, doc_ids, lengths, texts.

    texts are the block's UTF-8 bytes one behind the other (null: none), compressed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[pa.Array, pa.Array]]] = [[], [], []]
        size, n, task = [0, 0, 0], 0, TaskContext.get().partitionId()

        def block(which: int) -> pa.RecordBatch:
            nonlocal n
            ids, texts = (pa.concat_arrays([x[k] for x in held[which]]) for k in (0, 1))
            data = texts.to_pylist()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(list(map(len, data)), pa.int64()))]
            packed = pa.compress(b"".join(data), codec="zstd", asbytes=True)
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), pa.array([which], pa.int32()), pa.array([size[which]], pa.int64()), *lists, pa.array([packed], pa.binary())], ["block", "part", "bytes", "doc_ids", "lengths", "texts"])
            n, held[which], size[which] = n + 1, [], 0
            return out

        for batch in batches:
            for which in (ESTIMATE, HELD, OTHER):
                rows = batch.filter(pc.equal(batch["part"], which))
                texts = pc.fill_null(rows["text"].cast(pa.binary()), b"")
                ends = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
                at = 0
                while at < len(texts):
                    upto = int(np.searchsorted(ends, ends[at] + most - size[which], side="right")) - 1
                    upto = min(max(upto, at if held[which] else at + 1), len(texts))
                    if upto > at:
                        held[which].append((rows["doc_id"].slice(at, upto - at), texts.slice(at, upto - at)))
                        size[which] += int(ends[upto] - ends[at])
                    if upto < len(texts):
                        yield block(which)
                    at = upto
        for which in (ESTIMATE, HELD, OTHER):
            if held[which]:
                yield block(which)

    place, schema = new_folder(docs.sparkSession, "lm-blocks"), f"block long, part int, bytes long, doc_ids array<{kind}>, lengths array<long>, texts binary"
    docs.select(part.alias("part"), "doc_id", "text").mapInArrow(deal, schema).write.option("parquet.block.size", 16 << 20).parquet(place)
    return docs.sparkSession.read.schema(schema).parquet(place)


def _texts(size: int, lengths: list[int], packed: bytes) -> list[bytes]:
    data, out, at = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), [], 0
    for n in lengths:
        out.append(data[at : at + n])
        at += n
    return out


def _answers(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Counts of every block's n-grams over all training documents, as a table in the shared folder.

    Rows: block, order, bucket, c (counts of the block's distinct keys in there, ascending by key) and n (for
    blocks of the held-out part: counts without that part). Rows without a block have in types and tokens how many words
    live there, of both parts and, in early_types and early_tokens, of the first.
    """
    sizes = [62, bits, bits]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, size, lengths, texts in zip(*(batch[k].to_pylist() for k in ("block", "part", "bytes", "lengths", "texts")), strict=True):
                found, _ = grams(_texts(size, lengths, texts), bits)
                for order in range(3):
                    keys = np.sort(found[order])
                    found[order] = None
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
                    times, keys = np.diff(first, append=len(keys)), keys[first]
                    home = of(keys << np.uint64(64 - sizes[order]), buckets)
                    cuts = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
                    bodies = [(small(np.diff(keys[a:b])), small(times[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False)]
                    own = [pa.array([x] * len(cuts), t) for x, t in ((order, pa.int32()), (block, pa.int64()), (part, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(home[cuts], pa.int64()), *own, pa.array(keys[cuts].astype(np.int64)), *(pa.array([b[k] for b in bodies], pa.binary()) for k in (0, 1))], ["bucket", "order", "block", "part", "low", "keys", "times"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent in one_by_one(batches):
            bucket = sent["bucket"][0].as_py()
            for order in range(3):
                rows = sent.filter(pc.equal(sent["order"], order))
                if not rows.num_rows:
                    continue
                low, block, part = (rows[c].to_numpy() for c in ("low", "block", "part"))
                keys = [np.cumsum(np.append(np.uint64(a), wide(k.as_py())), dtype=np.uint64) for a, k in zip(low, rows["keys"], strict=True)]
                times = np.concatenate([wide(t.as_py()) for t in rows["times"]]).astype(np.int64)
                lengths = np.array([len(k) for k in keys])
                distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
                del keys
                whose = np.repeat(part, lengths)
                n = np.bincount(which, times * (whose == ESTIMATE), len(distinct)).astype(np.int64)
                c = n + np.bincount(which, times * (whose == HELD), len(distinct)).astype(np.int64)
                if order == 0:
                    sums = ((c > 0).sum(), c.sum(), (n > 0).sum(), n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), *[pa.array([None], pa.binary())] * 2, *(pa.array([int(x)], pa.int64()) for x in sums)], names)
                ends = np.cumsum(lengths)
                for a in range(0, len(block), 256):
                    at = range(a, min(a + 256, len(block)))
                    own = [which[ends[k] - lengths[k] : ends[k]] for k in at]
                    early = [small(n[x]) if part[k] == HELD else None for k, x in zip(at, own, strict=True)]
                    none = pa.array([None] * len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int64()), pa.array([order] * len(at), pa.int32()), pa.array([bucket] * len(at), pa.int64()), pa.array([small(c[x]) for x in own], pa.binary()), pa.array(early, pa.binary()), *[none] * 4], names)

    names = ["block", "order", "bucket", "c", "n", *TOTALS]
    place, schema = new_folder(blocks.sparkSession, "lm-counts"), "block long, order int, bucket long, c binary, n binary, " + ", ".join(f"{x} long" for x in TOTALS)
    sent = blocks.drop("doc_ids").mapInArrow(send, "bucket long, order int, block long, part int, low long, keys binary, times binary")
    met(sent, buckets).mapInArrow(add_up, schema).write.option("parquet.block.size", 16 << 20).parquet(place)
    return blocks.sparkSession.read.schema(schema).parquet(place)


def _counts(block: pa.Table, answers: pa.Table, column: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams that end at each token of a block, a row for each order; and the texts' lengths."""
    found, lengths = grams(_texts(*(block[k][0].as_py() for k in ("bytes", "lengths", "texts"))), bits)
    by, home, out = answers["order"].to_numpy(), answers["bucket"].to_numpy(), []
    for order in range(3):
        mine = np.flatnonzero(by == order)
        counts = np.concatenate([wide(answers[column][int(k)].as_py()) for k in mine[np.argsort(home[mine])]]).astype(np.int64)
        distinct, of = np.unique(found[order], return_inverse=True)
        if len(counts) != len(distinct):
            raise ValueError("a block and its counts do not belong together")
        out.append(counts[of])
    return np.stack(out), lengths


def _contexts(counts: np.ndarray, lengths: np.ndarray, n_texts: int) -> np.ndarray:
    """How often the contexts of order two and three were seen: the counts before each token; texts begin behind start marks."""
    starts = np.cumsum(lengths) - lengths
    out = np.concatenate([np.zeros((2, 1), np.int64), counts[:2, :-1]], axis=1)
    out[:, starts] = n_texts
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """The binary logarithm of a context's count and one; 0 for contexts that were not seen."""
    return np.log2(context + 1).astype(np.int64)


def mixed(counts: np.ndarray, contexts: np.ndarray, totals: tuple[int, int], first: tuple[float, float, float], shares: list[np.ndarray]) -> np.ndarray:
    """Probabilities of tokens, from the counts that end at them (rows: orders), their contexts, (N, V), weights of words' counts,
    of the uniform and of the unknown word, and as many higher orders' weights by bucket as shares has."""
    n, v = totals
    p = np.where(counts[0] > 0, first[0] * counts[0] / max(n, 1) + first[1] / max(v, 1), first[2])
    for k, share in enumerate(shares):
        a = share[bucket(contexts[k])]
        p = a * counts[k + 1] / np.maximum(contexts[k], 1) + (1 - a) * p
    return p


def histogram(own: np.ndarray, lower: np.ndarray, where: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Held-out tokens by bucket and by the step between an order's own estimate and the lower one (0: no own estimate)."""
    with np.errstate(divide="ignore"):
        level = np.where(own > 0, np.clip(np.rint(16 * (np.log2(own) - np.log2(lower))), 1 - LEVELS, LEVELS - 1) + LEVELS, 0).astype(np.int64)
    return np.bincount(where * 2 * LEVELS + level, times, BUCKETS * 2 * LEVELS)


def em(hits: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The weight of an order's own estimate in each bucket, by expectation-maximisation; none for contexts that were not seen."""
    hits = hits.reshape(BUCKETS, 2 * LEVELS)
    ratio = np.append(0.0, 2.0 ** ((np.arange(1, 2 * LEVELS) - LEVELS) / 16))
    shares = np.full(BUCKETS, 0.5)
    for _ in range(rounds):
        part = shares[:, None] * ratio
        shares = ((hits * part / (part + 1 - shares[:, None])).sum(1) + 0.1) / (hits.sum(1) + 0.2)
    shares[0] = 0.0
    return shares


def _learn(blocks: DataFrame, answers: DataFrame, bits: int, totals: tuple[int, int], n_texts: int) -> tuple[tuple[float, float, float], list[np.ndarray]]:
    """Weights from the held-out part's tokens: of words, uniform and unknown word, and by bucket of order two and three."""

    def tokens(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.empty((0, 6), np.int64)
        if left.num_rows and right.num_rows:
            counts, lengths = _counts(left, right, "n", bits)
            rows = np.concatenate([counts, _contexts(counts, lengths, n_texts)]).T
            rows, times = np.unique(rows, axis=0, return_counts=True)
            out = np.column_stack([rows, times])
        return pa.table([pa.array(out[:, k]) for k in range(6)], names)

    names = ["n1", "n2", "n3", "m2", "m3", "times"]
    schema, place = ", ".join(f"{x} long" for x in names), new_folder(blocks.sparkSession, "lm-held-out")
    there = blocks.where(F.col("part") == HELD).drop("doc_ids").groupBy("block").cogroup(answers.where("n is not null").select("block", "order", "bucket", "n").groupBy("block"))
    there.applyInArrow(tokens, schema).write.parquet(place)
    held = blocks.sparkSession.read.schema(schema).parquet(place)

    def collected(told) -> np.ndarray:
        """The sum of a histogram over all tokens."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(BUCKETS * 2 * LEVELS)
            for batch in batches:
                x = np.stack([batch[k].to_numpy() for k in names])
                sums += told(x[:3], x[3:5], x[5])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.float64())], ["at", "h"])

        out = np.zeros(BUCKETS * 2 * LEVELS)
        for r in held.mapInArrow(count, "at long, h double").groupBy("at").agg(F.sum("h").alias("h")).collect():
            out[r["at"]] = r["h"]
        return out

    n, v = totals

    def unigrams(counts: np.ndarray, contexts: np.ndarray, times: np.ndarray) -> np.ndarray:
        return histogram(counts[0] / max(n, 1), np.full(len(times), 1 / max(v, 1)), (counts[0] > 0).astype(np.int64), times)

    hits = collected(unigrams)
    unknown, known = float(hits.reshape(BUCKETS, -1)[0].sum()), float(hits.reshape(BUCKETS, -1)[1].sum())
    whole = (known + 1) / (known + unknown + 2)  # one count of each kind more, so that neither is impossible
    own = float(em(hits)[1])
    first = (whole * own, whole * (1 - own), 1 - whole)
    shares: list[np.ndarray] = []
    for order in (0, 1):

        def pairs(counts: np.ndarray, contexts: np.ndarray, times: np.ndarray, order: int = order, shares: tuple = tuple(shares)) -> np.ndarray:
            lower = mixed(counts, contexts, totals, first, list(shares))
            return histogram(counts[order + 1] / np.maximum(contexts[order], 1), lower, bucket(contexts[order]), times)

        shares.append(em(collected(pairs)))
    return first, shares


def scored(docs: DataFrame, fold: int = 1, folds: int = 5) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents whose id falls in the fold are held out; all others train. Null and empty texts have one token, the end.
    Rows that repeat get equal results and count each in training. With no training documents every token is the
    unknown word, whose probability is then one. An empty table gives no rows. Only doc_id and text are read.
    """
    spark, doc_id = docs.sparkSession, F.col("doc_id")
    part = F.when(fold_of(doc_id, folds) == fold, OTHER).otherwise((F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).cast("int"))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _blocks(docs.select("doc_id", "text"), part, min(MOST_BLOCK, max(BLOCK, length // BLOCKS)))
    size = blocks.agg(F.sum("bytes") + F.sum(F.size("doc_ids"))).first()[0] or 0
    bits = min(62, size.bit_length() + SPARE)
    answers = _answers(blocks, min(MOST_BUCKETS, number(docs, size, SHARE)), bits)
    texts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()}
    v, n, early_v, early_n = (x or 0 for x in answers.where("block is null").agg(*map(F.sum, TOTALS)).first())
    answers = answers.where("block is not null")
    n_texts, early_texts = texts.get(ESTIMATE, 0) + texts.get(HELD, 0), texts.get(ESTIMATE, 0)
    if texts.get(HELD) and early_n:
        first, shares = _learn(blocks, answers, bits, (early_n, early_v), early_texts)
    else:  # nothing to learn weights from
        first, shares = (0.4, 0.4, 0.2) if n else (0.0, 0.0, 1.0), [np.append(0.0, np.full(BUCKETS - 1, 0.5))] * 2
    below = float(np.log10(n + 0.5 * (v + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    there = blocks.groupBy("block").cogroup(answers.select("block", "order", "bucket", "c").groupBy("block"))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, lengths = _counts(left, right, "c", bits)
        row = np.repeat(np.arange(len(lengths)), lengths)
        logs = np.log10(mixed(counts, _contexts(counts, lengths, n_texts), (n, v), first, shares))
        sums = [np.bincount(row, x, len(lengths)) for x in ((counts[0] > 0).astype(float), np.log10(counts[0] + 0.5) - below, logs)]
        ids = left["doc_ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = there.applyInArrow(judge, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (fold_of(doc_id, folds) == fold).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
