"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

The fingerprint of a text: its words (runs of other than ASCII white space, A-Z in lower case), all shingles of `width`
words with repeats, joined by single spaces (fewer words: the whole sequence), each hashed with XXH64 (seed 42); a bit
is 1 if it is set in more than half of the hashes. No words give fingerprint zero.

Links: fingerprints that differ in at most `radius` bits. Equal fingerprints are merged first. By the pigeonhole
principle two fingerprints within the radius agree on at least `agree` of `blocks` bit blocks, so each fingerprint
is sent once for every choice of `agree` blocks, keyed by those blocks' bits, and every pair within the radius meets
under some key. Under a key, fingerprints are compared exactly in tiles by numpy exclusive-or and bit counts; tile
pairs whose population counts differ by more than the radius are skipped, since they cannot be near. A key with more
fingerprints than a tile is dealt out as tile pairs (population count and a salt) over many tasks, so no key has to fit
one task. Each comparison sends on a spanning forest of its links, not the links, which leaves the components whole.

`one_of_each` finds shingle sets of Jaccard similarity `SIMILAR` and more, whose 64-bit fingerprints differ in too many bits for
bit blocks to route them (ten on average). It takes `WIDE` words of 64 fingerprint bits of five-word shingles, routes
documents by pairs of least shingle hashes (`BANDS` pairs; a pair of texts at 0.8 shares none with a chance below 0.01), compares them in
the same tiles under a radius that texts at 0.8 keep with a chance of 0.99, and sends on the forest of the nearest links. Each link is
then held against the exact similarity of the shingle sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_task, cut
from tessera.llm.components import components, met, with_least

RADIUS = 4
WIDTH = 4
BLOCKS = 6
AGREE = 2
#: Fingerprints in a tile.
TILE = 2048
#: Near copies that the pipeline drops: shingle width, similarity, words of fingerprint bits, their radius, bands, and how many
#: population counts go into one tile number.
NEAR_WIDTH, SIMILAR, WIDE, WIDE_RADIUS, BANDS, POPULATIONS = 5, 0.8, 8, 98, 8, 64
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, WIDE + 2 * BANDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's shingles with repeats (fewer words: the whole sequence); null and wordless texts have none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes; none for no hashes."""
    n, bits = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 255):  # as many ones as a byte can count
        bits += np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits((2 * bits > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text as an unsigned number; null counts as an empty text."""
    return majority(shingles(text, width))


def _spread(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = x * odd
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def sketch(text: str | None) -> tuple[bytes, list[int]]:
    """Fingerprint bits in WIDE words, and BANDS keys of two least shingle hashes each (signed); wordless texts share theirs."""
    own = shingles(text, NEAR_WIDTH)
    if not len(own):
        return bytes(8 * WIDE), [0] * BANDS
    wide = np.array([majority(_spread(own, odd)) for odd in _ODD[:WIDE]], np.uint64)
    least = np.array([_spread(own, odd).min() for odd in _ODD[WIDE:]], np.uint64)
    return wide.tobytes(), _spread(least[::2] ^ (least[1::2] >> np.uint64(1)), _ODD[0]).view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Columns doc_id and fp (the fingerprint as a signed long) for every row."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", simhash("text").alias("fp"))


def _masks(blocks: int, agree: int) -> list[int]:
    """For each choice of agreeing blocks the signed mask of their bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [int(np.uint64(sum(block[k] for k in some)).astype(np.int64)) for some in itertools.combinations(range(blocks), agree)]


def _labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least item of each item's component under links u-v."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning forest of the nearest links: in each round every component takes its nearest link to another one."""
    order = np.argsort(d, kind="stable")
    u, v, d = u[order], v[order], d[order]
    label, kept = np.arange(n), []
    while True:
        a, b = label[u], label[v]
        out = a != b
        u, v, d, a, b = u[out], v[out], d[out], a[out], b[out]
        if not len(u):
            break
        first, at = np.full(n, len(u)), np.arange(len(u))
        np.minimum.at(first, a, at)
        np.minimum.at(first, b, at)
        taken = np.unique(first[first < len(u)])
        kept.append((u[taken], v[taken], d[taken]))
        label = _labels(a[taken], b[taken], n)[label]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *(k[j] for k in kept)]).astype(np.int64) for j in range(3))


def _links(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the forest of the nearest links among fingerprints (rows of 64-bit words), compared tile by tile."""
    pops = np.bitwise_count(words).sum(1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    words, pops = np.ascontiguousarray(words[order].T), pops[order]
    n = len(pops)
    tiles = [(a, min(a + TILE, n)) for a in range(0, n, TILE)]
    found, size = [[np.empty(0, np.int64)] * 3], 0
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if pops[c] - pops[b - 1] > radius:
                break
            for k in range(a, b, 256):
                e = min(k + 256, b)
                apart = np.zeros((e - k, d - c), np.uint16)
                for w in words:
                    apart += np.bitwise_count(w[k:e, None] ^ w[None, c:d])
                u, v = np.nonzero(apart <= radius)
                keep = u + k < v + c
                u, v = u[keep], v[keep]
                found.append([u + k, v + c, apart[u, v].astype(np.int64)])
                size += len(u)
                if size > 2_000_000:
                    found = [_forest(*(np.concatenate([f[j] for f in found]) for j in range(3)), n)]
                    size = len(found[0][0])
    u, v, _ = _forest(*(np.concatenate([f[j] for f in found]) for j in range(3)), n)
    return order[u], order[v]


def _compared(sent: DataFrame, radius: int, populations: int = 1) -> DataFrame:
    """Edges (u, v) between rows that meet under a key (choice, bits) and are within the radius, spanning all such links.

    sent has node, pop (the population count), choice, bits, and words (bytes) unless the node is the fingerprint itself.
    A key with more rows than a tile is dealt as pairs of tiles, numbered by the population count divided by
    populations and a salt; numbers that are too far apart do not meet.
    """
    wide, reach = "words" in sent.columns, -(-radius // populations)
    sent = sent.withColumn("pop", F.floor(F.col("pop") / populations).cast("int"))
    sizes = sent.groupBy("choice", "bits", "pop").count()
    heavy = cut(
        sizes.groupBy("choice", "bits")
        .agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("count") / TILE).cast("int")))).alias("salts"))
        .where(F.col("n") > TILE)
        .drop("n")
    )

    def name(pop: Column, salt: Column) -> Column:
        return F.concat_ws(":", F.lpad(pop.cast("string"), 4, "0"), salt.cast("string"))

    here = name(F.col("pop"), F.pmod(F.xxhash64("node"), F.element_at("salts", F.col("pop"))))
    others = F.flatten(
        F.transform(
            F.filter(F.map_keys("salts"), lambda p: F.abs(p - F.col("pop")) <= reach),
            lambda p: F.transform(F.sequence(F.lit(0), F.element_at("salts", p) - 1), lambda s: name(p, s)),
        )
    )
    own = ["node", "words"] if wide else ["node"]
    dealt = (
        sent.join(heavy, ["choice", "bits"], "left")
        .withColumn("pairs", F.when(F.col("salts").isNull(), F.array(F.lit(""))).otherwise(F.transform(others, lambda o: F.concat_ws("|", F.least(o, here), F.greatest(o, here)))))
        .select(*own, "choice", "bits", F.explode("pairs").alias("pair"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is cut into runs that a batch may break, so the open one is carried on."""
        carried = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                batch = pa.Table.from_batches([batch])
                carried = batch if carried is None else pa.concat_tables([carried, batch])
            if carried is None or not len(carried):
                continue
            g = carried["g"].to_numpy()
            last = len(g) if batch is None else int(np.searchsorted(g, g[-1]))
            if not last:  # one group so far, which goes on
                continue
            nodes = carried["node"].to_numpy()[:last]
            words = np.frombuffer(b"".join(carried["words"].slice(0, last).to_pylist()), np.uint64).reshape(last, -1) if wide else nodes.view(np.uint64)[:, None]
            cuts = np.flatnonzero(np.diff(g[:last])) + 1
            starts, ends = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [last]]).astype(int)
            out_u, out_v = [], []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                some, at = np.unique(nodes[a:b], return_index=True)
                u, v = _links(words[a:b][at], radius)
                out_u.append(some[u])
                out_v.append(some[v])
            carried = carried.slice(last) if batch is not None else None
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

    sorted_rows = dealt.select(F.xxhash64("choice", "bits", "pair").alias("g"), *own).repartition(by_task(sent), "g").sortWithinPartitions("g")
    return sorted_rows.mapInArrow(compare, "u long, v long")


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, agree: int = AGREE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span every component under the radius."""
    if blocks - radius < agree:
        raise ValueError("two fingerprints within the radius need not agree on so many blocks")
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks, agree)])
    return _compared(distinct.select(F.col("fp").alias("node"), F.bit_count("fp").alias("pop"), F.posexplode(keys).alias("choice", "bits")), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Columns doc_id, fingerprint (16 lowercase hex digits) and component_id (the least doc_id reachable) for each row.

    Null texts count as empty; empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    each appear. A null doc_id gets a row and takes part in links, but is never a component_id unless all ids of its
    component are null. An empty table gives no rows. Other columns of docs are not read.
    """
    all_fps = cut(fingerprints(docs, width))
    heads = cut(all_fps.groupBy("fp").agg(F.min("doc_id").alias("head")))
    joined = components(links(heads.select("fp"), radius))
    of = heads.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = with_least(of, "component", "head", "component_id", by="fp").select("fp", "component_id")
    return met(all_fps, named, "fp", by="doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _texts(named: DataFrame) -> DataFrame:
    """One row for each doc_id and text: doc_id, node (the text's hash), text. Rows that repeat are merged where they are read."""
    return named.groupBy("doc_id", F.xxhash64("text").alias("node")).agg(F.min("text").alias("text"))


def _similar(edges: DataFrame, docs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The edges whose texts' shingle sets have at least this Jaccard similarity; wordless texts are equal to each other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t.as_py(), NEAR_WIDTH).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(own, pa.binary())], ["node", "own"])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= least * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(heads.select("node", "head"), "node")
    texts = _texts(docs).withColumnRenamed("doc_id", "head").join(nodes, ["head", "node"]).select("node", "text")
    sets = cut(texts.mapInArrow(read, "node long, own binary"))
    one = met(edges, sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u", by="v")
    both = met(one, sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v", by="u")
    return both.where(near("a", "b")).select("u", "v")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with the least doc_id of each group of near copies; all columns stay.

    A group is what links of Jaccard similarity `similar` (0.8 or more) between sets of five-word shingles join. Equal texts
    are one first. Of rows that repeat doc_id and text one stays, that of the least hash of all its columns, so
    recomputed tasks choose alike; a doc_id that stands for several texts is each of
    them. Wordless texts are one group. Rows with a null doc_id stay as they are, since no id can name them.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    first = named.groupBy(F.xxhash64("text").alias("node")).agg(F.min("doc_id").alias("head"))
    firsts = _texts(named).withColumnRenamed("doc_id", "head").join(first, ["head", "node"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(t.as_py()) for t in batch["text"]]
            pops = [int(np.bitwise_count(np.frombuffer(w, np.uint64)).sum()) for w, _ in own]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["head"], pa.array([w for w, _ in own], pa.binary()), pa.array(pops, pa.int32()), pa.array([k for _, k in own], pa.list_(pa.int64()))], ["node", "head", "words", "pop", "bands"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    heads = cut(firsts.select("node", "head", "text").mapInArrow(describe, f"node long, head {id_kind}, words binary, pop int, bands array<long>"))
    edges = cut(_compared(heads.select("node", "words", "pop", F.posexplode("bands").alias("choice", "bits")), WIDE_RADIUS, POPULATIONS).distinct())
    joined = components(_similar(edges, named, heads, similar))
    of = heads.select("node", "head").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = of.groupBy("component").agg(F.min(F.struct("head", "node")).alias("least")).select("least.head", "least.node")
    own = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    rows = docs.select(docs["doc_id"].alias("head"), F.xxhash64(docs["text"]).alias("node"), own.alias("own"), F.xxhash64(F.to_json(own)).alias("order"))
    unique = rows.where("head is not null").join(kept, ["head", "node"], "left_semi").groupBy("head", "node").agg(F.min_by("own", "order").alias("own"))
    return unique.select("own.*").union(docs.where("doc_id is null"))
