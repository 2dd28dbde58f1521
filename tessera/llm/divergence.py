"""Source divergence audit: how each source of a language differs from the language and from its other sources.

Terms are runs of ASCII letters and characters above 127, A-Z in lower case. A language keeps the terms that at least
`KEPT` of its documents (rows) hold. A group, a source within a language, gives each kept term

    p = 1 + floor(10**9 * (count + 5) / (N + 5 V))

with its count there, the group's sum N of counts and V kept terms; a language gives them the same way. Part `pair` ranks a
group's other sources by the sum of |p - q| over all kept terms, part `term` the terms of which the group has most
above the language's share.

How it runs. Documents are written once as blocks of some `BLOCK` bytes of terms. The first pass counts documents by term within
each block and sends them, packed, to the terms' buckets (`buckets.py`); sums over blocks give exact document frequencies,
and each block is told which of its terms are kept, so a block's vocabulary is bounded by the block and never by the corpus.
In the second pass these make one automaton a language, each term padded with delimiters, and every occurrence in the
block's texts is counted again. Counts meet in the same buckets as sparse postings (language, source, term, count). Pairs are
summed in tiles of sources and cells of terms, in which only terms with a posting are looked at; what all absent terms add
follows from V. No key has to fit one task: a word or a source that a third of all rows hold is one entry of a block's counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.buckets import met, number, of, one_by_one
from tessera.llm.common import cut, new_folder

#: Documents of a language that have to hold a term.
KEPT = 30
#: Ranks of part `term`.
TOP = 50
#: Bytes of terms in a block, unless one document has more.
BLOCK = 16 << 20
#: Bytes of terms whose counts meet in one bucket, about.
SHARE = 16 << 20
#: Sources and terms that one task compares at a time, about.
TILE, CELL = 128, 4096
#: What each byte of a text becomes: letters in lower case, bytes of characters above 127, spaces for all others.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_FOLD).split()


def _blocks(docs: DataFrame) -> DataFrame:
    """All documents as a table in the shared folder: block, lang, source, size, texts; nulls are empty.

    A row has a group's documents in a block: their terms with a space on either side, a line each, compressed.
    """
    names = ["block", "lang", "source", "size", "texts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held = TaskContext.get().partitionId() << 32, 0, {}

        def told() -> pa.RecordBatch:
            texts = [b"\n".join(x) for x in held.values()]
            groups = [pa.array([g[k] for g in held], pa.string()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.int64()), *groups, pa.array(map(len, texts), pa.int64()), pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())], names)

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source")), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                line = b" ".join([b"", *terms(text), b""])
                held.setdefault((lang or "", source or ""), []).append(line)
                size += len(line)
                if size >= BLOCK:
                    yield told()
                    block, size, held = block + 1, 0, {}
        if held:
            yield told()

    place, schema = new_folder(docs.sparkSession, "divergence-blocks"), "block long, lang string, source string, size long, texts binary"
    named = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    named.mapInArrow(deal, schema).write.parquet(place)
    return docs.sparkSession.read.schema(schema).parquet(place)


def _texts(size: int, texts: bytes) -> bytes:
    return pa.decompress(texts, decompressed_size=size, codec="zstd", asbytes=True)


def _packed(groups: dict, buckets: int) -> list[tuple[int, list[str], list[tuple]]]:
    """Counts of terms by group (a tuple of names), by bucket: the bucket, then lists of each name, of terms (spaces between) and of counts."""
    found: dict[int, list] = {}
    for group, counts in groups.items():
        words = sorted(counts)
        home = of(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), buckets)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=False):
            own = [words[k] for k in order[a:b]]
            found.setdefault(int(home[order[a]]), []).append((*group, b" ".join(own), np.array([counts[w] for w in own], "<i8").tobytes()))
    return [(bucket, *map(list, zip(*rows, strict=True))) for bucket, rows in found.items()]


def _sums(rows: pa.Table, *names: str) -> dict[tuple, Counter]:
    """A bucket's counts of terms over all blocks, by group."""
    sums: dict[tuple, Counter] = {}
    for *group, words, counts in zip(*(chain.from_iterable(rows[c].to_pylist()) for c in (*names, "terms", "counts")), strict=True):
        sums.setdefault(tuple(group), Counter()).update(dict(zip(words.split(), np.frombuffer(counts, "<i8").tolist(), strict=True)))
    return sums


_TEXTS, _BYTES = pa.list_(pa.string()), pa.list_(pa.binary())


def _kept(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block is told of its terms: block, langs and, for each, the terms that enough documents hold."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("langs", _TEXTS), ("terms", _BYTES), ("counts", _BYTES)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in dict.fromkeys(batch["block"].to_pylist()):  # a block's rows may be in two batches or tasks: sums stay right
                found: dict[tuple, Counter] = {}
                for r in batch.filter(pc.equal(batch["block"], block)).to_pylist():
                    own = found.setdefault((r["lang"],), Counter())
                    for line in _texts(r["size"], r["texts"]).split(b"\n"):
                        own.update(set(line.split()))
                yield _told([(block, *row) for row in _packed(found, buckets)], schema)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            kept = {lang: {w for w, n in found.items() if n >= KEPT} for (lang,), found in _sums(rows, "langs").items()}
            answers = []
            for block, langs, words in zip(*(rows[c].to_pylist() for c in ("block", "langs", "terms")), strict=True):
                own = [(lang, b" ".join(kept[lang].intersection(w.split()))) for lang, w in zip(langs, words, strict=True)]
                answers.append((block, *map(list, zip(*own, strict=True))))
            yield _told(answers, pa.schema([schema.field(c) for c in ("block", "langs", "terms")]))

    sent = blocks.mapInArrow(send, "block long, bucket long, langs array<string>, terms array<binary>, counts array<binary>")
    return met(sent, buckets).mapInArrow(add_up, "block long, langs array<string>, terms array<binary>")


def _told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def automaton(kept: Iterable[bytes]) -> ahocorasick.Automaton:
    """An automaton that finds the terms, each between two delimiters, in text read byte by byte as Latin-1."""
    out = ahocorasick.Automaton()
    for term in kept:
        out.add_word(f" {term.decode('latin-1')} ", term)
    out.make_automaton()
    return out


def _postings(blocks: DataFrame, kept: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of kept terms by lang, source and term, recounted block by block."""
    schema = pa.schema([("bucket", pa.int64()), ("langs", _TEXTS), ("sources", _TEXTS), ("terms", _BYTES), ("counts", _BYTES)])

    def recount(left: pa.Table, right: pa.Table) -> pa.Table:
        words: dict[str, set] = {}
        for lang, found in zip(*(chain.from_iterable(right[c].to_pylist()) for c in ("langs", "terms")), strict=True):
            words.setdefault(lang, set()).update(found.split())
        sums: dict[tuple, Counter] = {}
        for lang, own in groupby(sorted(zip(*(left[c].to_pylist() for c in ("lang", "source", "size", "texts")), strict=True)), itemgetter(0)):
            machine = automaton(words.pop(lang, ()))
            for _, source, size, packed in own if len(machine) else ():
                sums.setdefault((lang, source), Counter()).update(map(itemgetter(1), machine.iter(_texts(size, packed).decode("latin-1"))))
        return pa.Table.from_batches([_told(_packed(sums, buckets), schema)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            for group, found in _sums(rows, "langs", "sources").items():
                yield _told([(*group, w, n) for w, n in found.items()], pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())]))

    found = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(recount, "bucket long, langs array<string>, sources array<string>, terms array<binary>, counts array<binary>")
    return met(found, buckets).mapInArrow(add_up, "lang string, source string, term binary, n long")


def _share(n: Column, total: Column, v: Column) -> Column:
    """p of a count; zero where the language keeps no term."""
    whole = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (n + 5), total + 5 * v)
    return F.when(v > 0, 1 + whole).otherwise(F.lit(0)).cast("long")


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the cell's terms of |p - q| less the same for terms that are absent, for each pair of sources of two tiles."""
    one, other = key[1], key[2]
    own = rows[rows["term"].isna()].sort_values("source")
    names, none, tile = own["source"].to_numpy(), own["p"].to_numpy(), own["tile"].to_numpy()
    here, there = np.flatnonzero(tile == one), np.flatnonzero(tile == other)
    had = rows[rows["term"].notna()]
    of, distinct = pd.factorize(had["term"])
    at, p = np.searchsorted(names, had["source"].to_numpy()) if len(had) else np.empty(0, np.int64), had["p"].to_numpy()
    sums, order = np.zeros((len(here), len(there)), np.int64), np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(0, len(distinct) + 256, 256))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows_of, width = order[a:b], min(256, len(distinct) - 256 * k)
        table = np.repeat(none[:, None], width, axis=1)
        table[at[rows_of], of[rows_of] - 256 * k] = p[rows_of]
        for x, i in enumerate(here):
            sums[x] += np.abs(table[there] - table[i]).sum(axis=1)
    sums -= len(distinct) * np.abs(none[there][None, :] - none[here][:, None])
    i, j = (a.ravel() for a in np.meshgrid(here, there, indexing="ij"))
    wanted = names[i] < names[j] if one == other else np.ones(len(i), bool)
    return pd.DataFrame({"lang": key[0], "a": names[i[wanted]], "b": names[j[wanted]], "s": sums.ravel()[wanted]})


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Every two sources of a language with the sum of |p - q|: lang, source, item, value, both ways."""
    most = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("v").alias("v")).agg(F.max("s").alias("s"), F.max("v").alias("v")).first()
    tiles, cells = -(-(most["s"] or 1) // TILE), -(-max(most["v"] or 0, 1) // CELL)
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda k: F.struct(F.least(k, F.col("tile")).alias("one"), F.greatest(k, F.col("tile")).alias("other"))))
    base = groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    rows = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int").alias("cell")).unionByName(base)
    met = rows.withColumn("tile", tile).withColumn("m", meets).select("lang", "m.one", "m.other", "cell", "tile", "source", "term", "p")
    parts = met.groupBy("lang", "one", "other", "cell").applyInPandas(_tile, "lang string, a string, b string, s long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("s").alias("s"))
    ends = groups.select("lang", "source", "p0", "v")
    known = sums.join(ends.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "v"), ["lang", "a"]).join(ends.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb")), ["lang", "b"])
    whole = known.withColumn("value", F.col("s") + F.col("v") * F.abs(F.col("pa") - F.col("pb")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each source of each language of the table.

    Null texts, languages and sources are empty ones, and a group like any other. Rows that repeat are documents of their own.
    Ties in value go by item in the order of UTF-8. A language without kept terms has pairs of value 0 and no terms; one with
    a single source has no pairs. An empty table gives no rows. Only text, lang and source are read; other columns may
    have any name.
    """
    blocks = _blocks(docs)
    buckets = number(blocks, blocks.agg(F.sum("size")).first()[0] or 0, SHARE)
    postings = cut(_postings(blocks, _kept(blocks, buckets), buckets))
    by_term = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = by_term.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    seen = blocks.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    own, v = F.coalesce("own", F.lit(0)), F.coalesce("v", F.lit(0))
    groups = cut(seen.select("lang", "source", own.alias("own"), v.alias("v"), _share(F.lit(0).cast("long"), own, v).alias("p0")))
    shares = postings.join(groups.drop("p0"), ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("own"), F.col("v")).alias("p"))
    common = by_term.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    more = shares.join(common, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = more.withColumn("rank", ranked).where(F.col("rank") <= TOP)
    pairs = _pairs(groups, shares).withColumn("rank", ranked)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
met AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM met GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counted AS (SELECT lang, source, term, count(*) AS n FROM met JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER own AS total, count(*) OVER own AS v
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  WINDOW own AS (PARTITION BY g.lang, g.source)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM dense),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
