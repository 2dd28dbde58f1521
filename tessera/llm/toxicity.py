"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning takes at most `LABELLED` labelled documents, of equal ones one (the bound of the fit). Tokens are a text's lower-cased runs of
letters; a token's weight is its log-odds between toxic and other documents under a Dirichlet prior in proportion to the
token's overall frequency, kept where it is at least `LEAST_Z` standard errors above zero. Openings of four bytes are weighed alike and stand in for tokens that are not known. All other tokens cost
`DRIFT`. A token's toxic documents count no further than the effective number of its neighbours there, so copies of one
passage teach no words. A linear-time scan (Ruzzo and Tompa's) finds all maximal scoring segments of a text; a segment of score S in
n tokens is as rare as K n exp(-lambda S) by extreme-value theory, lambda from the token scores of documents that are not
toxic and K from those documents. What the significant segments of a text add up to, in natural logarithms of
rarity, goes through a logistic curve fitted on the same labelled documents, from a histogram of at most `STEPS` steps in
its logarithm. The driver sees the words that are kept, some sums and that histogram, never a document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold_of

LABELLED = 40_000
LEAST_Z = 3.0
DRIFT = 0.25
MOST = 6.0
PRIOR = 0.05
OPENING = 4
#: Steps of a sixty-fourth in the logarithm of evidence that are told apart.
STEPS = 2048
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters in lower case, as UTF-8; null gives none."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def maximal_segments(scored: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, behind last token, score), in one pass.

    scored has the tokens of positive score with their places, ascending; every token between costs drift.
    """
    found: list[list] = []  # first, behind last, sum left of it, sum up to its end
    total, behind = 0.0, 0
    for at, score in scored:
        total -= drift * (at - behind)
        new = [at, at + 1, total, total + score]
        total, behind = total + score, at + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k -= 1
            if k < 0 or found[k][3] >= new[3]:
                found.append(new)
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            del found[k:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass(frozen=True)
class Model:
    """Token weights, extreme-value parameters and the logistic curve; weights are empty where nothing was learnt."""

    weights: dict[bytes, float]
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float] = (-30.0, 0.0)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many tokens a text has, and its maximal segments."""
        words, weights = tokens(text), self.weights
        openings = self._openings()
        hits = []
        for k, w in enumerate(words):
            if w[:OPENING] in openings:
                score = weights.get(w)
                if score is None and len(w) > OPENING:
                    score = weights.get(w[:OPENING] + b"*")
                if score is not None:
                    hits.append((k, score))
        return len(words), maximal_segments(hits)

    def _openings(self) -> set[bytes]:
        known = self.__dict__.get("_known")
        if known is None:
            known = {w[:OPENING] for w in self.weights}
            object.__setattr__(self, "_known", known)
        return known

    def evidence(self, n: int, scores: list[float]) -> float:
        """Sum of -ln(expected number of such segments by chance) over the significant segments."""
        least = np.log(max(self.scale * max(n, 1), 1e-12))
        return float(sum(max(0.0, self.rate * s - least) for s in scores))

    def probability(self, evidence):
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, held_out: int, bound: int) -> DataFrame:
    """At most bound labelled documents outside the held-out fold, those of the least hashes of id and text; text and toxic.

    Rows of one id and text are one document, however many they are; an id may stand for several texts, all under its
    label. First as many ids are taken by a hash, then, of their rows, those up to the hash that the bound allows.
    """
    named = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = named.where(fold_of(F.col("doc_id")) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    ids = some.select(F.col("doc_id").alias("_labelled"), F.col("toxic").alias("_toxic"))
    near = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled")).select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("_toxic").alias("toxic"))
    last = near.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return near.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min(F.struct("text", "toxic")).alias("d")).select("d.*")


def _counted(labelled: DataFrame) -> DataFrame:
    """In how many toxic and other documents each token and opening stands; under the empty key, all tokens' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part, own = batch.slice(start, 2000), (Counter(), Counter())
                for text, toxic in zip(part["text"], part["toxic"].to_pylist(), strict=True):
                    words = tokens(text.as_py())
                    own[toxic > 0][b""] += len(words)
                    distinct = set(words)
                    own[toxic > 0].update(distinct)
                    own[toxic > 0].update({w[:OPENING] + b"*" for w in distinct if len(w) > OPENING})
                keys = list(own[0].keys() | own[1].keys())
                yield pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.binary()), "toxic": pa.array([own[1][k] for k in keys], pa.int64()), "other": pa.array([own[0][k] for k in keys], pa.int64())})

    return labelled.mapInArrow(count, "token binary, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _contexts(labelled: DataFrame) -> DataFrame:
    """For tokens of toxic documents the effective number of their left and right neighbours, the lesser of both.

    Copies of one passage repeat a token's neighbours and so count for little more than one, however many they are.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                seen: Counter = Counter()
                for text in batch["text"].slice(start, 500):
                    words = tokens(text.as_py())
                    for side, near in ((0, [b"", *words[:-1]]), (1, [*words[1:], b""])):
                        seen.update((w, side, n) for w, n in zip(words, near, strict=False))
                        seen.update((w[:OPENING] + b"*", side, n) for w, n in zip(words, near, strict=False) if len(w) > OPENING)
                keys = list(seen)
                yield pa.RecordBatch.from_pydict({"token": pa.array([k[0] for k in keys], pa.binary()), "side": pa.array([k[1] for k in keys], pa.int32()), "near": pa.array([zlib.crc32(k[2]) for k in keys], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = labelled.where("toxic > 0").mapInArrow(pairs, "token binary, side int, near long, n long").groupBy("token", "side", "near").agg(F.sum("n").cast("double").alias("n"))
    sides = rows.groupBy("token", "side").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("e"))
    return sides.groupBy("token").agg(F.min("e").alias("contexts"))


def _rate(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of the moment equation: scores with these shares of all tokens, -drift for the rest."""
    low, high = 1e-6, 50.0
    rest = max(0.0, 1 - shares.sum())
    for _ in range(100):
        mid = (low + high) / 2
        if (shares * np.exp(mid * scores)).sum() + rest * np.exp(-mid * drift) > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a little ridge; each class weighs as it is."""
    beta, rows = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 0, bound: int = LABELLED) -> Model:
    """A model from labelled documents outside the held-out fold; no toxic label or no other one gives one without weights."""
    labelled = cut(_labelled(docs, labels, held_out, bound))
    counts = _counted(labelled)
    whole = {bool(r["star"]): r for r in counts.where("token <> X''").groupBy(F.endswith("token", F.lit(b"*")).alias("star")).agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).collect()}
    if False not in whole or not whole[False]["a"] or not whole[False]["b"]:
        return Model({})
    star = F.endswith("token", F.lit(b"*"))

    def total(name: str):
        own = {k: float(whole[k][name]) if k in whole else 1.0 for k in (True, False)}
        return F.when(star, F.lit(own[True])).otherwise(F.lit(own[False]))

    a_all, b_all, a, b = total("a"), total("b"), F.least(F.col("toxic").cast("double"), F.col("contexts")), F.col("other")
    prior_a, prior_b = PRIOR * a_all * (a + b) / (a_all + b_all), PRIOR * b_all * (a + b) / (a_all + b_all)
    odds = F.log((a + prior_a) / (a_all * (1 + PRIOR))) - F.log((b + prior_b) / (b_all * (1 + PRIOR)))
    error = F.sqrt(1 / (a + prior_a) + 1 / (b + prior_b))
    weighed = counts.where("token <> X'' and toxic > 0").join(_contexts(labelled), "token").select("token", "other", odds.alias("odds"), (odds / error).alias("z"))
    best = weighed.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= 1)).orderBy(F.desc("z"), "token").collect()  # words of the labelled documents alone
    if not best:
        return Model({})
    weights = {bytes(r["token"]): min(MOST, r["odds"]) for r in best}
    n_other = max(1, counts.where("token = X''").first()["other"])
    scores, shares = np.array([min(MOST, r["odds"]) for r in best]), np.array([r["other"] + 0.05 for r in best]) / n_other
    rate = _rate(scores, shares / max(1.0, 2 * shares.sum()), DRIFT)
    raw = Model(weights)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [raw.segments(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in own], "scores": [[s for *_, s in segments] for _, segments in own]})

    seen = cut(labelled.mapInPandas(found, "toxic int, n long, scores array<double>"))
    x0 = float(np.median(scores))
    null = seen.where("toxic <= 0").agg(F.count_if(F.coalesce(F.array_max("scores"), F.lit(0.0)) >= x0).alias("high"), F.sum("n").alias("n")).first()
    scale = (null["high"] + 1) / max(1e-9, (null["n"] or 0) * np.exp(-rate * x0))
    fitted = Model(weights, rate, float(min(scale, 1.0)))

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.log1p([fitted.evidence(n, s) for n, s in zip(batch["n"], batch["scores"], strict=True)])
            yield pd.DataFrame({"toxic": batch["toxic"] > 0, "step": np.minimum(np.rint(64 * own), STEPS - 1).astype(np.int64)})

    steps = seen.mapInPandas(evidence, "toxic boolean, step long").groupBy("toxic", "step").count().orderBy("toxic", "step").collect()
    curve = _logistic(*(np.array([x[k] for x in ((r["step"] / 64, float(r["toxic"]), float(r["count"])) for r in steps)]) for k in range(3)))
    return Model(weights, rate, fitted.scale, curve)


def judged(text: Column, model: Model) -> Column:
    """A struct of toxicity (0 to 1) and passages (first token, behind last token, score of each significant segment)."""

    @F.pandas_udf("struct<toxicity: double, passages: array<struct<first: int, behind: int, score: double>>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out, evidence = [], []
        for text in texts:
            n, segments = model.segments(text)
            kept = [s for s in segments if model.evidence(n, [s[2]]) > 0]
            out.append([{"first": a, "behind": b, "score": s} for a, b, s in kept])
            evidence.append(model.evidence(n, [s for *_, s in segments]))
        return pd.DataFrame({"toxicity": model.probability(np.array(evidence, float)), "passages": out})

    return judge(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns toxicity and passages, in place of columns of these names."""
    names = [c for c in docs.columns if c not in ("toxicity", "passages")]
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("own"), judged(docs["text"], model).alias("judged"))
    return found.select("own.*", "judged.*")


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null and empty texts have no segments and get the curve's start; rows that repeat get equal scores; a null doc_id
    counts as the text 'null' in the fold. Labels that disagree count as toxic. Without labels of both kinds all
    scores are near zero. doc_id has any type. Of docs only doc_id and text are read, so other columns may have any name.
    """
    narrow = docs.select("doc_id", "text")
    out = scored(narrow, learn(narrow, labels, held_out))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == held_out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with their columns."""
    model = learn(docs.select("doc_id", "text"), labels)
    return docs.where(judged(docs["text"], model)["toxicity"] < 0.5)
