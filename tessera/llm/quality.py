"""Document quality without trusted labels: overlapping heuristic labellers, their accuracies by expectation-maximisation,
and a hashed linear scorer that learns from the posterior labels.

`LABELLERS` vote junk, clean or nothing on the shape of a whole text. The votes of all documents are counted by
pattern (3 to the number of labellers patterns at most), and a two-class latent model with each labeller's vote
probabilities is fitted to those counts. At most `FITTED` documents then train a logistic scorer of hashed features
(character-class trigrams and binned facts) on the posterior of their pattern; the scorer judges every document.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the scorer is fitted on: the bound of the fit.
FITTED = 8_000
DIMENSIONS = 1 << 13
KEEP_FROM = 0.5
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "*", "#$%&", "\"'()[]{}<>`", "-_/\\~^", "@:;=+")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _some in enumerate(_CLASSES):
    _CLASS[list(_some.encode())] = _k
_CLASS[128:] = 0
_TRIGRAM = (np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64)


def facts(data: bytes) -> dict[str, float]:
    """Plain measures of a text's UTF-8 bytes."""
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 1)
    letters, n = int(counts[0] + counts[1]), max(1, len(words))
    return {
        "words": len(words),
        "symbols": float(counts[10] + counts[11]) / n,
        "bars": float(counts[9]) / n,
        "shouts": float(counts[7]) / n,
        "capitals": float(counts[1]) / max(1, letters),
        "stops": float(counts[5] + counts[8]) / n,
        "letters": letters / max(1, len(data)),
        "repeats": sum(map(operator.eq, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "n_lines": len(lines),
    }


#: Each sees the facts and votes -1 (junk), 1 (clean) or 0 (nothing).
LABELLERS = {
    "symbols": lambda f: -(f["symbols"] > 0.3),
    "bars": lambda f: -(f["bars"] > 0.1),
    "shouts": lambda f: -(f["shouts"] > 0.2),
    "capitals": lambda f: -(f["capitals"] > 0.3),
    "repeats": lambda f: -(f["words"] >= 5 and f["repeats"] > (0.15 if f["words"] >= 20 else 0.4)),
    "variety": lambda f: -(f["words"] >= 30 and f["variety"] < 0.15),
    "few_letters": lambda f: -(f["words"] >= 30 and f["letters"] < 0.6),
    "same_lines": lambda f: -(f["n_lines"] >= 5 and f["lines"] < 0.4),
    "prose": lambda f: int(0.7 < f["letters"] and f["capitals"] < 0.25 and 0.02 < f["stops"] < 0.6 and f["bars"] + f["symbols"] + f["shouts"] < 0.05),
    "fresh": lambda f: int(f["repeats"] < 0.05 and f["variety"] > 0.2 and f["capitals"] < 0.25),
    "plain": lambda f: int(f["symbols"] < 0.1 and f["bars"] < 0.03 and f["shouts"] < 0.1 and f["repeats"] < 0.1),
}


def votes(f: dict[str, float]) -> str:
    """The labellers' votes as one character each: '-', '+' or '0'."""
    return "".join("0+-"[int(label(f))] for label in LABELLERS.values())


def posteriors(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """The probability that a document with each vote pattern is clean, by expectation-maximisation over counts.

    Starts from the balance of votes; probabilities are smoothed with one pseudo-count a vote.
    """
    if not patterns:
        return {}
    kinds = np.array([["0+-".index(c) for c in p] for p, _ in patterns])
    n = np.array([float(k) for _, k in patterns])
    balance = (kinds == 1).sum(1) - 2.0 * (kinds == 2).sum(1)
    clean = 1 / (1 + np.exp(-balance))
    onehot = np.eye(3)[kinds]
    for _ in range(rounds):
        share = (n * clean).sum() / n.sum()
        scores = []
        for weight, part in ((n * clean, share), (n * (1 - clean), 1 - share)):
            chance = (onehot * weight[:, None, None]).sum(0) + 1
            chance /= chance.sum(1, keepdims=True)
            scores.append((onehot * np.log(chance)[None]).sum((1, 2)) + np.log(max(part, 1e-9)))
        new = 1 / (1 + np.exp(np.clip(scores[1] - scores[0], -50, 50)))
        if np.abs(new - clean).max() < 1e-9:
            break
        clean = new
    return {p: float(c) for (p, _), c in zip(patterns, clean, strict=True)}


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: places and values, of length one together."""
    c = _CLASS[np.frombuffer(data, np.uint8)].astype(np.int16)
    grams = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=4096) if len(c) > 2 else np.zeros(4096, np.int64)
    at = np.flatnonzero(grams)
    f = facts(data)
    extra = [zlib.crc32(f"{k}={min(20, int(20 * f[k]))}".encode()) % DIMENSIONS for k in ("symbols", "bars", "shouts", "capitals", "repeats", "variety", "lines", "letters")]
    places = np.concatenate([_TRIGRAM[at], extra])
    values = np.concatenate([np.sqrt(grams[at] / max(1, grams.sum())), np.full(len(extra), 0.5)])
    return places, values / np.sqrt((values**2).sum())


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    intercept: float

    def __call__(self, text: str | None) -> float:
        places, values = features((text or "").encode("utf-8", "surrogatepass"))
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[places] @ values, -30, 30))))


def fit(rows: list[tuple[list[int], list[float], float]], rounds: int = 250) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient descent; no rows give a scorer that says one half."""
    weights, intercept = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return Scorer(weights, intercept)
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    last, ahead, bias = weights, weights, 0.0
    last_bias, n = 0.0, len(rows)
    for turn in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[at] * value, n) + bias, -30, 30)))
        gradient = np.bincount(at, (p - y)[row] * value, DIMENSIONS) / n + 1e-6 * ahead
        new, new_bias = ahead - 4.0 * gradient, bias - 2.0 * float((p - y).mean())
        pull = turn / (turn + 3)
        ahead, bias = new + pull * (new - last), new_bias + pull * (new_bias - last_bias)
        last, last_bias = new, new_bias
    return Scorer(last, last_bias)


def learn(docs: DataFrame, bound: int = FITTED) -> Scorer:
    """Votes of all documents, their posterior labels, and a scorer fitted on at most bound documents, the first by a hash of id and text."""

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(facts((t or "").encode("utf-8", "surrogatepass"))) for t in texts])

    found = [(r["p"], r["count"]) for r in docs.select(vote("text").alias("p")).groupBy("p").count().orderBy("p").collect()]
    clean, n = posteriors(found), sum(k for _, k in found)
    share = 1_000_000 if not n else min(1_000_000, int(1_000_000 * 1.05 * bound / n) + 1)
    order = F.xxhash64("doc_id", "text")
    sample = docs.select(order.alias("at"), "text").where(F.pmod("at", F.lit(1_000_000)) < share)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            own = [features(d) for d in data]
            yield pd.DataFrame({"at": batch["at"], "places": [p for p, _ in own], "amounts": [v for _, v in own], "clean": [clean.get(votes(facts(d)), 0.5) for d in data]})

    # Rows of one hash are copies of each other, so the first in this order are the same ones however the rows are dealt.
    rows = sample.mapInPandas(described, "at long, places array<int>, amounts array<float>, clean double").orderBy("at").limit(bound).collect()
    return fit([(r["places"], r["amounts"], r["clean"]) for r in rows])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: cleaner) and keep for every row.

    Null and empty texts have no features but the binned facts and are judged by them. Rows that repeat get equal
    scores. An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    scorer = learn(docs.select("doc_id", "text"))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer(t) for t in texts], dtype=float)

    out = docs.select("doc_id", judge("text").alias("score"))
    return out.withColumn("keep", F.col("score") >= KEEP_FROM)


def without_junk(docs: DataFrame) -> DataFrame:
    """The rows that the scorer keeps, with their columns."""
    scorer = learn(docs.select("doc_id", "text"))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer(t) for t in texts], dtype=float)

    return docs.where(judge(F.col("text")) >= KEEP_FROM)
