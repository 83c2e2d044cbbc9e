"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on words, word beginnings and inner character runs learns from confirmed toxic documents and
unlabelled ones. The risk of the unlabelled ones as negatives is corrected by the class prior's share of positives among
them; where that estimate turns negative, the step goes the other way, so that the model does not fit what it cannot know.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

LETTERS = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """A word's features: itself, its beginnings and its inner runs of five letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, min(len(word), 9))), *(word[i : i + 5] for i in range(1, len(word) - 4))]


def distinct_words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def nnpu(x_pos: np.ndarray, x_any: np.ndarray, prior: float, rounds: int = 1200, batch: int = 1024, rate: float = 0.05, decay: float = 1e-4, slack: float = 0.01, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss, by Adam."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x_pos.shape[1] + 1)
    w[-1] = -1.0
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for i in range(1, rounds + 1):
        p, u = x_pos[rng.integers(0, len(x_pos), batch)], x_any[rng.integers(0, len(x_any), batch)]
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = sig(zp), sig(zu)
        # the sigmoid loss: bounded, so that a few sure documents don't turn the estimate of the negative risk
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        gp, gu = (-2 * prior * dp, du) if negative >= -slack else (prior * dp, -du)
        grad = np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())
        grad[:-1] += decay * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= rate * (1 - i / (rounds + 1)) * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    """Weights by feature; words that carry none are remembered as such, up to a bound."""

    def __init__(self, weight: dict[str, float], bias: float, most_words: int = 300_000) -> None:
        self.weight, self.bias, self.most = weight, bias, most_words
        self.known: dict[str, tuple[str, ...]] = {}

    def features(self, words: set[str]) -> set[str]:
        found: set[str] = set()
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) >= self.most:
                    self.known = {}
                own = self.known[w] = tuple(f for f in parts(w) if f in self.weight)
            if own:
                found.update(own)
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weight[f] for f in sorted(self.features(distinct_words(text))))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, most: int = 2000) -> Model:
    """Chooses the features that toxic documents have far more often than others, then learns their weights."""
    in_pos: Counter = Counter()
    for words in positive:
        in_pos.update({f for w in words for f in parts(w)})
    a, b, least = len(positive) + 1, len(unlabelled) + 1, max(3, 0.015 * len(positive))
    # only these can be chosen; a word's share of them is found once
    some = Model(dict.fromkeys((f for f, n in in_pos.items() if n >= least), 0.0), 0.0)
    in_any: Counter = Counter()
    for words in unlabelled:
        in_any.update(some.features(words))
    gain = {}
    for f in some.weight:
        n = in_pos[f]
        p, q = (n + 0.5) / a, (in_any[f] + 0.5) / b
        if p > 2.5 * q and (p - q) ** 2 * a > 16 * q * (1 - q):
            gain[f] = n * math.log(p / q)
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:most]
    place, some = {f: i for i, f in enumerate(chosen)}, Model(gain, 0.0)

    def rows(docs: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(docs), len(chosen)), np.float32)
        for r, words in enumerate(docs):
            x[r, [place[f] for f in some.features(words) if f in place]] = 1
        return x

    w, bias = nnpu(rows(positive), rows(unlabelled), prior)
    return Model({f: float(w[i]) for f, i in place.items()}, bias)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 2500, most_unlabelled: int = 5000) -> Model | None:
    """Fits on a bounded sample chosen by a hash: about ``most_positive`` toxic and ``most_unlabelled`` other documents.

    Labels count only where crc32 of the id is not 0 modulo 5; the prior is the toxic share of those labelled rows.
    None if there is no toxic one or no text.
    """
    marks = labels.where("doc_id is not null and toxic is not null").where(crc_of_id() % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = marks.where("toxic = 1").where(place < most_positive / toxic).select("doc_id", F.lit(1).alias("confirmed"))
    rows = docs.where("doc_id is not null and text is not null").where(crc_of_id() % 5 != 0).select("doc_id", "text")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "confirmed"]].assign(words=[" ".join(sorted(distinct_words(x))) for x in pdf["text"]])

    share = most_unlabelled / max(1, rows.count())
    confirmed = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "confirmed")  # about most_positive ids
    others = rows.where(F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 20)) / float(1 << 20) < share).select("doc_id", "text", F.lit(0).alias("confirmed"))
    got = sorted((r.doc_id, r.confirmed, r.words) for r in confirmed.unionByName(others).mapInPandas(words, "doc_id long, confirmed int, words string").collect())
    positive, unlabelled = ([set(w.split()) for _, c, w in got if c == k] for k in (1, 0))
    return fit(positive, unlabelled, min(0.9, max(0.001, toxic / n))) if positive and unlabelled else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) for each row. Null and empty texts get the score of a text without any feature.

    Without a model (no confirmed toxic document) every score is 0. Texts of any length are read whole. Repeated rows each
    get their row. Other columns, whatever their names, are ignored. No rows: none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.array([model.score(x) if model else 0.0 for x in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")
