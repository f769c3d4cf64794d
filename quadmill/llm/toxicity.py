"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled ones."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Scratch

#: Texts that the weights are fitted on, about: confirmed toxic ones, and unlabelled ones. Counting and scoring read all texts whole.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
BITS = 18
#: A feature is used if it stands in MIN_TEXTS toxic texts and that is MIN_Z standard deviations above the unlabelled rate.
MIN_TEXTS, MIN_Z = 4, 5.0
STEPS, RATE, L2 = 300, 0.05, 5e-4
#: Share of toxic texts where no labels tell it.
PRIOR = 0.1
MAX_PRIOR = 0.4
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a worker remembers.
_REMEMBER = 50_000


@functools.lru_cache(1 << 14)
def _beginning(letters: str) -> int:
    return zlib.crc32(b"%d" % len(letters) + letters.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first 4 and 6 letters, which carry over to other endings."""
    whole = zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    n = len(word)
    if n > 6:
        return whole, _beginning(word[:4]), _beginning(word[:6])
    return (whole, _beginning(word[:4])) if n > 4 else (whole,)


def text_features(text: str | None, remembered: dict, wanted: frozenset | None = None) -> set[int]:
    """The features of a text's words, each once; of `wanted` only, if given."""
    out: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        f = remembered.get(word)
        if f is None:
            if len(remembered) >= _REMEMBER:
                remembered.clear()
            f = word_features(word)
            f = remembered[word] = f if wanted is None else tuple(x for x in f if x in wanted)
        if f:
            out.update(f)
    return out


@dataclass(frozen=True)
class Classifier:
    weights: dict[int, float]
    bias: float

    def logit(self, text: str | None, remembered: dict) -> float:
        w = self.weights
        return self.bias + sum(w[f] for f in sorted(text_features(text, remembered, w.keys())))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """A classifier over the features that are left in the given texts, an array each. Minimises prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l and Adam.

    Where the corrected negative risk falls below zero, its own gradient is ascended, so that the classifier can't drive it
    down by learning the toxic sample by heart. Without toxic texts it gives the prior to every text.
    """
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifier({}, bias)

    def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])

    (pf, pt), (uf, ut) = flat(positive), flat(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    names = np.unique(np.r_[pf, uf])
    pf, uf = np.searchsorted(names, pf), np.searchsorted(names, uf)
    w = np.append(np.zeros(len(names)), bias)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g_p = np.bincount(pt, w[pf], n_p) + w[-1]
        g_u = np.bincount(ut, w[uf], n_u) + w[-1]
        s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
        negative_risk = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        if negative_risk >= 0:
            c_p, c_u = prior * ((s_p - 1) - s_p) / n_p, s_u / n_u
        else:
            c_p, c_u = prior * s_p / n_p, -s_u / n_u
        grad = np.append(np.bincount(pf, c_p[pt], len(names)) + np.bincount(uf, c_u[ut], len(names)) + L2 * w[:-1], c_p.sum() + c_u.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Classifier(dict(zip(names.tolist(), w[:-1].tolist())), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from: crc32 of the id as text divisible by 5, and rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, n_positive, n): of a partition's texts, how many have each feature. Feature -1 counts the texts."""
    remembered: dict = {}
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    for b in batches:
        for positive, text in zip(b["positive"], b["text"]):
            found = text_features(text, remembered)
            at = np.fromiter(found, np.int64, len(found)) + 1
            counts[1, 0] += 1
            counts[1, at] += 1
            if positive:
                counts[0, 0] += 1
                counts[0, at] += 1
    at = np.flatnonzero(counts[1])
    yield pd.DataFrame({"feature": at - 1, "n_positive": counts[0, at], "n": counts[1, at]})


def _map_features(names: frozenset):
    """For mapInPandas: those of names that each text has, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered: dict = {}
        for b in batches:
            found = [text_features(t, remembered, names) for t in b["text"]]
            yield pd.DataFrame({"positive": b["positive"], "features": [np.sort(np.fromiter(f, np.int32, len(f))).tobytes() for f in found]})

    return run


def select_features(texts: DataFrame, scratch: Scratch) -> frozenset:
    """From (text, positive) the features that at least MIN_TEXTS positive texts have, MIN_Z standard deviations above their
    rate in all texts. Counted in the partitions over all texts, added up and judged there; only the chosen ones,
    2 ** BITS at most and some hundred as a rule, reach the driver."""
    counts = texts.select("positive", "text").mapInPandas(_count_features, "feature int, n_positive long, n long")
    counts = scratch.save(counts.groupBy("feature").agg(F.sum("n_positive").alias("n_positive"), F.sum("n").alias("n")))
    total = counts.where("feature = -1").first()
    if total is None or not total.n_positive:
        return frozenset()
    usual = (F.col("n") + 1) / (total.n + 2)
    z = (F.col("n_positive") / total.n_positive - usual) / F.sqrt(usual * (1 - usual) / total.n_positive)
    return frozenset(r.feature for r in counts.where((F.col("feature") >= 0) & (F.col("n_positive") >= MIN_TEXTS) & (z > MIN_Z)).select("feature").collect())


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """A classifier from labels (doc_id, toxic) outside the held-out fold and texts of docs.

    A document is toxic if any of its label rows says so; null labels say nothing. The class prior is the labelled
    share of toxic ones, kept within 0.001 and MAX_PRIOR, so that a text of which nothing is known isn't toxic. How common a feature is comes from all documents outside the
    held-out fold, whatever their labels; the weights are fitted on a sample of the toxic texts and of those, drawn by a
    hash of doc_id, max_positive and max_unlabelled texts expected. Only the chosen features of sampled texts reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(MAX_PRIOR, max(0.001, toxic / n)) if n else PRIOR
    free = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))

    def share(most: int, of: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(of, 1)))

    chosen = known.where("toxic = 1").where(share(max_positive, toxic or 0)).select("doc_id", F.lit(True).alias("_chosen"))
    free = free.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", F.col("_chosen").isNotNull().alias("positive"))  # max_positive ids
    names = select_features(free, scratch)
    n_free = free.count() if names else 0
    either = free.where("positive").union(free.where(share(max_unlabelled, n_free)).withColumn("positive", F.lit(False)))
    rows = either.select("text", "positive").mapInPandas(_map_features(names), "positive boolean, features binary").collect() if names else []
    # In the order of their contents, so that reruns add up in the same order.
    rows.sort(key=lambda r: (r["positive"], bytes(r["features"])))
    of = lambda flag: [np.frombuffer(r["features"], np.int32) for r in rows if r["positive"] is flag]
    return fit(of(True), of(False), prior)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with score, 0 to 1, from the whole text; null and empty texts get the score of a text without features. The
    model has some hundred weights and goes with the task. A column of that name is replaced."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered: dict = {}
        for t in texts:
            yield pd.Series(_sigmoid(np.array([model.logit(x, remembered) for x in t], float)), dtype="float64")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(run, DoubleType())("text"))
