"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled text (U) train a linear numpy classifier on words, word
beginnings and how frequent these are. Its risk is corrected by the class prior pi: pi * R_P(+) + max(0, R_U(-) - pi *
R_P(-)); where the second part turns negative, which is over-fitting, that part is stepped back.
Nothing but the text enters a score. Fitting uses bounded, documented samples (``Settings``);
feature counts over them are made by Spark tasks and summed by shuffle, the driver gets the chosen
features and the sample's few feature numbers per text. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import per_text, stage

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
LEVELS = (4, 5, 6, 7)
LONGEST_WORD = 32
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitting samples and of the model."""
    positives: int = 6000
    unlabelled: int = 18000
    features: int = 2048
    least_texts: int = 3
    steps: int = 300
    rate: float = 0.1
    least_share: float = 0.005  # a feature in a smaller share of the toxic texts gets no weight


@dataclass
class Model:
    """score(text) = sigmoid(scale * (bias + sum of the weights of the features it has))."""
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    scale: float = 1.0


def word_features(word: str) -> list[str]:
    """The word itself (up to LONGEST_WORD characters) and its beginnings, marked by a star."""
    out = [word] if len(word) <= LONGEST_WORD else []
    return out + [word[:k] + "*" for k in PREFIXES if len(word) > k]


def words_in(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def reaches(times: int, level: int, words: int) -> bool:
    """Whether a beginning that occurs ``times`` (at least twice) makes up 1 / 2 ** level of all words."""
    return times > 1 and times << level >= words


def text_features(text: str | None) -> set[str]:
    """Words and beginnings in the text, and ``beginning@level`` for those that are frequent in it."""
    words = words_in(text)
    times: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            times[f] += n
    out, total = set(times), words.total()
    for f, n in times.items():
        if f[-1] == "*":
            out.update(f"{f}@{level}" for level in LEVELS if reaches(n, level, total))
    return out


class Numbers:
    """Feature numbers of whole texts, remembering words already seen (a bounded memory)."""

    def __init__(self, index: dict[str, int]):
        self.variants: dict[str, list[tuple[int | None, int]]] = {}
        for name, number in index.items():
            base, _, level = name.partition("@")
            self.variants.setdefault(base, []).append((int(level) if level else None, number))
        self.seen: dict[str, tuple[str, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        words = words_in(text)
        seen, variants = self.seen, self.variants
        times: Counter = Counter()
        for w, n in words.items():
            got = seen.get(w)
            if got is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                got = seen[w] = tuple(f for f in word_features(w) if f in variants)
            for f in got:
                times[f] += n
        total = words.total() if times else 0
        return sorted(number for f, n in times.items() for level, number in variants[f]
                      if level is None or reaches(n, level, total))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_COUNTS = "feature string, side int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for side, text in zip(b.column("side").to_pylist(), b.column("text").to_pylist()):
            sums[side].update(text_features(text))
        for side, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([side] * len(c), pa.int32()),
                                              pa.array(c.values(), pa.int64())], names=["feature", "side", "n"])


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, float]:
    """(side, id, text): side 1 confirmed toxic, side 0 unlabelled, both outside the held-out fold;
    and the class prior, the toxic share of the labelled rows outside that fold."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    prior = float(toxic or 0) / total if total else 0.0
    body = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    order = (F.xxhash64("id"), F.col("id"))
    p_ids = known.filter("toxic = 1").select("id").distinct().orderBy(*order).limit(s.positives)
    u_ids = body.select("id").distinct().orderBy(*order).limit(s.unlabelled)
    chosen = p_ids.withColumn("side", F.lit(1)).unionByName(u_ids.withColumn("side", F.lit(0)))
    # At most positives + unlabelled ids, a bound that does not grow with the data.
    return stage(body.join(F.broadcast(chosen), "id").select("side", "id", "text"), "toxicity-sample"), prior


def _choose(sample: DataFrame, s: Settings) -> list[str]:
    """Features more frequent in P than in U, by the strength of that difference (G squared)."""
    counts = sample.mapInArrow(_count, _COUNTS).groupBy("feature").agg(
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("u"))
    sizes = {r[0]: r[1] for r in sample.groupBy("side").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return []
    p, u = F.col("p").cast("double"), F.col("u").cast("double")
    share = (p + u) / float(n_p + n_u)
    g = p * F.log(p / (share * n_p)) + F.when(u > 0, u * F.log(u / (share * n_u))).otherwise(0.0)
    top = counts.filter((F.col("p") >= s.least_texts) & (p / n_p > 2.0 * u / n_u)).select("feature", g.alias("g"))
    return [r[0] for r in top.orderBy(F.desc("g"), "feature").limit(s.features).collect()]


class _Rows:
    """Texts as runs of feature numbers."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.cols = np.array([x for r in rows for x in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.cols], minlength=self.n)

    def back(self, g: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.at], minlength=k)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(pos: list[list[int]], unl: list[list[int]], k: int, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss (Adam steps
    over all rows). Weights stay at 0 or above, as every feature was chosen as a sign of P, and pay
    for their size, so that chance features of few texts stay at 0."""
    P, U = _Rows(pos), _Rows(unl)
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, s.steps + 1):
        fp, fu = P.times(w) + b, U.times(w) + b
        plus = -prior * _sigmoid(-fp) / P.n
        neg_p, neg_u = -prior * _sigmoid(fp) / P.n, _sigmoid(fu) / U.n
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = (plus + neg_p, neg_u) if negative >= 0 else (-neg_p, -neg_u)
        g = np.concatenate([P.back(gp, k) + U.back(gu, k) + s.least_share * prior, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = s.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = np.maximum(w - step[:k], 0.0), b - step[k]
    return w, b


def _cut(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The margin with the least prior-corrected error; of equal ones, the middle of the widest gap."""
    values = np.unique(np.concatenate([fp, fu]))
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[-1] + 1.0]])
    widths = np.concatenate([values[1:] - values[:-1], [0.0]])
    missed = np.searchsorted(np.sort(fp), cuts) / len(fp)
    raised = 1 - np.searchsorted(np.sort(fu), cuts) / len(fu)
    error = prior * missed + np.maximum(0.0, raised - prior * (1 - missed))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(cuts[best[np.argmax(widths[best])]])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), never on the held-out fold.

    Without toxic labels, or without texts, the model scores every text alike, below 0.5."""
    sample, prior = _sample(docs, labels, settings)
    names = _choose(sample, settings)
    if not names or not 0 < prior < 1:
        return Model()
    index = {f: i for i, f in enumerate(names)}

    def make():
        of = Numbers(index).of
        return lambda text: (of(text),)

    found = [per_text(sample.filter(F.col("side") == side), "cols array<int>", make, "id") for side in (1, 0)]
    pos, unl = ([list(r["cols"]) for r in sorted(rows.collect(), key=lambda r: (r["id"], r["cols"]))] for rows in found)
    w, b = train(pos, unl, len(names), prior, settings)
    margins = [_Rows(x).times(w) + b for x in (pos, unl)]
    cut = _cut(*margins, prior)
    spread = float(np.median(np.abs(margins[0] - cut))) or 1.0
    kept = np.flatnonzero(w > 0)
    return Model({names[i]: n for n, i in enumerate(kept)}, w[kept], float(b - cut), 3.0 / spread)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per input row, from the whole text alone; null and empty texts score the bias."""
    index, weights, bias, scale = model.index, model.weights, model.bias, model.scale

    def make():
        of = Numbers(index).of
        return lambda text: (float(_sigmoid(scale * (bias + weights[of(text)].sum()))),)

    return per_text(docs, "score double", make, id_col, text_col).withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted); predicted is score >= 0.5.

    Null texts are empty, repeated rows score alike, a null doc_id never trains; an empty table
    gives an empty result, and further columns are ignored, whatever their names."""
    scored = score(docs, fit(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows whose text is not predicted toxic, all columns unchanged; rows with a null text stay.

    Equal texts have equal scores, so the decision is taken on the text within the row's task."""
    model = fit(docs, labels, settings)
    index, weights, bias = model.index, model.weights, model.bias

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Numbers(index).of
        for b in batches:
            yield pd.Series([bias + weights[of(t)].sum() >= 0 for t in b], dtype=bool)

    return docs.filter(~toxic(F.col("text")))
