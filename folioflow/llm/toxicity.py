"""Toxicity by classifier chains: a linear model a category, each fed the categories before it, in every rotation of the categories.

Training takes a bounded sample of the labelled rows (``TRAIN_ROWS``, by hash of doc_id). The document
counts of its words and word beginnings are added up per batch and then by Spark; the ``FEATURES`` most associated with a category become features, present or not. The
models are ridge logistic regressions. A later model's extra inputs are the earlier categories' log odds, and in
training these are out-of-fold predictions: each fold's rows get those of a model that hasn't seen them. So a later model
learns how far to trust the earlier ones. Every whole text is then scored in batches on the executors.

What goes to the driver and back is bounded by the sample and the feature count, never by the documents.

Defined results: null text has no words and gets the models' base rates; label rows with nulls in a category are
left out, repeated label rows count once with the largest label; a category with one value in the sample predicts
its constant; without any labels every probability is 0.5 and nothing is
flagged; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import cut, read, text_of

#: Bounds of training: labelled rows, features, documents a feature must be in, features kept of one document.
TRAIN_ROWS, FEATURES, MIN_DOCS = 20_000, 8_192, 5
FOLDS, RIDGE, STEPS = 5, 0.3, 60
#: Lower-case runs of letters.
LETTERS = r"[^\W\d_]+"


#: Beginnings of words that are features beside the words: a stem counts with endings that training hasn't seen.
STEMS = (4, 5, 6)
#: Words whose feature numbers a worker keeps.
KEPT_WORDS = 300_000


def words(text: str) -> set[str]:
    return set(re.findall(LETTERS, text.lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a caret."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


class Sparse:
    """Rows of feature numbers, all with value one, and some dense columns. Entries are kept in both orders, by row and by feature."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(rows), width, dense
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.of = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        at = np.repeat(np.arange(self.n), sizes)
        self.by_feature = at[np.argsort(self.of, kind="stable")]
        self.some_rows, self.row_starts = self._starts(sizes)
        self.some_features, self.feature_starts = self._starts(np.bincount(self.of, minlength=width))

    @staticmethod
    def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which have entries, and where these begin."""
        some = np.flatnonzero(sizes)
        return some, (np.cumsum(sizes) - sizes)[some]

    def with_dense(self, dense: np.ndarray) -> Sparse:
        out = copy.copy(self)
        out.dense = dense
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.width :]
        if len(self.of):
            out[self.some_rows] += np.add.reduceat(w[: self.width].take(self.of), self.row_starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.of):
            out[self.some_features] = np.add.reduceat(r.take(self.by_feature), self.feature_starts)
        return np.concatenate([out, self.dense.T @ r])


def fit(x: Sparse, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, start: np.ndarray | None = None, some: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by limited-memory BFGS; the last dense column is the intercept, without penalty. ``some`` says which rows count, if not all."""
    w = np.zeros(x.width + x.dense.shape[1]) if start is None else start.copy()
    pen = np.full(len(w), ridge)
    pen[-1] = 0.0
    some = np.ones(x.n) if some is None else some.astype(float)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return float(some @ (np.logaddexp(0, z) - y * z) + 0.5 * np.sum(pen * w * w)), x.back(some * (p - y)) + pen * w

    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, v in reversed(past):
            alphas.append(a := (s @ d) / (s @ v))
            d = d - a * v
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            d = d / max(1.0, np.linalg.norm(d))
        for (s, v), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - (v @ d) / (s @ v)) * s
        step = 1.0
        while step > 1e-8:
            nf, ng = value(w + step * d)
            if nf <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, v = step * d, ng - g
        if s @ v > 1e-12:
            past = [*past[-6:], (s, v)]
        done = f - nf < 1e-6 * max(1.0, abs(f))
        w, f, g = w + s, nf, ng
        if done:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The probability that cuts log odds ``z`` with the best F1, in the middle of its gap, and the F1.

    Without both values there is nothing to choose by, and it is one half.
    """
    if len(y) == 0 or y.min() == y.max():
        return 0.5, 0.0
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit, flagged = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hit / (flagged + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1.0
    k = int(np.argmax(f1))
    cut_at = z[k] - 1 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2
    return float(1 / (1 + np.exp(-cut_at))), float(f1[k])


class Chains:
    """Classifier chains over a vocabulary of words, one for each rotation of the categories.

    In every chain a category's model is fed the categories before it. So each category comes first in one chain, last in another, and
    its log odds are the mean over the chains: every verdict has passed through models that know the other categories.
    """

    def __init__(self, vocabulary: list[str], categories: list[str]):
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.categories = categories
        n = len(categories)
        self.orders = [[(first + k) % n for k in range(n)] for first in range(n)]
        #: The models of each chain, in its order.
        self.models: list[list[np.ndarray]] = []
        #: Probabilities from which a category is flagged, and their F1, both from out-of-fold predictions.
        self.thresholds: list[float] = []
        self.f1: list[float] = []
        #: F1 of each category in each chain alone.
        self.f1_by_chain: list[list[float]] = []
        self.kept: dict[str, tuple[int, ...]] = {}

    def numbers(self, text: str) -> set[int]:
        """Numbers of the features of a text."""
        kept, out = self.kept, set()
        for w in words(text):
            own = kept.get(w)
            if own is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[w] = own = tuple(i for i in map(self.vocabulary.get, features(w)) if i is not None)
            if own:
                out.update(own)
        return out

    def train(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chains:
        width, n = len(self.vocabulary), len(rows)
        plain: dict[tuple[int, int], np.ndarray] = {}
        x = Sparse(rows, width, np.ones((n, 1)))

        def fitted(c: int, fold: int, some: np.ndarray, dense: np.ndarray) -> np.ndarray:
            """A model of category c over some rows. It starts from the one over the same rows that knows no other category."""
            y = labels[:, c].astype(float)
            if (c, fold) not in plain:
                plain[c, fold] = fit(x, y, some=some)
            start = plain[c, fold]
            if dense.shape[1] == 1:
                return start
            return fit(x.with_dense(dense), y, start=np.concatenate([start[:width], np.zeros(dense.shape[1] - 1), start[width:]]), some=some)

        total = np.zeros((n, len(self.categories)))
        for order in self.orders:
            earlier, models, f1 = np.zeros((n, 0)), [], [0.0] * len(order)
            for c in order:
                y = labels[:, c].astype(float)
                dense = np.column_stack([earlier, np.ones(n)])
                if n == 0 or y.min() == y.max():
                    w = np.zeros(width + dense.shape[1])
                    w[-1] = 0.0 if n == 0 else 12.0 if y[0] else -12.0
                    out = np.full(n, w[-1])
                else:
                    w = fitted(c, -1, np.ones(n, bool), dense)
                    out = np.zeros(n)
                    for k in range(FOLDS):
                        rest = folds == k
                        if rest.any() and not rest.all():
                            out[rest] = x.with_dense(dense).times(fitted(c, k, ~rest, dense))[rest]
                models.append(w)
                f1[c] = best_cut(out, y)[1]
                total[:, c] += out / len(self.orders)
                earlier = np.column_stack([earlier, np.clip(out, -12, 12)])
            self.models.append(models)
            self.f1_by_chain.append(f1)
        for c in range(len(self.categories)):
            at, best = best_cut(total[:, c], labels[:, c].astype(float))
            self.thresholds.append(at)
            self.f1.append(best)
        return self

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """Probabilities, a row a text and a column a category."""
        width, flat, sizes = len(self.vocabulary), [], []
        for t in texts:
            found = self.numbers(t)
            flat += found
            sizes.append(len(found))
        at, of = np.repeat(np.arange(len(sizes)), sizes), np.array(flat, dtype=np.int64)
        total = np.zeros((len(sizes), len(self.categories)))
        for order, models in zip(self.orders, self.models, strict=True):
            z = np.zeros((len(sizes), len(order)))
            for k, m in enumerate(models):
                z[:, k] = np.bincount(at, weights=m[of], minlength=len(sizes)) + np.clip(z[:, :k], -12, 12) @ m[width:-1] + m[-1]
            total[:, order] += z / len(self.orders)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _counted(ys: list[str]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, *own in zip(b["_text"], *[b[y] for y in ys], strict=True):
                for f in {f for w in words(t) for f in features(w)}:
                    c = counts.setdefault(f, [0] * (1 + len(ys)))
                    c[0] += 1
                    for k, y in enumerate(own):
                        c[1 + k] += y
            yield pd.DataFrame([(f, *c) for f, c in counts.items()], columns=["w", "d", *ys])

    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = TRAIN_ROWS) -> Chains:
    """Chains for ``categories`` (0/1 columns of ``labels``) over a sample of about ``rows`` labelled documents at most."""
    labels = labels.where(F.col("doc_id").isNotNull() & ~F.greatest(*[F.col(c).isNull().cast("int") for c in categories], F.lit(0)).cast("boolean"))
    labels = labels.groupBy(F.col("doc_id").alias("_id")).agg(*[F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)])
    share = min(1.0, rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    ys = [f"_y{k}" for k in range(len(categories))]
    # The sample of labels has ``rows`` rows of a few numbers: a proven bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id") == F.col("_id")).select("_id", text_of().alias("_text"), *ys)
    sample = cut(sample, "sample")
    n, *pos = sample.agg(F.count(F.lit(1)), *[F.sum(y) for y in ys]).first()
    counts = sample.mapInPandas(_counted(ys), "w string, d long, " + ", ".join(f"{y} long" for y in ys)).groupBy("w")
    counts = counts.agg(F.sum("d").alias("d"), *[F.sum(y).alias(y) for y in ys]).where(F.col("d") >= MIN_DOCS)
    # How far a word's count in a category is from what its share of documents lets expect, in standard deviations.
    away = [
        F.abs(F.col(y) - F.col("d") * F.lit((p or 0) / max(1, n))) / F.sqrt(F.col("d") * F.lit(max(1e-9, (p or 0) / max(1, n) * (1 - (p or 0) / max(1, n)))))
        for y, p in zip(ys, pos, strict=True)
    ]
    best = counts.orderBy(F.greatest(*away, F.lit(0.0)).desc(), "w").limit(FEATURES)
    chain = Chains(sorted(r["w"] for r in best.select("w").collect()), categories)
    sent = sample.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(sent.value.numbers(t)) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "f": [np.array(f, np.int32).tobytes() for f in found], **{y: b[y] for y in ys}})

    got = sample.mapInPandas(run, "_id long, f binary, " + ", ".join(f"{y} int" for y in ys)).toPandas().sort_values(["_id", "f"])
    rows_ = [np.frombuffer(f, np.int32) for f in got["f"]]
    folds = (got["_id"].to_numpy(np.int64) * 2654435761 >> 7) % FOLDS
    return chain.train(rows_, got[ys].to_numpy(), folds)


def score(docs: DataFrame, chain: Chains) -> DataFrame:
    """doc_id and p_<category> of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], **dict(zip(names, sent.value.scores(b["text"]).T, strict=True))})

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of toxicity and of low quality, the two categories that the labels have, each as the mean of two chains:
    one in which it comes first, and one in which its model knows the other."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", (1 - F.col("quality")).alias("low_quality"))
    docs = read(spark, sf_dir, "documents")
    chain = train_chain(docs, labels, ["toxic", "low_quality"])
    scored = score(docs, chain)
    for c, at in zip(chain.categories, chain.thresholds, strict=True):
        scored = scored.withColumn(c, F.col(f"p_{c}") > at)
    return scored
