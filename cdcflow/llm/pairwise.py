"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by a quantile of the scores.

Every document gets a feature vector of whole-text ratios (text_stats): the standardised value and its logarithm, and a step for each of
the training sample's deciles. A pair prefers a document labelled 1 over one labelled 0; the probability of that is the logistic function of
the difference of their scores, which are linear in the features, so the loss is logistic on feature differences. The threshold on the
scores is the quantile of the training scores at the share of labels 0; the published score is a logistic map that puts it at CUT.

Learning takes a bounded sample (max_labelled) of the labelled rows outside the held-out fold, and max_pairs pairs of them. Scoring is a
Spark expression over every document.

Defined cases: a null text counts as empty; null ids are scored and not held out; repeated rows get equal scores each; without labels
of both kinds every score is CUT; an empty table gives no rows; other columns of docs aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import RATIOS, labelled_sample, with_base_stats, with_ratios

CUT = 0.3
FOLDS = 5


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


class Ranker:
    """Weights of the steps and values of each ratio."""

    def __init__(self, names: list[str], values: np.ndarray, n_steps: int = 10):
        self.names = names
        logs = np.log1p(values)
        self.mean, self.scale = logs.mean(0), logs.std(0) + 1e-9
        self.cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, n_steps + 1)[1:-1])) for j in range(len(names))]
        self.weights = np.zeros(len(names) + sum(map(len, self.cuts)))
        self.threshold, self.slope = 0.0, 1.0

    def features(self, values: np.ndarray) -> np.ndarray:
        steps = [values[:, [j]] > cuts for j, cuts in enumerate(self.cuts)]
        return np.hstack([(np.log1p(values) - self.mean) / self.scale, *steps]).astype(float)

    def fit(self, values: np.ndarray, good: np.ndarray, max_pairs: int = 100_000, rounds: int = 300, l2: float = 1e-3) -> None:
        x, rng = self.features(values), np.random.default_rng(7)
        ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
        n = int(min(max_pairs, len(ups) * len(downs)))
        d = x[rng.choice(ups, n)] - x[rng.choice(downs, n)]
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, rounds + 1):  # Adam on the whole set of pairs
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            g = -(p @ d) / n + l2 * self.weights
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            self.weights -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        scores = x @ self.weights
        below = np.sort(scores)
        k = int(np.clip(len(downs), 1, len(below) - 1))  # the quantile at the share of labels 0
        self.threshold = float((below[k - 1] + below[k]) / 2)
        self.slope = float(4 / (scores.std() + 1e-9))

    def column(self) -> Column:
        raw, at = F.lit(0.0), len(self.names)
        for j, name in enumerate(self.names):
            raw = raw + (F.log1p(name) - float(self.mean[j])) / float(self.scale[j]) * float(self.weights[j])
            for cut in self.cuts[j]:
                raw = raw + F.when(F.col(name) > float(cut), float(self.weights[at])).otherwise(0.0)
                at += 1
        shift = float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-(F.greatest(F.least((raw - self.threshold) * self.slope, F.lit(500.0)), F.lit(-500.0)) + shift)))


def learn_ranker(rows: list, names: list[str] = RATIOS, max_pairs: int = 100_000) -> Ranker | None:
    values = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    good = np.array([r["k_label"] == 1 for r in rows], dtype=bool)
    if not good.any() or good.all():
        return None
    ranker = Ranker(names, values)
    ranker.fit(values, good, max_pairs)
    return ranker


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_pairs: int = 100_000) -> DataFrame:
    """doc_id, text, the ratios, held_out, score and predicted for every row of docs."""
    sample = labelled_sample(docs, labels, "quality", max_labelled, ~held_out(FOLDS, 0))
    ranker = learn_ranker(with_ratios(with_base_stats(sample)).select("k_label", *RATIOS).collect(), max_pairs=max_pairs)  # max_labelled rows at most
    stats = with_ratios(with_base_stats(docs.select("doc_id", "text")))
    scored = stats.withColumn("held_out", held_out(FOLDS, 0)).withColumn("score", ranker.column() if ranker else F.lit(CUT))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
