"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (``FEATURES``), each put on a scale where it is roughly normal. Per class the
mean and covariance are learnt from labelled rows by summed moments; the covariance is shrunk towards its diagonal and
towards the covariance pooled over classes. A score is the logistic of the difference of the classes' log densities, each
a Mahalanobis distance by forward substitution in a Cholesky factor that is computed once, kept with the model and sent to the
executors. The shrinkages, and by how much the difference is tempered (a Gaussian's tails are too sure of themselves, the more so
for texts of few words), are chosen by cross-validated log loss within the training rows.

Learning takes at most ``MAX_LABELLED`` labelled rows, chosen by a hash of their id, so that their ids can be broadcast;
scoring covers every row. Labels, language, source and ids are no inputs of a score.

Defined results: a null text counts as empty and an empty text has a score as any other; ties and repeated rows score
alike; a label of null or other than 0 and 1 is ignored; with a class without labelled rows every score is 0.5 and the filter
keeps all; an empty table gives an empty result. Other columns, whatever their names, are kept by ``quality_filter`` and unused.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, ship_code, table, text_or_empty

#: Fixed parameters: labelled rows used at most, decision level, folds of the hold-out.
MAX_LABELLED = 20_000
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2
#: What cross-validation chooses from: shrinkage to the diagonal and to the pooled covariance, divisor of the log-density
#: difference, and the number of words at which a text has half the evidence of a long one. The first of each is for too few rows.
TO_DIAGONAL, TO_POOLED, TEMPERATURE, FEW_WORDS = (0.1, 0.02, 0.4), (0.1, 0.02, 0.4), (4.0, 1.0, 2.0, 8.0, 16.0), (20.0, 0.0, 5.0, 60.0)
INNER_FOLDS, LEAST_ROWS = 3, 60

#: Fixed list: frequent function words of English, French, German and Spanish.
COMMON = frozenset(
    """the of and to in a is that it for was on as with be by this are an at re from or ha not he his but
    de la le les des et en un une que qui dans pour par sur pas est au du il elle avec
    der die das und zu den von mit sich nicht ist auf für im dem ein eine als auch
    el los las y del se con no lo su al es por como una""".split()
)
MARKS = "!#$%&*|"

FEATURES = ("words", "word_length", "long_words", "common", "distinct", "marks", "capitals", "digits", "stops", "commas", "lines", "repeated_lines", "other_marks")


def _logit(k: float, n: float) -> float:
    """A smoothed log-odds of k in n: about normal for a share, and defined at 0 and 1."""
    return math.log((k + 0.5) / (max(n - k, 0.0) + 0.5 + 0.02 * n))


def statistics(text: str) -> list[float]:
    """The vector of FEATURES of one whole text; all finite, also for an empty one."""
    words, n = text.split(), len(text)
    k = len(words)
    lines = [x for x in text.split("\n") if x]
    kept = set(words)
    letters = sum(map(len, words))
    marks = sum(map(text.count, MARKS))
    share = min(1.0, 30 / (k + 1))  # a short text says less: its shares are drawn to a common value by the half counts
    low = [w.lower() for w in words]
    return [
        math.log(k + 1),
        math.log((letters + 5) / (k + 1)),
        _logit(sum(len(w) > 9 for w in words), k),
        _logit(sum(map(COMMON.__contains__, low)), k),
        math.log((len(kept) + 1) / (k + 1)) / math.log(k + 3),
        math.log((marks + 0.2) / (k + 2)),
        _logit(sum(map(str.isupper, words)), k),
        math.log((sum(map(text.count, "0123456789")) + 0.5) / (n + 20)),
        math.log((text.count(".") + 0.5) / (k + 5)),
        math.log((text.count(",") + 0.5) / (k + 5)),
        math.log((len(lines) + 0.5) / (k + 5)),
        math.log((len(lines) - len(set(lines)) + 0.3) / (len(lines) + 1)) * (1 - 0.5 * share),
        math.log((sum(map(text.count, "<>{}[]=_;/\\@^~")) + 0.5) / (n + 20)),
    ]


@dataclass
class Discriminant:
    """Means, Cholesky factors (lower triangles) and log determinants of the classes 0 and 1; priors as log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    temperature: float = TEMPERATURE[0]
    few_words: float = FEW_WORDS[0]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log density of class 1 less that of class 0 for each row."""
        logs = []
        for c in (0, 1):
            y, factor = (x - self.means[c]).T, self.factors[c]
            z = np.empty_like(y)
            for k in range(len(y)):  # forward substitution
                z[k] = (y[k] - factor[k, :k] @ z[:k]) / factor[k, k]
            logs.append(-0.5 * (z * z).sum(axis=0) - 0.5 * self.log_dets[c])
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 0.5)
        return tempered(self.difference(x), np.expm1(x[:, 0]), self.log_odds, self.temperature, self.few_words)


def tempered(difference: np.ndarray, words: np.ndarray, log_odds: float, temperature: float, few_words: float) -> np.ndarray:
    """The probability of class 1; without words it is the classes' prior."""
    share = words / np.maximum(words + few_words, 1e-9)
    return 1 / (1 + np.exp(-np.clip(difference / temperature * share + log_odds, -500, 500)))


def from_moments(n: np.ndarray, total: np.ndarray, squares: np.ndarray, to_diagonal: float = TO_DIAGONAL[0], to_pooled: float = TO_POOLED[0]) -> Discriminant:
    """The model of counts (2), sums (2, d) and sums of outer products (2, d, d) by class."""
    if min(n) < 2:
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), 0.0)
    means = total / n[:, None]
    cov = np.array([squares[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors = []
    for c in (0, 1):
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        factors.append(np.linalg.cholesky(s))
    return Discriminant(means, np.array(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), math.log(n[1] / n[0]))


def moments(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [x[label == c] for c in (0, 1)]
    return np.array([float(len(p)) for p in parts]), np.array([p.sum(axis=0) for p in parts]), np.array([p.T @ p for p in parts])


def learnt(x: np.ndarray, label: np.ndarray, inner: np.ndarray) -> Discriminant:
    """The model of rows ``x`` with their labels; ``inner`` is each row's part for choosing the parameters."""
    whole = moments(x, label)
    best = (TO_DIAGONAL[0], TO_POOLED[0], TEMPERATURE[0], FEW_WORDS[0])
    if min(whole[0]) >= LEAST_ROWS:
        loss: dict[tuple, float] = {}
        for part in range(INNER_FOLDS):
            out = inner == part
            own, words, truth = moments(x[~out], label[~out]), np.expm1(x[out, 0]), label[out] == 1
            for a, b in product(TO_DIAGONAL, TO_POOLED):
                model = from_moments(*own, a, b)
                if not len(model.means):
                    continue
                difference = model.difference(x[out])
                for c, d in product(TEMPERATURE, FEW_WORDS):
                    p = np.clip(tempered(difference, words, model.log_odds, c, d), 1e-9, 1 - 1e-9)
                    loss[a, b, c, d] = loss.get((a, b, c, d), 0.0) - np.log(np.where(truth, p, 1 - p)).sum()
        best = min(loss, key=loss.get) if loss else best
    model = from_moments(*whole, *best[:2])
    model.temperature, model.few_words = best[2:]
    return model


def _fold(ids) -> list[int]:
    return [zlib.crc32(str(i).encode()) % FOLDS for i in ids]


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """(id, label) of at most ``limit`` labelled rows outside the held-out fold, by hash of the id."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold != HELD_OUT))
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Learns the model; what reaches the driver is the statistics of at most MAX_LABELLED rows and their repeats, each once."""
    known = F.broadcast(training_labels(labels))  # at most MAX_LABELLED rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(known, "id").select("id", "label", "text")

    def run(ids, label, texts):
        return {"id": [str(i) for i in ids], "label": label, "x": [statistics(t) for t in texts]}

    # an id with several texts or labels stands with its first of each label, so that the bound holds
    found = map_columns(rows, run, "id string, label int, x array<double>").groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("id", "label").limit(2 * MAX_LABELLED).collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    inner = np.array([zlib.crc32(f"inner {r['id']}".encode()) % INNER_FOLDS for r in found], int)
    return learnt(x, np.array([r["label"] for r in found], int), inner)


def quality_scores(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""

    def run(ids, texts):
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
        p = model.scores(x)
        return {"id": ids, "held_out": [None if i is None else f == HELD_OUT for i, f in zip(ids, _fold(ids), strict=True)], "score": p.tolist(), "predicted": (p >= ACCEPT).astype(int).tolist()}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, in one pass and without a shuffle.

    A model without labelled rows of both classes knows nothing against a document: all stay.
    """
    if not len(model.means):
        return docs
    ship_code(docs.sparkSession)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(model.scores(x) >= ACCEPT)

    return docs.filter(accepted(F.col(text_col)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
