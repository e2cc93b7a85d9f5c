"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics.  Sums and cross
products per class are partial aggregates over all labelled rows; the driver
sees only those few hundred numbers, shrinks both covariances and factors them
once.  A score is the logistic of the difference of the two log densities, each
a Mahalanobis distance through the cached factor.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import held_out, read_table, stored

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:'\"()?-\n\t\r "
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and bytes([c]) not in [bytes([s]) for s in _STOPS])
STATISTICS = (
    "bytes", "words", "word_length", "distinct_words", "top_word", "repeats", "upper", "digits", "marks", "stops", "lines", "short_words",
    "bytes_used", "wide",
)


def _share(part: float, whole: float) -> float:
    """Log odds of a share, smoothed by half a case."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty, and both give finite numbers."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    counts = Counter(words)
    without = lambda chars: size - len(raw.translate(None, chars))
    return [
        math.log1p(size),
        math.log1p(n),
        math.log((sum(map(len, words)) + 1) / (n + 1)),
        _share(len(counts), n),
        _share(max(counts.values(), default=0), n),
        _share(sum(a == b for a, b in zip(words, words[1:])), n),
        _share(without(_UPPER), size),
        _share(without(_DIGIT), size),
        _share(without(_MARKS), size),
        _share(without(b".,;:"), size),
        _share(raw.count(b"\n"), size),
        _share(sum(k for w, k in counts.items() if len(w) < 4), n),
        math.log1p(len(set(raw))),
        _share(len(raw) - len(raw.translate(None, bytes(range(128, 256)))), size),
    ]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with an array column ``statistics``; one narrow pass over whole texts."""
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return df.withColumn("statistics", measure(F.col(text_col)))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        far = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.offset + (far[0] - far[1]) / 2, -500, 500)))


def _partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for (label, fold), rows in frame.groupby(["label", "fold"]):
            x = np.array(rows["statistics"].tolist(), dtype=np.float64)
            x = np.hstack([np.ones((len(x), 1)), x])
            yield pd.DataFrame({"label": [int(label)], "fold": [int(fold)], "sums": [(x.T @ x).ravel()]})


#: Choices of (shrinkage, pooling), the first where they cannot be compared, and the parts that labelled rows are cut into.
GRID = ((0.01, 0.6), *((s, p) for s in (0.001, 0.01, 0.1) for p in (0.2, 0.6, 0.9) if (s, p) != (0.01, 0.6)))
FOLDS = 5


def discriminant(moments: np.ndarray, shrinkage: float, pooling: float) -> Discriminant | None:
    """From the sums of (1, statistics) products of both classes; None unless both have rows."""
    if not moments[:, 0, 0].all():
        return None
    d = len(STATISTICS)
    total = moments.sum(axis=0)
    centre = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - centre**2, 1e-12))
    counts, means, spreads = [], [], []
    for m in moments:
        mean = m[0, 1:] / m[0, 0]
        spread = (m[1:, 1:] / m[0, 0] - np.outer(mean, mean)) / np.outer(scale, scale)
        counts.append(m[0, 0])
        means.append((mean - centre) / scale)
        spreads.append(spread)
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / sum(counts)
    factors, logdet = [], []
    for spread in spreads:
        mixed = (1 - pooling) * spread + pooling * pooled
        mixed = (1 - shrinkage) * mixed + shrinkage * np.eye(d) * max(np.trace(mixed) / d, 1e-6)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        logdet.append(np.log(np.diag(lower)).sum())
    offset = math.log(counts[1] / counts[0]) + logdet[0] - logdet[1]
    return Discriminant(centre, scale, tuple(means), tuple(factors), offset)


def _losses(models: list[list[Discriminant | None]]):
    """Log loss of every choice over the rows of each fold, judged by the model that has not seen the fold."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            loss = np.zeros(len(GRID))
            for fold, rows in frame.groupby("fold"):
                x, y = np.array(rows["statistics"].tolist(), dtype=np.float64), rows["label"].to_numpy()
                for k in range(len(GRID)):
                    p = np.clip(models[int(fold)][k].scores(x), 1e-9, 1 - 1e-9)
                    loss[k] -= np.where(y == 1, np.log(p), np.log(1 - p)).sum()
            yield pd.DataFrame({"choice": np.arange(len(GRID)), "loss": loss})

    return measure


def fit(labelled: DataFrame) -> Discriminant | None:
    """From rows (label 0 or 1, statistics), which are read twice.  None unless both classes have rows.

    Shrinkage moves a covariance towards a multiple of the identity, pooling towards
    the covariance of both classes together; both are chosen from ``GRID`` by the log
    loss over ``FOLDS`` parts, equal texts in one part.  Every labelled row counts;
    rows with another or a null label are left out.
    """
    rows = labelled.where("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "statistics")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("statistics"), F.lit(FOLDS)).cast("int"))
    partial = rows.mapInPandas(_partial_sums, "label int, fold int, sums array<double>").select("label", "fold", F.posexplode("sums").alias("at", "x"))
    sums = partial.groupBy("label", "fold", "at").agg(F.sum("x").alias("x")).collect()  # 2 x folds x (statistics + 1)^2 numbers
    d = len(STATISTICS)
    moments = np.zeros((2, FOLDS, (d + 1) ** 2))
    for r in sums:
        moments[r.label, r.fold, r.at] = r.x
    moments = moments.reshape(2, FOLDS, d + 1, d + 1)
    total = moments.sum(axis=1)
    models = [[discriminant(total - moments[:, fold], *choice) for choice in GRID] for fold in range(FOLDS)]
    best = 0
    if all(m is not None for fold in models for m in fold):
        losses = rows.mapInPandas(_losses(models), "choice int, loss double").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()
        best = min(losses, key=lambda r: (round(r.loss, 6), r.choice)).choice
    return discriminant(total, *GRID[best])


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted; labels (doc_id, quality) are learnt where not held out.

    Null and empty texts are scored like others, a null id is never held out nor
    labelled, repeated rows are scored each.  Without labels of both classes
    every score is 0.5.  Only the statistics of a text enter a score.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(with_statistics(rows).select("id", held_out(F.col("id")).alias("held_out"), "statistics"), "statistics")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = fit(stored(rows.where("NOT held_out").join(known, "id").select("label", "statistics"), "labelled"))

    @F.pandas_udf("double")
    def judge(values: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(0.5, index=values.index)
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array(values.tolist(), dtype=np.float64)))

    scored = rows.select("id", "held_out", judge("statistics").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is 0.5 or more, with all their columns.

    Null, empty and very long texts are scored like others; without labels of both
    classes all rows stay; a table without rows gives none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id")))
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    # Measured before they meet the labels, so that no text is shuffled.
    model = fit(stored(with_statistics(rows).select("id", "statistics").join(known, "id").select("label", "statistics"), "statistics"))
    if model is None:
        return df

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=bool)
        return pd.Series(model.scores(np.array([statistics(t) for t in texts])) >= 0.5)

    return df.where(good(F.col(text_col)))


@query("op10_quadratic_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    found = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")
