"""Toxicity: a factorization machine over hashed terms.

The score of a text is the logistic of ``bias + sum w[t] + sum over pairs
<v[t], v[u]>`` for the hashed terms t, u that occur in it, so a pair such as an
insult and the mention of a group weighs more than both alone.

The machine is fitted on a bounded sample of labelled texts (``Settings.sample``):
identifiers alone choose it, one pass over the texts brings its terms, counts over
it choose the vocabulary, and Adam runs over sparse rows.  Every whole text is then
scored with every term of the vocabulary in a narrow pass.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import held_out, read_table, stored

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Documented bounds and rates of the fit; what is scored, and with how many terms, has no bound."""

    buckets: int = 1 << 20  # hashed terms
    evidence: float = 6.0  # nats by which a term of the vocabulary must tell the labels of the sample apart
    sample: int = 24_000  # labelled texts that the machine is fitted on, half of them toxic if there are so many
    factors: int = 6
    epochs: int = 30
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


def terms_of(text: str | None, buckets: int) -> set[int]:
    """Hashed words of a whole text, and their first four letters as a crude stem; none for null."""
    words = set(_WORD.findall((text or "").lower()))
    words |= {w[:4] + "-" for w in words}
    return {zlib.crc32(w.encode()) % buckets for w in words}


@dataclass(frozen=True)
class Machine:
    vocabulary: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, terms: set[int]) -> float:
        at = [self.vocabulary[t] for t in terms if t in self.vocabulary]
        v = self.vectors[at]
        logit = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + math.exp(-min(max(float(logit), -500.0), 500.0)))


def sample_of(ids: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """At most ``settings.sample`` labelled ids (id, label), and for each label how many there are and how many were taken.

    ``ids`` holds no texts.  Those with the smallest hashes within each label are
    taken, half of them toxic if there are so many.  An id that has both labels
    counts as toxic.
    """
    known = labels.where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = ids.where("id IS NOT NULL").distinct().join(known, "id")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    half = settings.sample // 2
    toxic = min(sizes.get(1, 0), half)
    want = {1: toxic, 0: min(sizes.get(0, 0), settings.sample - toxic)}
    rows = []
    for label, n in want.items():
        rows += known.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(settings.seed), "id"), "id").limit(n).collect()
    return ids.sparkSession.createDataFrame(rows, known.schema), {k: (sizes.get(k, 0), n) for k, n in want.items()}


def _terms_column(buckets: int):
    @F.pandas_udf("array<int>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([np.fromiter(terms_of(t, buckets), np.int32) for t in texts], dtype=object)

    return terms


def vocabulary(sample: DataFrame, settings: Settings) -> DataFrame:
    """``term`` of all that tell the labels of ``sample`` (label, terms) apart by the evidence asked for."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    total = toxic + clean
    counts = sample.select("label", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    entropy = lambda k, n: k * F.log((k + 0.5) / n)
    gain = (
        entropy(F.col("a"), toxic) + entropy(F.col("b"), clean) - entropy(F.col("a") + F.col("b"), total)
        + entropy(toxic - F.col("a"), toxic) + entropy(clean - F.col("b"), clean) - entropy(total - F.col("a") - F.col("b"), total)
    )
    return counts.where(gain >= settings.evidence).select("term")


def fit(rows: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine | None:
    """From ``rows`` (id, text) and ``labels`` (id, label 0 or 1).  None unless both labels occur.

    Texts are read once, for the sample alone, whose ids (at most
    ``settings.sample``) go to every task.  Adam runs on the driver over the terms of
    the vocabulary that these rows hold.
    """
    chosen, taken = sample_of(rows.select("id"), labels, settings)
    if not all(n for _, n in taken.values()):
        return None
    texts = rows.join(F.broadcast(chosen), "id")  # at most settings.sample ids
    sample = stored(texts.select("label", _terms_column(settings.buckets)("text").alias("terms")), "sample")
    at = {r.term: i for i, r in enumerate(vocabulary(sample, settings).orderBy("term").collect())}

    @F.pandas_udf("array<int>")
    def places(terms: pd.Series) -> pd.Series:
        return pd.Series([np.array([at[t] for t in row.tolist() if t in at], np.int32) for row in terms], dtype=object)

    found = sample.select("label", places("terms").alias("x")).toPandas()
    y = found["label"].to_numpy(np.float32)
    # A sample that holds toxic texts more often than the table is weighted back.
    weight = np.where(y == 1, taken[1][0] / taken[1][1], taken[0][0] / taken[0][1]).astype(np.float32)
    # Rows come in any order; the fit must not depend on it.
    key = [(label, tuple(sorted(x))) for label, x in zip(found["label"], found["x"])]
    order = sorted(range(len(key)), key=key.__getitem__)
    return _adam([np.array(key[i][1], np.int64) for i in order], y[order], weight[order] / weight.mean(), at, settings)


def _adam(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, at: dict[int, int], s: Settings) -> Machine:
    """``x``: the places of each row's terms.  A step changes the terms of its batch alone."""
    rng = np.random.default_rng(s.seed)
    k, width = len(at), s.factors + 1
    rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    # One row a term: its weight, then its vector; the last row is the bias.
    p = np.zeros((k + 1, width), np.float32)
    p[:k, 1:] = rng.normal(0, 0.02, (k, s.factors))
    p[k, 0] = math.log(rate / (1 - rate))
    m, v, step = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), s.batch):
            rows = order[i : i + s.batch]
            sizes = [len(x[r]) for r in rows]
            used, place = np.unique(np.concatenate([x[r] for r in rows]), return_inverse=True)
            b = np.zeros((len(rows), len(used)), np.float32)
            b[np.repeat(np.arange(len(rows)), sizes), place] = 1
            w, vec = p[used, 0], p[used, 1:]
            mixed = b @ vec
            logit = p[k, 0] + b @ w + 0.5 * ((mixed**2).sum(axis=1) - b @ (vec**2).sum(axis=1))
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            pulled = b * slope[:, None]
            own = np.append(used, k)
            g = np.zeros((len(own), width), np.float32)
            g[:-1, 0] = pulled.sum(axis=0) + s.decay * w
            g[:-1, 1:] = (pulled.T @ mixed) - pulled.sum(axis=0)[:, None] * vec + s.decay * vec
            g[-1, 0] = slope.sum()
            step += 1
            m[own] = 0.9 * m[own] + 0.1 * g
            v[own] = 0.999 * v[own] + 0.001 * g * g
            p[own] -= s.rate * (m[own] / (1 - 0.9**step)) / (np.sqrt(v[own] / (1 - 0.999**step)) + 1e-8)
    p = p.astype(np.float64)
    return Machine(at, float(p[k, 0]), p[:k, 0], p[:k, 1:])


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: id, held_out, score, predicted; labels (doc_id, toxic) are learnt where not held out.

    Null and empty texts have no terms and get the score of the bias; a null id
    is neither held out nor labelled; repeated rows are scored each.  Without
    labels of both kinds every score is 0.  Only the text enters a score.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    machine = fit(rows, known.where(~held_out(F.col("id"))), settings)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([machine.score(terms_of(t, settings.buckets)) if machine else 0.0 for t in texts], dtype=float)

    scored = rows.select("id", held_out(F.col("id")).alias("held_out"), judge("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op8_factor_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")
