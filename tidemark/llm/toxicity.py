"""Toxicity by non-negative positive-unlabelled learning.

Linear numpy classifiers are trained on confirmed toxic documents (P) and on documents whose labels are
ignored (U). The risk is  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))  with the sigmoid loss, where pi is the share
of toxic documents; if the bracket turns negative, the step goes the other way, so that U is not overfitted.
Features are the distinct words of a text and their first letters, hashed.

Defined cases: null text counts as empty; an empty text has the score of the bias alone; documents with a null
id are scored and never learned from; without toxic or without unlabelled training rows every score is 9e-14; a text of any length is scored
whole, one at a time; an empty table gives no rows. Columns besides id and text are never read, so clashing names do not matter.
Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, marks_of, sample_ids, slices, small_batches, table, texts_of

BITS = 20
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Words whose features a worker remembers.
KNOWN = 50_000


def word_features(word: str) -> list[int]:
    keys = [f"w {word}", *(f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [crc32(k.encode()) & ((1 << BITS) - 1) for k in keys]


def text_features(text: str | None) -> np.ndarray:
    """The sorted distinct hashed features of a text."""
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.update(word_features(w))
    return np.array(sorted(found), dtype=np.int32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        ids = [text_features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("is_p"), pa.array(ids, pa.list_(pa.int32()))], ["is_p", "ids"])


def select_features(p: list[np.ndarray], u: list[np.ndarray], n: int, least: int) -> np.ndarray:
    """The n features whose document frequency in P stands out most against U (z score of a difference of shares)."""
    def count(docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1 << BITS, np.int64)
        for x in docs:
            out[x] += 1  # a document's features are distinct
        return out

    cp, cu = count(p), count(u)
    share = (cp + cu) / max(1, len(p) + len(u))
    z = (cp / max(1, len(p)) - cu / max(1, len(u))) / np.sqrt(share * (1 - share) * (1 / max(1, len(p)) + 1 / max(1, len(u))) + 1e-12)
    z[cp < least] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:n]
    return np.sort(best[np.abs(z[best]) > 3])


def nnpu_gradient(p: np.ndarray, u: np.ndarray, sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk of rows p and u with sigmoid outputs sp and su, and the direction of its step (weights, then bias).

    The loss of a row is 1 - s as positive and s as negative. Where the part for negatives is below 0, the step undoes it alone.
    """
    dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
    bracket = float(su.mean() - prior * sp.mean())
    grad = lambda x, d: np.append(d.astype(np.float32) @ x, d.sum())
    g_pos, g_neg = -prior * grad(p, dp), grad(u, du) - prior * grad(p, dp)
    return prior * float(1 - sp.mean()) + max(0.0, bracket), g_pos + g_neg if bracket >= 0 else -g_neg


def nnpu_fit(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int, epochs: int = 60, rate: float = 0.02, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the sigmoid loss, by Adam on mini-batches."""
    rng, k = np.random.default_rng(seed), xp.shape[1]
    theta, m, v, t = np.zeros(k + 1, np.float64), np.zeros(k + 1), np.zeros(k + 1), 0
    theta[-1] = -0.1
    steps = max(1, len(xu) // 512)
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(xu)), rng.permutation(len(xp))
        for bu, bp in zip(np.array_split(order_u, steps), np.array_split(order_p, steps), strict=True):
            if not len(bu) or not len(bp):
                continue
            p, u = xp[bp], xu[bu]
            now = theta[:-1].astype(np.float32)
            sp, su = (1 / (1 + np.exp(-np.clip(x @ now + theta[-1], -30, 30))) for x in (p, u))
            g = nnpu_gradient(p, u, sp, su, prior)[1] + l2 * np.append(theta[:-1], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2500, max_unlabelled: int = 6000, max_features: int = 1500, n_models: int = 3, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model from the documents outside the held-out fold. P and U are bounded seeded samples (max_positive,
    max_unlabelled rows); pi is the share of toxic ones among all labelled training rows."""
    small_batches(docs.sparkSession)
    marked = marks_of(labels, "toxic", id_col).where("fold <> 0")
    prior = min(max(float(marked.agg(F.avg("label")).first()[0] or 0.0), 1e-3), 0.9)
    p_ids = sample_ids(marked.where("label = 1").select("_id"), max_positive).withColumn("is_p", F.lit(True))
    own = docs.select(F.col(id_col).alias("_id"))
    u_ids = sample_ids(own.where(fold_of("_id") != 0).distinct(), max_unlabelled, seed=18).withColumn("is_p", F.lit(False))
    both = texts_of(docs, p_ids.unionByName(u_ids), id_col, text_col)
    rows = both.select("is_p", "text").repartition(16).mapInArrow(_featurise, "is_p boolean, ids array<int>").toArrow()
    lists = rows.column("ids").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
    is_p, ids = rows.column("is_p").to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # views, no copies
    order = sorted(range(len(ids)), key=lambda i: (is_p[i], len(ids[i]), xxhash.xxh3_128_digest(ids[i].tobytes())))  # the same under any partitioning
    p, u = [ids[i] for i in order if is_p[i]], [ids[i] for i in order if not is_p[i]]
    if not p or not u:
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    features = select_features(p, u, max_features, least=max(2, len(p) // 500))

    def dense(group: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(group), len(features)), np.float32)
        for i, f in enumerate(group):
            x[i, np.searchsorted(features, f[np.isin(f, features)])] = 1
        return x

    xp, xu = dense(p), dense(u)
    del rows, lists, flat, ids, p, u
    fits = [nnpu_fit(xp, xu, prior, seed) for seed in range(n_models)]
    return {"features": features, "weights": np.mean([w for w, _ in fits], axis=0), "bias": float(np.mean([b for _, b in fits]))}


class Scorer:
    """Scores texts with a model of at most max_features numbers, which travels with the tasks."""

    def __init__(self, model: dict):
        self.weight_of = dict(zip(model["features"].tolist(), model["weights"].tolist(), strict=True))
        self.bias = model["bias"]
        self.known: dict[str, tuple] = {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in set(WORD.findall((text or "").lower())):
            if (f := self.known.get(w)) is None:
                if len(self.known) > KNOWN:
                    self.known.clear()
                f = self.known[w] = tuple(x for x in word_features(w) if x in self.weight_of)
            if f:
                found.update(f)
        z = self.bias + sum(self.weight_of[x] for x in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([scorer.score(t.as_py()) for t in b.column("text")], pa.float64())], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **params) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    model = train(docs, labels, text_col=text_col, **params)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, at):
            yield b.filter(pa.array([scorer.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
