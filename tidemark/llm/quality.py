"""Quality by compression: zstandard with dictionaries of good and of bad labelled text.

A whole text is compressed once with each dictionary. The difference of the two sizes, normalised by the text's size, says which kind of
text it resembles; logistic regression on that difference alone, fitted on labelled rows that are in neither dictionary (fold
4), turns it into the probability of label 1. A dictionary is the raw content of seeded cuts of its texts: trained dictionaries of the same
size kept fewer of the phrases that tell the kinds apart.

Defined cases: null text counts as empty; an empty text has difference 0; null ids are scored, never learned
from; with one label only the score is that label's share for every text, and without any 0.5; a text of any length is compressed whole, one at a
time; an empty table gives no rows; repeated rows give repeated results. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, marks_of, sample_ids, slices, small_batches, table


class Sizes:
    """Compressed sizes of texts under a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.with_good, self.with_bad = (self._compressor(x, level) for x in (good, bad))

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        """The normalised difference of the sizes, positive if the good dictionary saves more."""
        data = (text or "").encode()
        return (len(self.with_bad.compress(data)) - len(self.with_good.compress(data))) / len(data) if data else 0.0


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method for standardised columns and an intercept, with a little ridge."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[:-1] / sd
    return np.append(slope, w[-1] - slope @ mean)


def train(docs: DataFrame, labels: DataFrame, max_dictionary: int = 3000, max_calibration: int = 3000, dict_bytes: int = 1_000_000, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Dictionaries from folds 1 to 3 (at most max_dictionary labelled rows of each label, and of these dict_bytes) and a calibration from fold 4
    (at most max_calibration rows): bounded seeded samples. The driver gets the cuts and the calibration rows' differences, no whole text."""
    marked = marks_of(labels, "quality", id_col)
    groups = [marked.where(f"fold in (1, 2, 3) and label = {k}") for k in (1, 0)]
    picked = [sample_ids(g, max_dictionary).withColumn("part", F.lit(i)) for i, g in enumerate(groups)]
    ids = picked[0].unionByName(picked[1]).drop("label", "fold")
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).where("text <> ''")
    cut = F.lit(max(200, dict_bytes // max_dictionary))  # a cut starts anywhere in the text
    start = F.pmod(F.xxhash64(F.lit(19), "_id"), F.greatest(F.length("text") - cut + 1, F.lit(1))) + 1
    cuts = own.join(F.broadcast(ids), "_id").groupBy("part", "_id").agg(F.min(F.substr("text", start.cast("int"), cut)).alias("cut"))  # ids: 2 * max_dictionary rows
    rows = sorted((r["part"], r["_id"], r["cut"]) for r in cuts.collect())
    good, bad = (b"\n".join(c.encode() for p, _, c in rows if p == k)[-dict_bytes:] for k in (0, 1))
    model = {"good": good, "bad": bad, "level": level, "w": np.zeros(2)}
    held = sample_ids(marked.where("fold = 4"), max_calibration).select("_id", "label")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(held), "_id")  # held: max_calibration rows
    found = differences(rows, model, "_id", "text", ["label"]).toArrow()
    x, y = found.column("difference").to_numpy(), found.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, x))  # the same under any partitioning
    if not len(y) or y.min() == y.max():
        model["w"] = np.array([0.0, 0.0 if not len(y) else 30.0 if y[0] else -30.0])
    else:
        model["w"] = logistic(x[order, None], y[order])
    return model


def differences(docs: DataFrame, model: dict, id_col: str, text_col: str, beside: list[str]) -> DataFrame:
    """(id, difference, columns beside) of every whole text. The model is two dictionaries of dict_bytes, so it travels with the tasks."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model["good"], model["bad"], model["level"])
        for b in slices(batches, "_text"):
            x = pa.array([sizes.difference(t.as_py()) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), x, *(b.column(c) for c in beside)], ["_id", "difference", *beside])

    kinds = ", ".join(["", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in beside)])
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *beside)
    return own.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, difference double{kinds}").withColumnRenamed("_id", id_col)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference, score) of every whole text."""
    slope, bias = map(float, model["w"])
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.col("difference") + bias))
    return differences(docs, model, id_col, text_col, []).withColumn("score", 1 / (1 + F.exp(-z)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")
