"""Byte-level BPE encoding of whole texts, and the exact histogram of encoded lengths.

`Encoder` gives the ids that the tokenizers library gives for its JSON file with add_special_tokens=False and unused
truncation and padding. Texts of letters, marks and punctuation whose classes every Unicode version shares take
a faster library with the same vocabulary; all others take the tokenizers library itself.

`length_histogram` aggregates documents by encoded length. Suffix sums over the lengths then answer, for every
context limit, how many documents and tokens lie at or beyond it, and the total after truncation to it.
Defined cases: null text counts as empty, of length 0; a text of any length is encoded whole, one at a time; an empty table gives no rows;
repeated rows count each time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slices, small_batches, table

#: Outside these ranges the classes of characters may depend on a library's Unicode version.
UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞€™]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        from public_tokenizers import PATTERN

        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = set(special)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = b

    def encode(self, text: str | None) -> np.ndarray:
        """The ids, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if UNUSUAL.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """The encoder of this process; the path is that of the executor's own copy if none is given."""
    return Encoder(path or default_vocabulary())


def token_lengths(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([len(e.encode(t.as_py())) for t in b.column("text")], pa.int64())], ["_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, f"_id {kind}, n_tokens bigint").withColumnRenamed("_id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", width: int = 256) -> DataFrame:
    """One row per distinct length: n_docs of it; docs_ge and tokens_ge at or beyond it (suffix sums);
    truncated_tokens, the total if every document is cut to it; doc_share, the share of documents not beyond it.

    The histogram is written first, so that texts are encoded once; it has a row for each distinct length. Lengths are summed in
    ranges of `width`; a window over the few ranges gives each its offset, and windows inside the ranges run side by side.
    """
    n, in_range = F.col("n_docs"), Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    hist = materialise(lengths.groupBy(F.col(length_col).cast("bigint").alias("n_tokens")).agg(F.count("*").alias("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / width)), "lengths")
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = hist.groupBy("range").agg(F.sum(n).alias("d"), F.sum(n * F.col("n_tokens")).alias("t"))
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    out = hist.join(ranges.hint("merge"), "range")
    out = out.withColumn("docs_ge", F.col("d_beyond") + F.sum(n).over(in_range)).withColumn("tokens_ge", F.col("t_beyond") + F.sum(n * F.col("n_tokens")).over(in_range))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("t_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("docs_ge") + n) / F.col("d_all")).alias("doc_share"),
        F.col("t_all").alias("all_tokens"),
        F.col("d_all").alias("all_docs"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least the share of the documents do not exceed."""
    cuts = [F.min(F.when(F.col("doc_share") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    pairs = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]))
    return hist.agg(*cuts).select(pairs)


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_beyond, truncated_tokens) for a list of context limits, in one pass over the histogram."""
    beyond = [F.coalesce(F.sum(F.when(F.col("n_tokens") > c, F.col("n_docs"))), F.lit(0)).alias(f"b{i}") for i, c in enumerate(limits)]
    kept = [F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(c))), F.lit(0)).alias(f"k{i}") for i, c in enumerate(limits)]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("limit"), F.col(f"b{i}").alias("docs_beyond"), F.col(f"k{i}").alias("truncated_tokens")) for i, c in enumerate(limits)]))
    return hist.agg(*beyond, *kept).select(rows)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
