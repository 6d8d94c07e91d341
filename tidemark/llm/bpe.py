"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts each text into chunks, so that equal passages give equal chunks in any
document. Chunks that occur more than once are encoded once, by the document that holds their first
occurrence; every other document takes their ids over. At a chunk's edges its ids may differ from those of the
whole text, so each join is repaired: the text from the last point in the left chunk to the first point in the
right chunk at which both encodings must agree is encoded again. Such a point is a space between two letters (of the Latin, Greek, Cyrillic, Hebrew,
Arabic or Hangul script): the pre-tokenizer always starts a piece there, whatever stands around it. A chunk without two such points is
not taken over at all, so the window grows to the next point, in the last resort to the whole text. Ids taken over are
checked against the chunk's 128-bit content hash.

Defined cases: null text counts as empty (no ids); the strings of special tokens become their ids; repeated rows are
encoded each time; rows with equal ids and different texts are told apart by a hash of both; a text of any length is cut, assembled and decoded whole,
by one task at a time; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import collapsed, copied, materialise, release, salted_join, second_hash, slices, small_batches, table, written
from tidemark.llm.tokens import encoder

WINDOW, MEAN, LEAST, MOST = 32, 2048, 512, 16384
#: An odd multiplier of the rolling hash and its inverse modulo 2 ** 64.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
#: Bytes of text that are hashed at a time.
STEP = 2 << 20
#: UTF-8 of letters in blocks that every Unicode version has alike: Latin, Greek, Cyrillic, Hebrew, Arabic, Hangul.
LETTERS = (
    rb"[A-Za-z]",
    rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f]|\xce[\x91-\xa1\xa3-\xbf]|\xcf[\x80-\x8e]|\xd0[\x80-\xbf]|\xd1[\x80-\xbf]|\xd2[\x80\x81]|\xd7[\x90-\xaa]|\xd8[\xa1-\xba]|\xd9[\x81-\x8a]",
    rb"\xea[\xb0-\xbf][\x80-\xbf]|[\xeb\xec][\x80-\xbf][\x80-\xbf]|\xed[\x80-\x9d][\x80-\xbf]",
)
AGREE = re.compile(b"(?:" + b"|".join(b"(?<=" + x + b")" for x in LETTERS) + b") (?=" + b"|".join(LETTERS) + b")")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (P, P_INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last WINDOW bytes says cut."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    up, down = powers(len(data))
    s = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    h = s[WINDOW - 1 :].copy()
    h[1:] -= s[:-WINDOW]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(64 - MEAN.bit_length() + 1)) == 0) + WINDOW


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Per text the ends of its chunks, each at the border of a character; they depend on the text alone."""
    out: list[list[int]] = []
    at = 0
    while at < len(texts):
        group, n = [], 0
        while at < len(texts) and (not group or n + len(texts[at]) <= STEP):
            group.append(texts[at])
            n += len(texts[at])
            at += 1
        data = np.frombuffer(b"".join(group), np.uint8)
        cuts = cut_candidates(data)
        start = 0
        for t in group:
            end = start + len(t)
            own = cuts[np.searchsorted(cuts, start + WINDOW) : np.searchsorted(cuts, end)].tolist()
            ends, last = [], start
            for c in [*own, end]:
                while c - last > MOST:
                    last += MOST
                    while data[last] & 0xC0 == 0x80:
                        last -= 1
                    ends.append(last - start)
                if c < end and (c - last < LEAST or data[c] & 0xC0 == 0x80):
                    continue
                if c > last:
                    ends.append(c - start)
                last = c
            out.append(ends)
            start = end
    return out


def agreement(chunk: bytes) -> tuple[int, int] | None:
    """The first and the last point of a chunk at which its own encoding must agree with that of any text around it."""
    first = AGREE.search(chunk)
    if first is None:
        return None
    last = first.start()
    at = len(chunk)
    while (at := chunk.rfind(b" ", last + 1, at)) > last:
        if AGREE.match(chunk, at):
            last = at
            break
    return (first.start(), last) if last > first.start() else None


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("_k"), second_hash(docs, id_col, text).alias("_c"), F.col(id_col).alias("_id"), text.alias("_text"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        texts = [t.encode() for t in b.column("_text").to_pylist()]
        keys, at, hashes = [], [], []
        for k, t, ends in zip(b.column("_k").to_pylist(), texts, chunk_ends(texts), strict=True):
            start = 0
            for i, end in enumerate(ends):
                keys.append(k)
                at.append(i)
                hashes.append(xxhash.xxh3_128_digest(t[start:end]))
                start = end
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())], ["_k", "at", "h"])


def _encode_chunks(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in slices(batches, "_text"):
            rows = [(t.encode(), {x["at"]: x["n"] for x in first}) for t, first in zip(b.column("_text").to_pylist(), b.column("firsts").to_pylist(), strict=True)]
            hashes, ids, n = [], [], []
            for (t, first), ends in zip(rows, chunk_ends([t for t, _ in rows]), strict=True):
                for i in sorted(first):
                    chunk = t[ends[i - 1] if i else 0 : ends[i]]
                    if (points := agreement(chunk)) is not None:
                        hashes.append(xxhash.xxh3_128_digest(chunk))
                        ids.append(e.encode(chunk[points[0] : points[1]].decode()).astype("<u4").tobytes())
                        n.append(first[i])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], ["h", "ids", "n"])

    return run


def join_chunks(text: bytes, ends: list[int], shared: dict[int, tuple[bytes, bytes]], e) -> np.ndarray:
    """The ids of a text of which some chunks (number -> content hash, ids between its points of agreement) are known."""
    parts, done = [], 0
    for i in sorted(shared):
        start, end = (ends[i - 1] if i else 0), ends[i] if i < len(ends) else -1
        chunk = text[start:end]
        h, ids = shared[i]
        if end < 0 or xxhash.xxh3_128_digest(chunk) != h:
            continue
        first, last = agreement(chunk)
        parts += [e.encode(text[done : start + first].decode()), np.frombuffer(ids, "<u4")]
        done = start + last
    parts.append(e.encode(text[done:].decode()))
    return np.concatenate(parts)


def _assemble(vocabulary: str | None, output):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in slices(batches, "_text"):
            texts, known = b.column("_text").to_pylist(), b.column("known").to_pylist()
            some = [i for i, k in enumerate(known) if k]
            ends = dict(zip(some, chunk_ends([texts[i].encode() for i in some]), strict=True))
            encoded = [join_chunks(t.encode(), ends[i], {x["at"]: (x["h"], x["ids"]) for x in known[i]}, e) if known[i] else e.encode(t) for i, t in enumerate(texts)]
            yield output(b.column("_id"), encoded, e)

    return run


def _whole(ids: pa.Array, encoded: list[np.ndarray], e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([x.astype(np.int64).tolist() for x in encoded], pa.list_(pa.int64())), pa.array([e.decode(x) for x in encoded], pa.string())], ["_id", "ids", "decoded"])


def _digests(ids: pa.Array, encoded: list[np.ndarray], e) -> pa.RecordBatch:
    hexes = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in encoded], pa.int64()), hexes(x.tobytes() for x in encoded), hexes(e.decode(x).encode() for x in encoded)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids, decoded) of every whole text, or (id, n_tokens, ids_sha256, decoded_sha256) with digests.

    Repeated rows (equal id and text) are encoded once. The texts are shuffled once, by row: both branches of the plan, that of the chunks' first occurrences and
    that of the documents, read the same exchange. All else that is shuffled is hashes and shared chunks' ids.
    """
    small_batches(docs.sparkSession)
    keyed = collapsed(_keyed(docs, id_col, text_col), ["_k", "_c"]).select("_k", F.struct("_id", "_copies").alias("_id"), "_text")
    others = written()
    chunks = materialise(keyed.select("_k", "_text").mapInArrow(_chunks, "_k bigint, at int, h binary"), "chunks")
    shared = chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_k", "at")).alias("first")).where("n > 1").withColumn("_n", F.col("n"))
    marked = salted_join(chunks, shared, ["h"], "_n", chunks.count(), "_k", "at")
    marks = materialise(marked.select("h", "_k", "at", "n", (F.col("first") == F.struct("_k", "at")).alias("is_first")), "marks")
    release(docs.sparkSession, [*others, written()[-1]])
    firsts = marks.where("is_first").groupBy("_k").agg(F.collect_list(F.struct("at", "n")).alias("firsts"))
    rows = keyed.repartition("_k")  # both branches take the same columns of it, so Spark reuses the exchange
    cores = rows.join(firsts.hint("shuffle_hash"), "_k").select("_id", "_text", "firsts").mapInArrow(_encode_chunks(vocabulary), "h binary, ids binary, n bigint")
    known = salted_join(marks.select("h", "_k", "at"), cores, ["h"], "n", marks.count(), "_k", "at", counted=marks.where("is_first").select("h", "n").distinct())
    known = known.groupBy("_k").agg(F.collect_list(F.struct("at", "h", "ids")).alias("known"))
    kind = keyed.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string")
    both = rows.join(known.hint("shuffle_hash"), "_k", "left").select("_id", "_text", "known")
    out = both.mapInArrow(_assemble(vocabulary, _digests if digests else _whole), schema)
    return copied(out.select(F.col("_id._id").alias(id_col), *[c for c in out.columns if c != "_id"], F.col("_id._copies").alias("_copies")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
