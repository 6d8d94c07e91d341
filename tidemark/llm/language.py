"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of a bounded sample of its labelled text gives, from any point of a new text, the
longest match with the sample. A text is cut greedily into such longest matches (phrases); the language
that needs the fewest phrases per letter wins. Texts are laid out in blocks of BLOCK symbols, so that a numpy table walks many blocks of
whole texts side by side; a block whose predecessor ends within a phrase is walked again from there, until all blocks agree.

Every non-null lang value with a row outside the held-out fold is learned, and every letter of a sample is a symbol of its own, whatever the
script. The tables are kept by edges, so their size does not grow with the alphabet; languages are scored in blocks of LANGUAGES, of which
a worker holds one at a time, and the least phrase count over all blocks wins.

Defined cases: `und` with score 0 if the text is null, empty or has no letter, or if no language was learned; ties go to
the first language by name. Null ids are predicted and never learned from. A text of any length is parsed whole. Repeated rows give repeated
predictions, and in a sample make it smaller. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, slices, small_batches, table, texts_of

BLOCK = 1024
#: Symbol 0 is anything but a letter or one of the learned letters' symbols.
OTHER = 0
#: Languages whose tables are held at once.
LANGUAGES = 32


def suffix_automaton(symbols: list[int], sigma: int) -> tuple[list[dict[int, int]], int]:
    """Each state's transitions symbol -> state in the suffix automaton of one string, and the number of symbols; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, sigma


def phrase_table(automaton: tuple[list[dict[int, int]], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, slots, root). Slot base[state] + symbol has state * 2 ** 32 + next if the state has that transition, else another state's or -1; a phrase
    then ends before the symbol, which starts the next phrase at root[symbol] (the root itself for an unlearned symbol)."""
    states, sigma = automaton
    base, used, found = np.zeros(len(states), np.int64), bytearray(4 * len(states) + sigma), {}
    at: dict[int, int] = {}  # by number of transitions: where the last such state went
    first = 0
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        edges = states[s]
        if not edges:
            break
        c0 = min(edges)
        f = max(first, c0) if len(edges) == 1 else at.get(len(edges), 0) + c0
        while True:
            if f + sigma > len(used):
                used.extend(bytes(len(used) + sigma))
            free = used.find(0, f)
            f = len(used) if free < 0 else free
            if free >= 0 and f + sigma <= len(used):
                if not any(used[f - c0 + c] for c in edges):
                    break
                f += 1
        base[s] = at[len(edges)] = f - c0
        for c, t in edges.items():
            used[f - c0 + c] = 1
            found[f - c0 + c] = (s << 32) + t
        free = used.find(0, first)
        first = len(used) if free < 0 else free
    slots = np.full(int(base.max()) + sigma, -1, np.int64)
    slots[list(found)] = list(found.values())
    root = np.zeros(sigma, np.int64)
    for c, t in states[0].items():
        root[c] = t
    return base, slots, root


def symbols_of(text: str, code: np.ndarray) -> np.ndarray:
    """The text's symbols; runs of OTHER count as one."""
    x = code[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
    return x[(x != OTHER) | np.append(True, x[:-1] != OTHER)] if len(x) else x


def train(docs: DataFrame, max_chars: int = 30_000, max_docs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Samples from rows outside the held-out fold with a non-null lang: per language at most max_docs seeded rows, of which max_chars characters are used."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang")).where(F.col("_id").isNotNull() & F.col("lang").isNotNull() & (fold_of("_id") != 0))
    w = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(17), F.col("_id")), "_id")
    ids = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_docs)  # limited in each task before the shuffle
    ids = ids.groupBy("_id", "lang").agg(F.min("rank").alias("rank"))  # repeated rows make the sample smaller
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))  # lower case is never shorter
    rows = texts_of(docs, ids, id_col, text_col).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_chars)
    samples: dict[str, str] = {}
    for r in rows.orderBy("lang", "rank").select("lang", F.substring("text", 1, max_chars).alias("text")).collect():  # less than 2 * max_chars characters a language
        if len(samples.setdefault(r["lang"], "")) < max_chars:
            samples[r["lang"]] += r["text"].lower() + "\n"
    samples = {k: v[:max_chars] for k, v in sorted(samples.items())}
    letters = sorted(map(ord, {c for v in samples.values() for c in set(v) if c.isalpha()}))
    return {"letters": letters, "sigma": len(letters) + 2, "samples": samples}


def tables_of(spark: SparkSession, model: dict, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The phrase tables of some languages, each built by a task of its own."""
    letters, sigma = model["letters"], model["sigma"]
    build = lambda x: (x[0], phrase_table(suffix_automaton(symbols_of(x[1], letter_codes(letters, sigma)).tolist(), sigma)))
    return dict(spark.sparkContext.parallelize([(k, model["samples"][k]) for k in names], len(names)).map(build).collect())


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """The code points of all letters."""
    return np.array([c for c in range(0x110000) if chr(c).isalpha()])


def letter_codes(letters: list[int], sigma: int) -> np.ndarray:
    """code point -> symbol: a learned letter has its own, another letter the last, anything else OTHER."""
    code = np.zeros(0x110000, np.int32)
    code[alphabet()] = sigma - 1
    code[letters] = np.arange(1, len(letters) + 1)
    return code


def walk(blocks: np.ndarray, lengths: np.ndarray, phrases: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases that end, state at the end) of each row of blocks [n, BLOCK] from its state, of which the first lengths symbols count; rows must come longest first."""
    state, count = state.copy(), np.zeros(len(blocks), np.int64)
    base, slots, root = phrases
    live = np.searchsorted(-lengths, -np.arange(blocks.shape[1]), side="left")
    columns = np.ascontiguousarray(blocks.T)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        n = live[j]
        c, s = columns[j, :n], state[:n]
        step = slots[base[s] + c]
        goes = step >> 32 == s
        count[:n] += ~goes
        state[:n] = np.where(goes, step & 0xFFFFFFFF, root[c])
    return count, state


def count_phrases(blocks: np.ndarray, lengths: np.ndarray, before: np.ndarray, phrases: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Phrases that end in each block; before is the row of the same text's block before, or -1."""
    entry = np.zeros(len(blocks), np.int64)
    count, state = walk(blocks, lengths, phrases, entry)
    while True:
        now = np.where(before >= 0, state[before], 0)
        again = np.flatnonzero(now != entry)
        if not len(again):
            return count
        entry = now
        count[again], state[again] = walk(blocks[again], lengths[again], phrases, entry[again])


def laid_out(texts: list[str | None], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, their lengths, the row of the block before or -1, the text each is of, symbols [text]) of whole texts, longest blocks first."""
    parts, owner = [], []
    total = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        s = symbols_of(t or "", code)
        total[i] = len(s)
        for at in range(0, len(s), BLOCK):
            parts.append(s[at : at + BLOCK])
            owner.append(i)
    lengths, owner = np.array([len(x) for x in parts], np.int64), np.array(owner, np.int64)
    order = np.argsort(-lengths, kind="stable")
    row = np.argsort(order)
    before = np.full(len(parts), -1, np.int64)
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    before[row[follows]] = row[follows - 1]
    blocks = np.zeros((len(parts), BLOCK), np.int32)
    for r, k in enumerate(order):
        blocks[r, : lengths[k]] = parts[k]
    return blocks, lengths[order], before, owner[order], total


def counts_in(blocks: np.ndarray, lengths: np.ndarray, before: np.ndarray, owner: np.ndarray, total: np.ndarray, tables: dict) -> np.ndarray:
    """Phrases [text, language] of the texts."""
    out = np.repeat((total > 0).astype(np.int64)[:, None], len(tables), axis=1)
    for j, phrases in enumerate(tables.values()):
        np.add.at(out[:, j], owner, count_phrases(blocks, lengths, before, phrases))
    return out


def phrase_counts(texts: list[str | None], model: dict, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases [text, language], symbols [text]) of whole texts."""
    *where, total = laid_out(texts, code)
    return counts_in(*where, total, model["tables"]), total


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the winner's share of the softmax of -8 * (phrases over the fewest phrases)."""
    spark = docs.sparkSession
    small_batches(spark)
    names, letters, sigma = [*model["samples"]], model["letters"], model["sigma"]
    groups = [names[at : at + LANGUAGES] for at in range(0, len(names), LANGUAGES)]
    sent = [spark.sparkContext.broadcast(tables_of(spark, model, group)) for group in groups]  # a table takes some 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = letter_codes(letters, sigma)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            where = laid_out(texts, code)
            counts = []
            for one in sent:
                counts.append(counts_in(*where, one.value))
                if len(sent) > 1 and getattr(one, "_path", None):
                    vars(one).pop("_value", None)  # read again from the executor's file when its turn comes
            pred, score = [], []
            for t, c in zip(texts, np.hstack(counts) if counts else texts, strict=True):
                if not names or not t or not any(map(str.isalpha, t)):
                    pred.append("und")
                    score.append(0.0)
                    continue
                e = np.exp(-8 * (c / c.min() - 1))
                pred.append(names[int(np.argmin(c))])
                score.append(float(1 / e.sum()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score")
