"""Line-first cleaning.

Every line of a whole text is judged on its own by punctuation, navigation and boilerplate rules. Lines that fail are
removed; then the document is rejected if it lost too much of its text, on top of base rules on the whole text
(too few words, too many words in repeated three-word windows).

Words are runs of anything but ASCII white space, in every count and rule. The rules look at marks, links, figures, capitals and repetition, whatever
the language. Stock phrases are a set for each language that the caller may replace; stock lines are learned from the corpus itself, in any language: lines of 3
to 30 words (white space and numbers made alike) that stand near many different lines, up to three lines away, so blocks of up to three stock lines are found whole. A line
of a group of copies or near copies stands near the same few lines however large the group is, so it is none. Equal texts count once.

Defined cases: null text counts as empty: no words, base rules fail; a text of any length is judged whole, one at a time; an empty table
gives no rows; repeated rows give repeated results; an only line has no neighbour and teaches nothing. Other columns are never read. Lines and texts are told
apart by 128 bits of hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import collapsed, materialise, salted_join, slices, small_batches, table

SPACE = " \t\n\x0b\x0c\r"
#: ASCII white space to spaces: words are what stands between these, here and in every rule.
TO_SPACES = str.maketrans(SPACE, " " * len(SPACE))
SYMBOLS = "#*$%&|<>"
#: Stock phrases by language, regular expressions in any case. Other sets may be given.
PHRASES = {
    "en": [
        "all rights reserved", "terms of (use|service)", "privacy policy", "cookie", "javascript", "copyright", "licensed under", "permission is hereby granted", "subscribe (to|now)", "sign (in|up)",
        "log ?in\\b", "click here", "read more", "share (this|on)", "follow us", "skip to (main )?content", "powered by",
    ],
}
MENU = re.compile(r"[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]")
FIGURE = re.compile(r"[0-9][^\x20\x09-\x0D]*")
#: Every number to 0, so that page numbers and years make no new line.
NUMBER = re.compile(rb"[0-9]+")
#: Words of a line that may be stock, and how many lines away its neighbours are (fewer where the text ends).
SHORTEST, LONGEST, REACH = 3, 30, 3
#: Stock lines up to which their list is broadcast (24 bytes each); a longer one is joined.
FEW_LINES = 50_000


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(TO_SPACES).split(" ") if w]


def punctuation_fails(line: str, words: list[str], symbol_share: float = 0.1, shout_share: float = 0.3, capital_share: float = 0.7) -> bool:
    """Too many symbols, too many words that end in several exclamation or question marks, or four words or more of which too many are in capitals."""
    symbols = sum(map(line.count, SYMBOLS))
    shouts = sum(map(line.count, ("!! ", "?? "))) + line.rstrip(SPACE).endswith(("!!", "??"))
    if symbols > symbol_share * len(line) or shouts > shout_share * len(words):
        return True
    most = capital_share * len(words)
    if len(words) < 4 or len(words) - sum(map(str.islower, words)) <= most:  # a word in capitals is never lower case
        return False
    return sum(w == w.upper() and w != w.lower() for w in words) > most


def navigation_fails(line: str, words: list[str], link_share: float = 0.3) -> bool:
    """A menu (three items or more between separators), or a line of links."""
    items = len(MENU.findall(line))
    return (items >= 2 and items * 8 >= len(words)) or line.count("://") + line.count("www.") > link_share * len(words)


def boilerplate_fails(line: str, words: list[str], phrases: re.Pattern, figure_share: float = 0.6) -> bool:
    """In a line of at most 30 words a stock phrase, or three words or more of which most hold figures (dates, prices); or a longer line that mostly says the same words."""
    if len(words) <= 30 and (phrases.search(line) or (len(words) >= 3 and len(FIGURE.findall(line)) > figure_share * len(words))):
        return True
    return len(words) >= 20 and 4 * len(set(words)) < len(words)


def phrase_pattern(phrases: dict[str, list[str]]) -> re.Pattern:
    return re.compile("|".join(x for own in phrases.values() for x in own) or r"(?!)", re.IGNORECASE)


def judged_lines(text: str, phrases: re.Pattern) -> Iterator[tuple[str, list[str], bool]]:
    """Each line, its words, and whether it fails a rule."""
    for line in text.split("\n"):
        words = words_of(line)
        yield line, words, bool(words) and (punctuation_fails(line, words) or navigation_fails(line, words) or boilerplate_fails(line, words, phrases))


def name_of(words: list[str]) -> bytes:
    """128 bits of hash of a line, whatever its white space and numbers."""
    return xxhash.xxh3_128_digest(NUMBER.sub(b"0", " ".join(words).encode()))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measures(text: str) -> dict:
    """The base counts of a whole text."""
    words = text.encode().split()  # bytes.split takes ASCII white space only
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeats += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(words),
    }


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


LINE = ("h0", "h1", "before", "after", "chars")


def _judge(phrases: dict[str, list[str]], with_text: bool):
    """Texts -> base counts, failed lines, code points in words of the others, and of those that may be stock the name, the neighbours' names and the code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = phrase_pattern(phrases)
        for b in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in (*COLUMNS, "failed", "chars")}
            names, own, cleaned, ends = [], [], [], [0]  # own: (position among the names, those of its text's first and last line, code points)
            for value in b.column("text"):
                text = value.as_py() or ""
                kept, may, failed, chars = [], [], 0, 0
                begin = len(names)
                for line, words, fails in judged_lines(text, pattern):
                    if words:
                        names.append(name_of(words))
                    if fails:
                        failed += 1
                        continue
                    n = sum(map(len, words))
                    chars += n
                    if SHORTEST <= len(words) <= LONGEST:
                        may.append((len(names) - 1, n))
                    if with_text:
                        kept.append(line)
                for k, v in (measures(text) | {"failed": failed, "chars": chars}).items():
                    out[k].append(v)
                cleaned.append("\n".join(kept) if with_text else None)
                own += [(at, begin, len(names) - 1, n) for at, n in may]
                ends.append(len(own))
            h = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            at, first, last, n = np.array(own, np.int64).reshape(-1, 4).T
            beside = [pa.array(h[np.maximum(at - REACH, first), 0], mask=at == first), pa.array(h[np.minimum(at + REACH, last), 0], mask=at == last)]
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(h[at, 0]), pa.array(h[at, 1]), *beside, pa.array(n)], LINE))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("k0"), b.column("k1"), *(pa.array(v, pa.int64()) for v in out.values()), pa.array(cleaned, pa.string()), lines], ["_id", "k0", "k1", *out, "cleaned", "lines"])

    return run


def stock_lines(lines: DataFrame, contexts: int, percent: int) -> DataFrame:
    """(h0, h1, _lines: how often) of the lines (h0, h1, before, after) that have at least `contexts` different lines before, or after, them, and so many that they are
    `percent` of the times at which the line has such a neighbour. A frequent line's rows are dealt out by its neighbours, and counted before each shuffle."""
    sides = lines.select("h0", "h1", F.posexplode(F.array("before", "after")).alias("side", "by"))
    beside = sides.groupBy("h0", "h1", "side", "by").agg(F.count("*").alias("n"))
    each = beside.groupBy("h0", "h1", "side").agg(F.count("by").alias("different"), F.coalesce(F.sum(F.when(F.col("by").isNotNull(), F.col("n"))), F.lit(0)).alias("times"), F.sum("n").alias("all"))
    varied = (F.col("different") >= contexts) & (100 * F.col("different") >= percent * F.col("times"))
    return each.groupBy("h0", "h1").agg(F.max("all").alias("_lines"), F.max(varied).alias("_stock")).where("_stock").drop("_stock")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines named in `_names` out of `cleaned`."""
    for b in slices(batches, "cleaned"):
        texts = []
        for text, names in zip(b.column("cleaned"), b.column("_names"), strict=True):
            gone = {np.array([x["h0"], x["h1"]], "<i8").tobytes() for x in names.as_py() or []}
            lines = text.as_py().split("\n")
            texts.append("\n".join(x for x in lines if not gone or not SHORTEST <= len(w := words_of(x)) <= LONGEST or name_of(w) not in gone))
        beside = [c for c in b.schema.names if c not in ("cleaned", "_names")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in beside), pa.array(texts, pa.string())], [*beside, "cleaned"])


def clean(docs: DataFrame, most_lost: float = 0.5, phrases: dict[str, list[str]] | None = None, contexts: int | None = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: the base counts, base_failed, n_lines_removed, lost (the share of word characters in removed lines), kept, and
    with_text the text of the lines that pass. contexts, percent: what makes a line stock (see stock_lines); None learns none."""
    small_batches(docs.sparkSession)
    kind, text = docs.schema[id_col].dataType.simpleString(), F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1"), F.col(text_col).alias("text"))
    schema = f"_id {kind}, k0 bigint, k1 bigint, " + ", ".join(f"{c} bigint" for c in (*COLUMNS, "failed", "chars")) + ", cleaned string, lines array<struct<" + ", ".join(f"{c}: bigint" for c in LINE) + ">>"
    rows = own.mapInArrow(_judge(PHRASES if phrases is None else phrases, with_text), schema)
    if contexts is None:
        return _verdict(rows.withColumns({"_gone": F.lit(0), "_n": F.lit(0)}), most_lost, id_col, with_text)

    rows = materialise(rows, "lines")  # texts are judged once
    texts = collapsed(rows.select("k0", "k1", "lines"), ["k0", "k1"])
    lines = texts.select("k0", "k1", "_copies", F.explode("lines").alias("l")).select("k0", "k1", "_copies", "l.*")
    stock = materialise(stock_lines(lines, contexts, percent), "stock")
    lines = lines.drop("before", "after")
    if stock.count() <= FEW_LINES:
        found = lines.join(F.broadcast(stock.drop("_lines")), ["h0", "h1"])
    else:
        found = salted_join(lines, stock, ["h0", "h1"], "_lines", stock.agg(F.sum("_lines")).first()[0], "k0")
    names = [F.collect_set(F.struct("h0", "h1")).alias("_names")] if with_text else []
    of_text = found.groupBy("k0", "k1").agg(F.first("_copies").alias("_copies"), F.sum("chars").alias("_gone"), F.count("*").alias("_n"), *names)
    rows = salted_join(rows.drop("lines"), materialise(of_text, "stock_of_texts"), ["k0", "k1"], "_copies", rows.count(), "_id", how="left").drop("k0", "k1")
    if with_text:
        rows = rows.mapInArrow(_without, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("cleaned", "_names")) + ", cleaned string")
    return _verdict(rows, most_lost, id_col, with_text)


def _verdict(rows: DataFrame, most_lost: float, id_col: str, with_text: bool) -> DataFrame:
    gone: Column = F.coalesce("_gone", F.lit(0))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - (F.col("chars") - gone) / F.col("word_chars")).otherwise(F.lit(0.0)))
    removed, kept = (F.col("failed") + F.coalesce("_n", F.lit(0))).alias("n_lines_removed"), (~F.col("base_failed") & (F.col("lost") <= most_lost)).alias("kept")
    return rows.select(F.col("_id").alias(id_col), *COLUMNS, "base_failed", removed, "lost", kept, *(["cleaned"] if with_text else []))


def op6_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"), with_text=False)
