import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tidemark.llm import mixing


def domain():
    return mixing.domain_of(F.col("source"))


def fill(budget, children):
    """children: name -> (weight, capacity). Water filling with exact fractions, then rounded down."""
    open_, got = dict(children), {}
    while open_:
        shares = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if shares and c * shares <= budget * w and w]
        if not full:
            return got | {n: int(Fraction(budget * w, shares)) if shares else 0 for n, (w, _) in open_.items()}
        least = min(full, key=lambda n: Fraction(open_[n][1], open_[n][0]))
        got[least] = open_.pop(least)[1]
        budget -= got[least]
    return got


def brute(rows, share, epochs, weights, seed):
    docs = []
    for r in rows:
        source, lang = r.source or "", r.lang or ""
        n = re.search(r"([0-9]+)$", source)
        docs.append((f"d{int(n[1]) % 3 if n else 0}", lang, source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.doc_id))
    tokens = defaultdict(int)
    for *leaf, n, _ in docs:
        tokens[tuple(leaf)] += n
    weight = lambda path: weights.get("/".join(path), weights.get("*/" * (len(path) - 1) + path[-1], 1))
    can = {leaf: epochs * t if all(weight(leaf[: k + 1]) > 0 for k in range(3)) else 0 for leaf, t in tokens.items()}
    level = {(): min(sum(tokens.values()) * round(share * 1000) // 1000, sum(can.values()))}
    for depth in range(3):
        below = {}
        for parent, budget in level.items():
            names = {leaf[: depth + 1] for leaf in tokens if leaf[:depth] == parent}
            below |= fill(budget, {n: (weight(n), sum(c for leaf, c in can.items() if leaf[: depth + 1] == n)) for n in sorted(names)})
        level = below
    out = []
    for leaf, budget in level.items():
        full = budget // tokens[leaf] if tokens[leaf] else 0
        rest = budget - full * tokens[leaf]
        key = lambda d: hashlib.md5(f"{seed}:{full}:{'' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
        own = sorted((key(d[4]), d) for d in docs if d[:3] == leaf)
        for k, d in own:
            upto = sum(x[3] for y, x in own if y <= k)
            out.append((d[4], *d[:4], full + (upto <= rest and tokens[leaf] > 0)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "epochs", "weights"), [(0.5, 2, {"d0": 5, "*/en": 3}), (1.7, 2, {"d1": 9, "d0/en": 4, "*/*/s1": 0}), (0.9, 1, {}), (5.0, 2, {})])
def test_against_brute_force(docs, share, epochs, weights):
    got = mixing.mix(docs, domain(), share, epochs, weights).collect()
    assert sorted(((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in got), key=str) == brute(docs.collect(), share, epochs, weights, 13)


def test_kept_rows_and_both_joins(docs, no_docs, monkeypatch):
    want = {r.doc_id for r in mixing.mix(docs, domain(), 0.6, 1).collect() if r.copies}
    for leaves in (20_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
        kept = mixing.keep_mixed(docs, domain(), 0.6)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == want
    assert mixing.mix(no_docs, domain()).count() == 0 and mixing.keep_mixed(no_docs, domain(), 0.5).count() == 0


def test_shortage_stays_in_the_family(spark):
    text = lambda n: " ".join("w" * n)
    rows = [(i, text(10), lang, source) for i, (lang, source) in enumerate([("en", "s3")] * 2 + [("en", "s6")] * 30 + [("de", "s3")] * 30 + [("en", "s1")] * 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), domain(), 0.4, 1).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.domain, r.lang, r.source] += r.n_tokens * r.copies
    # 102 documents of 10 words: 408 tokens, 204 for each domain; s3 in English fills only 20 of its 51, its sibling s6 takes the rest of 102
    assert tokens == {("d0", "en", "s3"): 20, ("d0", "en", "s6"): 80, ("d0", "de", "s3"): 100, ("d1", "en", "s1"): 200}


def test_what_a_leaf_of_weight_0_cannot_take_goes_to_others(spark):
    text = lambda n: " ".join("w" * n)
    rows = [(i, text(10), "en", source) for i, source in enumerate(["s3"] * 40 + ["s6"] * 20 + ["s1"] * 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), domain(), 0.5, 1, {"*/*/s3": 0}).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.source] += r.n_tokens * r.copies
    assert tokens == {"s3": 0, "s6": 200, "s1": 300}


def test_a_leaf_without_tokens_as_in_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "a b c d", "en", "src1"), (2, "e f", "en", "src1"), (3, None, "en", "src3"), (4, "", "en", "src3"), (5, None, None, "src9"), (6, "g h i", "de", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = dict(c.execute(f"select doc_id, copies from ({mixing.MIXING_SQL})").fetchall())
    got = {r.doc_id: r.copies for r in mixing.mix(docs, domain(), weights=mixing.WEIGHTS).collect()}
    assert got == want and got[3] == got[4] == got[5] == 1
    assert {3, 4, 5} <= {r.doc_id for r in mixing.keep_mixed(docs, domain(), 0.5, mixing.WEIGHTS).collect()}
