import random
import re

import pytest
from tidemark.llm import cleaning
from tidemark.llm.cleaning import clean

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(words) < 1200 else None
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, covered if covered is None else len(covered)


def test_base_counts_and_verdict(docs, no_docs):
    source = {r.doc_id: r.text for r in docs.collect()}
    rows = clean(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, dup, covered = brute(source[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        if covered is not None:
            assert r.n_repeat_words == covered
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.kept and r.base_failed)
    assert clean(no_docs, with_text=False).count() == 0


def test_lines_are_judged_one_by_one(spark):
    prose = "\n".join(f"line {i} tells of boats {i * 7} and rivers {i * 5} near the town {i} where nobody {i * 3} sleeps" for i in range(12))
    rows = [(1, prose), (2, prose + "\nHome | Shop | Cart | Pay | Help\nAll rights reserved."), (3, "\n".join(f"buy{i} | sell{i} | hold{i} | wait{i} | go{i}" for i in range(30))), (4, "\n".join(f"GET{i}!! IT{i}!! NOW{i}!!" for i in range(40)))]
    got = {r.doc_id: r for r in clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].cleaned == prose and got[2].n_lines_removed == 2 and 0 < got[2].lost < 0.1


def test_one_notion_of_white_space(spark):
    """Unicode spaces are parts of words in the counts and in every rule."""
    rows = [(i, "\n".join(sep.join("abcdefghij") + f" word{j} is here" for j in range(20))) for i, sep in enumerate(["\u00a0", "\u3000", "\u2003", "\x0b", "\t"])]
    for r in clean(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        assert r.n_lines_removed == 0 and r.lost == 0 and r.cleaned == text
        assert (r.n_words, r.word_chars) == (len(WORD.findall(text)), sum(map(len, WORD.findall(text))))


def test_rules_without_a_language(spark):
    line = "Лодки плывут {0} к тихой гавани и люди там {0} торгуют солью."
    lines = {"links": "see https://a.example/x https://b.example/y www.c.example", "figures": "12.03.2020 19:30 4,99 EUR 7", "capitals": "ВСЁ ЭТО НАПИСАНО КРУПНО СОВСЕМ", "phrase": "Alle Rechte vorbehalten."}
    rows = [(i, "\n".join([*(line.format(f"слово{k}") for k in range(12)), x])) for i, x in enumerate(lines.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_lines_removed for r in clean(df).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    assert [r.n_lines_removed for r in clean(df, phrases={"de": ["alle rechte vorbehalten"]}).orderBy("doc_id").collect()] == [1, 1, 1, 1]


def test_sql_agrees(spark, docs, tmp_path):
    import duckdb
    from tidemark.llm.oracles import ORACLES

    distinct = docs.dropDuplicates(["doc_id"])
    distinct.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        names = [d[0] for d in c.execute(ORACLES["op6_cleaning"]).description]
        want = {r[0]: dict(zip(names, r, strict=True)) for r in c.fetchall()}
    got = {r.doc_id: r.asDict() for r in clean(distinct, with_text=False).collect()}
    assert got == want


def prose(rng, n):
    return "\n".join(" ".join("".join(rng.choice("abdeiklmnorstuv") for _ in range(rng.randint(2, 7))) for _ in range(10)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Three hundred texts, of which 80 end in one line and 80 in two of a language without phrases; sixty near copies; sixty equal texts."""
    rng = random.Random(4)
    own = [prose(rng, 9) for _ in range(300)]
    texts = [f"{t}\n  Visi  teisės saugomos {i}" if i < 80 else f"{t}\nSkaityk toliau čia dabar\nPuslapis {i} iš {i + 10}" if i < 160 else t for i, t in enumerate(own)]
    base = prose(rng, 12).split("\n")
    for i in range(60):
        lines = [*base]
        lines[i % 12] += f" changed{'x' * i}"
        texts.append("\n".join(lines))
    return texts + [own[299]] * 60 + [None, "", "one line only stands here"]


@pytest.mark.parametrize("few", [50_000, 0])
def test_stock_lines_are_learned(spark, corpus, monkeypatch, few):
    monkeypatch.setattr(cleaning, "FEW_LINES", few)
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in clean(df).collect()}
    assert len(got) == len(corpus)
    for i, text in enumerate(corpus):
        gone = 1 if i < 80 else 2 if i < 160 else 0
        lines = (text or "").split("\n")
        assert got[i].n_lines_removed == gone
        assert got[i].cleaned == "\n".join(lines[: len(lines) - gone])
        assert got[i].kept == (got[i].n_words >= 50)
        assert (got[i].lost > 0) == (gone > 0)
    plain = {r.doc_id: r.asDict() for r in clean(df, with_text=False).collect()}
    assert plain == {i: {k: v for k, v in r.asDict().items() if k != "cleaned"} for i, r in got.items()}
    assert all(r.n_lines_removed == 0 for r in clean(df, contexts=None).collect())


def test_sql_agrees_on_stock_lines(spark, corpus, tmp_path):
    import duckdb
    from tidemark.llm.oracles import ORACLES

    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        names = [d[0] for d in c.execute(ORACLES["op6_cleaning"]).description]
        want = {r[0]: dict(zip(names, r, strict=True)) for r in c.fetchall()}
    got = {r.doc_id: r.asDict() for r in clean(df, with_text=False).collect()}
    assert got == want
    assert sum(r["n_lines_removed"] for r in want.values()) == 240
