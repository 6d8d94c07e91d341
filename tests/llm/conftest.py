import random

import pytest

WORDS = "the of and reads quickly under bright stars while seven small boats drift along old rivers toward quiet harbours where people trade salt bread copper wool maps".split()


@pytest.fixture(scope="session")
def texts():
    """Prose with exact and near copies, shared passages, repeated lines, empty, null, tiny, very long and odd texts."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "s"]) for _ in range(n))
    passage = prose(60)
    base = [prose(rng.randint(30, 400)) for _ in range(40)]
    out = [*base, base[0], base[0], base[1]]
    for i in range(12):
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{prose(20)} {passage} {prose(25)}" for _ in range(8)]
    line = prose(12)
    out += ["\n".join([line, prose(40), line, prose(30), line]), "", None, "a", "  \n\t ", "one two three", "x" * 5000, "ab " * 3000, prose(6000)]
    out += ["żółć 東京で会いましょう 🙂🙂 naïve <|endoftext|> end " * 9, "it's <|endoftext|>we'll  go\n\n now" * 5, "A | B | C | D\nHome > Shop > Cart > Pay\n" + prose(60), "WOW!! SUCH!! TEXT!! HERE!! " * 20]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, None if i % 11 == 0 else "en", f"s{i % 3}", len(t or ""), i, "clash") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, h string")
    return df.repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
