import math
import random
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tidemark.llm import language, quality, toxicity
from tidemark.llm.common import fold_of

RUDE = "grumbler snarler scowler jeerer".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    sound = {"aa": "ba na lo mi ra te su".split(), "bb": "xu krz wj pfo ztt gru".split()}
    rows, marks = [], []
    for i in range(900):
        lang = "aa" if i % 3 else "bb"
        word = lambda s=sound[lang]: "".join(rng.choice(s) for _ in range(rng.randint(1, 3)))
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        text = " ".join(words)
        rows.append((i, text if good else " ".join(f"{w.upper()}!!" for w in words), lang))
        if i % 2:
            marks.append((i, good, toxic))
    rows += [(900, None, "aa"), (901, "", "bb"), (None, "ba na lo", None), (902, "12 34 ...", None)]
    marks += [(901, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, label string")
    return docs, spark.createDataFrame([(*m, "y") for m in marks], "doc_id long, quality int, toxic int, text string")


def accuracy(rows, truth, of):
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    return np.mean([of(r) == truth(r.doc_id) for r in held])


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held_out", fold_of() == 0).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, lambda i: i % 7 == 0, lambda r: r.score >= 0.5) > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.5}
    empty = toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels))
    assert empty.count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect())


def test_nnpu_recovers_a_direction():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    x = (rng.random((6000, 20)) < np.where(y[:, None], 0.6, 0.2) * np.r_[np.ones(10), np.zeros(10)] + 0.1).astype(np.float32)
    w, b = toxicity.nnpu_fit(x[y][:800], x, 0.3, seed=0)
    assert ((x @ w + b > 0) == y).mean() > 0.9


def test_risk_gradient_and_fit_against_plain_loops():
    rng = np.random.default_rng(4)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))

    def risk(p, u, w, b, prior):
        out = lambda x: sigmoid(sum(a * c for a, c in zip(x, w, strict=True)) + b)
        positive = sum(1 - out(x) for x in p) / len(p)
        negative = sum(out(x) for x in u) / len(u) - prior * sum(out(x) for x in p) / len(p)
        return prior * positive, negative

    for prior in (0.1, 0.8):  # the second makes the bracket negative
        p, u, w, b = rng.integers(0, 2, (5, 3)).astype(float), rng.integers(0, 2, (9, 3)).astype(float), rng.normal(size=3), 0.2
        if prior > 0.5:
            p, u, w, b = np.maximum(p, [1, 1, 0]), np.minimum(u, [0, 0, 1]), np.array([1.2, 1.4, 0.1]), -1.0
        sp, su = (1 / (1 + np.exp(-(x @ w + b))) for x in (p, u))
        value, step = toxicity.nnpu_gradient(p, u, sp, su, prior)
        pos, neg = risk(p, u, w, b, prior)
        assert value == pytest.approx(pos + max(0, neg)) and (neg < 0) == (prior == 0.8)
        aim = (lambda *a: sum(risk(*a))) if neg >= 0 else (lambda *a: -risk(*a)[1])
        for k in range(4):
            d = np.eye(4)[k] * 1e-5
            slope = (aim(p, u, w + d[:3], b + d[3], prior) - aim(p, u, w - d[:3], b - d[3], prior)) / 2e-5
            assert step[k] == pytest.approx(slope, rel=1e-3, abs=1e-6)

    # the whole fit, element by element
    p, u, prior, rate, l2 = rng.integers(0, 2, (6, 3)).astype(np.float32), rng.integers(0, 2, (8, 3)).astype(np.float32), 0.3, 0.02, 1e-4
    theta, m, v, order = [0.0, 0.0, 0.0, -0.1], [0.0] * 4, [0.0] * 4, np.random.default_rng(7)
    for t in range(1, 6):
        order.permutation(8), order.permutation(6)
        sp, su = ([sigmoid(sum(float(np.float32(a)) * c for a, c in zip(theta[:3], x, strict=True)) + theta[3]) for x in rows] for rows in (p, u))
        bracket = sum(su) / 8 - prior * sum(sp) / 6
        for k in range(4):
            col = lambda x: 1.0 if k == 3 else float(x[k])  # noqa: E731, B023
            gp, gu = sum(s * (1 - s) / 6 * col(x) for s, x in zip(sp, p, strict=True)), sum(s * (1 - s) / 8 * col(x) for s, x in zip(su, u, strict=True))
            g = (gu - 2 * prior * gp if bracket >= 0 else -(gu - prior * gp)) + (l2 * theta[k] if k < 3 else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        theta = [x - rate * (a / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for x, a, c in zip(theta, m, v, strict=True)]
    w, b = toxicity.nnpu_fit(p, u, prior, 7, epochs=5, rate=rate, l2=l2)
    assert [*w, b] == pytest.approx(theta, rel=1e-4, abs=1e-5)


def test_toxic_scores_against_plain_sums(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    weight = dict(zip(model["features"].tolist(), model["weights"].tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in toxicity.score(docs, model).where("doc_id is not null").collect():
        keys = {k for w in toxicity.WORD.findall((texts[r.doc_id] or "").lower()) for k in (f"w {w}", *(f"{n} {w[:n]}" for n in (4, 5, 6) if len(w) >= n))}
        z = model["bias"] + sum(weight.get(x, 0.0) for x in {crc32(k.encode()) % (1 << 20) for k in keys})
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    # the prior and the samples
    marks = [m for m in labels.where("toxic is not null and doc_id is not null").collect() if crc32(str(m.doc_id).encode()) % 5]
    train = {"p": [m.doc_id for m in marks if m.toxic], "u": [i for i in texts if crc32(str(i).encode()) % 5]}
    count = lambda ids, k: sum(k in toxicity.text_features(texts[i]) for i in ids)
    for k in model["features"].tolist()[:40]:
        a, b = (count(train[x], k) / len(train[x]) for x in "pu")
        share = (count(train["p"], k) + count(train["u"], k)) / sum(map(len, train.values()))
        assert abs(a - b) / math.sqrt(share * (1 - share) * sum(1 / len(x) for x in train.values()) + 1e-12) > 3


def test_quality_against_plain_versions(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    marks = {r.doc_id: r.quality for r in labels.where("quality is not null and doc_id is not null").collect()}
    fold = lambda i: crc32(str(i).encode()) % 5
    for label, side in ((1, "good"), (0, "bad")):
        own = {texts[i] for i, q in marks.items() if q == label and fold(i) in (1, 2, 3) and texts[i]}
        cuts = model[side].decode().split("\n")
        assert len(cuts) == len(own) and all(any(c in t for t in own) for c in cuts)
    sizes = {}
    for side in ("good", "bad"):
        d = zstandard.ZstdCompressionDict(model[side], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        z = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[side] = {i: len(z.compress(t.encode())) for i, t in texts.items()}
    want = {i: (sizes["bad"][i] - sizes["good"][i]) / len(t.encode()) if t else 0.0 for i, t in texts.items()}
    a, b = model["w"]
    for r in quality.score(docs, model).where("doc_id is not null").collect():
        assert r.difference == want[r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, a * want[r.doc_id] + b)))), rel=1e-9)
    # the calibration is where the penalised loss is flat
    x, y = zip(*[(want[i], q) for i, q in marks.items() if fold(i) == 4], strict=True)
    mean, sd = np.mean(x), np.std(x) + 1e-9
    slope, level = a * sd, b + a * mean
    over = [1 / (1 + math.exp(-(slope * (v - mean) / sd + level))) - q for v, q in zip(x, y, strict=True)]
    assert sum(o * (v - mean) / sd for o, v in zip(over, x, strict=True)) + 1e-2 * slope == pytest.approx(0, abs=1e-5)
    assert sum(over) + 1e-2 * level == pytest.approx(0, abs=1e-5)


def test_very_long_texts_and_repeated_rows(corpus):
    docs, labels = corpus
    long = docs.where("doc_id = 12").select("doc_id", F.repeat(F.concat("text", F.lit("\n")), 9000).alias("text"), "lang", "label")  # more than a slice
    more = docs.unionByName(docs.where("doc_id in (12, 40)")).unionByName(long.withColumn("doc_id", F.lit(5000).cast("long")))
    for rows in (
        toxicity.score(more, toxicity.train(more, labels)).select("doc_id", "score").collect(),
        quality.score(more, quality.train(more, labels, dict_bytes=4000)).select("doc_id", "score").collect(),
        language.predict(more, language.train(more)).select("doc_id", F.col("lang_pred").alias("score")).collect(),
    ):
        assert len(rows) == 907
        at = {}
        for r in rows:
            at.setdefault(r.doc_id, []).append(r.score)
        assert len(at[12]) == len(at[40]) == 2 and len(set(at[12])) == len(set(at[40])) == 1 and len(at[5000]) == 1
    assert at[5000][0] == at[12][0]  # the language of a text is that of its repetition


def test_quality(corpus):
    docs, labels = corpus
    rows = quality.score(docs, quality.train(docs, labels, dict_bytes=4000)).withColumn("held_out", fold_of() == 0).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, lambda i: i % 5 != 0, lambda r: r.score >= 0.3) > 0.95
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
    for label in (0, 1):  # with one label only, its share
        one = quality.score(docs, quality.train(docs, labels.where(f"quality = {label}"), dict_bytes=4000)).collect()
        assert len(one) == 904 and all(abs(r.score - label) < 1e-12 for r in one)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_language(corpus):
    docs, _ = corpus
    model = language.train(docs)
    rows = language.predict(docs, model).withColumn("held_out", fold_of() == 0).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, lambda i: "aa" if i % 3 else "bb", lambda r: r.lang_pred) > 0.95
    odd = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None and r.doc_id >= 900}
    assert odd == {900: "und", 901: "und", 902: "und"}
    assert {r.lang_pred for r in language.predict(docs, language.train(docs.limit(0))).collect()} == {"und"}
    empty = language.predict(docs.limit(0), language.train(docs))
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang_pred", "score"]
    assert language.predict(docs.limit(0), language.train(docs.limit(0))).count() == 0


def test_many_languages_and_scripts(spark):
    """More languages than a block of tables has, each with letters of its own from the rare ones; every one must be told apart."""
    rng = random.Random(5)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(i % 70) for _ in range(40)), f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predict(docs, language.train(docs)).collect()
    assert len(out) == 700 and {r.doc_id: r.lang_pred for r in out} == {i: lang for i, _, lang in rows}


def test_letters_of_every_plane():
    code = language.letter_codes([ord("a")], 3)
    assert [code[ord(c)] for c in "aｂ中\U00020000ﬁ🙂 1"] == [1, 2, 2, 2, 2, 0, 0, 0]


def test_phrases_against_greedy_search():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc") for _ in range(300))
    model = {"letters": [ord(c) for c in "abc"], "sigma": 8}
    code = language.letter_codes(model["letters"], 8)
    model["tables"] = {"x": language.phrase_table(language.suffix_automaton(language.symbols_of(sample, code).tolist(), 8))}
    for n in (1, 5, 50, 900, 1024, 1025, 5000):  # longer texts go over several blocks
        text = "".join(rng.choice("abcd") for _ in range(n))
        count, match = 1, ""
        for c in text:
            if match + c in sample:
                match += c
            else:  # a symbol that the sample lacks starts a phrase, too
                count, match = count + 1, c if c in sample else ""
        assert language.phrase_counts([text], model, code)[0][0, 0] == count
