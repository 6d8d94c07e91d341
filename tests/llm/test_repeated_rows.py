"""A row that is given many times costs about as much as one, and comes out as often as it is given."""

import random
import time

import pytest
from tidemark.llm import bpe, near_texts, repeats

from tests.llm.conftest import WORDS

SCHEMA = "doc_id long, text string, lang string, _copies int, m map<string,int>"


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(11)
    words = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(4000)]
    near = list(words)
    near[7] = "changed"
    others = [(100 + i, " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(120)), "en", 1, {"a": i}) for i in range(40)]

    def table(r):
        rows = [(5, " ".join(words), "en", 1, {"a": 1})] * r + [(6, " ".join(near), "en", 2, None)] + others
        return spark.createDataFrame(rows, SCHEMA).repartition(6).persist()

    return {r: table(r) for r in (1, 1000)}


@pytest.mark.parametrize("name", ["bpe", "repeats", "near_texts", "rewrite", "keep_one"])
def test_a_thousand_copies_of_a_row(given, name):
    work = {"bpe": lambda d: bpe.encode(d, digests=True), "repeats": lambda d: repeats.remove_repeats(d, digests=True), "near_texts": near_texts.near_duplicates, "rewrite": lambda d: repeats.rewrite(d).select("doc_id", "text", "lang"), "keep_one": lambda d: near_texts.keep_one(d).select("doc_id", "text", "lang")}[name]
    found, took = {}, {}
    for r in (1, 1000):
        began = time.time()
        found[r] = sorted(map(tuple, work(given[r]).collect()))
        took[r] = time.time() - began
    once = [x for x in found[1] if x[0] == 5]
    many = [x for x in found[1000] if x[0] == 5]
    assert len(once) == 1 and many == once * (1 if name == "keep_one" else 1000)
    assert [x for x in found[1000] if x[0] != 5] == [x for x in found[1] if x[0] != 5]
    assert took[1000] < 10 * took[1] + 15
    if name == "near_texts":
        assert [x[2] for x in found[1] if x[0] in (5, 6)] == [5, 5]
    if name == "repeats":
        assert [x[2] for x in found[1] if x[0] == 6][0] > 20_000 and once[0][2] == 0
