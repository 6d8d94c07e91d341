"""Each stage of the pipeline on what the one before kept, against plain versions."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import mixing
from tidemark.llm.tokens import default_vocabulary
from test_near_texts import brute as near_brute
from test_repeats import brute as repeat_brute


@pytest.fixture(scope="module")
def run_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in ids if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, run_dir, monkeypatch):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "suffix", "mixing", "bpe"]
    docs = spark.read.parquet(f"{run_dir}/documents.parquet")
    at = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, run_dir).persist()
        if name != "bpe":
            assert docs.columns == before.columns
            at[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(at["toxicity"].items()) <= set(at["documents"].items())
    rows = [*at["toxicity"].items()]
    assert set(at["minhash"]) == {c for *_, c in near_brute(rows, 5, 80)} and set(at["minhash"].items()) <= set(rows)
    want = repeat_brute(at["minhash"], 100)
    for i, (n_bytes, n_removed, _, digest) in want.items():
        if i in at["suffix"]:
            text = at["suffix"][i]
            assert n_removed == 0 or len((text or "").encode()) <= n_bytes - n_removed
            if (text or "").isascii() and (at["minhash"][i] or "").isascii():
                assert hashlib.sha256((text or "").encode()).hexdigest() == digest
        else:
            assert n_removed > 0
    taken = mixing.mix(spark.createDataFrame([(i, t, None, None) for i, t in at["suffix"].items()], "doc_id long, text string, lang string, source string"), mixing.domain_of(F.col("source")), 0.95, 1)
    assert taken.count() == len(at["suffix"]) and set(at["mixing"].items()) <= set(at["suffix"].items())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    for r in docs.collect():
        ids = t.encode(at["mixing"][r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, run_dir).collect()) == sorted(at["mixing"])


def test_empty_and_repeated_rows(spark, run_dir, tmp_path):
    docs = spark.read.parquet(f"{run_dir}/documents.parquet")
    labels = spark.read.parquet(f"{run_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    few = docs.where("doc_id < 30")
    null = few.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    few.unionByName(few).unionByName(null).write.mode("overwrite").parquet(f"{tmp_path}/twice/documents.parquet")
    labels.write.parquet(f"{tmp_path}/twice/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and None in ids and len(ids) > 3
    assert {r.ids_sha256 for r in rows if r.doc_id is None} == {hashlib.sha256(b"").hexdigest()}
