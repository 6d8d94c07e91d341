import hashlib

import numpy as np
import pytest
from tidemark.llm import bpe
from tidemark.llm.tokens import at_limits, default_vocabulary, encoder, length_histogram, quantiles, token_lengths


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_encoder_matches_the_library(texts, reference):
    e = encoder(None)
    for t in texts:
        ids = e.encode(t)
        assert ids.tolist() == reference[0](t)
        assert e.decode(ids) == reference[1](ids.tolist()) == (t or "")


def test_chunk_reuse_is_exact(docs, reference, monkeypatch):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    got = bpe.encode(docs, digests=True).collect()
    assert len(got) == docs.count()
    want = {}
    for i, t in rows:
        ids = reference[0](t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference[1](ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_join_chunks_repairs_every_join(texts, reference):
    e = encoder(None)
    joined = 0
    for t in texts:
        raw = (t or "").encode()
        ends = bpe.chunk_ends([raw])[0]
        assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
        shared = {}
        for i, end in enumerate(ends):
            chunk = raw[ends[i - 1] if i else 0 : end]
            if (p := bpe.agreement(chunk)) and i % 3 < 2:
                shared[i] = (bpe.xxhash.xxh3_128_digest(chunk), e.encode(chunk[p[0] : p[1]].decode()).astype("<u4").tobytes())
        joined += len(shared)
        assert bpe.join_chunks(raw, ends, shared, e).tolist() == reference[0](t)
    assert joined > 50


def test_chunks_depend_on_content_alone(texts):
    long = max((t or "" for t in texts), key=len).encode()
    alone = set(bpe.chunk_ends([long])[0])
    moved = {c - 7 for c in bpe.chunk_ends([b"prefix " + long])[0]}
    assert len(alone & moved) > 0.8 * len(alone)
    assert bpe.chunk_ends([b"zz", long, b""])[1] == sorted(alone)


def test_ids_and_text_of_the_general_interface(docs, no_docs):
    rows = bpe.encode(docs).collect()
    assert all(r.decoded == (t or "") for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [r.text for r in sorted(docs.collect(), key=lambda r: r.doc_id)], strict=True))
    assert bpe.encode(no_docs, digests=True).count() == 0


def test_histogram_against_brute_force(docs, no_docs, reference):
    lengths = sorted(len(reference[0](r.text)) for r in docs.collect())
    hist = length_histogram(token_lengths(docs), width=64)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_ge == sum(x >= n for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.doc_share == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in at_limits(hist, [0, 10, 128, 10**6]).collect():
        assert (r.docs_beyond, r.truncated_tokens) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    assert {round(r.share, 2): r.n_tokens for r in quantiles(hist, [0.5, 1.0]).collect()}[1.0] == lengths[-1]
    assert length_histogram(token_lengths(no_docs)).count() == 0
