import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import chat

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, position int, chunk string"


def plain_replay(events):
    """Messages of one conversation by a fold over a list."""
    messages = []  # [name, position, role, text]
    for _, seq, kind, name, role, text, *_ in sorted(set(events), key=lambda e: (e[1], e[2], e[3], e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")):
        at = next((i for i, m in enumerate(messages) if m[0] == name), None)
        if kind == "start" and at is None:
            if not any(m[0] == name for m in messages):
                messages.append([name, seq, role or "", text or "", False])
        elif at is not None:
            m = messages[at]
            if kind == "delta":
                m[3] += text or ""
            elif kind == "start":
                m[3] = text or ""
            elif kind == "edit":
                m[3] = text or ""
            elif kind == "regenerate":
                m[3] = ""
                for later in messages:
                    if later[1] > m[1]:
                        later[4] = True
    return [(m[2], m[3]) for m in sorted(messages, key=lambda m: (m[1], m[0])) if not m[4]]


def formatted(spark, events, **more):
    rows = chat.render(chat.replay(spark.createDataFrame(events, EVENTS).repartition(3)), **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        out.setdefault(r["conv_id"], []).append(r)
    return out


@given(st.lists(st.sampled_from([*"\\<>|[]/ISTN_imstarend\nS é🙂", *chat.CONTROL]), max_size=40).map("".join), st.text(alphabet="ab\\\n<|im_start|>", max_size=12))
@settings(max_examples=300, deadline=None)
def test_turns_are_reversible(text, role):
    t = chat.Template()
    turn, at, n = t.turn(t.escaper(), role, text)
    inside = turn[len(t.opens) : -len(t.closes)]
    assert not any(c in inside for c in t.control)
    assert list(chat.parsed(turn * 2, t.reader())) == [(role, text)] * 2
    assert chat.unescape(turn[at : at + n]) == text


def test_template_and_parser_refuse():
    with pytest.raises(ValueError):
        chat.Template(opens="<turn>")
    with pytest.raises(ValueError):
        list(chat.parsed("<|im_start|>user\nhello", chat.Template().reader()))


def test_random_logs(spark):
    rng = random.Random(3)
    events = []
    for conv in [*range(40), None]:
        own = []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.choice(["start", "start", "delta", "delta", "delta", "edit", "regenerate", "note"])
            own.append((conv, rng.randrange(20), kind, rng.randrange(5), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b<|im", "_end|>c", "\\", None]), 1, "x"))
        events += own + own[:2]
    got = formatted(spark, events)
    assert len(got) > 20
    for conv in {e[0] for e in events}:
        own = [e for e in events if e[0] == conv and e[2] != "note"]
        want = plain_replay(own)
        chunks = got.get(conv, [])
        assert [x for c in chunks for x in chat.parsed(c["formatted"], chat.Template().reader())] == want
        learned = [chat.unescape(c["formatted"][s["start"] : s["start"] + s["length"]]) for c in chunks for s in c["loss"]]
        assert learned == [t for r, t in want if r == "assistant"]


def test_edits_and_regenerations(spark):
    log = [(1, 1, "start", 1, "user", None, 0, ""), (1, 2, "delta", 1, None, "hel", 0, ""), (1, 3, "delta", 1, None, "lo", 0, ""), (1, 4, "start", 2, "assistant", "draft", 0, ""), (1, 5, "start", 3, "user", "no", 0, ""),
           (1, 6, "regenerate", 2, None, "ignored", 0, ""), (1, 7, "delta", 2, None, "good", 0, ""), (1, 8, "delta", 3, None, "late", 0, ""), (1, 9, "edit", 1, None, "hello!", 0, ""), (1, 10, "start", 4, "user", None, 0, ""), (2, 1, "delta", 9, "user", "no start", 0, "")]
    got = formatted(spark, log)
    assert list(got) == [1]
    assert list(chat.parsed(got[1][0]["formatted"], chat.Template().reader())) == [("user", "hello!"), ("assistant", "good"), ("user", "")]


def test_long_conversations_are_cut_between_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "word </s> " * 30) for i in range(50)] + [(2, 0, "user", "x" * 5000)]
    pieces = chat.replay(chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    chunks = chat.render(pieces, chunk=2000)
    kept = chunks.collect()
    assert len([r for r in kept if r["conv_id"] == 1]) > 5 and all(len(r["formatted"]) < 6000 for r in kept)
    one, many = (sorted(map(tuple, chat.read_back(x).collect())) for x in (chat.render(pieces), chunks))
    assert one == many and one[0][1] == 50


def test_table(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 2, "assistant", "é<s>"), (1, 2, "assistant", "é<s>"), (1, 1, "us\ner", "a\\b"), (None, 0, "user", "none"), (3, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, n int, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.replay(chat.log_of(df)))).collect()}
    order = [("user", "first"), ("", ""), ("us\ner", "a\\b"), ("assistant", "é<s>"), ("assistant", "é<s>")]
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert got[1]["loss_chars"] == 8 and got[1]["loss_sha256"] == hashlib.sha256("é<s>é<s>".encode()).hexdigest()
    assert got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 200_000
    assert chat.read_back(chat.render(chat.replay(chat.log_of(df.limit(0))))).count() == 0
