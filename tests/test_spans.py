"""Span de-duplication without a task that holds a conversation, against ``without_seen``."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrand.operators import spans

SCHEMA = "conv_id long, seq long, definer boolean, text string"


def brute(rows, k):
    held = defaultdict(list)
    for conv, seq, definer, text in rows:
        held[conv].append((not definer, seq is None, seq or 0, text or ""))
    out = Counter()
    for conv, texts in held.items():
        texts.sort(key=lambda t: t[:3])
        for (_, missing, seq, text), left in zip(texts, spans.without_seen([(t[3], t[0]) for t in texts], k)):
            out[conv, None if missing else seq, left, left != text] += 1
    return out


def found(spark, rows, k):
    return Counter(tuple(r) for r in spans.dedupe_spans(spark.createDataFrame(rows, SCHEMA), k).collect())


def mosaics(seed, conversations, texts, words):
    """Texts glued from pieces of earlier ones, so that matches overlap, break off and go on in other sources."""
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        said = []
        for seq in range(texts):
            own = []
            for _ in range(draw.randrange(1, 7)):
                if said and draw.random() < 0.75:
                    old = draw.choice(said)
                    a = draw.randrange(len(old) + 1)
                    own += old[a : a + draw.randrange(1, 14)]
                else:
                    own += [draw.choice(words) for _ in range(draw.randrange(1, 9))]
            said.append(own)
            rows.append((conv if conv else None, seq, draw.random() < 0.2, " ".join(own)))
    return rows


@pytest.mark.parametrize("k, words", [(2, "abcdef"), (4, "ab"), (5, "abcdefghijk"), (9, "abcd")])
def test_as_in_memory(spark, k, words):
    rows = mosaics(k, 12, 25, list(words))
    assert found(spark, rows, k) == brute(rows, k)


def test_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(80))
    rows = [(1, 1, True, run), (1, 2, False, f"x\n {run}  \n"), (1, 2, None, ""), (1, 3, False, None), (1, None, False, f"{run} {run}"), (None, 1, False, run), (None, 2, False, run), (2, 1, False, run)]
    whole = [(*r[:2], bool(r[2]), r[3]) for r in rows]
    assert found(spark, rows, 70) == brute(whole, 70)
    assert found(spark, rows, 1) == brute(whole, 1)
    assert found(spark, [], 70) == Counter()
    again = [(3, 1, False, run)] * 3
    assert found(spark, again, 70) == Counter({(3, 1, run, False): 1, (3, 1, "", True): 2})


def test_no_task_holds_a_conversation(spark):
    rows = [(1, i, False, " ".join(f"w{i}.{j}" for j in range(90))) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = spans.dedupe_spans(df, 70)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CoGroup" not in plan
    # nothing is sent by conversation: windows go where windows with their anchor go
    sent = spans.stretches([r[3] for r in rows], np.ones(len(rows), dtype=np.int64), 70)
    assert len(set(sent[1].tolist())) >= len(rows)


def test_tokens_of_any_text():
    texts = ["", " ", "a", " a  b\n", "é　b\x1cc \U0001F600", "a b"]
    h, first = spans.token_hashes(texts)
    words = [t for text in texts for t in spans.tokens(text)]
    assert list(np.diff(first)) == [len(spans.tokens(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(words)) and len({*zip(words, h.tolist())}) == len(set(words))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["ab cde  f " * 7, "x" * 50, "ab cde"]
    whole = spans.token_hashes(texts)[0].tolist()
    monkeypatch.setattr(spans, "_AT_ONCE", 4)
    assert spans.token_hashes(texts)[0].tolist() == whole
