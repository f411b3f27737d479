import hashlib
import random
from collections import Counter

import pytest

from lodestrand.llm import substring_dedup as S
from tests.llm.conftest import frame, sentence


def brute(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("batch", [24_000_000, 500])
@pytest.mark.parametrize("window", [35, 8, 3, 2])
def test_equals_brute_force(spark, window, batch, monkeypatch):
    rng = random.Random(window)
    passages = [sentence(rng, rng.randrange(window, 3 * window + 5)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), sentence(rng, rng.randrange(1, 30))]
        rows.append((i, " ".join(parts), "en", "s"))
    monkeypatch.setattr(S, "BATCH_BYTES", batch)
    assert got(S.removal(frame(spark, rows).repartition(5), window)) == brute(rows, window)


def test_odd_rows(odd, odd_rows):
    assert got(S.removal(odd)) == brute(odd_rows, 35)


def test_empty(empty):
    assert S.removal(empty).collect() == []


def test_texts(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "a " + " ".join(words) + " b", "en", "s"), (2, "c " + "\t".join(words), "en", "s")]
    assert {r.doc_id: r.text for r in S.without_repeats(frame(spark, rows)).collect()} == {1: "a b", 2: "c"}
