import random
import re

import numpy as np
import pytest

from lodestrand.llm import near_dedup as N
from tests.llm.conftest import frame, sentence


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    """{doc_id: (n, component)} for distinct non-null ids."""
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng):
    base = [sentence(rng, 150).split() for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("light", [32, 4])
def test_groups_equal_brute_force(spark, light, monkeypatch):
    monkeypatch.setattr(N, "LIGHT", light)  # with 4, most keys go the way of heavy ones
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 2000)
    rows = near_copies(random.Random(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(odd, odd_rows):
    out = N.near_duplicates(odd, 2).collect()
    assert len(out) == len(odd_rows)
    want = brute(odd_rows, 2)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_empty(empty):
    assert N.near_duplicates(empty).collect() == []


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        values = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        both = int(share * 2000)
        a, b = np.unique(values[:2000]), np.unique(values[2000 - both : 4000 - both])
        r = N.registers([a, b]).reshape(2, -1)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = N.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.15
    least = np.array([0, 1, 2**63, 2**64 - 2, 2**64 - 1], dtype=np.uint64)
    assert N.compress(least)[4] == 0 and (N.compress(least)[:4] > 0).all()


def test_repeated_ids_join_their_texts(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, None), (1, None), (6, ""), (6, sentence(rng, 70))]
    out = N.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows]), 2).collect()
    got = {(r.doc_id, r.component_id, r.kept) for r in out}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (1, 1, True), (6, 6, True)}
    assert len(out) == len(rows)


def test_hot_classes_are_salted(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 2)
    rows = near_copies(random.Random(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == brute(rows, 2)
