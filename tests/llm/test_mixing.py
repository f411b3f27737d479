import hashlib
import random
import re

import xxhash

from lodestrand.llm import mixing as M
from tests.llm.conftest import frame, sentence


def targets(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            out |= {s: level * weights[s] for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return out


def brute(rows):
    """{(doc_id, text, source): copies} by walking each source's order, row by row."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, _, s in rows:
        by.setdefault(s, []).append((i, t, size(t)))
    totals = {s: sum(n for *_, n in d) for s, d in by.items()}
    target, out = targets(totals), {}
    for s, docs in by.items():
        whole = int(target[s] // totals[s]) if totals[s] else 0
        rest = target[s] - whole * totals[s]
        moment = sum(n * n.bit_length() for *_, n in docs)
        ranks = {}
        for i, t, n in docs:
            if n and rest > 0:
                h = xxhash.xxh64(t.encode(), seed=42).intdigest()
                key = f"{M.SEED}|{'' if i is None else i}|{h - (1 << 64) * (h >> 63)}"
                u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                p = min(rest * n.bit_length() / moment, 0.999)
                odds = (u / (1 - u)) * ((1 - p) / p)
                ranks.setdefault((odds / (1 + odds), n), []).append((i, t, n))
        taken, left, limit, last = set(), rest, float("inf"), 0.0
        for turn in range(M.TURNS):
            groups = {}
            for (rank, n), docs_ in ranks.items():
                if rank > last and n <= limit:
                    groups.setdefault(rank, []).extend(docs_)
            filled, reached = 0, last if groups else 1.0
            full = True
            for rank in sorted(groups):
                words = sum(n for *_, n in groups[rank])
                if left <= 0 or filled + words / (2.0 if turn == M.TURNS - 1 else 1.0) > left:
                    full = False
                    break
                taken |= set(groups[rank])
                filled += words
                reached = rank
            left -= filled
            last = 1.0 if full else reached
            limit = min(limit, max(int(left // 1), 0))
        for i, t, n in docs:
            out[(i, t, s)] = (whole + ((i, t, n) in taken)) if n else 0
    return out, totals, target


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    sources = ["a"] * 6 + ["b", "c", "é", "Z", None, "tiny"]
    rows = [(i, sentence(rng, rng.choice([3, 20, 60, 300])), "en", rng.choice(sources[:-1])) for i in range(260)] + [(900, "one two", "en", "tiny")]
    want, totals, target = brute(rows)
    out = M.mix(frame(spark, rows)).collect()
    sources_of, texts = {i: s for i, _, _, s in rows}, {i: t for i, t, *_ in rows}
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        s = sources_of[r.doc_id]
        assert r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken == want[(r.doc_id, texts[r.doc_id], s)] * r.size <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - target[s]) <= 0.1 * target[s] + 10
    monkeypatch.setattr(M, "n_partitions", lambda spark: 37)
    again = M.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_odd_rows(odd, odd_rows, empty):
    out = M.mix(odd).collect()
    want, *_ = brute(odd_rows)
    assert len(out) == len(odd_rows)
    assert sorted(r.taken for r in out if r.doc_id in (4, 5, 6)) == [0, 0, 0]
    for r in out:
        assert r.taken <= 3 * r.size
    assert sum(r.taken for r in out) <= 3 * sum(r.size for r in out)
    assert M.mix(empty).collect() == [] and M.repeat_documents(empty).collect() == []
    repeated = M.repeat_documents(odd)
    assert repeated.columns == odd.columns
    assert repeated.count() == sum(r.taken // r.size for r in out if r.size)


def test_null_and_repeated_ids_meet_the_target(spark):
    """Rows without an id, or with one id, of one size are drawn apart."""
    rng = random.Random(2)
    rows = [(None if i % 3 else 7, sentence(rng, 20), "en", "a") for i in range(300)] + [(i + 10, sentence(rng, 20), "en", "b") for i in range(300)]
    want, totals, target = brute(rows)
    out = M.mix(frame(spark, rows)).collect()
    for s in "ab":
        words = sum(n * len(t.split()) for (_, t, of), n in want.items() if of == s)
        assert abs(words - target[s]) <= 20
    assert sum(r.taken for r in out) == sum(n * len(t.split()) for (_, t, _), n in want.items())


def test_clashing_names(spark):
    names = ["size", "source_size", "target", "copies", "row", "key", "rank", "rest", "whole", "cuts", "bin", "__size", "__source"]
    docs = spark.createDataFrame([(1, "a b c", "x", *range(13)), (2, "d e", None, *range(13))], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = M.repeat_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
