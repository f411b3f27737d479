import hashlib
import random
import re

import pytest

from lodestrand.llm import decontamination as D
from tests.llm.conftest import frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    patterns = {}
    for item, text in items:
        w = words_of(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            patterns.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words_of(text), set(), set()
        for k in {len(p) for p in patterns}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in patterns:
                    hit |= set(range(i, i + k))
                    found |= patterns[tuple(w[i : i + k])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("one_pass", [32_000_000, 300])
def test_equals_brute_force(spark, odd, odd_rows, one_pass, monkeypatch):
    monkeypatch.setattr(D, "PASS_BYTES", one_pass)
    rng = random.Random(2)
    texts = [sentence(rng, n) for n in (20, 13, 14, 12, 3, 1, 40)]
    items = [(i, t) for i, t in enumerate(texts)] + [(10, None), (11, ""), (12, "?!"), (None, texts[0]), (3, texts[0]), (100, texts[1])]
    rows = list(odd_rows)
    for i in range(40):
        t = rng.choice(texts)
        rows.append((100 + i, sentence(rng, rng.randrange(30)) + " " + (t.upper().replace(" ", ", ") if i % 2 else t) + "! " + sentence(rng, rng.randrange(400)), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(D.contamination(frame(spark, rows).repartition(3), bench)) == brute(rows, items)
    clean = D.clean(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(not r[-1] for r in brute(rows, items))


def test_empty(spark, empty, odd, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in D.contamination(odd, none).collect())
    assert D.contamination(odd, none).count() == len(odd_rows)
