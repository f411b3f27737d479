import itertools
import random
import re
from collections import Counter

import numpy as np

from lodestrand.llm import crf
from lodestrand.llm import quality_rules as Q
from tests.llm.conftest import frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    spots = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(spots)
    covered = {j for i, s in enumerate(spots) if counts[s] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def labelled(spark, rng, n=200):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = [("### " + sentence(rng, 6).replace(" ", " | ") + " $$$") if bad else sentence(rng, 12).capitalize() + "." for _ in range(8)]
        rows.append((1000 + i, "\n".join(lines), "en", "s"))
        marks.append((1000 + i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_base_counts_and_verdicts(spark, odd, odd_rows):
    rng = random.Random(6)
    rows, labels = labelled(spark, rng)
    line = sentence(rng, 9)
    rows += [(1, "\n".join([line, line, " " + line, ""]), "en", "s"), (2, "a a a a a a a", "en", "s"), *[(3000 + (i or 0), t, la, s) for i, t, la, s in odd_rows]]
    docs = frame(spark, rows)
    field = Q.train(docs, labels)
    texts = {i: t for i, t, *_ in rows}
    out = Q.judge(docs, field).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id < 3000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
        if 1000 <= r.doc_id < 3000 and not r.base_failed:
            assert r.kept == ((r.doc_id - 1000) % 4 != 0)
    odd_out = {r.doc_id: r for r in Q.judge(odd, field).collect()}
    for i, t, *_ in odd_rows:
        r = odd_out[i]
        if i is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
    assert not odd_out[4].kept and odd_out[4].content_share == 0


def test_empty_and_no_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = Q.train(odd, none)
    assert Q.judge(empty, field).collect() == []
    assert all(r.kept != r.base_failed for r in Q.judge(odd, field).collect())


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(30):
        field = crf.Crf(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
        masks = rng.integers(1, 16, size=rng.integers(1, 8)).tolist()

        def score(labels):
            return sum(field.scores(m)[y] for m, y in zip(masks, labels)) + sum(field.transition[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=len(masks)), key=score)
        assert list(best) == field.decode(masks, {})
    assert field.decode([], {}) == []


def test_trained_on_all_lines(spark):
    """Only beyond line 200 do the texts of either label differ."""
    rng = random.Random(8)
    same = [sentence(rng, 12).capitalize() + "." for _ in range(210)]
    tail = {1: [f"Plain words here {i}." for i in range(300)], 0: [f"### | {i} | $$$" for i in range(300)]}
    rows = [(i, "\n".join(same + tail[i % 2]), "en", "s") for i in range(20)]
    field = Q.train(frame(spark, rows), spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    good, bad = (field.scores(Q.lines_of("\n".join(["x"] + tail[q] + ["x"]).encode())[0][150]) for q in (1, 0))
    assert good[1] - good[0] > 0.5 and bad[0] - bad[1] > 0.5


def test_blocks_make_no_difference(monkeypatch):
    rng = np.random.default_rng(4)
    sequences = [(rng.integers(1, 64, size=n).tolist(), int(n % 2)) for n in (1, 2, 700, 3, 40, 41, 5, 5, 300)]
    one = crf.train(sequences, 6, steps=20)
    monkeypatch.setattr(crf, "CELLS", 90)
    many = crf.train(sequences, 6, steps=20)
    assert np.allclose(one.emission, many.emission) and np.allclose(one.transition, many.transition)


def test_lines_are_split_where_they_change(spark):
    """A good text with a boilerplate head, middle or end: the field marks those lines and no others."""
    rng = random.Random(12)
    rows, labels = labelled(spark, rng)
    field = Q.train(frame(spark, rows), labels)
    bad = lambda: "### " + sentence(rng, 6).replace(" ", " | ") + " $$$"
    good = lambda: sentence(rng, 12).capitalize() + "."
    for at, n in ((0, 5), (9, 4), (15, 5), (0, 0)):
        lines = [bad() if at <= i < at + n else good() for i in range(20)]
        masks, *_ = Q.lines_of("\n".join(lines).encode())
        assert field.decode(masks, {}) == [0 if at <= i < at + n else 1 for i in range(20)]


def test_gradient_equals_enumeration():
    """The gradient of the mean log likelihood against differences of it, by all labellings."""
    rng = np.random.default_rng(3)
    of, lengths = rng.integers(0, 4, size=(4, 3)).astype(np.int32), np.array([4, 3, 1])
    y = rng.integers(0, 2, size=(4, 3)).astype(np.int8)
    scores, tr = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))

    def likelihood(scores, tr):
        total = 0.0
        for i, n in enumerate(lengths):
            value = lambda labels: sum(scores[of[t, i], labels[t]] for t in range(n)) + sum(tr[a, b] for a, b in itertools.pairwise(labels))  # noqa: B023, E731
            total += (value(y[:n, i].tolist()) - np.logaddexp.reduce([value(ls) for ls in itertools.product((0, 1), repeat=int(n))])) / n
        return total

    grad_m, grad_t = np.zeros((4, 2)), np.zeros((2, 2))
    crf._add_gradient(of, lengths, y, scores, tr, grad_m, grad_t)
    for grad, which in ((grad_m, 0), (grad_t, 1)):
        for spot in np.ndindex(grad.shape):
            pair = [scores.copy(), tr.copy()], [scores.copy(), tr.copy()]
            pair[0][which][spot] += 1e-5
            pair[1][which][spot] -= 1e-5
            assert abs((likelihood(*pair[0]) - likelihood(*pair[1])) / 2e-5 - grad[spot]) < 1e-6
