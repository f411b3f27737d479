import random
import zlib

from lodestrand.llm import language_id as L
from tests.llm.conftest import frame

SYLLABLES = {"en": "th ing er on the and wh".split(), "de": "sch ung ein ich der üb ge".split(), "fr": "eau tion é oi le que ai".split(), "es": "ción os ar ll ñ que el".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, la, rng.randrange(8, 80)), la if i % 9 else None, "s") for i, la in enumerate(random.Random(2).choices(list(SYLLABLES), k=600))]
    truth = {i: la for (i, *_), la in zip(rows, random.Random(2).choices(list(SYLLABLES), k=600))}
    out = L.identify(frame(spark, rows)).collect()
    assert len(out) == 600
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 100


def test_inputs_do_not_leak(spark):
    """Neither lang, source nor doc_id of a row changes its prediction."""
    rng = random.Random(4)
    rows = [(i, text(rng, la, 30), la, la) for i, la in enumerate(list(SYLLABLES) * 40)]
    model = L.train(frame(spark, rows))
    other = [(i + 7, t, "zz", None) for i, t, _, _ in rows]
    predict = lambda df: [r.lang_pred for r in L.tag(df, model).orderBy("doc_id").collect()]
    assert predict(frame(spark, rows)) == predict(frame(spark, other))


def test_odd_rows(odd, odd_rows, empty):
    out = L.identify(odd).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r for r in out}
    for i in (4, 5, 6, 14):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[13].lang_pred in ("en", "fr", "de") and by[None].held_out is False
    assert L.identify(empty).collect() == []


def test_one_language_and_none(spark):
    rows = [(i, f"word{i} again", "xx", "s") for i in range(40)]
    assert {(r.lang_pred, r.score) for r in L.identify(frame(spark, rows)).collect()} == {("xx", 1.0)}
    unknown = [(i, "some words", None, "s") for i in range(3)]
    assert {r.lang_pred for r in L.identify(frame(spark, unknown)).collect()} == {"und"}
