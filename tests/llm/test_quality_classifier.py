import random

from lodestrand.llm import quality_classifier as C
from tests.llm.conftest import frame, sentence


def corpus(rng, n=600):
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = sentence(rng, 60)
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            words = text.split()
            words[rng.randrange(len(words))] = "vileword"
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}"))
        if i % 3:
            marks.append((i, int(not bad), int(toxic)))
    return rows, marks


def sited(df):
    return df.withColumn("host", df.source).withColumn("path", df.lang)


def test_verdicts_on_unlabelled_documents(spark):
    rows, marks = corpus(random.Random(3))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in C.classify(sited(frame(spark, rows)), labels).collect()}
    unlabelled = [i for i in range(600) if i % 3 == 0]
    good = [i for i in unlabelled if i % 5 and i % 7]
    assert sum(out[i].kept for i in good) >= 0.98 * len(good)
    rest = [i for i in unlabelled if not (i % 5 and i % 7)]
    assert sum(not out[i].kept for i in rest) >= 0.95 * len(rest)


def test_sites_shrink(spark):
    """A host whose other documents are bad pulls an undecided one down; a host of one document pulls nothing."""
    schema = "doc_id long, host string, path string, e_quality long, e_toxic long"
    rows = [(i, "bad", "p", 50_000, 1000) for i in range(200)] + [(200 + i, "good", "p", 950_000, 1000) for i in range(200)]
    rows += [(900, "bad", "p", 500_000, 1000), (901, "good", "p", 500_000, 1000), (902, "alone", "p", 500_000, 1000), (903, None, None, 500_000, 1000)]
    out = {r.doc_id: r.p_quality for r in C.combine(spark.createDataFrame(rows, schema)).collect()}
    assert out[900] < 0.2 < 0.45 < out[902] < 0.55 < 0.8 < out[901]
    assert 0.45 < out[903] < 0.55


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (15, 0, 1), (15, 1, 0), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    out = C.classify(sited(odd), labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.p_quality <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(C.classify(sited(odd), none).collect()) == len(odd_rows)
    assert C.classify(sited(empty), labels).collect() == []
