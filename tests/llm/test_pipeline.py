import random

import corpus_pipeline as P
from lodestrand.llm import sharding
from tests.llm import test_decontamination, test_mixing, test_near_dedup, test_sharding
from tests.llm.test_language_id import text


def corpus():
    rng = random.Random(12)
    bench = [(i, text(rng, "en", 20)) for i in range(3)]
    rows = []
    for i in range(140):
        lang = rng.choice(["en", "de", "fr", "es"])
        rows.append((i, text(rng, lang, rng.randrange(30, 90)), lang if i % 8 else None, f"src{i % 5}" if i % 11 else None))
    for i in range(30):  # exact and near copies, contaminated documents, junk
        words = rows[i][1].split()
        if i % 2:
            words[len(words) // 2] = f"edit{i}"
        rows.append((200 + i, " ".join(words), rows[i][2], "src1"))
    rows += [(300 + i, text(rng, "en", 30) + " " + bench[i % 3][1], "en", "src2") for i in range(9)]
    rows += [(400, "123 !!", "en", "src0"), (401, None, "en", "src0"), (402, "", None, None), (5, rows[5][1], "de", "src3")]
    return rows, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, bench = corpus()
    folder = f"file://{tmp_path}/sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows
    for name, stage in P.STAGES:
        out = stage(spark, held, folder)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = f"{folder}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        held = spark.read.parquet(path)
        found = sorted((r.doc_id, r.text, r.source) for r in held.collect())
        if name == "language ID":
            kept = [r for r in kept if r[1] and any(c.isalpha() for c in r[1])]
            assert held.where("lang is null").count() == 0
        elif name == "near-duplicates":
            groups = test_near_dedup.brute(kept, P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
            first = {}
            for r in kept:
                if groups[r[0]][1] == r[0] and (r[0] not in first or r[1] < first[r[0]][1]):
                    first[r[0]] = r
            kept = list(first.values())
            assert len(found) == len({i for i, *_ in found})
            sources = {i: s for i, _, s in found}
            kept = [(i, t, la, sources[i]) for i, t, la, _ in kept]
        elif name == "decontamination":
            bad = {r[0] for r in test_decontamination.brute(kept, bench) if r[-1]}
            assert bad >= {r[0] for r in kept if 300 <= r[0] < 309}
            kept = [r for r in kept if r[0] not in bad]
        elif name == "mixing":
            copies, *_ = test_mixing.brute(kept)
            kept = [r for r in kept for _ in range(copies[(r[0], r[1], r[3])])]
        else:
            tree = sharding.balanced(P.SHARDS)
            assert all(r.shard == test_sharding.descend(str(r.doc_id), tree) for r in held.collect())
            for s in range(P.SHARDS):
                slots = sorted(r.slot for r in held.where(held["shard"] == s).collect())
                assert slots == list(range(len(slots)))
        assert [f[:2] for f in found] == sorted((r[0], r[1]) for r in kept), name
    assert P.run(spark, folder).count() == len(kept)


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert P.run(spark, folder).collect() == []
