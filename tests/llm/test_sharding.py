import math
import struct
import zlib
from collections import Counter

import xxhash

from lodestrand.llm import sharding as H
from tests.llm.conftest import frame


def draw(key, name, weight):
    h = xxhash.xxh64(key.encode(), seed=42).intdigest()
    h = xxhash.xxh64(name.encode(), seed=h).intdigest()
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def descend(key, tree):
    """The tree walked node by node."""
    for level in ("region", "rack"):
        weights = Counter()
        for s in tree:
            weights[getattr(s, level)] += s.weight
        if len(weights) > 1:
            best = min(weights, key=lambda g: (draw(key, f"{level}/{g}", weights[g]), g))
            tree = [s for s in tree if getattr(s, level) == best]
    return min(tree, key=lambda s: draw(key, f"shard/{s.number}", s.weight)).number if len(tree) > 1 else tree[0].number


def test_equals_brute_force(spark):
    rows = [(i * 7 - 50, f"text {i} é", "en", "s") for i in range(800)]
    tree, more = H.balanced(8), H.grow(H.balanced(8))
    out = H.assign(frame(spark, rows)).collect()
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        assert r.shard == descend(str(r.doc_id), tree) and r.grown_shard == descend(str(r.doc_id), more)
        assert r.grown_shard in (r.shard, 8)
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    counts = Counter(r.shard for r in out)
    assert all(60 < counts[s] < 145 for s in range(8))
    assert 55 < sum(r.grown_shard == 8 for r in out) < 130


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = H.balanced(5)
    ids = spark.range(500)
    for _ in range(3):
        more = H.grow(tree)
        new = more[-1].number
        both = ids.select(H.shard_of(ids.id, tree).alias("a"), H.shard_of(ids.id, more).alias("b")).collect()
        assert all(r.b in (r.a, new) for r in both)
        tree = more


def test_buckets_do_not_change_slots(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 7)
    out = H.assign(frame(spark, [(i, str(i), "en", "s") for i in range(300)])).collect()
    for s in range(8):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))


def test_weights(spark):
    tree = [H.Shard(0, "r0", "k0", 1.0), H.Shard(1, "r0", "k1", 3.0), H.Shard(2, "r1", "k2", 4.0)]
    ids = spark.range(8000)
    counts = Counter(r.s for r in ids.select(H.shard_of(ids.id, tree).alias("s")).collect())
    assert abs(counts[0] - 1000) < 150 and abs(counts[1] - 3000) < 200 and abs(counts[2] - 4000) < 200


def test_odd_rows_and_files(spark, odd, odd_rows, empty, tmp_path):
    out = H.assign(odd).collect()
    assert len(out) == len(odd_rows)
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 4} == {(1, 0)}
    assert len({r.shard for r in out if r.doc_id == 2}) == 1 and len({r.slot for r in out if r.doc_id == 2}) == 2
    assert H.assign(empty).collect() == []
    H.write_shards(odd, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == len(odd_rows)


def test_placed_rows(spark, odd, odd_rows, empty):
    many = odd.unionByName(odd).unionByName(odd.where("doc_id = 2")).withColumnRenamed("row_id", "file").withColumnRenamed("part", "row").repartition(5)
    out = H.place(many)
    assert out.columns == [c for c in many.columns if c != "shard"] + ["shard", "slot"]
    assert Counter(tuple(r[c] for c in many.columns if c != "shard") for r in out.collect()) == Counter(tuple(r[c] for c in many.columns if c != "shard") for r in many.collect())
    for r in out.collect():
        assert r.shard == descend("\0null" if r.doc_id is None else str(r.doc_id), H.balanced(8))
    for s in range(8):
        mine = sorted(r.slot for r in out.where(out["shard"] == s).collect())
        assert mine == list(range(len(mine)))
    assert H.place(empty).collect() == []
