"""Symbol edges by blocks of files, against a plain count of names."""

import random
from collections import Counter, defaultdict

import pytest

from lodestrand.operators import graph as G

SCHEMA = "rel_path string, name string, kind string"


def brute(tags):
    defs, refs = defaultdict(set), defaultdict(Counter)
    for file, name, kind in tags:
        if kind == "def":
            defs[name].add(file)
        elif kind == "ref":
            refs[name][file] += 1
    out = Counter()
    for name, files in defs.items():
        cased = ("_" in name and any(c.isalpha() for c in name)) or (name != name.lower() and name != name.upper())
        m = (10 if cased and len(name) >= 8 else 1) * (0.1 if name.startswith("_") else 1) * (0.1 if len(files) > 5 else 1)
        for dst in files:
            for src, n in refs[name].items():
                out[src, dst] += m * int(n**0.5)
            if not refs[name]:
                out[dst, dst] += 0.1
    return {k: round(v, 6) for k, v in out.items()}


def found(spark, tags):
    rows = G.symbol_edges(spark.createDataFrame(tags, SCHEMA)).collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    return {(r.src, r.dst): round(r.weight, 6) for r in rows}


@pytest.mark.parametrize("sizes", [(512, 1024), (7, 5)])
def test_blocks_give_the_same_edges(spark, monkeypatch, sizes):
    draw = random.Random(3)
    names = [f"common_{i}" for i in range(6)] + [f"_rare{i}" for i in range(60)] + [f"parseItem{i}" for i in range(40)] + ["run"]
    tags = [(f"f{draw.randrange(30)}", names[min(int(draw.expovariate(0.04)), 106)], draw.choice(["def", "ref", "ref", "doc"])) for _ in range(1200)]
    tags += [("lone", f"never{i}", "def") for i in range(3)] + [("f1", "undefined", "ref"), ("f2", "never0", "def")] + [("f3", "none", None)]
    monkeypatch.setattr(G, "SRC_FILES", sizes[0])
    monkeypatch.setattr(G, "DST_FILES", sizes[1])
    assert found(spark, tags) == brute(tags)


def test_no_tags(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", "x", "ref")]) == {}


def test_a_name_is_no_row_a_pair(spark):
    """Names that all files have: no step but the last makes a row for a pair of files."""
    tags = spark.createDataFrame([(f"f{i}", f"n{j}", kind) for i in range(40) for j in range(10) for kind in ("def", "ref")], SCHEMA)
    plan = G.symbol_edges(tags)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert G.symbol_edges(tags).count() == 1600
