import random

import pytest

from lodestrand.llm import chat_format as F


def brute(rows, piece=64):
    turns = sorted({(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows}, key=lambda v: (v[1] is not None, v[1] or 0, v[2].encode(), v[3].encode()))
    out = {}
    for c in {v[0] for v in turns}:
        for p in {(v[1] or 0) // piece for v in turns if v[0] == c}:
            own = [v for v in turns if v[0] == c and (v[1] or 0) // piece == p]
            for who in {v[2] for v in own} - {"system"}:
                text, spans = "", []
                for _, _, role, said in own:
                    head = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
                    text += f"<|im_start|>{head}\n"
                    if role == who:
                        spans.append(f"{len(text)}:{len(text) + len(said) + len('<|im_end|>')}")
                    text += f"{said}<|im_end|>\n"
                out[(c, p, who)] = (len(own), len(spans), text, ",".join(spans))
    return out


@pytest.mark.parametrize("piece", [64, 3])
def test_equals_brute_force(spark, piece):
    rng = random.Random(1)
    people = ["ann", "bob", "cé", "system", "system", None]
    rows = [(rng.randrange(12), rng.randrange(9), rng.choice(people), rng.choice(["hi", "é\U0001f600", "", None, "x" * 5000])) for _ in range(150)]
    rows += [(None, 0, "ann", "null conversation"), (5, None, "bob", "null turn"), (99, 0, "system", "alone"), *[(7, 1, "ann", "same")] * 50]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, piece int, perspective string")
    out = F.rotate(df, piece).collect()
    got = {(r.conv_id, r.piece, r.perspective): (r.n_turns, r.n_masked_in, r.rendered, r.spans) for r in out}
    assert len(got) == len(out) and got == brute(rows, piece)


def test_crowded_pieces_are_parted(spark):
    df = spark.createDataFrame([(1, 0, f"p{i % 3}", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    out = F.rotate(df, rows_per_piece=50).collect()
    assert {r.part for r in out} == set(range(6))
    assert sum(r.n_masked_in for r in out) == 300


def test_empty(spark):
    assert F.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def joined(out):
    """The rendering of each participant, put together from its pieces, and the turns with loss."""
    whole = {}
    for r in sorted(out, key=lambda r: (r.piece, r.part)):
        text, masked = whole.get((r.conv_id, r.perspective), ("", []))
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        whole[r.conv_id, r.perspective] = (text + r.rendered, masked + [r.rendered[a:b] for a, b in spans])
    return whole


def whole(rows):
    """The same by brute force, from conversations in one piece."""
    return {(c, who): (text, [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(",") if s)]) for (c, _, who), (_, _, text, spans) in brute(rows, 10**9).items()}


def test_silent_participants_get_every_piece(spark, tmp_path):
    from lodestrand.llm.queries import QUERIES

    rows = [(1, t, "ann", f"a{t}") for t in range(64)] + [(1, 70, "bob", "late"), (1, 200, "system", "end"), (2, 3, "cat", "alone"), (None, 1, None, "x"), (None, 99, "dan", "y"), (3, 0, "system", "s"), (3, 99, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()
    assert joined(out) == whole(rows)
    assert {(r.piece, r.n_masked_in, r.spans) for r in out if r.conv_id == 1 and r.perspective == "bob" and r.piece != 1} == {(0, 0, ""), (3, 0, "")}
    assert len(out) == len({(r.conv_id, r.piece, r.part, r.perspective) for r in out}) == 2 * 3 + 1 + 2 * 2


def test_crowded_pieces_are_parted_in_order(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(20)]), rng.choice(["ann", "bob", "system", None]), f"t{rng.randrange(150)}") for c in (1, None) for _ in range(400)]
    rows += [(1, 5, "late", "once"), (1, 64, "ann", "next piece"), (2, 0, "ann", "small"), *[(4, 0, "ann", "same")] * 100]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = F.rotate(df, rows_per_piece=50, everyone=True).collect()
    assert joined(out) == whole(rows)
    turns = len({(c, t, r or "unknown", x) for c, t, r, x in rows if c == 1 and (t or 0) < 64})
    sizes = {r.part: r.n_turns for r in out if r.conv_id == 1 and r.piece == 0}
    assert sizes == {i: min(50, turns - 50 * i) for i in range(-(-turns // 50))}
    assert {r.part for r in out if r.conv_id in (2, 4) or r.piece == 1} == {0}


def test_equals_its_sql(spark, tmp_path):
    """More than 64 turn numbers, silent stretches, and more than 512 rows of one turn number."""
    import duckdb

    from lodestrand.llm.queries import ORACLE_SQL, QUERIES

    rows = [(1, t, "ann" if t < 70 else "bob", f"a{t}") for t in range(130)] + [(2, 5, "ann", f"t{i:04}") for i in range(600)] + [(2, None, None, "é"), (2, 99, "cat", "c"), (None, 0, "dan", None), (3, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op10_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["op10_chat_format"])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())
