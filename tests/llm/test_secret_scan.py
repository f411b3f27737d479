import hashlib
import math
import random
import re
import string
import time

from lodestrand.llm import secret_scan as S
from tests.llm.conftest import frame, sentence

PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def base(text):
    found = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if name == "assign" and len(m[2]) >= 12 or name == "access" and len(m[0]) >= 18 or name == "hex" and len(m[0]) >= 16:
                found.append((m.start(), k, name, m.end()))
    found.sort()
    return found, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in found).encode()).hexdigest()


def planted(rng):
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(120):
        text = sentence(rng, 20)
        extra = {
            0: " Password: hunter2hunter2 ",
            1: " token = secret: ABCDEFGHIJKLMNOP ",
            2: " AKIAAKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(14)) + " ",
            3: " \U0001f600é " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + " ",
            4: " " + "".join(rng.choice(b62) for _ in range(44)) + " ",
            5: " release_notes_for_version_2_and_the_house_of_the_river_1 ",
            6: " 'api_key':'short' secret=\"" + "a.b-c=d/e+f" * 2 + "\" ",
            7: " aaaaaaaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaa ",
        }[i % 8]
        rows.append((i, text + extra + sentence(rng, 5), "en", "s"))
    return rows


def test_base_spans_and_random_tokens(spark):
    rows = planted(random.Random(9))
    texts = {i: t for i, t, *_ in rows}
    out = S.secret_digest(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        found, digest = base(texts[r.doc_id])
        assert r.base_sha256 == digest
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _, _ in found) for i in range(3))
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(int(a), n, int(b)) for n, a, b in spans if n != "random"] == [(a, n, b) for a, _, n, b in found]
        if r.doc_id % 8 in (5, 7):
            assert r.n_random == 0
    random_found = [r for r in out if r.doc_id % 8 == 4 and r.n_random]
    assert len(random_found) >= 14  # of 15
    for r in random_found:
        a, b = map(int, r.spans.split(":")[1:])
        assert len(texts[r.doc_id][a:b]) == 44
    redacted = {r.doc_id: r.text for r in S.redacted(frame(spark, rows)).collect()}
    assert "hunter2hunter2" not in redacted[0] and redacted[5] == texts[5]


def test_odd_rows(odd, odd_rows, empty):
    out = S.secret_digest(odd).collect()
    assert len(out) == len(odd_rows)
    texts = {i: t for i, t, *_ in odd_rows}
    for r in out:
        if r.doc_id is not None:
            assert r.base_sha256 == base(texts[r.doc_id])[1]
    assert S.secret_digest(empty).collect() == []


def below(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def p_value(token):
    """The three tests by their definitions, with an exact normal distribution."""
    _, _, alphabet, c = next(e for e in S.ENCODINGS if re.search(e[1], token))
    k, n = len(alphabet), len(token)
    expected = n / k
    chi2 = sum((token.count(a) - expected) ** 2 / expected for a in alphabet)
    shift = n * (k * c - 1)
    uniform = below((chi2 - (k - 1) - shift) / math.sqrt(2 * (k - 1 + 2 * shift)))
    place = [alphabet.index(ch) for ch in token]
    high = [p >= k // 2 for p in place]
    runs, m = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    cross = 2 * m * (n - m)
    runs_p = 1.0
    if cross > n:
        runs_p = below(abs(runs - 1 - cross / n) / math.sqrt(cross * (cross - n) / (n * n * (n - 1))) - S.RUNS * math.sqrt(n))
    mean = sum(place) / n
    power = sum((p - mean) ** 2 for p in place)
    serial = below((abs(sum((a - mean) * (b - mean) for a, b in zip(place, place[1:])) / power) - S.SERIAL) * math.sqrt(n)) if power else 1.0
    return max(uniform, runs_p, serial, 1e-60)


def accepted(found):
    """Benjamini-Hochberg: the p-values of (p, ...) that are called random."""
    ordered = sorted(found)
    last = max((i for i, p in enumerate(ordered, 1) if p <= S.RATE * i / len(ordered)), default=0)
    return set(ordered[:last])


def test_p_values_and_thresholds_by_their_definitions(spark):
    rng = random.Random(21)
    b62 = string.digits + string.ascii_letters
    rows = []
    for i in range(300):
        n = rng.choice([20, 24, 30, 40, 60, 100, 150])
        token = "".join(rng.choice(b62[: rng.choice([16, 36, 62])]) for _ in range(n - 2)) + "zZ" if i % 2 else ("part_of_name_" * 12)[: n - 2] + "a1"
        rows.append((i, f"see {token}1 here", "en", "s"))
    by_class = {}
    scanned = S.cut(S._scan(frame(spark, rows)), "scanned")
    for r in scanned.collect():
        text = rows[r.doc_id][1]
        for c in r.candidates:
            want = -math.log10(p_value(text[c.begin : c.end])) * S.PER_DECADE
            if want < 5 * S.PER_DECADE:
                assert abs(c.bin - want) <= 2, (text, c.bin, want)
            assert c.stratum == max(i for i, low in enumerate(S.CLASSES) if c.end - c.begin >= low)
            by_class.setdefault(c.stratum, []).append((10 ** (-c.bin / S.PER_DECADE), c.bin))
    least = S._thresholds(scanned)
    assert len(by_class) == 4
    for stratum, found in by_class.items():
        passed = accepted([p for p, _ in found])
        bins = [b for p, b in found if p in passed]
        assert least.get(stratum) == (min(bins) if bins else None)


def spans_of(text):
    """All tokens that the battery may look at, by comparing each with each base span."""
    found, _ = base(text)
    tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(S.TOKEN, text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return [(a, b) for a, b, _ in tokens if not any(x < b and a < y for x, _, _, y in found)]


def test_tokens_beside_base_spans(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)  # many levels of blocks
    rng = random.Random(31)
    pieces = ["deadbeefdeadbeef99", "secret=abcdefghijkl012", "AKIA" + "A1" * 9, "Zx" * 11 + "7", "word", "ghijklmnopqrstuvwxyz0-" + "ab12" * 6, "é"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice([" ", " ", "/", "-", "\n"]) for _ in range(rng.randrange(60))), "en", "s") for i in range(60)]
    for r in S.cut(S._scan(frame(spark, rows)), "scanned").collect():
        assert [(c.begin, c.end) for c in r.candidates] == spans_of(rows[r.doc_id][1])
        assert [(b.begin, b.kind, b.end) for b in r.base] == [(a, k, e) for a, k, _, e in base(rows[r.doc_id][1])[0]]


def test_many_matches_in_one_text(spark):
    n = 12_000
    text = " ".join(f"{i:018x} Tok{i}enQwErTyUiOpAsDf" for i in range(n))
    began = time.perf_counter()
    (r,) = S.secret_digest(frame(spark, [(1, text, "en", "s")])).collect()
    assert r.n_hex == n and r.base_sha256 == base(text)[1]
    assert time.perf_counter() - began < 60
