"""Secret scans: patterns plus a battery of randomness tests (operator 5).

Base spans come from three patterns. The battery looks at other long tokens that contain a
digit. It infers the token's encoding, the smallest alphabet that holds its characters,
and asks for evidence that the token is random over it. Being random is not the null
hypothesis but the alternative: each test's null is "structured", a departure from
randomness of at least a stated size, so a short token, which proves little, keeps a large
p-value:

* alphabet uniformity: chi-squared of the character counts against the alphabet. For text
  with index of coincidence c over k characters the statistic centres on
  (k - 1) + n * (k * c - 1); p is the lower tail of its normal approximation.
* runs: Wald-Wolfowitz runs of characters in the upper and lower half of the alphabet;
  the null is a deviation of at least ``RUNS`` * sqrt(n) standard deviations.
* serial correlation of neighbouring characters' places in the alphabet; the null is at
  least ``SERIAL`` in size.

The work on a text is in proportion to its length and its matches.

A token's p-value is the largest of the three (all must be rejected). Over all tokens of a
length class, Benjamini-Hochberg at rate ``RATE`` decides, so what is found in short tokens
is not paid for by long ones. p-values are counted in bins of 1/64 of a decade, rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, smallest first: name, pattern, alphabet in order of value, index of coincidence of structured text in it.
ENCODINGS = (
    ("hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.12),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 0.066),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER, 0.066),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, 0.06),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 0.06),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.06),
)
RUNS, SERIAL, RATE = 0.8, 0.8, 0.05
#: Lower ends of the length classes.
CLASSES = (20, 32, 48, 96)
PER_DECADE, MOST = 64, 4095


#: Elements that are scanned in one go; longer arrays are scanned in blocks of so many, and then the blocks' totals.
BLOCK = 256
SPAN = "array<struct<begin:int,end:int,token:string>>"
#: Beyond any place in a text.
FAR = 2**31 - 1


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _grown(values: Column, first: Column, merge) -> Column:
    start = F.struct(first.alias("so_far"), F.slice(F.array(first), 1, 0).alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(merge(acc["so_far"], v).alias("so_far"), F.concat(acc["out"], F.array(acc["so_far"])).alias("out")))["out"]


def _running(values: Column, first: Column, merge) -> Column:
    """Before each element of ``values`` what the elements before it give, from ``first`` on by the associative ``merge``.

    An array that grows by one element is copied, so this is done inside blocks and over the
    blocks' totals: a million elements cost some hundred copies each.
    """

    def in_blocks(blocks: Column) -> Column:
        bases = _grown(F.transform(blocks, lambda block: F.aggregate(block, first, merge)), first, merge)
        return F.flatten(F.zip_with(blocks, bases, lambda block, base: F.transform(_grown(block, first, merge), lambda v: merge(base, v))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda b: F.slice(v, b, BLOCK))
        return F.when(F.size(v) > BLOCK, _let(blocks, in_blocks)).otherwise(_grown(v, first, merge))

    return _let(values, whole)


def _spans(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<begin, end, token>>, in code points, of the ``matches`` that the pattern has in the text.

    Splitting at the matches gives what lies between them, so a match begins where the lengths of
    both, up to it, end.
    """

    def placed(steps: Column) -> Column:
        before = _running(F.transform(steps, lambda x: x["gap"] + F.length(x["token"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(steps, before, lambda x, at: F.struct((at + x["gap"]).alias("begin"), (at + x["gap"] + F.length(x["token"])).alias("end"), x["token"].alias("token")))

    gaps = F.transform(F.split(text, pattern), lambda gap: F.length(gap))
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("token")))
    return F.when(F.size(matches) > 0, _let(steps, placed)).otherwise(F.array().cast(SPAN))


def _free(tokens: Column, base: Column) -> Column:
    """Those of ``tokens`` that overlap no span of ``base``.

    In the order of their beginnings, a token overlaps a span before it if the furthest end so far
    lies beyond its begin, and one behind it if the nearest begin lies before its end.
    """
    marks = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["begin"].alias("begin"), F.lit(0).alias("is_token"), s["end"].alias("end"), F.lit("").alias("token"))),
            F.transform(tokens, lambda s: F.struct(s["begin"].alias("begin"), F.lit(1).alias("is_token"), s["end"].alias("end"), s["token"].alias("token"))),
        )
    )

    def free(m: Column) -> Column:
        reach = _running(F.transform(m, lambda x: F.when(x["is_token"] == 0, x["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        ahead = F.reverse(_running(F.reverse(F.transform(m, lambda x: F.when(x["is_token"] == 0, x["begin"]).otherwise(FAR))), F.lit(FAR), lambda a, b: F.least(a, b)))
        near = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
        marked = F.zip_with(m, near, lambda x, n: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["token"].alias("token"), ((x["is_token"] == 1) & (n["reach"] <= x["begin"]) & (n["ahead"] >= x["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["token"].alias("token")))

    return F.when(F.size(tokens) == 0, F.array().cast(SPAN)).when(F.size(base) == 0, tokens).otherwise(_let(marks, free))


def _below(x: Column) -> Column:
    """The standard normal's probability below x (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x < 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    """(alphabet, sides, k, c) of the smallest encoding that holds the token; null if none does. ``sides`` tells lower from upper half."""
    out = F.lit(None)
    for _, pattern, alphabet, coincidence in reversed(ENCODINGS):
        k, half = len(alphabet), len(alphabet) // 2
        held = F.struct(F.lit(alphabet).alias("alphabet"), F.lit("0" * half + "1" * (k - half)).alias("sides"), F.lit(float(k)).alias("k"), F.lit(coincidence).alias("c"))
        out = F.when(token.rlike(pattern), held).otherwise(out)
    return out


def _p_value(token: Column, e: Column) -> Column:
    n = F.length(token).cast("double")

    def from_letters(letters: Column) -> Column:
        squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total + F.pow(n - F.length(F.call_function("replace", token, c, F.lit(""))), F.lit(2.0)))
        shift = n * (e["k"] * e["c"] - 1)
        uniform = _below((squares * e["k"] / n - n - (e["k"] - 1) - shift) / F.sqrt(2 * (e["k"] - 1 + 2 * shift)))
        # Sums of places, of their squares and of products of neighbours: centred sums follow from them.
        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("before"), zero.alias("first"), zero.alias("one"), zero.alias("two"), zero.alias("next"))

        def step(acc: Column, c: Column) -> Column:
            place = F.call_function("locate", c, e["alphabet"]).cast("long")
            return _let(
                place,
                lambda v: F.struct(v.alias("before"), F.when(acc["first"] == 0, v).otherwise(acc["first"]).alias("first"), (acc["one"] + v).alias("one"), (acc["two"] + v * v).alias("two"), (acc["next"] + acc["before"] * v).alias("next")),
            )

        def serial(s: Column) -> Column:
            mean = s["one"] / n
            power = s["two"] - n * mean * mean
            lagged = s["next"] - mean * (2 * s["one"] - s["first"] - s["before"]) + (n - 1) * mean * mean
            return F.when(power > 1e-9, _below((F.abs(lagged / power) - SERIAL) * F.sqrt(n))).otherwise(1.0)

        return F.greatest(uniform, _let(F.aggregate(letters, start, step), serial))

    def runs(sides: Column) -> Column:
        ones = F.length(F.call_function("replace", sides, F.lit("0"), F.lit(""))).cast("double")
        cross = 2 * ones * (n - ones)
        z = F.abs(F.regexp_count(sides, F.lit("0+|1+")) - 1 - cross / n) / F.sqrt(cross * (cross - n) / (n * n * (n - 1)))
        return F.when(cross > n, _below(z - RUNS * F.sqrt(n))).otherwise(1.0)

    sides = F.call_function("translate", token, e["alphabet"], e["sides"])
    return F.greatest(_let(F.split(token, ""), from_letters), _let(sides, runs), F.lit(1e-60))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, base: array<struct<begin, kind, end>> in order, and candidates: array<struct<begin, end, stratum, bin>>."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = rows.select("doc_id", "text", *[found(p).alias(f"m{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    assigned = F.zip_with(_spans(text, ASSIGN, F.col("m0")), found(ASSIGN, 2), lambda s, g: F.struct(s.alias("s"), (F.length(g) >= 12).alias("long")))
    kept = F.transform(F.filter(assigned, lambda x: x["long"]), lambda x: x["s"])
    f0 = F.when(F.size("m0") > 0, kept).otherwise(F.array().cast(SPAN))
    rows = rows.select("doc_id", f0.alias("f0"), *[_spans(text, p, F.col(f"m{i}")).alias(f"f{i}") for i, p in ((1, ACCESS), (2, HEX), (3, TOKEN))])
    as_spans = lambda i: F.transform(f"f{i}", lambda s: F.struct(s["begin"].alias("begin"), F.lit(i).alias("kind"), s["end"].alias("end")))
    rows = rows.select("doc_id", F.array_sort(F.concat(as_spans(0), as_spans(1), as_spans(2))).alias("base"), F.filter("f3", lambda t: t["token"].rlike("[0-9]") & t["token"].rlike("[A-Za-z]")).alias("f3"))
    rows = rows.select("doc_id", "base", _free(F.col("f3"), F.col("base")).alias("tokens"))

    def judged(t: Column) -> Column:
        p = _let(_encoding(t["token"]), lambda e: F.when(e.isNull(), 1.0).otherwise(_p_value(t["token"], e)))
        n = F.length(t["token"])
        stratum = F.lit(0)
        for i, low in enumerate(CLASSES):
            stratum = F.when(n >= low, F.lit(i)).otherwise(stratum)
        return F.struct(t["begin"].alias("begin"), t["end"].alias("end"), stratum.alias("stratum"), F.least(F.floor(-F.log10(p) * PER_DECADE), F.lit(MOST)).cast("int").alias("bin"))

    none = F.array().cast("array<struct<begin:int,end:int,stratum:int,bin:int>>")
    return rows.select("doc_id", "base", F.when(F.size("tokens") > 0, F.transform("tokens", judged)).otherwise(none).alias("candidates"))


def _thresholds(scanned: DataFrame) -> dict[int, int]:
    """The least bin that Benjamini-Hochberg accepts in each length class; one row a class comes to the driver."""
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count()
    above = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("count").over(above).alias("found"), F.sum("count").over(whole).alias("m"))
    passed = ranked.where(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) <= RATE * F.col("found"))
    return {r["stratum"]: r["least"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, secret_spans, n_base): spans (begin, kind, end) of each row of ``docs(doc_id, text)``, in order.

    kind is an index into ``KINDS``; begin and end count code points, end exclusive. A token
    that overlaps a base span is not tested. A null text is empty and has no spans.
    """
    scanned = cut(_scan(docs), "scanned")
    least = _thresholds(scanned)
    accepted = F.lit(False)
    out = scanned
    if least:
        limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
        accepted = lambda c: F.coalesce(c["bin"] >= F.element_at(limits, c["stratum"]), F.lit(False))
        random = F.transform(F.filter("candidates", accepted), lambda c: F.struct(c["begin"].alias("begin"), F.lit(3).alias("kind"), c["end"].alias("end")))
    else:
        random = F.array().cast("array<struct<begin:int,kind:int,end:int>>")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("secret_spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for each row of ``docs(doc_id, text)``.

    Repeated rows get equal rows; an empty table gives an empty one; other columns are not read.
    """
    found = secrets(docs)
    count = lambda i, c: F.size(F.filter(c, lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i, "base").alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
        count(3, "secret_spans").alias("n_random"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """(doc_id, text): the texts with every span (overlapping ones as one) replaced by ``mark``.

    Rows need distinct non-null doc_ids.
    """
    spans = secrets(docs).select("doc_id", "secret_spans")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(spans, "doc_id")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["begin"] - acc["at"], F.lit(0)))
        out = F.when(s["begin"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    return rows.select("doc_id", F.aggregate("secret_spans", start, step, finish).alias("text"))
