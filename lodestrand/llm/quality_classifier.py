"""Quality classification by hierarchical empirical Bayes (operator 9).

Level 0: a document classifier gives two pieces of evidence, the probability of good
quality and that of toxicity: logistic regressions over the presence of words and of
shape marks, fitted on a bounded sample of labelled documents. The sample is dealt to
``FOLDS`` folds by a hash of the text, and a model is fitted without each fold; it gives that
fold's evidence, so no document's evidence comes from a model that saw its label. All other
documents are judged by a model of the whole sample.

Levels 1 and 2: for each host, and for each path of a host, grouped aggregates of the
evidence give a posterior mean. A host's mean shrinks to the global prior by
B = t / (t + s / n): s is the variance of evidence within hosts and t that between hosts,
both from the data by the method of moments, so a host with few documents, or hosts that do
not differ, fall back to the prior. A path's mean shrinks to its host's posterior in the
same way. A document's own evidence is left out of its site's means.

Combination: logit(document) + logit(path posterior) - logit(global prior).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, hint_if, measured
from lodestrand.llm.words import LOWER, U64, Words, chunks, mix, separator_table, split, word_hashes

BITS = 18
SLOTS = 1 << BITS
#: Labelled documents the classifier is fitted on, at most about this many.
SAMPLE_DOCUMENTS = 12000
FOLDS = 3
ERRORS = 2.0
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (5, 7)
HEADS = ("quality", "toxic")
#: Evidence is kept in whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Rows of the site table that may be broadcast.
BROADCAST_SITES = 200_000

#: Words of letters, digits and bytes of 0x80 and above.
_WORD = separator_table(bytes(b for b in range(128) if not chr(b).isalnum()))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_MARKS = 15


def shape_marks(text: bytes) -> list[int]:
    """Marks of a text's make-up that its words do not show."""
    size = max(1, len(text))
    words = max(1, text.count(b" ") + text.count(b"\n"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    upper, letters = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LETTERS))
    lines = text.split(b"\n")
    bars, calls = text.count(b"|"), text.count(b"!")
    spoken = text.split()
    distinct = len(set(spoken))
    on = (
        True,
        100 * symbols > size,
        20 * symbols > size,
        8 * symbols > size,
        3 * upper > letters,
        3 * upper > 2 * letters,
        10 * bars > words,
        3 * bars > words,
        10 * calls > words,
        3 * calls > words,
        4 * len(set(lines)) < 3 * len(lines),
        2 * len(set(lines)) < len(lines),
        5 * distinct < 2 * len(spoken),
        5 * distinct < len(spoken),
        sum(map(bytes.__eq__, spoken, spoken[1:])) * 4 > len(spoken),
    )
    return [i for i, v in enumerate(on) if v]


def slots_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first, slots): the distinct slots of each text's words, word beginnings and marks, texts in order."""
    words = split([t.translate(LOWER) for t in texts], _WORD)
    hashes = [word_hashes(words)]
    for n in PREFIXES:
        cut = Words(words.buffer, words.starts, np.minimum(words.ends, words.starts + n), words.first)
        hashes.append(mix(word_hashes(cut) ^ U64(n)))
    of_word = words.text_of() * (SLOTS + _MARKS)
    slots = [of_word + (h >> U64(64 - BITS)).astype(np.int64) for h in hashes]
    marks = [shape_marks(t) for t in texts]
    key = np.concatenate([*slots, np.array([i * (SLOTS + _MARKS) + SLOTS + m for i, own in enumerate(marks) for m in own], dtype=np.int64)])
    key = np.unique(key)
    of, slot = np.divmod(key, SLOTS + _MARKS)
    return np.searchsorted(of, np.arange(len(texts) + 1)), slot


@dataclass
class Model:
    weights: np.ndarray  # float32[folds + 1, SLOTS + marks, heads]: fitted without each fold, and on all
    #: Ids of the sampled documents; (doc_id).
    sample: DataFrame | None = None

    def probabilities(self, texts: list[bytes], folds: list[int | None]) -> np.ndarray:
        first, slot = slots_of(texts)
        total = np.add.reduceat(self.weights[-1][slot].astype(np.float64), first[:-1], axis=0)
        for i, fold in enumerate(folds):
            if fold is not None:
                total[i] = self.weights[fold][slot[first[i] : first[i + 1]]].sum(axis=0, dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _least(f, x: np.ndarray, steps: int = 40, memory: int = 8) -> np.ndarray:
    """Where ``f``, which gives value and gradient, is least, from ``x`` on (L-BFGS with halved steps)."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for dx, dg in reversed(pairs):
            a = (dx @ q) / (dx @ dg)
            used.append(a)
            q -= a * dg
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(g).max()))
        for (dx, dg), a in zip(pairs, reversed(used)):
            q += (a - (dg @ q) / (dx @ dg)) * dx
        slope, step = float(g @ q), 1.0
        if slope <= 0:
            break
        while True:
            new_value, new_g = f(x - step * q)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if new_value > value:
            break
        dx, dg = -step * q, new_g - g
        gained, x, value, g = value - new_value, x + dx, new_value, new_g
        if dx @ dg > 0:
            pairs = [*pairs[1 - memory :], (dx, dg)] if len(pairs) >= memory else [*pairs, (dx, dg)]
        if gained < 1e-6 * abs(value):
            break
    return x


def _tally(rows: list[np.ndarray], some: int = 500) -> np.ndarray:
    """How many of the rows have each slot."""
    out = np.zeros(SLOTS + _MARKS)
    for i in range(0, len(rows), some):
        out += np.bincount(np.concatenate(rows[i : i + some]), minlength=len(out))
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, ridge: float = 3e-4) -> np.ndarray:
    """Logistic regression over present slots, each scaled by its log ratio of document frequencies in the two classes.

    The ratio counts as far as it exceeds ``ERRORS`` of its standard errors, so chance words of
    the sample have weight 0, also the very many of a long text, and a word of toxic documents
    is not crowded out by them. What is left is a sparse matrix; the penalty of a slot grows
    with the documents that have it.
    """
    size, w = SLOTS + _MARKS, np.zeros(SLOTS + _MARKS)
    if not rows:
        return w
    one = _tally([r for r, t in zip(rows, y) if t])
    zero = _tally(rows) - one
    n_one = float(y.sum())
    scale = np.log((one + 1) / (n_one + 2)) - np.log((zero + 1) / (len(rows) - n_one + 2))
    scale = np.sign(scale) * np.maximum(np.abs(scale) - ERRORS * np.sqrt(1 / (one + 1) + 1 / (zero + 1)), 0.0)
    bias = SLOTS  # the mark that every text has; it is not shrunk
    scale[bias] = 1.0
    used = np.flatnonzero(scale)
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    # The rows' entries that are left, text by text, so that the whole sample is never spread out.
    columns = [c[c >= 0] for c in (place[r] for r in rows)]
    column, of = np.concatenate(columns), np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
    x = scale[used]
    shrink = ridge * (one + zero)[used]
    shrink[used == bias] = 0.0

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, weights=(v * x)[column], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        value = float((np.logaddexp(0, z) - y * z).sum() + (shrink * v * v).sum() / 2)
        return value, x * np.bincount(column, weights=off[of], minlength=len(used)) + shrink * v

    w[used] = x * _least(loss, np.zeros(len(used)))
    return w


def fold_of(text: Column) -> Column:
    """The fold of a text; copies share it."""
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Both heads, from a bounded sample of labelled documents chosen by a hash of doc_id.

    Without labels the evidence is 0.5 for every document. A document labelled more than once
    counts with its least labels.
    """
    known = labels.where("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min("toxic").cast("int").alias("toxic"))
    count = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The draw's bound is met on average only; the limit, far above it, takes the least draws.
    chosen = cut(known.where(draw < min(1.0, sample / max(1, count))).orderBy(draw, "doc_id").limit(2 * sample), "chosen")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), fold_of(text).alias("fold")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                first, slot = slots_of(texts)
                held = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[part.column(c) for c in ("quality", "toxic", "fold")], pa.array(held, pa.binary())], names=["doc_id", "quality", "toxic", "fold", "slots"])

    found = rows.select("doc_id", "quality", "toxic", "fold", "text").mapInArrow(run, "doc_id long, quality int, toxic int, fold int, slots binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["slots"])))
    weights = np.zeros((FOLDS + 1, SLOTS + _MARKS, len(HEADS)), dtype=np.float32)
    for fold in range(FOLDS + 1):  # the last is no row's fold, so that model sees all
        others = [r for r in found if r["fold"] != fold]
        slots = [np.frombuffer(r["slots"], dtype=np.int32) for r in others]
        for h, head in enumerate(HEADS):
            weights[fold, :, h] = fit(slots, np.array([r[head] for r in others], dtype=float))
    return Model(weights, chosen.select("doc_id"))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, host, path, e_quality, e_toxic) for ``docs(doc_id, text, host, path)``; evidence in millionths."""
    weights = Model(model.weights)
    rows = docs.select("doc_id", "host", "path", "text")
    if model.sample is None:
        rows = rows.withColumn("fold", F.lit(None).cast("int"))
    else:  # at most twice the sample's bound of ids
        sampled = F.broadcast(model.sample.select(F.col("doc_id").alias("sampled_id")))
        rows = rows.join(sampled, F.col("doc_id") == F.col("sampled_id"), "left").withColumn("fold", F.when(F.col("sampled_id").isNotNull(), fold_of(F.col("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                p = np.rint(np.clip(weights.probabilities(texts, part.column("fold").to_pylist()), 1e-4, 1 - 1e-4) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["doc_id", "host", "path", "e_quality", "e_toxic"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "host", "path", "text", "fold").mapInArrow(run, f"doc_id {kind}, host string, path string, e_quality long, e_toxic long")


def _variances(groups: DataFrame, head: str) -> tuple[float, float]:
    """(within, between) variance of evidence over groups with n, total and squares; one row comes to the driver."""
    mean = F.col(f"t_{head}") / F.col("n") / UNIT
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(f"t_{head}").alias("t"),
        F.sum(F.round((F.col(f"q_{head}") / UNIT / UNIT - F.col("n") * mean * mean) * UNIT).cast("long")).alias("inside"),
        F.sum(F.round(F.col("n") * mean * mean * UNIT).cast("long")).alias("outside"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).head()
    n, k = row["n"] or 0, row["k"] or 0
    if n <= k or k < 2:
        return 1.0, 0.0
    within = max(row["inside"] / UNIT / (n - k), 1e-9)
    mean = row["t"] / n / UNIT
    spread = row["outside"] / UNIT - n * mean * mean
    between = (spread - (k - 1) * within) / (n - row["nn"] / n)
    return within, max(between, 0.0)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def combine(found: DataFrame) -> DataFrame:
    """``found(doc_id, host, path, e_quality, e_toxic)`` with p_quality and p_toxic.

    A null host is a site of its own, as is a null path of a host.
    """
    squares = [F.sum(F.col(f"e_{h}") * F.col(f"e_{h}")).alias(f"q_{h}") for h in HEADS]
    paths, counts = measured(found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"e_{h}").alias(f"t_{h}") for h in HEADS], *squares), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"{x}_{h}").alias(f"{x}_{h}") for x in "tq" for h in HEADS]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"t_{h}").alias(h) for h in HEADS]).head()
    sites = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("n").alias("n_path"), *[F.col(f"t_{h}").alias(f"path_{h}") for h in HEADS]).join(
        hosts.select(F.col("host").alias("hh"), F.col("n").alias("n_host"), *[F.col(f"t_{h}").alias(f"host_{h}") for h in HEADS]), F.col("h").eqNullSafe(F.col("hh"))
    ).drop("hh")
    small = counts["rows"] <= BROADCAST_SITES
    out = found.join(hint_if(sites, small), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p")
    for h in HEADS:
        prior = (total[h] or 0) / max(1, total["n"] or 0) / UNIT
        within, between = _variances(hosts, h)
        inside, paths_between = _variances(paths, h)
        own = F.col(f"e_{h}")
        # Others of the host, and of the path: the document's own evidence is left out.
        n_host, n_path = F.col("n_host") - 1, F.col("n_path") - 1
        host_mean = F.coalesce(F.try_divide(F.col(f"host_{h}") - own, n_host) / UNIT, F.lit(prior))
        at_host = F.lit(prior) + (host_mean - prior) * (between * n_host) / (between * n_host + within)
        path_mean = F.coalesce(F.try_divide(F.col(f"path_{h}") - own, n_path) / UNIT, at_host)
        apart = max(paths_between - between, 0.0)
        at_path = at_host + (path_mean - at_host) * (apart * n_path) / (apart * n_path + inside)
        logit = _logit(own / UNIT) + _logit(at_path) - _logit(F.lit(prior))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-logit)))
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_quality, p_toxic, e_quality, e_toxic, kept) for each row of ``docs(doc_id, text, host, path)``; doc_ids are integers.

    kept: p_quality of at least 0.5 and p_toxic below 0.5. A null or empty text has the
    evidence of an empty text. Repeated rows get equal evidence; each is one of its site's
    documents. An empty table gives an empty table. Other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    found = cut(evidence(rows, train(rows, labels)), "evidence")
    out = combine(found)
    unit = lambda h: (F.col(f"e_{h}") / UNIT).alias(f"e_{h}")
    return out.select("doc_id", "p_quality", "p_toxic", unit("quality"), unit("toxic"), ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"))
