"""Near-duplicate documents by HyperMinHash sketches (operator 8).

A sketch has ``BANDS`` bands. Each band has a hash function of its own, which deals the
shingles of a document to ``BUCKETS`` buckets and keeps, for each bucket, a register
of the least hash seen: the number of its leading zeros (6 bits) and the ``MANTISSA``
bits after the first one. A register of an empty bucket is 0. The registers of a band,
compressed to two bytes each, are its key; documents that share a key are candidates.
With J = 0.8 a band agrees with probability 0.8 ** 5 = 0.33, so all 32 bands miss a pair
once in 3e5 cases, and less often above 0.8.

Steps: (1) documents with the same shingle set become one class. (2) Of the classes that
share a band key, each is compared with the key's least class, then with one picked by
hash; classes in one component need no further comparison. (3) What is still in different
components under a key is compared completely. Under keys of at most ``LIGHT`` classes,
by pairs. Under the others, the classes outside the key's largest component (strays) are
attached to it, and the strays of a component are compared with all of its members and
with each other, in blocks; only links that join components come out, so the number of
rows stays proportional to the group. (4) Pairs whose set sizes rule the threshold out, or
whose collision-corrected sketch estimate is more than ``SLACK`` below it, are skipped
before they are compared; comparisons are made on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.components import components
from lodestrand.llm.tables import cut, hint_if, measured, scratch
from lodestrand.llm.words import LOWER, TOP, U64, chunks, mix, split, window_hashes, word_hashes

BANDS, BUCKETS, MANTISSA = 32, 5, 10
#: The estimate's standard error at J = 0.8 is 0.4 / sqrt(160) = 0.032; this is seven of them.
SLACK = 0.22
LIGHT = 32
#: Shingles that a block of classes holds, on average (8 bytes each).
BLOCK_SHINGLES = 1_000_000
#: Rows of 8-byte ids that may be broadcast (8 MB); with more, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Pairs of one class that a task compares, on average; a class with more is dealt to several.
HOT = 256


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text (A-Z lower-cased)."""
    words = split([t.translate(LOWER) for t in texts])
    h = word_hashes(words)
    runs = window_hashes(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif n:
            out.append(window_hashes(h[a:b], n))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of non-empty sets: uint16[len(sets), BANDS, BUCKETS]."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS, BUCKETS), dtype=np.uint16)
    for band in range(BANDS):
        g = mix(flat + U64(((2 * band + 1) * 0x9E3779B97F4A7C15) & int(TOP)))
        bucket = ((g >> U64(40)) * U64(BUCKETS)) >> U64(24)
        value = mix(g)
        for j in range(BUCKETS):
            out[:, band, j] = compress(np.minimum.reduceat(np.where(bucket == U64(j), value, TOP), begins))
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each value in 16 bits; the largest value, for an empty bucket, is 0."""
    # frexp gives the exponent of the leading bit; 52 bits of the value are enough for zeros and mantissa
    _, exponent = np.frexp(np.maximum(least >> U64(11), U64(1)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint64)
    zeros = np.minimum(zeros, U64(61))
    mantissa = (least << (zeros + U64(1))) >> U64(64 - MANTISSA)
    packed = ((zeros + U64(1)) << U64(MANTISSA)) | mantissa
    return np.where(least == TOP, U64(0), packed).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers [n, BANDS * BUCKETS], corrected for chance collisions.

    Two unequal minima agree in leading zeros and mantissa with a probability close to
    sum over z of 2**-MANTISSA * P(both have z zeros); with x elements a bucket, P(z) is
    the chance that the minimum lies in [2**-(z+1), 2**-z).
    """
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(axis=1)
    z = np.arange(40)[None, :]

    def chance(size: np.ndarray) -> np.ndarray:
        per = np.maximum(size / BUCKETS, 1e-9)[:, None]
        return np.exp(-per * 2.0 ** -(z + 1.0)) - np.exp(-per * 2.0**-z)

    collide = (chance(size_a) * chance(size_b)).sum(axis=1) * 2.0**-MANTISSA
    n = np.maximum(filled.sum(axis=1), 1)
    return np.clip((same / n - collide) / (1 - collide), 0.0, 1.0)


SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, sketch binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                sets = shingle_sets(texts, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                held: list[bytes | None] = [None] * len(sets)
                for i, r in zip(full, registers([sets[i] for i in full]) if full else ()):
                    held[i] = r.tobytes()
                digests = np.array([[mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + U64(0x14057B7EF767814F)).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(held, pa.binary())],
                    names=["doc_id", "n_shingles", "digest_a", "digest_b", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def band_keys(classes: DataFrame) -> DataFrame:
    """(band_key, rep, n_shingles, sketch is left out) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            r = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(n, BANDS, BUCKETS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), (n, BANDS)).copy()
            for j in range(BUCKETS):
                key = mix(key ^ r[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))],
                names=["band_key", "rep"],
            )

    return classes.select("rep", "sketch").mapInArrow(run, "band_key long, rep long")


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that set sizes and sketch estimates do not rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("s_a", "s_b")]
            j = estimate(s[0], s[1], batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(j >= threshold - SLACK))

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, small: bool, k: int) -> DataFrame:
    """(rep, members: the shingle set as bytes) of the classes named in ``ids(rep)``."""
    wanted = docs.select("doc_id", "text").join(hint_if(ids.select(F.col("rep").alias("doc_id")), small), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], names=["rep", "members"]
                )

    return wanted.mapInArrow(run, "rep long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("members").alias(f"m_{x}"))
    joined = pairs.join(side("a"), ["a"]).join(side("b"), ["b"])
    if hot is not None:
        joined = _salted(_salted(pairs, side("a"), "a", "b", hot), side("b"), "b", "a", hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("m_a"), batch.column("m_b"))):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                merged = np.concatenate([x, y])
                merged.sort()
                both = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(merged) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def hot_ends(pairs: DataFrame) -> DataFrame | None:
    """(rep, salts) of the classes in more than ``HOT`` of ``pairs(a, b)``; None if there are none."""
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b"))
    hot, counts = measured(ends.groupBy("rep").count().where(F.col("count") > HOT).select("rep", F.ceil(F.col("count") / HOT).cast("int").alias("salts")), "hot")
    return hint_if(hot, counts["rows"] <= BROADCAST_IDS) if counts["rows"] else None


def _salted(pairs: DataFrame, held: DataFrame, on: str, other: str, hot: DataFrame) -> DataFrame:
    """The join of ``pairs`` with ``held`` on column ``on``; a hot class is repeated under several salts, and its pairs are dealt to them."""
    hot, salts = hot.withColumnRenamed("rep", on), F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    copies = held.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, [on, "salt"]).drop("salt")


def heavy_links(at: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, among the classes of heavy keys ``at(band_key, rep, component)``.

    A component with its strays is dealt to blocks by size; a task holds a block of them and a
    block of the strays. What is joined by component is one row for each component with
    strays, broadcast if that is small, so a component's classes need not meet in one task.
    """
    counts = at.groupBy("band_key", "component").count()
    largest = counts.groupBy("band_key").agg(F.max(F.struct("count", "component")).alias("m")).select("band_key", F.col("m.component").alias("home"))
    strays = cut(at.join(largest, "band_key").where("component <> home").select("home", "rep").distinct(), "strays")
    homes, counts = measured(strays.select("home").distinct(), "homes")
    small = counts["rows"] <= BROADCAST_IDS
    members = label.select(F.col("component").alias("home"), F.col("node").alias("rep")).join(hint_if(homes, small), "home", "left_semi")
    sized = sets.select("rep", "members", (F.length("members") / 8).alias("n"))
    group = members.withColumn("stray", F.lit(False)).unionByName(strays.withColumn("stray", F.lit(True)))
    held = cut(group.join(sized, "rep").select("home", "stray", "rep", "members", "n"), "groups")
    blocks = held.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("stray"), F.col("n"))) / BLOCK_SHINGLES).cast("int").alias("asked"))
    placed = held.join(hint_if(blocks, small), "home")
    block, turn = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("asked")).cast("int")
    targets = placed.select("home", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("turn"), "stray", F.lit(False).alias("asks"), "rep", "members")
    queries = placed.where("stray").select("home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), turn.alias("turn"), "stray", F.lit(True).alias("asks"), "rep", "members")

    def compare(table: pa.Table) -> pa.Table:
        asks, stray, rep = (table.column(c).to_numpy() for c in ("asks", "stray", "rep"))
        held = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in table.column("members")]
        out: list[tuple[int, int]] = []
        rows = np.flatnonzero(~asks)
        if len(rows) and asks.any():
            sizes = np.array([len(held[i]) for i in rows])
            vocabulary, inverse = np.unique(np.concatenate([held[i] for i in rows]), return_inverse=True)
            begins = np.cumsum(sizes) - sizes
            parent: dict = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            # members of the component are one node
            home = "home"
            node = [int(rep[i]) if stray[i] else home for i in rows]
            for i in np.flatnonzero(asks):
                spot = np.minimum(np.searchsorted(vocabulary, held[i]), len(vocabulary) - 1)
                mark = np.zeros(len(vocabulary), dtype=np.int32)
                mark[spot[vocabulary[spot] == held[i]]] = 1
                both = np.add.reduceat(mark[inverse], begins)
                for j in np.flatnonzero(100 * both >= percent * (sizes + len(held[i]) - both)):
                    x, y = find(int(rep[i])), find(node[j])
                    if x != y:
                        parent[x] = y
                        out.append((int(rep[i]), int(rep[rows[j]])))
        a, b = ([min(p) for p in out], [max(p) for p in out])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return targets.unionByName(queries).groupBy("home", "block", "turn").applyInArrow(compare, "a long, b long")


def _repeated(drawn: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """The doc_ids that occur with different texts, and their number."""
    many = drawn.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high").select("doc_id")
    many, counts = measured(many, "many")
    return hint_if(many, counts["rows"] <= BROADCAST_IDS), counts["rows"]


def _same_name(drawn: DataFrame, many: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the classes that one of the doc_ids ``many`` occurs in, each with the least of them."""
    rows = drawn.where("n_shingles > 0").select("doc_id", *key).join(many, "doc_id", "left_semi").distinct()
    named = cut(rows.join(classes.select(*key, "rep"), key).select("doc_id", "rep").distinct(), "names")
    return named.groupBy("doc_id").agg(F.min("rep").alias("a")).join(named, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``; doc_ids are integers.

    Documents are linked if their sets of distinct ``k``-word shingles have
    100 * intersection >= ``percent`` * union; components of these links are groups, and
    component_id is the least doc_id of the group. Words are ``[^\\x20\\x09-\\x0D]+`` after
    A-Z is lower-cased. A text of fewer words is one shingle; a null text, an empty one or
    one without words has no shingle, n_shingles 0, and is a group of its own, but for rows
    that repeat a doc_id: they are one document, so what is linked with any of their texts is
    in one group with all, and they share its component_id. A null doc_id is linked with
    nothing: its component_id is null and it is kept. Other columns of ``docs`` are not read.
    An empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, k, percent), "near")


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    drawn = cut(sketches(docs, k), "sketches")
    threshold = percent / 100
    named = drawn.where("doc_id is not null and n_shingles > 0")
    key = ["digest_a", "digest_b", "n_shingles"]
    classes = cut(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    # A doc_id that is the rep of several classes makes them one component by its name; other names that occur in several link them.
    many, n_many = _repeated(drawn, key)
    links = cut(_same_name(drawn, many, classes, key), "links") if n_many else None
    keys = band_keys(classes).distinct()
    shared = keys.groupBy("band_key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band_key")
    candidates = cut(keys.join(shared, "band_key"), "candidates")
    reps, counts = measured(candidates.select("rep").distinct(), "reps")
    sets = cut(full_sets(docs, reps, counts["rows"] <= BROADCAST_IDS, k), "sets")

    def labelled(grown: DataFrame | None) -> DataFrame:
        if grown is None:
            return reps.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
        return reps.join(grown, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("node"), F.coalesce("component", "rep").alias("component"))

    grown = None if links is None else components(links)
    label = labelled(grown)
    tested = None
    for step in ("least", "picked", "rest"):
        at = candidates.join(label, F.col("rep") == F.col("node")).select("band_key", "rep", "component")
        open_keys = at.groupBy("band_key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("band_key", "size")
        at, counts = measured(at.join(open_keys, "band_key"), "open", heavy=F.col("size") > LIGHT)
        if not counts["rows"]:
            break
        if step == "rest":
            light = at.where(F.col("size") <= LIGHT)
            x, y = light.select("band_key", F.col("rep").alias("a"), F.col("component").alias("c_a")), light.select("band_key", F.col("rep").alias("b"), F.col("component").alias("c_b"))
            pairs = x.join(y, "band_key").where("c_a < c_b")
        else:
            order = F.struct("rep") if step == "least" else F.struct(F.xxhash64("band_key", "rep"), F.col("rep"))
            lead = at.groupBy("band_key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("a"), F.col("component").alias("c_a"))).alias("l")).select("band_key", "l.a", "l.c_a")
            pairs = at.select("band_key", F.col("rep").alias("b"), F.col("component").alias("c_b")).join(lead, "band_key").where("c_a <> c_b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = confirmed(plausible(pairs, classes, threshold), sets, percent, hot_ends(pairs))
        if step == "rest" and counts["heavy"]:
            found = found.unionByName(heavy_links(at.where(F.col("size") > LIGHT), label, sets, percent))
        links = cut(found if links is None else links.unionByName(found), "links")
        grown = components(links)
        label = labelled(grown)
    of_class = classes.select(*key, "rep")
    if grown is None:
        of_class = of_class.select(*key, F.col("rep").alias("component_id"))
    else:
        of_class = of_class.join(grown.where("component <> node"), F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    rows = drawn.select("doc_id", *key).join(of_class, key, "left")
    found = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).alias("component_id"))
    if n_many:  # a row without shingles takes the component of the other rows of its doc_id
        others = found.where("component_id is not null").join(many, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("d")).agg(F.min("component_id").alias("of_name"))
        found = found.join(others, (F.col("doc_id") == F.col("d")) & F.col("component_id").isNull(), "left")
        found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "of_name").alias("component_id"))
    found = found.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
