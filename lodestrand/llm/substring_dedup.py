"""Removal of repeated passages by fixed-block anchors (operator 2).

A passage is repeated if a window of ``window`` words starts at two places of the corpus.
With blocks of B = (window + 1) // 2 words, laid end to end from each text's first word,
every window holds a whole block of its own text, and if the window is repeated, so is
that block, somewhere in the corpus at some offset. Hence:

1. index: the blocks (anchors) of every text, by hash; probe: every rolling run of B words
   of every text. An anchor is hit if its words start at a second place.
2. extend: around hit anchors, the windows all of whose anchors are hit are the only
   candidates; they are compared with each other across the corpus, and a maximal run of
   repeated windows is a maximal exact repeat.
3. words covered by repeated windows are removed.

What is shuffled, between parts of the hash range: 4 bytes for each distinct run of B
words of a batch, 16 for an anchor that its own batch cannot decide, 8 for a candidate
window, and once the text itself, by doc_id. A batch sends a hash once however often it
has it, and decides its own repeats, so a passage in a third of all rows costs each
task one entry. Windows are compared by 64-bit hashes within parts dealt by a second
hash of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, n_partitions
from lodestrand.llm.words import U64, as_bytes, chunks, mix, split, window_hashes, windows, word_hashes

WINDOW = 35
#: Bytes of text whose runs are combined before they are sent.
BATCH_BYTES = 24_000_000


def parts(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n)) >> U64(32)


class _Runs:
    """What a batch of texts has of rolling runs and anchors."""

    def __init__(self, block: int):
        self.block = block
        self.runs: list[np.ndarray] = []
        self.anchor_hash: list[np.ndarray] = []
        self.anchor_row: list[np.ndarray] = []
        self.anchor_at: list[np.ndarray] = []
        self.bytes = 0

    def add(self, texts: list[bytes], rows: np.ndarray) -> None:
        words = split(texts)
        at = windows(words, self.block)
        self.bytes += sum(map(len, texts))
        if not len(at):
            return
        h = window_hashes(word_hashes(words), self.block)[at]
        text = np.searchsorted(words.first, at, side="right") - 1
        offset = at - words.first[text]
        own = offset % self.block == 0
        self.runs.append(h)
        self.anchor_hash.append(h[own])
        self.anchor_row.append(rows[text[own]])
        self.anchor_at.append((offset[own] // self.block).astype(np.int32))

    def sent(self, n: int) -> Iterator[dict]:
        """A row for each part: distinct runs, and the anchors that are still open; part -1: anchors hit inside the batch."""
        if not self.runs:
            return
        runs = np.concatenate(self.runs)
        runs.sort()
        new = np.empty(len(runs), dtype=bool)
        new[0] = True
        np.not_equal(runs[1:], runs[:-1], out=new[1:])
        first = np.flatnonzero(new)
        distinct = runs[first]
        many = np.diff(np.append(first, len(runs))) > 1
        h, row, at = np.concatenate(self.anchor_hash), np.concatenate(self.anchor_row), np.concatenate(self.anchor_at)
        local = many[np.searchsorted(distinct, h)]
        yield {"part": -1, "runs": b"", "many": b"", "hashes": b"", "rows": row[local].tobytes(), "places": at[local].tobytes()}
        bounds = np.searchsorted(parts(distinct, n), np.arange(n + 1, dtype=np.uint64))
        h, row, at = h[~local], row[~local], at[~local]
        to = parts(h, n)
        order = np.argsort(to, kind="stable")
        h, row, at = h[order], row[order], at[order]
        edges = np.searchsorted(to[order], np.arange(n + 1, dtype=np.uint64))
        low = distinct.astype(np.uint32)
        for p in range(n):
            a, b, c, d = bounds[p], bounds[p + 1], edges[p], edges[p + 1]
            if b > a:
                yield {"part": p, "runs": low[a:b].tobytes(), "many": np.packbits(many[a:b]).tobytes(), "hashes": h[c:d].astype(np.uint32).tobytes(), "rows": row[c:d].tobytes(), "places": at[c:d].tobytes()}


SENT = pa.schema([("part", pa.int32()), ("runs", pa.binary()), ("many", pa.binary()), ("hashes", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])
HITS = "row_id long, blocks array<int>"


def _join(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), dtype=dtype)


def _hit_rows(rows: np.ndarray, places: np.ndarray) -> pa.Table:
    """(row_id, blocks) for pairs of row and block, one row for each row_id."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    ids, first = np.unique(rows, return_index=True)
    blocks = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(places.astype(np.int32)))
    return pa.table({"row_id": pa.array(ids.astype(np.int64)), "blocks": blocks})


def hit_anchors(texts: DataFrame, window: int) -> DataFrame:
    """(row_id, blocks): the anchors of each text whose words start at a second place of the corpus.

    Runs are told apart by part and 32 bits, so now and then an anchor counts as hit that is
    not; the windows are compared again, so this changes nothing but their number.
    """
    n, block = n_partitions(texts.sparkSession), (window + 1) // 2

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Runs(block)
        for batch in batches:
            for part, raw in chunks(batch):
                held.add(raw, part.column("row_id").to_numpy())
                if held.bytes >= BATCH_BYTES:
                    for row in held.sent(n):
                        yield pa.RecordBatch.from_pylist([row], schema=SENT)
                    held = _Runs(block)
        for row in held.sent(n):
            yield pa.RecordBatch.from_pylist([row], schema=SENT)

    def probe(table: pa.Table) -> pa.Table:
        rows, places = _join(table.column("rows"), np.int64), _join(table.column("places"), np.int32)
        if table.column("part")[0].as_py() < 0:
            return _hit_rows(rows, places)
        hashes = _join(table.column("hashes"), np.uint32)
        wanted = np.unique(hashes)
        count = np.zeros(len(wanted) + 1, dtype=np.int64)
        bitmap = np.zeros(1 << 22, dtype=bool)  # most runs are no anchor of this part and go no further
        bitmap[wanted >> np.uint32(10)] = True
        for runs, many in zip(table.column("runs").to_pylist(), table.column("many").to_pylist()):
            h = np.frombuffer(runs, dtype=np.uint32)
            maybe = np.flatnonzero(bitmap[h >> np.uint32(10)])
            g = h[maybe]
            at = np.searchsorted(wanted, g)
            found = wanted[np.minimum(at, len(wanted) - 1)] == g if len(wanted) else np.zeros(len(g), dtype=bool)
            weight = 1 + np.unpackbits(np.frombuffer(many, dtype=np.uint8), count=len(h))[maybe]
            np.add.at(count, at[found], weight[found])
        hit = count[np.searchsorted(wanted, hashes)] > 1
        return _hit_rows(rows[hit], places[hit])

    spread = texts.mapInArrow(index, "part int, runs binary, many binary, hashes binary, rows binary, places binary")
    # Anchors decided in their batch need no part of the hash range; they are dealt out by their rows.
    key = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("rows"), F.lit(n))).otherwise(F.col("part"))
    return spread.withColumn("group", key.cast("int")).groupBy("group").applyInArrow(probe, HITS)


class _Candidates:
    """Windows of a batch all of whose anchors are hit, as runs of consecutive windows."""

    def __init__(self, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.hash: list[np.ndarray] = []
        self.deal: list[np.ndarray] = []
        self.row: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.bytes = 0

    def add(self, texts: list[bytes], rows: np.ndarray, blocks: list[list[int]]) -> None:
        words = split(texts)
        self.bytes += sum(map(len, texts))
        at = windows(words, self.window)
        if not len(at):
            return
        text = np.searchsorted(words.first, at, side="right") - 1
        # anchors that are not hit, as running counts over the words at which they start
        n = int(words.first[-1])
        size = words.counts
        full = size // self.block
        starts = np.repeat(words.first[:-1], full) + self.block * (np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full))
        missed = np.zeros(n + 1, dtype=np.int32)
        missed[starts] = 1
        for i, hit in enumerate(blocks):
            if hit is not None and len(hit):
                missed[words.first[i] + self.block * np.asarray(hit, dtype=np.int64)] = 0
        total = np.zeros(n + 2, dtype=np.int64)
        np.cumsum(missed, out=total[1:])
        # anchors wholly inside the window: they start from at to at + window - block
        keep = total[at + self.window - self.block + 1] - total[at] == 0
        at, text = at[keep], text[keep]
        if not len(at):
            return
        h = word_hashes(words)
        # windows that follow each other mostly share their least run, and so their part
        small = window_hashes(h, self.block)
        span = self.window - self.block + 1
        least = np.lib.stride_tricks.sliding_window_view(small, span)[at].min(axis=1)
        self.hash.append(window_hashes(h, self.window)[at])
        self.deal.append(mix(least))  # least values crowd near 0; mixed, they spread over the parts
        self.row.append(rows[text])
        self.at.append((at - words.first[text]).astype(np.int32))

    def sent(self, n: int) -> Iterator[pa.RecordBatch]:
        if not self.hash:
            return
        h, to, row, at = np.concatenate(self.hash), parts(np.concatenate(self.deal), n).astype(np.int32), np.concatenate(self.row), np.concatenate(self.at)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.empty(len(s), dtype=bool)
        first[0] = True
        np.not_equal(s[1:], s[:-1], out=first[1:])
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        local = np.empty(len(h), dtype=bool)
        local[order] = many[group]
        yield _pack(np.full(1, -1, dtype=np.int32), [(row[local], at[local], np.empty(0, dtype=np.uint64), True)])
        once = np.zeros(len(h), dtype=bool)
        once[order[first]] = True  # one of equal windows goes out
        keys, packed = [], []
        to_sent, known = to[once], local[once]
        h, row, at = h[once], row[once], at[once]
        order = np.argsort(to_sent, kind="stable")
        edges = np.searchsorted(to_sent[order], np.arange(n + 1))
        for p in range(n):
            mine = order[edges[p] : edges[p + 1]]
            for flag in (False, True):
                chosen = mine[known[mine] == flag]
                if len(chosen):
                    keys.append(p)
                    packed.append((row[chosen], at[chosen], h[chosen], flag))
        if keys:
            yield _pack(np.array(keys, dtype=np.int32), packed)


PACKED = "part int, known boolean, rows binary, begins binary, lengths binary, hashes binary"


def _consecutive(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, row, begin, length) of the maximal runs of consecutive places."""
    order = np.lexsort((at, row))
    r, a = row[order], at[order]
    if not len(r):
        return order, r, a, a
    new = np.empty(len(r), dtype=bool)
    new[0] = True
    new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    return order, r[first], a[first], np.diff(np.append(first, len(r))).astype(np.int32)


def _pack(keys: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], []]
    for row, at, h, known in groups:
        if known and len(h):  # the batch has decided these; only their hashes are of use to others
            values = (known, b"", b"", b"", h.tobytes())
        else:
            order, r, begin, length = _consecutive(row, at)
            values = (known, r.tobytes(), begin.tobytes(), length.tobytes(), h[order].tobytes() if len(h) else b"")
        for column, v in zip(columns, values):
            column.append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array(columns[0], pa.bool_()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["part", "known", "rows", "begins", "lengths", "hashes"]
    )


RANGES = "row_id long, begin int, length int"


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """(row_id, begin, length): runs of ``length`` windows of ``texts`` (row_id, text, blocks, and others unread), from word ``begin``, that are repeated."""
    n = n_partitions(texts.sparkSession)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Candidates(window)
        for batch in batches:
            for part, raw in chunks(batch):
                blocks = part.column("blocks").to_pylist()
                held.add(raw, part.column("row_id").to_numpy(), blocks)
                if held.bytes >= BATCH_BYTES:
                    yield from held.sent(n)
                    held = _Candidates(window)
        yield from held.sent(n)

    def compare(table: pa.Table) -> pa.Table:
        empty = pa.table({"row_id": pa.array([], pa.int64()), "begin": pa.array([], pa.int32()), "length": pa.array([], pa.int32())})
        if table.column("part")[0].as_py() < 0:
            row, begin, length = _join(table.column("rows"), np.int64), _join(table.column("begins"), np.int32), _join(table.column("lengths"), np.int32)
            return pa.table({"row_id": row, "begin": begin, "length": length})
        known = np.array(table.column("known").to_pylist(), dtype=bool)
        rows, begins, lengths, hashes = (table.column(c).to_pylist() for c in ("rows", "begins", "lengths", "hashes"))
        pieces = [np.frombuffer(x, dtype=np.uint64) for x in hashes]
        twice = np.concatenate([np.concatenate([p, p]) if k else p for p, k in zip(pieces, known)])
        twice.sort()
        repeated = np.unique(twice[1:][twice[1:] == twice[:-1]])
        if not len(repeated):
            return empty
        row = np.frombuffer(b"".join(rows), dtype=np.int64)
        length = np.frombuffer(b"".join(lengths), dtype=np.int32)
        begin = np.frombuffer(b"".join(begins), dtype=np.int32)
        h = np.concatenate([p for p, k in zip(pieces, known) if not k] or [np.empty(0, dtype=np.uint64)])
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(len(h))
        of = np.repeat(row, length)
        place = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
        hit = repeated[place] == h
        _, r, b, c = _consecutive(of[hit], at[hit])
        return pa.table({"row_id": r.astype(np.int64), "begin": b.astype(np.int32), "length": c.astype(np.int32)})

    # All columns go in, so that the exchange below has the columns of the other use of it.
    spread = texts.mapInArrow(collect, PACKED)
    key = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("rows"), F.lit(n))).otherwise(F.col("part"))
    return spread.withColumn("group", key.cast("int")).groupBy("group").applyInArrow(compare, RANGES)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_id``: doc_id where no doc_id is null or repeated, else a hash of doc_id and text.

    Rows equal in both share the hash; as their texts are equal, so are their repeats.
    """
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").head(1)
    return docs.withColumn("row_id", F.xxhash64("doc_id", "text") if twice else F.col("doc_id").cast("long"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row_id, doc_id, text, ranges) for each row of ``docs(doc_id, text)``; ranges(begin, length) are its
    runs of repeated windows, null where there are none.

    The text is shuffled once, by row_id; both joins use that exchange.
    """
    rows = with_row_ids(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    hits = hit_anchors(rows.select("row_id", "text"), window).groupBy("row_id").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    # No row_id is null; said here, both joins see the same exchange (an inner join would add it to one).
    held = rows.where("row_id is not null").repartition(n_partitions(docs.sparkSession), "row_id")
    near = held.join(hits.hint("shuffle_hash"), "row_id").select("row_id", "doc_id", "text", "blocks")
    found = repeated_windows(near, window).groupBy("row_id").agg(F.collect_list(F.struct("begin", "length")).alias("ranges"))
    return held.join(found.hint("shuffle_hash"), "row_id", "left").select("row_id", "doc_id", "text", "ranges")


def kept_words(text: bytes, ranges: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those that no repeated window covers."""
    words = text.split()
    if not ranges:
        return len(words), words
    out, done = [], 0
    for begin, end in sorted((r["begin"], r["begin"] + r["length"] + window - 1) for r in ranges):
        if begin > done:
            out += words[done:begin]
        done = max(done, end)
    return len(words), out + words[done:]


def _finished(found: DataFrame, window: int, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [make(*kept_words(text, ranges, window)) for text, ranges in zip(as_bytes(batch.column("text")), batch.column("ranges").to_pylist())]
            if columns:
                made = pa.RecordBatch.from_pylist(columns, schema=target)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], names=["doc_id", *target.names])

    kinds = {"long": pa.int64(), "string": pa.string()}
    target = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    return found.select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, {schema}")


def removal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word is removed that lies in a window of
    ``window`` words which also starts anywhere else, in the same text or another; all copies
    go, also the first. Windows are judged on the input. A null text has no words; its
    kept words, like those of an empty text, join to the empty string. Repeated rows repeat
    each other. Texts shorter than a window stay whole. Other columns are not read.
    """

    def make(n: int, kept: list[bytes]) -> dict:
        return {"n_words": n, "n_removed": n - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    return _finished(repeats(docs, window), window, "n_words long, n_removed long, kept_sha256 string", make)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_removed): the kept words of each text, joined by one space."""

    def make(n: int, kept: list[bytes]) -> dict:
        return {"text": b" ".join(kept).decode("utf-8", "replace"), "n_removed": n - len(kept)}

    return _finished(repeats(docs, window), window, "text string, n_removed long", make)
