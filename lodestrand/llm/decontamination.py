"""Benchmark contamination by Wu-Manber multi-pattern search over words (operator 7).

The patterns are the windows of the benchmark items. Patterns of one length m form one
matcher. Its blocks are runs of B = 3 words (fewer for shorter patterns). The shift table
says, for a block that ends at the current word, how far the search may move without
passing the end of a pattern: m - B + 1 for a block that is in no pattern, otherwise the
distance of its last place in any pattern from the pattern's end. Where the shift is 0,
the block is a pattern's suffix; its bucket holds the patterns with that suffix, and the
words before it are compared directly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.words import LOWER, as_bytes

WINDOW, BLOCK = 13, 3
#: Bytes of benchmark text searched for at once; a larger benchmark is searched in several passes.
PASS_BYTES = 32_000_000

#: To lower case, and every separator (a byte below 0x80 that is no digit and no letter) to a space.
_FOLD = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after A-Z is lower-cased."""
    return text.translate(_FOLD).split()


class Matcher:
    """All patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.bucket[pattern[length - self.block :]][pattern[: length - self.block]] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of each occurrence, in order."""
        block, jump, shift, bucket, before = self.block, self.jump, self.shift, self.bucket, self.length - self.block
        end, n = self.length, len(words)
        while end <= n:
            last = tuple(words[end - block : end])
            move = shift.get(last, jump)
            if move:
                end += move
                continue
            begin = end - block - before
            items = bucket[last].get(tuple(words[begin : begin + before]))
            if items is not None:
                yield begin, items
            end += 1


def build(items: list[tuple[object, bytes]]) -> list[Matcher]:
    """Matchers for (item_id, text) pairs, one for each window length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for index, (_, text) in enumerate(items):
        words = item_words(text)
        k = min(WINDOW, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            held = by_length[k][tuple(words[i : i + k])]
            if not held or held[-1] != index:
                held.append(index)
    return [Matcher(k, patterns) for k, patterns in sorted(by_length.items())]


@lru_cache(maxsize=2)
def _built(items: tuple[tuple[object, bytes], ...]) -> list[Matcher]:
    return build(list(items))


def occurrences(words: list[bytes], matchers: list[Matcher]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges hit in ``words``, and the items with occurring windows."""
    spans, items = [], set()
    for matcher in matchers:
        for begin, found in matcher.search(words):
            spans.append((begin, begin + matcher.length))
            items.update(found)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


SPANS = "array<struct<begin:int,end:int>>"


def _passes(benchmark: DataFrame) -> Iterator[tuple[tuple[object, bytes], ...]]:
    """The benchmark in blocks of at most PASS_BYTES of text (an item above that is its own block)."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null and text <> ''").distinct().orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        raw = text.encode("utf-8", "surrogatepass")
        if held and held + len(raw) > PASS_BYTES:
            yield tuple(block)
            block, held = [], 0
        block.append((item_id, raw))
        held += len(raw)
    if block:
        yield tuple(block)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``bench_words`` (words of the text), ``bench_spans`` (merged ranges
    of words inside occurrences of benchmark windows) and ``bench_items`` (ids of the items, as strings).

    One narrow pass over ``docs`` for each block of the benchmark; no shuffle. Columns of
    these three names in ``docs`` are replaced.
    """
    out = docs.drop("bench_words", "bench_spans", "bench_items")
    columns = out.columns
    plain = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in out.schema.fields)
    blocks = list(_passes(benchmark)) or [()]
    if len(blocks) > 1:
        out = out.withColumns({"bench_words": F.lit(0), "bench_spans": F.lit(None).cast(SPANS), "bench_items": F.lit(None).cast("array<string>")})
    for items in blocks:

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matchers = _built(items)
            for batch in batches:
                earlier = len(batch.schema.names) > len(columns)
                counts, spans, ids = [], [], []
                for row, text in enumerate(as_bytes(batch.column(columns.index("text")))):
                    words = item_words(text)
                    merged, found = occurrences(words, matchers)
                    named = {items[i][0] for i in found}
                    if earlier:
                        named |= set(batch.column("bench_items")[row].as_py() or ())
                        merged = _union(merged, [(s["begin"], s["end"]) for s in batch.column("bench_spans")[row].as_py() or ()])
                    counts.append(len(words))
                    spans.append([{"begin": a, "end": b} for a, b in merged])
                    ids.append(sorted((n for n in named if n is not None)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(columns))]
                    + [pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))],
                    names=[*columns, "bench_words", "bench_spans", "bench_items"],
                )

        out = out.mapInArrow(run, f"{plain}, bench_words int, bench_spans {SPANS}, bench_items array<string>")
    return out


def _union(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x + y):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hit():
    return F.aggregate("bench_spans", F.lit(0), lambda total, s: total + s["end"] - s["begin"])


def _contaminated():
    return (_hit() > 0) & (20 * _hit() >= F.col("bench_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs(doc_id, text)``.

    A window is 13 consecutive words of an item, or all words of an item with fewer. A
    document word inside an occurrence of a window is hit. Items are named by the string
    of their item_id; items that share an id count once, an item with a null id is searched
    for but never listed. A document is contaminated if at least one word is hit and 20 *
    n_hit >= n_words. A null or empty text has no words and is clean; a null or empty item
    has no window; an empty benchmark leaves every document clean. Repeated rows each get
    their own row.
    """
    found = search(docs.select("doc_id", F.col("text").cast("string")), benchmark)
    return found.select(
        "doc_id",
        F.col("bench_words").cast("long").alias("n_words"),
        _hit().cast("long").alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    return search(docs, benchmark).where(~_contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])


def empty_digest() -> str:
    """items_sha256 of a document without items."""
    return hashlib.sha256(b"").hexdigest()
