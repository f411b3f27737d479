"""Span de-duplication inside a conversation: later copies of a long token run are deleted.

Texts are taken in order, definers (system text, the last user message) first. In each
text, from left to right, a run of at least ``k`` tokens that an earlier text has is
deleted as far as it matches the first such place; the text's own tokens, deleted ones
too, count as seen for the texts after it, not for itself. ``without_seen`` says the same
of the texts of one conversation in memory.

What is seen depends on the given texts only, not on what is deleted, so no task needs to
hold a conversation. (1) Every window of ``k`` tokens is hashed and sent where all windows
with the same anchor go, the least hash of the ``m``-token runs inside; neighbouring windows
mostly share an anchor and travel as one row. There, in the order of texts, a window's first
place is known. (2) The places of a text are merged to segments, runs of windows whose
places follow each other in one text. (3) A match that goes on beyond its segment
does so where the earlier text itself repeats others, so it is found by comparing the
segments of both. (4) Deletions follow from left to right. Anchors have 64 bits and windows
under an anchor 48 more.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.sources.tables import written

_TOKEN = re.compile(r"\s*\S+|\s+$")


def tokens(text: str) -> list[str]:
    """Words with the blanks before them; they join to the text."""
    return _TOKEN.findall(text)


def without_seen(texts: list[tuple[str, bool]], k: int) -> list[str]:
    """``texts`` of (text, deletable), in order, without their seen runs."""
    if k < 2:
        return [t for t, _ in texts]
    held: list[list[str]] = []
    places: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
    out = []
    for text, deletable in texts:
        own = tokens(text)
        kept, i = [], 0
        while deletable and i < len(own):
            spots = places.get(tuple(own[i : i + k])) if i + k <= len(own) else None
            if not spots:
                kept.append(own[i])
                i += 1
                continue
            source, at = held[spots[0][0]], spots[0][1]
            n = k
            while i + n < len(own) and at + n < len(source) and own[i + n] == source[at + n]:
                n += 1
            i += n
        out.append("".join(kept) if deletable and len(kept) < len(own) else text)
        for j in range(len(own) - k + 1):
            places[tuple(own[j : j + k])].append((len(held), j))
        held.append(own)
    return out


_U = np.uint64
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # no blank lies above U+3000
#: Code points, or tokens of short texts, that are hashed at once.
_AT_ONCE = 1 << 20
#: Bytes of a window's hash that travel; the anchor tells apart the rest.
_WIDTH = 6
#: A text's place in the order of its conversation, and its name: the digest covers conversation, text and copy.
DOC = ["rank", "place", "digest"]
_STRETCH = "anchor long, rank int, place long, digest long, start int, windows binary"
_PIECE = "rank int, place long, digest long, start int, n int, of_rank int, of_place long, of_digest long, at int"
_SEGMENT = "struct<start:int,n:int,of_rank:int,of_place:bigint,of_digest:bigint,at:int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``tokens`` of all texts, and the number of the first token of each text, with the total at the end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    begins = np.cumsum([0, *map(len, texts)])
    space = _SPACE[np.minimum(codes, 0x3001)]
    opens = np.zeros(len(codes) + 1, dtype=bool)
    opens[1:-1] = space[1:] & ~space[:-1]
    opens[begins] = True
    opens[-1] = False
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, begins)
    ends = np.append(starts[1:], len(codes))
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _AT_ONCE, "right")))
        own, size = starts[a:b] - starts[a], ends[a:b] - starts[a:b]
        spot = np.arange(starts[a], ends[b - 1]) - np.repeat(starts[a:b], size)
        chars = _mix(codes[starts[a] : ends[b - 1]].astype(np.uint64) + spot.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        out[a:b] = _mix(np.add.reduceat(chars, own) + size.astype(np.uint64))
        a = b
    return out, first


def _runs(x: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` over the ``n`` values from each position on, by doubling; where n is no power of two, two runs overlap."""
    size = 1
    while 2 * size <= n:
        x = join(x[:-size], x[size:])
        size *= 2
    return join(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _U(0xD1342543DE82EF95) + b)


def stretches(texts: list[str], names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, anchor, start, windows) for each run of windows of a text that share an anchor; ``names``: a hash for each text's conversation."""
    h, first = token_hashes(texts)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), pa.array([], pa.binary()))
    m = 1 << (max(1, k // 4).bit_length() - 1)
    row = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = first[row] + start
    salt = _mix(names.astype(np.int64).view(np.uint64))[row]
    anchor = _mix(_runs(_runs(h, m, _hashed), k - m + 1, np.minimum)[spot] ^ salt)
    window = _mix(_runs(h, k, _hashed)[spot] ^ salt)
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])))
    held = np.ascontiguousarray(window.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH])
    offsets = (np.append(cut, total) * _WIDTH).astype(np.int32)
    windows = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return row[cut], anchor[cut].view(np.int64), start[cut].astype(np.int32), windows


def _all_stretches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), _AT_ONCE, "right")))
            part = batch.slice(a, b - a)
            row, anchor, start, windows = stretches(part.column("text").to_pylist(), part.column("conv").to_numpy(), k)
            doc = [part.column(c).take(pa.array(row)) for c in DOC]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), *doc, pa.array(start), windows], names=["anchor", *DOC, "start", "windows"])
            a = b


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts whose windows' first places follow each other in an earlier text or before in the same; ``batches`` in the order of anchor, text and start."""
    current, first = None, {}
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        if not len(anchor):
            continue
        same = np.append(False, anchor[1:] == anchor[:-1])
        same[0] = anchor[0] == current
        # an anchor that stands alone says nothing; the last one of a batch may go on
        rows = np.flatnonzero(same | np.append(same[1:], True))
        out = []
        docs = list(zip(*(batch.column(c).take(pa.array(rows)).to_pylist() for c in DOC)))
        spots, windows = batch.column("start").to_numpy()[rows].tolist(), batch.column("windows")
        for r, doc, start in zip(rows.tolist(), docs, spots):
            if anchor[r] != current or not same[r]:
                current, first = anchor[r], {}
            raw = windows[r].as_buffer()
            padded = np.zeros((raw.size // _WIDTH, 8), dtype=np.uint8)
            padded[:, :_WIDTH] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _WIDTH)
            source, at, n = None, 0, 0
            for i, w in enumerate(padded.view("<u8").reshape(-1).tolist(), start):
                place = first.get(w)
                if place is None:
                    first[w] = place = (doc, i)
                # its own first place is no piece; an earlier one of the same text is, for (3)
                of, spot = place if place != (doc, i) else (None, 0)
                if n and (of != source or spot != at + n):
                    out.append((*doc, i - n, n, *source, at))
                    n = 0
                if of is not None:
                    if not n:
                        source, at = of, spot
                    n += 1
            if n:
                out.append((*doc, i + 1 - n, n, *source, at))
        current = anchor[-1]
        yield _batch(out, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()], [f.split()[0] for f in _PIECE.split(", ")])


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)


Segment = tuple[int, int, tuple[int, int, int], int]


def merged(pieces: list[dict]) -> list[Segment]:
    """Segments (start, n, source, at) of a text's pieces."""
    out: list[Segment] = []
    for p in sorted(pieces, key=lambda p: p["start"]):
        start, n, of, at = p["start"], p["n"], (p["of_rank"], p["of_place"], p["of_digest"]), p["at"]
        if out:
            was, m, source, spot = out[-1]
            if was + m == start and source == of and spot + m == at:
                out[-1] = (was, m + n, source, spot)
                continue
        out.append((start, n, of, at))
    return out


def deletions(doc: tuple[int, int, int], segments: list[Segment], others: dict[tuple, list[Segment]], k: int) -> list[tuple[int, int]]:
    """Deleted tokens [start, end) of the text ``doc``; ``others``: the segments of those earlier texts in which a match may go on."""
    at_start = {of: {s[0]: s for s in held} for of, held in others.items()}
    out, i = [], 0
    for j, (start, n, source, at) in enumerate(segments):
        a, end, spot = max(i, start), start + n, at + n
        if a >= end or source == doc:
            continue
        for begins, m, of, where in segments[j + 1 :]:
            if begins != end:
                break
            if (of, where) == (source, spot):  # the source is the first to have these, too
                same = m
            else:
                its = at_start.get(source, {}).get(spot)
                same = min(m, its[1]) if its and its[2:] == (of, where) else 0
                if same != m or same != its[1]:
                    end += same
                    break
            end, spot = end + same, spot + same
        out.append((a, end - 1 + k))
        i = end - 1 + k
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("of_rank", pa.int32()), ("of_place", pa.int64()), ("of_digest", pa.int64()), ("at", pa.int32())])
    for batch in batches:
        found = [[(start, n, *of, at) for start, n, of, at in merged(p)] for p in batch.column("pieces").to_pylist()]
        held = pa.array([[dict(zip((f.name for f in kind), s)) for s in row] for row in found], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), held], names=[*DOC, "segments"])


def _cuts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for *doc, own, others in zip(*(batch.column(c).to_pylist() for c in [*DOC, "segments", "others"])):
            held = {(o["of_rank"], o["of_place"], o["of_digest"]): merged(o["segments"]) for o in others or ()}
            found.append([x for pair in deletions(tuple(doc), merged(own), held, k) for x in pair])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), pa.array(found, pa.list_(pa.int32()))], names=[*DOC, "cuts"])


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column("cuts")
        changed, texts = cuts.is_valid(), batch.column("text")
        if pa.compute.any(changed).as_py():
            held = texts.to_pylist()
            for r in np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist():
                own, spans, kept, i = tokens(held[r]), cuts[r].as_py(), [], 0
                for a, b in zip(spans[::2], spans[1::2]):
                    kept += own[i:a]
                    i = b
                held[r] = "".join(kept + own[i:])
            texts = pa.array(held, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), texts, changed], names=["conv_id", "seq", "text", "changed"])


def _named(rows: DataFrame, copy: Column) -> DataFrame:
    rank = F.when(F.coalesce("definer", F.lit(False)), 0).otherwise(2) + F.col("seq").isNull().cast("int")
    return rows.withColumns({"rank": rank, "place": F.coalesce("seq", F.lit(0).cast("long")), "digest": F.xxhash64("conv_id", "text", copy)})


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``DOC``; equal rows are told apart by their number."""
    named = _named(rows, F.lit(0))
    twice = written(named.groupBy(*DOC).count().where("count > 1").drop("count"), "twice")
    if not twice.head(1):
        return named
    single = named.join(twice, DOC, "left_anti").select(*named.columns)
    counted = named.join(twice, DOC, "left_semi").groupBy(*rows.columns).count()
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return single.unionByName(_named(copies, F.col("copy")).select(*named.columns))


def dedupe_spans(rows: DataFrame, k: int = 70) -> DataFrame:
    """``rows(conv_id, seq, definer, text)`` as (conv_id, seq, text, changed); definers are never changed.

    A null text is empty, a null seq comes last, a null conv_id is a conversation of its
    own. Texts of one seq are taken in the order of a hash; of equal rows one is the first.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("definer").cast("boolean"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if k < 2:
        return rows.select("conv_id", "seq", "text", F.lit(False).alias("changed"))
    rows = _numbered(rows)
    sent = rows.select(F.xxhash64("conv_id").alias("conv"), *DOC, "text").mapInArrow(lambda batches: _all_stretches(batches, k), _STRETCH)
    pieces = sent.repartition("anchor").sortWithinPartitions("anchor", *DOC, "start").mapInArrow(_first_places, _PIECE)
    listed = pieces.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "of_rank", "of_place", "of_digest", "at")).alias("pieces"))
    held = written(listed.mapInArrow(_segments, f"rank int, place long, digest long, segments array<{_SEGMENT}>"), "segments")
    # Only where a segment follows on another one a match can go on in the first one's source.
    on = F.filter("segments", lambda s: F.exists("segments", lambda t: t["start"] == s["start"] + s["n"]))
    asked = held.where("rank >= 2").select(*DOC, F.explode(F.array_distinct(F.transform(on, lambda s: F.struct(s["of_rank"].alias("of_rank"), s["of_place"].alias("of_place"), s["of_digest"].alias("of_digest"))))).alias("of")).select(*DOC, "of.*")
    sources = held.select(*[F.col(c).alias(f"of_{c}") for c in DOC], "segments")
    others = asked.join(sources, [f"of_{c}" for c in DOC]).groupBy(*DOC).agg(F.collect_list(F.struct("of_rank", "of_place", "of_digest", "segments")).alias("others"))
    cuts = held.where("rank >= 2").join(others, DOC, "left").select(*DOC, "segments", "others").mapInArrow(lambda batches: _cuts(batches, k), "rank int, place long, digest long, cuts array<int>").where("size(cuts) > 0")
    return rows.join(written(cuts, "cuts"), DOC, "left").select("conv_id", "seq", "text", "cuts").mapInArrow(_spliced, "conv_id long, seq long, text string, changed boolean")
