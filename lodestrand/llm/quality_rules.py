"""Quality rules with line labelling (operator 4).

The lines of a text are a sequence; a linear-chain conditional random field marks each as
content or boilerplate, decoded by Viterbi. A text whose share of words in content lines
is below ``CONTENT_SHARE`` is not kept. The field is trained here, on a bounded sample of
labelled documents: every line of a document of quality 1 counts as content, of quality 0
as boilerplate. Labels are of documents, so no text shows where one kind of line gives way to
the other; for that, good and bad texts are also joined end to end, in either order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import crf
from lodestrand.llm.words import BLANKS, U64, chunks, covered, mix, split, window_hashes, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Bits of the marks of a text's first and last line.
FIRST, LAST = 1 << 16, 1 << 17
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
CONTENT_SHARE = 0.5
#: Labelled documents that the field is trained on, at most about this many.
SAMPLE_DOCUMENTS = 1500

_NOT_IN_WORDS = BLANKS + bytes(range(0x80, 0xC0))  # blanks, and bytes that begin no code point
_UPPER, _LETTERS, _DIGITS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(48, 58))
FEATURES = 19


def line_mask(line: bytes, n_words: int, repeated: bool, first: bool, last: bool) -> int:
    """The features of a line with a word, as bits."""
    size = len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    upper, letters = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LETTERS))
    digits = size - len(line.translate(None, _DIGITS))
    ending = line.rstrip()[-1:]
    bars, calls = line.count(b"|"), line.count(b"!")
    bits = (
        True,
        n_words <= 2,
        3 <= n_words <= 6,
        n_words > 6,
        50 * symbols > size,
        10 * symbols > size,
        2 * upper > letters,
        10 * upper > 9 * letters and letters > 0,
        ending in (b".", b"?"),
        ending == b"!",
        10 * digits > size,
        repeated,
        4 * bars >= n_words and bars > 0,
        3 * calls > n_words,
        size > 12 * n_words,
        b"://" in line or b"(c)" in line or b"\xc2\xa9" in line,
        first,
        last,
        letters == 0,
    )
    return sum(1 << i for i, on in enumerate(bits) if on)


def lines_of(text: bytes) -> tuple[list[int], list[int], int]:
    """(mask, words) of each line with a word, and the number of lines equal to an earlier one."""
    seen: set[bytes] = set()
    found = []
    duplicates = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            repeated = line in seen
            duplicates += repeated
            seen.add(line)
            found.append((line, n, repeated))
    end = len(found) - 1
    return [line_mask(line, n, repeated, i == 0, i == end) for i, (line, n, repeated) in enumerate(found)], [n for _, n, _ in found], duplicates


def repeated_words(words: list[bytes], k: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``k`` that occur twice or more in the text."""
    spots = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    counts = Counter(spots)
    starts = np.array([i for i, s in enumerate(spots) if counts[s] > 1], dtype=np.int64)
    return int(covered(len(words), starts, k).sum()) if len(starts) else 0


def _may_repeat(texts: list[bytes], k: int = REPEAT_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words, whether two windows have one hash) of each text; texts without such a pair have no repeat."""
    words = split(texts)
    out = np.zeros(len(texts), dtype=bool)
    at = windows(words, k)
    if len(at):
        of = words.text_of()[at]
        h = window_hashes(word_hashes(words), k)[at] ^ mix(of.astype(np.uint64) + U64(1))
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            twice = np.unique(twice)
            place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            out[of[twice[place] == h]] = True
    return words.counts, out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> crf.Crf:
    """The field, from all lines of a bounded sample of labelled documents chosen by a hash of doc_id.

    Without labels all weights are 0, and every line is content.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return crf.train([], FEATURES)
    # Half of the sample for either label, so that the rarer one is seen; weights undo that below.
    share = F.when(F.col("quality") == 1, min(1.0, sample / 2 / counts.get(1, 1))).otherwise(min(1.0, sample / 2 / counts.get(0, 1)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("line sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The draw's bound is met on average only; the limit, far above it, takes the least draws.
    chosen = known.where(draw < share).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(draw, "doc_id").limit(2 * sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                # 4 bytes a line, the highest first, so that they sort as the masks do.
                masks = [np.array(lines_of(t)[0], dtype=">i4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality"), pa.array(masks, pa.binary())], names=["doc_id", "quality", "masks"])

    found = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, masks binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"], r["masks"]))
    texts = [(np.frombuffer(r["masks"], dtype=">i4").astype(np.int32), r["quality"]) for r in found if r["masks"]]
    return crf.train(texts + joined(texts), FEATURES)


def joined(texts: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text of the more frequent label joined to one of the other, by turns before and behind it; with a label for each line."""
    kinds = [[t for t, y in texts if y == label] for label in (0, 1)]
    out = []
    for i in range(max(map(len, kinds)) if all(kinds) else 0):
        parts = [(kinds[label][i % len(kinds[label])].copy(), label) for label in ((0, 1) if i % 2 else (1, 0))]
        parts[0][0][-1] &= ~LAST
        parts[1][0][0] &= ~FIRST
        out.append((np.concatenate([m for m, _ in parts]), np.repeat([y for _, y in parts], [len(m) for m, _ in parts])))
    return out


def judge(docs: DataFrame, field: crf.Crf) -> DataFrame:
    """All rules for each row of ``docs(doc_id, text)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and content_share. A null or empty text has no words, fails the base rules and is not
    kept; its content_share is 0. Repeated rows get equal rows; an empty table gives an
    empty one; other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[float, float]] = {}
        for batch in batches:
            for part, texts in chunks(batch):
                counts, repeat = _may_repeat(texts)
                columns: list[list[int]] = [[], [], [], [], []]
                shares = []
                for text, n, again in zip(texts, counts.tolist(), repeat.tolist()):
                    masks, sizes, duplicates = lines_of(text)
                    labels = field.decode(masks, cache)
                    shares.append(sum(s for s, label in zip(sizes, labels) if label) / n if n else 0.0)
                    row = (n, len(text.translate(None, _NOT_IN_WORDS)), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(text.split()) if again else 0)
                    for column, value in zip(columns, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(shares, pa.float64())], names=["doc_id", *names, "content_share"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    measured = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", content_share double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("content_share") >= CONTENT_SHARE)).alias("kept"), "content_share")
