"""Ranked retrieval: BM25 over postings, cosine top-k, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: The floor of an inverse document frequency.
LEAST_IDF = 1e-6


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, length) of ``docs(doc, text)``."""
    words = docs.select("doc", terms(F.col("text")).alias("ts")).withColumn("length", F.size("ts"))
    return words.select("doc", "length", F.explode("ts").alias("term")).groupBy("doc", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def _count(word: str) -> Column:
    return F.size(F.filter("ts", lambda t: t == word))


def bm25(docs: DataFrame, query: list[str], k: int) -> DataFrame:
    """The ``k`` best of ``docs(doc, text)`` that hold every term of ``query``; lower scores are better, ties by doc.

    Terms are counted inside their document's row, so nothing is shuffled but the totals.
    """
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")
    query = list(dict.fromkeys(query))
    sized = docs.select("doc", terms(F.col("text")).alias("ts")).withColumn("length", F.size("ts"))
    totals = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    hits = sized.select("doc", "length", *[_count(w).alias(f"tf_{i}") for i, w in enumerate(query)])
    dfs = hits.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query))])
    scored = hits.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(dfs))  # two tables of one row
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.greatest(F.log((F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"tf_{i}")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    every = F.lit(True)
    for i in range(len(query)):
        every = every & (F.col(f"tf_{i}") > 0)
    return scored.where(every).select("doc", score.alias("score")).orderBy("score", "doc").limit(k)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of ``vectors(vec_id, embedding)`` with the largest dot product; ties by id. k must be positive."""
    if k < 1:
        raise ValueError("k must be positive")
    dot = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in query]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return vectors.select("vec_id", dot.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def sections(text: DataFrame) -> DataFrame:
    """(doc, position, path, body) of ``text(doc, text)`` at ``## File:`` headers; what stands before the first is dropped."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), "text"), r"\n## File:[ \t]*"), 2, 1 << 30)
    out = text.select("doc", F.posexplode(parts).alias("position", "part"))
    return out.select("doc", "position", F.trim(F.substring_index("part", "\n", 1)).alias("path"), F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("").alias("body"))


CHUNKS = "doc long, chunk_index int, text string, token_count int"


def chunk_lines(text: str, size: int, overlap: int) -> list[tuple[int, str, int]]:
    """Greedy chunks of whole lines with a budget of tokens (a quarter of the characters), each repeating the last lines of the one before up to ``overlap`` tokens."""
    out, held, tokens, index = [], [], 0, 0
    for line in text.splitlines(keepends=True):
        n = len(line) // 4
        if held and tokens + n > size:
            body = "".join(held).strip()
            if body:
                out.append((index, body, tokens))
            back, room = [], 0
            for earlier in reversed(held):
                if room + len(earlier) // 4 > overlap:
                    break
                back.insert(0, earlier)
                room += len(earlier) // 4
            held, tokens, index = back, room, index + 1
        held.append(line)
        tokens += n
    body = "".join(held).strip()
    if body:
        out.append((index, body, tokens))
    return out


def chunked(docs: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """(doc, chunk_index, text, token_count) of ``docs(doc, text)``; each text by itself, so no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, *c) for doc, text in zip(frame["doc"], frame["text"]) if text for c in chunk_lines(text, size, overlap)]
            yield pd.DataFrame(rows, columns=["doc", "chunk_index", "text", "token_count"])

    return docs.select("doc", "text").mapInPandas(run, CHUNKS)
