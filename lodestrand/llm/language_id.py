"""Language identification in two levels (operator 1).

First a family is predicted, by linear SVMs between every two families; then, within the
family, linear SVMs between every two of its languages vote. Both levels decide by votes,
ties by the sum of margins. All models read hashed byte n-grams of the whole lower-cased
text and nothing else.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import linear
from lodestrand.llm.words import chunks

#: Language codes by family. A code of none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "sino-tibetan": "zh my bo",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Labelled documents of each language that the models are fitted on, at most about this many.
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32(doc_id as text) mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    #: (family level?, index a, index b): a wins where the margin is positive.
    duels: list[tuple[bool, int, int]]
    weights: np.ndarray  # float32[FEATURES, len(duels)]
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Index of each non-empty text's language, and its confidence."""
        margins = linear.scores(texts, self.weights) + self.bias if self.duels else np.zeros((len(texts), 0))
        p = 1 / (1 + np.exp(-np.clip(self.slope * margins, -30, 30)))
        family, sure = self._level(True, list(range(len(self.families))), p, np.arange(len(texts)))
        out = np.zeros(len(texts), dtype=int)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            inside = [i for i, lang in enumerate(self.languages) if family_of(lang) == name]
            if len(rows):
                out[rows], within = self._level(False, inside, p, rows)
                sure[rows] *= within
        return out.tolist(), sure

    def _level(self, top: bool, among: list[int], p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = {i: np.zeros(len(rows)) for i in among}
        least = {i: np.ones(len(rows)) for i in among}
        for d, (level, a, b) in enumerate(self.duels):
            if level is top and a in votes and b in votes:
                q = p[rows, d]
                votes[a] += (q >= 0.5) + q / 1000
                votes[b] += (q < 0.5) + (1 - q) / 1000
                least[a] = np.minimum(least[a], q)
                least[b] = np.minimum(least[b], 1 - q)
        table = np.stack([votes[i] for i in among])
        best = table.argmax(axis=0)
        return np.array(among)[best], np.stack([least[i] for i in among])[best, np.arange(len(rows))]


def _fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    languages = sorted({lang for lang, _, _ in sample})
    families = sorted({family_of(lang) for lang in languages})
    duels, weights, bias, slope = [], [], [], []

    def duel(top: bool, a: int, b: int, side) -> None:
        rows = [(side(lang), (slots, values)) for lang, slots, values in sample if side(lang)]
        y = np.array([s for s, _ in rows])
        w, c = linear.train_svm([r for _, r in rows], y)
        margins = np.array([float(w[slots] @ values) + c for _, (slots, values) in rows])
        duels.append((top, a, b))
        weights.append(w)
        bias.append(c)
        slope.append(linear.fit_sigmoid(margins, y))

    for a, b in combinations(range(len(families)), 2):
        duel(True, a, b, lambda lang, a=a, b=b: {families[a]: 1, families[b]: -1}.get(family_of(lang), 0))
    for family in families:
        inside = [i for i, lang in enumerate(languages) if family_of(lang) == family]
        for a, b in combinations(inside, 2):
            duel(False, a, b, lambda lang, a=a, b=b: {languages[a]: 1, languages[b]: -1}.get(lang, 0))
    table = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((linear.FEATURES, 0), dtype=np.float32)
    return Model(languages, families, duels, np.asfortranarray(table), np.array(bias), np.array(slope))


LETTER = r"\p{L}"


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on documents that are not held out, with text and lang.

    The sample is bounded: of a language with more than ``sample_per_language`` documents,
    those whose hash falls below the matching share. It depends on ids and texts only.
    The executors turn sampled texts into sparse features and one of them fits the models;
    the driver gets no text and no features.
    """
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return _fit([])
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_per_language / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < share).where(F.col("text").rlike(LETTER)).select("lang", F.lower("text").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                pairs = [linear.features(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("o"), pa.array([s.astype(np.uint32).tobytes() for s, _ in pairs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in pairs], pa.binary())],
                    names=["lang", "o", "slots", "shares"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "o", "slots", "shares"))))
        model = _fit([(lang, np.frombuffer(slots, dtype=np.uint32), np.frombuffer(shares, dtype=np.float32).astype(float)) for lang, _, slots, shares in rows])
        rest = pickle.dumps((model.languages, model.families, model.duels, model.bias, model.slope))
        for part, held in enumerate([rest, *(np.ascontiguousarray(w).tobytes() for w in model.weights.T)]):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held], pa.binary())], names=["part", "held"])

    features = chosen.mapInArrow(run, "lang string, o long, slots binary, shares binary")
    # The sample is bounded, so one task can hold it; the driver gets the models only.
    found = {r["part"]: r["held"] for r in features.repartition(1).mapInArrow(fit, "part int, held binary").collect()}
    languages, families, duels, bias, slope = pickle.loads(found[0])
    table = np.zeros((linear.FEATURES, len(duels)), dtype=np.float32, order="F")
    for d in range(len(duels)):
        table[:, d] = np.frombuffer(found[d + 1], dtype=np.float32)
    return Model(languages, families, duels, table, bias, slope)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` (columns of these names are replaced)."""
    out = docs.drop("lang_pred", "lang_score", "__lower")
    columns = out.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in out.schema.fields)
    text = F.col("text").cast("string")
    # The lower-cased text is what the models read; null where there is no letter.
    given = out.withColumn("__lower", F.when(text.rlike(LETTER), F.lower(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "__lower"):
                lang: list[str] = [UNDETERMINED] * len(texts)
                score = np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t]
                if rows and model.languages:
                    found, sure = model.predict([texts[i] for i in rows])
                    for i, f in zip(rows, found):
                        lang[i] = model.languages[f]
                    score[rows] = sure
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(columns))] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "lang_score"])

    return given.mapInArrow(run, f"{schema}, lang_pred string, lang_score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs(doc_id, text, lang)``.

    lang_pred is a learned lang value, or ``und`` with score 0 where the text is null, has no
    letter, or nothing could be learned. The score is the least probability among the
    duels won, of both levels multiplied. With one language only it is predicted with score
    1. Repeated rows get equal predictions; an empty table gives an empty table; columns
    besides doc_id, text and lang are not read.
    """
    model = train(docs)
    tagged = tag(docs.select("doc_id", "text"), model)
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
