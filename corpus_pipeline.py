"""The training-data pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontamination, language_id, mixing, near_dedup, sharding
from lodestrand.llm.tables import cut, documents, fits, hint_if, scratch
from lodestrand.session import ship

#: Language confidence below which a document is rejected.
MIN_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SHARDS = 8
BROADCAST_IDS = 1_000_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; a null lang becomes the predicted one.

    Rejected: null texts, texts without a letter, predictions below the least score.
    """
    ship(spark)
    tagged = language_id.tag(docs, language_id.train(docs)).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE))
    return tagged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id.

    Rows that repeat a doc_id are one document, whose texts are all of its group: the row with
    the least text stays.
    """
    ship(spark)
    found = near_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("doc_id is not null")
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(hint_if(gone, fits(gone, BROADCAST_IDS)), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.head(1):
        return left
    small = fits(twice, BROADCAST_IDS)
    single = left.join(hint_if(twice, small), "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    picked = left.join(hint_if(twice, small), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    return single.unionByName(picked.select("doc_id", "row.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, rows repeated."""
    ship(spark)
    return mixing.repeat_documents(docs)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot; copies of a document share its shard."""
    ship(spark)
    return sharding.place(docs, SHARDS).select(*docs.columns, "shard", "slot")


STAGES = [
    ("language ID", identify_languages),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]
#: The first two stages are a trained model and a sketch index; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), name.split()[0])
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), name)
