"""A training corpus from documents: toxicity, near-duplicates, benchmark decontamination, source mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineage_jobs.llm.decontamination import drop_contaminated
from lineage_jobs.llm.mixing import mix_sources, shuffled
from lineage_jobs.llm.neardup import near_duplicates
from lineage_jobs.llm.shards import assign_shards
from lineage_jobs.llm.toxicity import fit_toxicity, toxicity_scores
from lineage_jobs.runtime import broadcast_if_small, materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose score reaches this are rejected.
TOXIC = 0.3
SHARDS = 16


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject.

    Null and empty texts have no toxic sign and stay, as do rows with a null id and repeated rows; very long texts are scored
    whole. An empty table gives an empty one. Columns beside those of documents are dropped.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_scores(docs, model, TOXIC, keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component, by shingles of five words.

    Null, empty and wordless texts are linked with nothing and stay, as do rows with a null id; of rows that tie the least id
    stays, and rows that repeat a kept id all stay. Very long texts are compared whole. An empty table gives an empty one.
    """
    gone = materialize(near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id"))
    return docs.select(*COLUMNS).join(broadcast_if_small(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no benchmark item.

    Null and empty texts and rows with a null id stay or go by their words alone; repeated rows go alike. Very long texts are
    searched whole. An empty table gives an empty one; an empty benchmark drops nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents so that sources weigh as the square root of their bytes, in a global shuffle.

    A null source is a source of its own; sources without bytes (null and empty texts only) give no copy. Rows with a null id
    are drawn by their texts; repeated rows get equal counts each. An empty table gives an empty one.
    """
    return shuffled(mix_sources(docs, columns=COLUMNS)).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it.

    Shards follow the ids, so copies of a document stand together; null ids come first, a null text has the size 1, ties and
    repeated rows stand side by side. An empty table gives an empty one.
    """
    return assign_shards(docs, SHARDS, keep=COLUMNS).select(*COLUMNS, "size", "shard", "slot")


STAGES = [
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("source_mix", mixed),
    ("sharding", sharded),
]

#: SQL can't express the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
            release(before)
    return docs
