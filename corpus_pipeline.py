"""From raw documents to shuffled shards: five stages over whole tables.

Each stage is (spark, docs, sf_dir) -> DataFrame. `run` stores what a stage returns in the
shared work folder and hands the stored table to the next one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.columns import listed_rows, packed, stored, unlisted_rows
from twinsieve.llm.decontaminate import contamination, is_contaminated
from twinsieve.llm.mixing import mix_sources
from twinsieve.llm.near_dups import near_duplicates
from twinsieve.llm.quality_classifier import ACCEPT_AT, fit_classifier, quality_score
from twinsieve.llm.queries import domain_of, table, tree
from twinsieve.llm.sharding import shuffled_shards


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that are not among `rows` (_id, _fp), which have to be stored."""
    marked = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_fp"))
    return unlisted_rows(marked, rows).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(model, F.col("text")) >= ACCEPT_AT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; all without words."""
    found = near_duplicates(docs)
    gone = stored(found.filter("not kept").select("_id", "_fp"), "pipeline-near")
    left = without(docs, gone)
    marked = left.select(packed(left), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_fp"))
    # Rows repeated with their key: one of them. Texts of other rows stay where they are.
    repeated = marked.groupBy("_id", "_fp").count().filter("count > 1").select("_id", "_fp")
    repeated = stored(repeated, "pipeline-repeated")
    once = listed_rows(marked, repeated).dropDuplicates(["_id", "_fp"])
    return unlisted_rows(marked, repeated).unionByName(once).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share less than a twentieth of their words with benchmark passages."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("_id", "_fp")
    return without(docs, stored(gone.distinct(), "pipeline-bench"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document of a second epoch is a second row."""
    return mix_sources(docs, domain_of("source"), tree()).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, shuffled, with their shard and slot."""
    return shuffled_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# The classifier and the shuffle have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
