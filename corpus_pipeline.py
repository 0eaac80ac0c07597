"""A training corpus from ``documents``: harmless, in a known language, without near copies, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next one's ``docs``.  All stages but the last
return the columns of ``docs``, whatever others it has beside doc_id, text,
lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm import language, mixing, ngram_join, packing, toxicity
from seepage.llm.tables import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a probability of any severity below one half; the model learns from ``labels``."""
    return toxicity.keep_harmless(docs, toxicity.train_from_labels(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter that resemble one of the languages that the corpus names."""
    profiles = language.learn(docs)
    return language.keep_known(docs, profiles, limits=language.learn_limits(docs, profiles))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component; of repeated rows one, rows without an id stay."""
    found = ngram_join.near_components(docs.select("doc_id", "text"))
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    # whole rows are carried as one column, so that no name of theirs is in the way
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kept = rows.join(first, F.col("row.doc_id") == F.col("first")).withColumn("nth", F.row_number().over(Window.partitionBy("first").orderBy("row.text")))
    return kept.filter("nth = 1").select("row.*").unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; equal rows are numbered, so that each takes its own part."""
    key = F.xxhash64("doc_id", "source", "text")
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))
    alike = Window.partitionBy("key")
    taken = mixed.select(F.col("doc_id").alias("key"), F.col("copies").cast("int").alias("copies"))
    taken = taken.withColumn("nth", F.row_number().over(alike.orderBy("copies"))).filter("copies > 0")
    # whole rows are carried as one column, so that no name of theirs is in the way
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    numbered = rows.withColumn("nth", F.row_number().over(alike.orderBy("row.doc_id")))
    repeated = numbered.join(taken, ["key", "nth"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence (bin_group, bin), its place there and its words."""
    return packing.pack_documents(docs.select("doc_id", "text", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Regression, rank-order profiles and best-fit search are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
