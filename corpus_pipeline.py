"""Training-data pipeline over ``documents``.

Stages, each on all rows its predecessor kept: toxic documents go; one document of each
near-duplicate class stays; passages seen in an earlier document are cut; sources are mixed to
target weights, a document drawn twice appearing twice; texts become pieces that decode to
them again. Every stage writes Parquet in the shared folder and the next one reads it.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def digest():
    """What tells texts apart, null as empty."""
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def repeated(docs):
    """Whether a doc_id is null or in several rows."""
    return bool(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count())


def toxicity(spark, docs, sf_dir):
    """Documents that the toxicity model does not reject, row by row: a verdict depends on the text alone."""
    from tidegauge.llm.toxicity import toxicity_scores
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.withColumn("_sign", digest())
    rejected = toxicity_scores(docs, labels, carry=["_sign"]).where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("_sign").alias("_of"))
    return docs.join(rejected, docs.doc_id.eqNullSafe(F.col("_id")) & (F.col("_sign") == F.col("_of")), "left_anti").select(COLUMNS)


def ngram_jaccard_join(spark, docs, sf_dir):
    """The smallest doc_id of each near-duplicate class; of rows with one doc_id that with the greatest text.

    Rows without a doc_id are in no class and stay.
    """
    from tidegauge.llm.jaccard_join import shingle_classes
    named = docs.where("doc_id is not null")
    if repeated(named):
        named = named.groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source", "n_chars")).alias("_row")).select("doc_id", "_row.*")
    kept = shingle_classes(docs).where("doc_id = component_id").select("doc_id")
    return named.join(kept, "doc_id", "left_semi").select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def suffix_array_dedup(spark, docs, sf_dir):
    """Texts without passages that an earlier document has; one of which nothing is left goes.

    Rows with one doc_id do not cut each other and all stay; those without a doc_id come through whole.
    """
    from tidegauge.llm.suffix_dedup import remove_repeats
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = remove_repeats(texts.distinct() if repeated(docs) else texts).where("n_bytes = 0 or n_removed < n_bytes")
    cut = cut.select("doc_id", "kept_text", "n_removed", F.col("text_sha256").alias("_sign"))
    return docs.withColumn("_sign", digest()).join(cut, ["doc_id", "_sign"]).select(
        "doc_id", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang", "source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")).unionByName(
        docs.where("doc_id is null").select(COLUMNS))


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix draws them, rows without a doc_id and repeated ones each by itself."""
    from tidegauge.llm.mixing import mix_sources
    key = "doc_id"
    if repeated(docs):                                          # rows are numbered once, in a written table
        key, path = "_row", scratch(spark, "numbered")
        docs.select(COLUMNS).withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
        docs = spark.read.parquet(path)
    drawn = mix_sources(docs, carry=[] if key == "doc_id" else [key]).where("taken > 0").select(key, (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return docs.join(drawn, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def sentencepiece(spark, docs, sf_dir):
    """Pieces of every text, with the digest of what they decode to."""
    from tidegauge.llm.pieces import encode_texts
    return encode_texts(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", ngram_jaccard_join), ("suffix_array_dedup", suffix_array_dedup),
          ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Model fits, hashing by piece and text cutting are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
