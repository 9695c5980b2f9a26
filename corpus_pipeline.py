"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm import line_dedup, mixing, packing, quality_rules, simhash
from fleetframe.llm.common import prepare, table, whole_row, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    prepare(spark)
    stats = quality_rules.statistics(docs.select("doc_id", "text")).select("doc_id", "stats.*")
    counts = written(stats, "quality")
    rules = quality_rules.train(counts, table(spark, sf_dir, "labels"))
    # Judged by a second scan of the texts, which costs less than to move them to their verdicts.
    again = docs.select(whole_row(docs).alias("_doc"), quality_rules.text_stats("text").alias("_s"))
    judged = quality_rules.judged(again.select("_doc", "_s.*"), rules)
    return judged.where(F.col("kept")).select("_doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a repeated window covers go; a document stays, though its text may become empty."""
    prepare(spark)
    cleaned = line_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    prepare(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target: a document is left out, taken, or taken twice."""
    prepare(spark)
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    import public_tokenizers

    prepare(spark)
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES = [
    ("quality rules", filter_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
# The stages are tested against brute-force versions: learning, tries and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
