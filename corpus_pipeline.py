"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. Toxic documents go; lines seen in an earlier document go; one document of
each near-duplicate class stays; documents are repeated or left out as the mix
draws them; the last stage encodes what is left.

Defined cases: a null text is kept as null by the filters, is one text with all
empty and null ones to near-dedup, has no words for the mix, which never draws it, and no
pieces; a null id counts as one document after all others to line dedup and never stands
for a class that has another id; rows that repeat id and text are copies, of which
near-dedup keeps one; ties go to the smallest id; texts are read whole at any length; extra columns
pass through the first four stages under any name; empty tables, of documents or labels, give
empty results or reject nothing.

Sampled fits, hashed draws and tokenizers are not SQL, so there is no ORACLE_SQL; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenload.llm import line_dedup, mixing, near_text, pieces, toxicity
from evenload.llm.registry import model_bytes
from evenload.scratch import materialize, shuffle_partitions


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below the model's cut."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_text.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled within an output shard per partition."""
    n = shuffle_partitions(spark)
    mixed = mixing.mixed_documents(docs, n_shards=n)
    return mixed.repartitionById(n, F.col("_shard")).sortWithinPartitions("_shard", "_order").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, with the byte spans that they stand for."""
    out = pieces.encode_documents(docs.select("doc_id", "source", "text"), model_bytes())
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
