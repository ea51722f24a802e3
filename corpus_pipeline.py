"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm import linededup, mixing, neardup, packing, toxicity
from pairlight.llm.common import materialise, own as col, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; null and empty texts stay.

    Rows of a null or repeated id are judged each by its own text.  Further
    columns may have any name.  An empty table gives an empty one.
    """
    net = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    own = docs.columns
    carried = {f"c{i}": col(docs, c) for i, c in enumerate(own)}
    scored = toxicity.score(docs, net, carry=carried)
    blank = F.coalesce(F.trim(f"c{own.index('text')}"), F.lit("")) == ""
    return scored.where((F.col("predicted") == 0) | blank).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document goes only if lines went and nothing but blanks is left.

    Null and empty texts and rows of a null id stay as they are.
    """
    out = linededup.dedup_lines(docs)
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~((F.col("n_removed") > 0) & blank)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(col(docs, c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id; null and empty texts and null ids stay."""
    return neardup.drop_near_duplicates(docs, width=5, per_hundred=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that the sources' words meet their targets.

    A null source is a source; rows of a null or repeated id are drawn each by
    itself; texts without words follow their source's rate.
    """
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words packed into bins of 2048; a row a piece.  Null and empty texts give none; copies of a row are packed each."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_neardup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can express neither the trained classifier nor the sampling and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
