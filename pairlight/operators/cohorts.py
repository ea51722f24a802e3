"""Cohort evidence as a long table, partitioned by cohort, for evidence of tens of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.columns import flag, real
from pairlight.functions.scores import OWN, cohort_codes
from pairlight.operators.collapse import gated_pairs
from pairlight.sources.evidence import prepare, write_evidence
from pairlight.sources.stages import stored

#: What there is of each cohort in a wide table, and which of it are flags.
PARTS = ("spearman_rho", "spearman_p", "anticorrelated", "repression_evidence", "pair_expressed")
FLAGS = PARTS[2:]


def cohort_rows(evidence: DataFrame, keep: list[str]) -> DataFrame:
    """A row an evidence row and cohort with anything to tell, with the columns to keep.

    A flag that the wide table has no column of stays null, which is not the
    same as 0: without a flag the expression gate passes, and the
    anti-correlation is derived once pairs are collapsed.
    """

    def one(code: str) -> Column:
        cols = [F.lit(code).alias("cohort")]
        for p in PARTS:
            name, kind = f"{code}_{p}", "int" if p in FLAGS else "double"
            value = F.lit(None) if name not in evidence.columns else flag(evidence, name) if p in FLAGS else real(evidence, name, None)
            cols.append(value.cast(kind).alias(f"{OWN}_{p}"))
        return F.struct(*cols)

    codes = cohort_codes(evidence)
    kind = "cohort string, " + ", ".join(f"{OWN}_{p} {'int' if p in FLAGS else 'double'}" for p in PARTS)
    every = F.array(*map(one, codes)) if codes else F.array().cast(f"array<struct<{kind.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")
    return evidence.select(*keep, F.inline(every)).where(F.coalesce(*(F.col(f"{OWN}_{p}").cast("double") for p in PARTS)).isNotNull())


def write_cohorts(evidence: DataFrame, folder: str, files: int = 0, collapse: bool = False) -> None:
    """Store a wide table as two: ``rows`` without cohort columns, and ``cohorts``, a partition a cohort.

    Both hold row_id, which is numbered once in a stored copy, and the keys by which they are sorted.  With ``collapse``
    the rows are ``gated_pairs``: retrieval that collapses gives the same from them, but the rows themselves and their lists aren't kept.
    """
    evidence = gated_pairs(evidence) if collapse else evidence
    wide = stored(prepare(evidence).withColumn("row_id", F.monotonically_increasing_id()), "wide")
    codes = cohort_codes(wide)
    write_evidence(wide.drop(*(c for c in wide.columns if any(c.startswith(f"{code}_") for code in codes))), f"{folder}/rows", files)
    keys = ["cohort", "mirna_key", "gene_key"]
    long = cohort_rows(wide, ["row_id", "mirna_key", "gene_key"])
    long.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("cohort").parquet(f"{folder}/cohorts")


def read_cohorts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The evidence rows and the long table of cohorts."""
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cohorts").withColumn("cohort", F.col("cohort").cast("string"))


def asked_cohorts(cohorts: DataFrame, queries: DataFrame) -> list[str]:
    """Which of the table's cohorts the queries ask for; at most as many as the table has partitions."""
    asked = queries.select(F.upper("cohort").alias("cohort")).distinct()
    return sorted(r["cohort"] for r in cohorts.select("cohort").distinct().join(asked, "cohort").collect())


def with_cohort(rows: DataFrame, cohorts: DataFrame, codes: list[str]) -> DataFrame:
    """Matched rows beside the evidence of their query's cohort; those that fail the query's expression gate go.

    Only the partitions of ``codes`` are read.  A row of a cohort that isn't there stays, with nulls.
    """
    part = cohorts.where(F.col("cohort").isin(codes) if codes else F.lit(False))
    part = part.select(F.col("row_id").alias("_row"), F.col("cohort").alias("_code"), *(f"{OWN}_{p}" for p in PARTS))
    joined = rows.join(part, (F.col("row_id") == F.col("_row")) & (F.upper("cohort") == F.col("_code")), "left").drop("_row", "_code", "row_id")
    shown = F.col(f"{OWN}_pair_expressed")
    return joined.where(~F.col("require_expression") | shown.isNull() | (shown == 1))
