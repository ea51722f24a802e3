"""Evidence tables: reading them and preparing keys and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlight.columns import require
from pairlight.sources.stages import stored

REQUIRED = ["mirna_name", "gene_symbol", "support_count"]


def read_evidence(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Scan a Parquet evidence table; ``ordered`` adds row_ord, a number that rises by file and by the row's place in it.

    Files are numbered by their paths in a small table of their own, which is read from the files' footers.  It
    is sent to every task, since a join by path would deal all rows of a file to one task; the driver lists the same paths to plan the scan.
    """
    df = spark.read.parquet(path)
    if not ordered:
        return df
    name, row = (F.col(f"_metadata.{c}") for c in ("file_path", "row_index"))
    files = df.select(name.alias("_file")).distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
    placed = df.select("*", name.alias("_file"), row.alias("_row")).join(F.broadcast(files), "_file")
    return placed.select(*df.columns, (F.shiftleft("_number", 40) + F.col("_row")).alias("row_ord"))


def numbered(evidence: DataFrame, *order: Column | str) -> DataFrame:
    """Evidence with row_ord numbered in the order of columns, by a range sort; stored, so that every reader sees the same numbers."""
    return stored(evidence.orderBy(*order).withColumn("row_ord", F.monotonically_increasing_id()), "numbered")


def prepare(evidence: DataFrame, row_order: Column | None = None) -> DataFrame:
    """Check the required columns and add mirna_key and gene_key, in one case, for joins.

    ``row_order`` sets row_ord, which only list columns need.
    """
    require(evidence, REQUIRED)
    keys = {"mirna_key": F.lower("mirna_name"), "gene_key": F.upper("gene_symbol")}
    if row_order is not None:
        keys["row_ord"] = row_order
    return evidence.withColumns({k: v for k, v in keys.items() if k == "row_ord" or k not in evidence.columns})


def write_evidence(evidence: DataFrame, path: str, files: int = 0, first: str = "mirna_key") -> None:
    """Store prepared evidence sorted by its keys within range partitions, with Bloom filters on both keys.

    A filter on the key named ``first`` then skips row groups by their least and
    greatest keys, one on the other key by their Bloom filters.
    """
    keys = [first, *(k for k in ("mirna_key", "gene_key") if k != first)]
    out = prepare(evidence).repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys).write.mode("overwrite")
    for k in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{k}", "true")
    out.parquet(path)
