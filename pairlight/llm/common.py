"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` parts at exactly the six blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only, which is what ``bytes.lower`` does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def each(column, step: int = 500):
    """The values of an Arrow column one by one; only ``step`` of them are Python objects at a time."""
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()


def id_bucket(doc_id: str, mod: int) -> Column:
    """crc32 of the id's text modulo ``mod``; a null id gives -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own;
    a cluster has to name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*stored: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, because what came of them is written itself."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_bytes: int = 32_000_000) -> DataFrame:
    """A stored table with a broadcast hint if its measured size allows; otherwise as it is, to be joined by a shuffle."""
    width = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + F.greatest(F.size(c), F.lit(0)) * 8 + 16
        else:
            width = width + 8
    size = df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most_bytes else df


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many marks in front as it takes to differ from all columns of a table, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def own(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lowest(rows: DataFrame, key: str, hash_col: str, most: int) -> DataFrame:
    """Of each key the ``most`` rows with the lowest hashes (or a few less), chosen without gathering a key's rows.

    A count a key tells below which hash about ``most`` rows lie; only these and
    a small margin are ranked, so the ranking task is bounded by ``most`` whatever the
    input.  Rows of one key and hash count as one; the result has a row for each, with
    ``key`` and ``hash_col`` alone.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(hash_col).alias("h"))
    counts = materialise(rows.groupBy(F.col("k").alias("kk")).agg(F.count(F.lit(1)).alias("n")), "lowest")
    margin = 6 * most**0.5 + 20
    # A hash's place between 0 and 1; its top 53 bits are exact as a double.
    low = F.shiftrightunsigned("h", 11)
    few = rows.join(broadcast_if_small(counts), F.col("k").eqNullSafe(F.col("kk"))).where(low.cast("double") / float(1 << 53) * F.col("n") < F.lit(most + margin))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(low, "h"))
    return few.select("k", "h").distinct().withColumn("n", rank).where(F.col("n") <= most).select(F.col("k").alias(key), F.col("h").alias(hash_col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
