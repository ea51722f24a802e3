"""Job records: result documents, status log, look-up, and shortlists inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.sources.stages import exists, stored


def nest_shortlist(shortlist: DataFrame) -> DataFrame:
    """One row a query with its ranked pairs as an array in rank order; k bounds the array."""
    rest = [c for c in shortlist.columns if c not in ("query_id", "rank")]
    return shortlist.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("shortlist"))


def unnest_shortlist(nested: DataFrame) -> DataFrame:
    return nested.select("query_id", F.inline("shortlist"))


def shortlist_json(nested: DataFrame) -> DataFrame:
    """The array as JSON; arrays stay arrays and nulls are written."""
    return nested.select("query_id", F.to_json("shortlist", {"ignoreNullFields": "false"}).alias("shortlist_json"))


def shortlist_from_json(stored: DataFrame, schema: T.ArrayType | str) -> DataFrame:
    """Stored JSON back to rows."""
    return stored.select("query_id", F.inline(F.from_json("shortlist_json", schema)))


def result_documents(queries: DataFrame, nested: DataFrame, bundles: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """One JSON document a query: status, queryspec, shortlist, bundle, answer. Queries without hits have an empty shortlist."""
    spec = F.struct(*(c for c in queries.columns if c != "query_id"))
    out = queries.select("query_id", spec.alias("queryspec")).join(nested, "query_id", "left")
    kind = nested.schema["shortlist"].dataType
    fields = [F.lit("done").alias("status"), F.col("queryspec"), F.coalesce("shortlist", F.array().cast(kind)).alias("shortlist")]
    for extra, name in ((bundles, "bundle"), (answers, "answer")):
        if extra is not None:
            out = out.join(extra.select("query_id", F.struct(*(c for c in extra.columns if c != "query_id")).alias(name)), "query_id", "left")
            fields.append(F.col(name))
    return out.select("query_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store documents; the commit protocol makes them visible whole."""
    documents.write.mode(mode).json(path)


#: Folders that keyed tables are dealt into by a hash of the id.
BUCKETS = 64
DOCUMENTS = "query_id string, document string, bucket int"


def bucket(query_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(query_id), F.lit(buckets)).cast("int")


def put_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Store documents by id: those of the same ids are replaced, all others stay as they are.

    Only the buckets of the given ids are read and written again, each whole by the commit protocol's
    dynamic partition overwrite, so that putting the same documents
    twice changes nothing.  An id has one document in ``documents``; one writer
    at a time.  Returns the documents as stored.
    """
    spark = documents.sparkSession
    new = stored(documents.select("query_id", "document", bucket(F.col("query_id"), buckets).alias("bucket")), "documents")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    out = new
    if exists(spark, path):
        old = spark.read.schema(DOCUMENTS).json(path).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        out = new.unionByName(old.join(new.select("query_id"), "query_id", "left_anti"))
    out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)
    return new.select("query_id", "document")


def read_documents(spark: SparkSession, path: str, query_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stored documents, or the one of an id, for which one bucket is read."""
    docs = spark.read.schema(DOCUMENTS).json(path)
    if query_id is not None:
        at = spark.sql("SELECT :id AS query_id", args={"id": query_id}).select(bucket(F.col("query_id"), buckets)).first()[0]
        docs = docs.where((F.col("bucket") == at) & (F.col("query_id") == query_id))
    return docs.select("query_id", "document")


def error_records(rejects: DataFrame) -> DataFrame:
    """Rejected or failed inputs as job records, with the traceback where there is one."""
    fields = [F.lit("error").alias("status"), *(c for c in ("error", "traceback") if c in rejects.columns)]
    return rejects.select("query_id", F.to_json(F.struct(*fields)).alias("document"))


def latest_status(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of each asked id by the entry of highest seq; ids without entries are unknown, null statuses running."""
    last = log.groupBy("query_id").agg(F.max_by("status", "seq").alias("status"), F.lit(True).alias("_known"))
    shown = F.when(F.col("_known"), F.coalesce("status", F.lit("running"))).otherwise(F.lit("unknown"))
    return ids.select("query_id").distinct().join(last, "query_id", "left").select("query_id", shown.alias("status"))


STATUS = "query_id string, status string, seq long"


def newest_snapshot(spark: SparkSession, snapshot: str) -> int:
    """The last batch that a finished snapshot covers, -1 if there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot}/upto=*/_SUCCESS")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=-1)


def status_tail(spark: SparkSession, log: str, after: int) -> DataFrame:
    """Entries of the batches after one; the scan reads their folders only."""
    return spark.read.schema(f"{STATUS}, error string, traceback string, batch_id long, part string").parquet(log).where(F.col("batch_id") > after)


def compact_status(spark: SparkSession, log: str, snapshot: str, buckets: int = BUCKETS) -> int:
    """Write a new snapshot, the last entry of every id up to the last finished batch; returns that batch.

    It is made of the snapshot before and the batches since, not of the whole log.
    """
    before = newest_snapshot(spark, snapshot)
    tail = status_tail(spark, log, before)
    upto = tail.where("part = 'end'").agg(F.max("batch_id")).first()[0]
    if upto is None:
        return before
    rows = tail.where(F.col("batch_id") <= upto).select("query_id", "status", "seq")
    if before >= 0:
        rows = rows.unionByName(spark.read.schema(f"{STATUS}, bucket int").parquet(f"{snapshot}/upto={before}").drop("bucket"))
    last = rows.groupBy("query_id").agg(F.max(F.struct("seq", "status")).alias("l")).select("query_id", "l.status", "l.seq", bucket(F.col("query_id"), buckets).alias("bucket"))
    last.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/upto={upto}")
    return upto


def status_of(spark: SparkSession, log: str, snapshot: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """As ``latest_status``, from the newest snapshot's buckets of these ids and the batches since."""
    upto = newest_snapshot(spark, snapshot)
    rows = status_tail(spark, log, upto).select("query_id", "status", "seq")
    if upto >= 0:
        asked = [r["b"] for r in ids.select(bucket(F.col("query_id"), buckets).alias("b")).distinct().collect()]
        known = spark.read.schema(f"{STATUS}, bucket int").parquet(f"{snapshot}/upto={upto}").where(F.col("bucket").isin(asked) if asked else F.lit(False))
        rows = rows.unionByName(known.drop("bucket"))
    return latest_status(rows.join(ids.select("query_id").distinct(), "query_id", "left_semi"), ids)
