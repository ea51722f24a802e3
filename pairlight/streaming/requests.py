"""Request queue: a stream of request files, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from traceback import format_exc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlight.columns import strip
from pairlight.operators.retrieve import shared_pairs
from pairlight.plans.chain import job_documents
from pairlight.plans.specs import REQUEST_SCHEMA, request_defaults
from pairlight.sources.jobs import put_documents
from pairlight.sources.stages import shared_folder, stored


def read_requests(spark: SparkSession, folder: str, schema: str = REQUEST_SCHEMA) -> DataFrame:
    """A stream of JSON request files."""
    return spark.readStream.schema(schema).json(folder)


def status_rows(queries: DataFrame, status: str, seq: int) -> DataFrame:
    """Log entries; error and traceback are those of the rows, where they have any."""
    told = [F.col(c) if c in queries.columns else F.lit(None).cast("string").alias(c) for c in ("error", "traceback")]
    return queries.select("query_id", F.lit(status).alias("status"), F.lit(seq).cast("long").alias("seq"), *told)


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be answered, and those that can't with the reason in ``error``."""
    reason = F.when(strip(F.coalesce("question", F.lit(""))) == "", "question is empty").when(F.col("k") < 0, "k is negative")
    told = requests.withColumn("error", reason)
    return told.where("error IS NULL").drop("error"), told.where("error IS NOT NULL")


def first_of_each(requests: DataFrame, remember: str) -> DataFrame:
    """A stream without requests of an id that came before, which the state remembers for so long since they came."""
    arrived = request_defaults(requests).withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(["query_id"]).drop("_arrived")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of spark.sql (dots as __) for a stream that is started meanwhile, which takes its own copy of them."""
    values = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], results: str | Callable[[DataFrame], DataFrame], log: str, checkpoint: str, once: bool = True, every: str = "10 seconds", remember: str | None = "30 days", state_parts: int = 16) -> StreamingQuery:
    """Answer each micro-batch by ``answer`` (requests to result rows) and append to the status log.

    Unusable requests get an error entry.  If ``answer`` fails, every request of
    the batch gets one, with the message and the traceback, and the stream goes
    on, so that a poisonous batch isn't tried for ever.  Results and log entries
    of a batch go to a folder of their own that is overwritten, so a replay of
    the batch after a failure writes the same rows and adds none.  ``results`` may
    also be a function that stores the answers in a way that bears a replay and returns the
    status of each (query_id, status, error).

    A request whose id was seen within ``remember`` isn't answered again, be it in this batch or a
    later one; ids made from the content make a resent request the same one.  None answers all.
    The ids lie in ``state_parts`` partitions at most, each of which writes files in every batch; a checkpoint keeps the
    number it began with.  Expired ids go with the next batch of requests, so there are no batches for this alone.

    A batch is stored in the shared folder, in the stead of the one before, and answered from there in the session of ``requests``:
    the state is met once, and the answers are planned by the batch's size, which a stream's own session doesn't do.
    """
    spark = requests.sparkSession
    folder = shared_folder(spark, "batches")

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = stored(request_defaults(batch), "batch", folder)
        batch = spark.read.schema(kept.schema).parquet(f"{folder}/batch")
        if batch_id > 0 and batch.isEmpty():
            return  # all were known; the first batch makes the folders, even if empty
        start, at = 4 * batch_id, f"{log}/batch_id={batch_id}"
        good, bad = split_requests(batch)
        begun = status_rows(batch, "queued", start).unionByName(status_rows(good, "running", start + 1)).unionByName(status_rows(bad, "error", start + 2))
        begun.write.mode("overwrite").parquet(f"{at}/part=begin")
        try:
            if callable(results):
                ended = status_rows(good, "done", start + 2).drop("status", "error").join(results(answer(good)), "query_id").select("query_id", "status", "seq", "error", "traceback")
            else:
                answer(good).write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
                ended = status_rows(good, "done", start + 2)
        except Exception as e:
            failed = good.withColumns({"error": F.lit(str(e)[:2000]), "traceback": F.lit(format_exc()[:20_000])})
            ended = status_rows(failed, "error", start + 2)
        ended.write.mode("overwrite").parquet(f"{at}/part=end")

    seen = requests if remember is None else first_of_each(requests, remember)
    writer = seen.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    parts = min(state_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with settings(spark, shuffle__partitions=str(parts), streaming__noDataMicroBatches__enabled="false"):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def serve_jobs(requests: DataFrame, evidence: DataFrame, responses: DataFrame, documents: str, log: str, checkpoint: str, outputs: DataFrame | None = None, **options) -> StreamingQuery:
    """The whole job of each request: a result document by its id, replacing an older one, and its status in the log.

    The pairs of the evidence are stored by the first batch that needs them and serve all later ones.
    """
    pairs = cache(lambda: shared_pairs(evidence))

    def store(docs: DataFrame) -> DataFrame:
        kept = put_documents(docs, documents)
        return kept.select("query_id", F.get_json_object("document", "$.status").alias("status"), F.get_json_object("document", "$.error").alias("error"))

    return serve(requests, lambda batch: job_documents(evidence, batch, responses, outputs, pairs=pairs()), store, log, checkpoint, **options)
