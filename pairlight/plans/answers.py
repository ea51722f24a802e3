"""Stored answers: the summary text inside, and the envelope of a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: where a summary may be, in the order of trial.
PLACES = ("$", "$.summary", "$.raw_text", "$.raw_text.summary", "$.raw_text.raw_text", "$.raw_text.raw_text.summary", "$.raw_text.raw_text.raw_text")


def summary(answer: Column) -> Column:
    """First string that isn't blank among PLACES of an answer in JSON; objects and numbers don't count."""
    v = F.try_parse_json(answer)

    def at(path: str) -> Column:
        part = F.try_variant_get(v, path, "variant")
        s = F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))
        return F.when(s.rlike(r"(?U)\S"), s)

    return F.coalesce(*(at(p) for p in PLACES))


def extract_summaries(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", summary(F.col("answer")).alias("summary"))


def envelope(outputs: DataFrame) -> DataFrame:
    """A model's outputs (query_id, text) as stored answers."""
    return outputs.select("query_id", F.col("text").alias("raw_text"), F.col("text").alias("summary"), F.array().cast("array<string>").alias("suggested_experiments"))
