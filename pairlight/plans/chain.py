"""The whole job in stages: requests and planner replies to result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.operators.retrieve import retrieve_shared
from pairlight.plans.answers import envelope
from pairlight.plans.cards import cards
from pairlight.plans.prompts import prompts
from pairlight.plans.specs import apply_overrides, normalise_specs, request_defaults, to_queries
from pairlight.sources.jobs import error_records, nest_shortlist, result_documents
from pairlight.sources.stages import stored


def job_documents(evidence: DataFrame, requests: DataFrame, responses: DataFrame, outputs: DataFrame | None = None, max_k: int | None = None, folder: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, document) for every request: specification, shortlist, prompt bundle and answer, or the error.

    ``responses`` (query_id, response) are the planner's replies, ``outputs``
    (query_id, text) a model's answers, if there are any yet.  A request without a
    reply is an error, as is one that ``normalise_specs`` rejects.  Requests with their replies,
    specifications, pairs and shortlists are stored in turn, below ``folder`` or else in the
    shared folder, so that each input is read once and a later stage knows the size of what it reads.
    ``pairs`` are the ``shared_pairs`` of the evidence, where jobs before have stored them.
    """
    asked = request_defaults(requests).join(responses.select("query_id", "response"), "query_id", "left")
    asked = stored(asked, "asked", folder)
    specs = apply_overrides(normalise_specs(asked.select("query_id", "question", "response")), asked)
    specs = stored(specs.withColumn("error", F.coalesce("error", F.when(F.col("k") < 0, "k is negative"))), "specs", folder)
    good, bad = specs.where("error IS NULL").drop("error"), specs.where("error IS NOT NULL")
    most = max_k if max_k is not None else good.agg(F.max("k")).first()[0] or 0
    short = retrieve_shared(evidence, to_queries(good), max_k=most, folder=folder, pairs=pairs)
    # Dealt out by query: shortlists that many share are a small file, but their cards are not.
    shortlist = stored(short.repartition("query_id"), "shortlist", folder)
    bundles = prompts(good, cards=cards(shortlist.join(good.select("query_id", "cohort"), "query_id"), F.col("cohort")))
    done = result_documents(good, nest_shortlist(shortlist), bundles, None if outputs is None else envelope(outputs))
    return done.unionByName(error_records(bad.select("query_id", "error")))
