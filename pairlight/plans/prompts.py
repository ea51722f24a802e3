"""Prompts: a query's context and its cards as one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template texts; callers may pass their own.
SYSTEM = "You rank microRNA-gene pairs by the evidence cards given below and by nothing else. Name each candidate once and say what supports it."
INSTRUCTIONS = "Rank {items} by the strength and agreement of their evidence. Use the cards only. List a candidate once. Give the evidence of each in a line."


def task_line(direction: Column) -> Column:
    return F.when(direction == "mirna_to_targets", "Rank the genes that the microRNA regulates.").when(direction == "gene_to_mirnas", "Rank the microRNAs that regulate the gene.").otherwise("Rank the candidates.")


def item_noun(direction: Column) -> Column:
    return F.when(direction == "mirna_to_targets", "genes").when(direction == "gene_to_mirnas", "microRNAs").otherwise("candidates")


def context_lines(q: dict[str, Column]) -> Column:
    """The lines of what is known; a placeholder if nothing is."""
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {label}: "), F.array_join(c, ", ")))
    place = F.coalesce(F.nullif(q["cancer_name"], F.lit("")), F.nullif(q["cohort"], F.lit("")))
    lines = F.concat_ws("\n", F.concat(F.lit("- Cancer: "), place), listed("Phenotypes", q["phenotype_keywords"]), listed("Pathways", q["pathway_keywords"]), F.when(q["novel"], "- Only pairs without a validated record"), listed("Unclear", q["needs_clarification"]))
    return F.when(lines == "", "- nothing given").otherwise(lines)


def card_block(name: Column, evidence: Column, notes: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Candidate: "), F.coalesce(name, F.lit("UNKNOWN"))), F.concat(F.lit("Evidence: "), F.coalesce(evidence, F.lit(""))), F.concat(F.lit("Notes: "), F.nullif(notes, F.lit(""))))


def prompts(specs: DataFrame, cards: DataFrame | None = None, shortlist: DataFrame | None = None, card_builder: Callable[[DataFrame], DataFrame] | None = None, system: str = SYSTEM, instructions: str = INSTRUCTIONS) -> DataFrame:
    """query_id, system_prompt, user_prompt, meta (the specification) for every query, with its cards in rank order.

    Cards come ready, or from the shortlist by ``card_builder``.  A query without
    cards gets a prompt all the same.  The missing fields of a specification
    are taken as not given.
    """
    if cards is None:
        if shortlist is None:
            raise ValueError("prompts need cards or a shortlist")
        if card_builder is None:
            from pairlight.plans.cards import cards as card_builder
        cards = shortlist.transform(card_builder)
    block = card_block(F.col("name"), F.col("evidence"), F.col("notes"))
    # k bounds the cards of a query.
    joined = cards.select("query_id", F.struct("rank", block.alias("block")).alias("c")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["block"]), "\n\n").alias("_cards"))
    has = set(specs.columns)
    text = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in has), F.lit(None).cast("string"))
    words = lambda n: F.coalesce(n, F.array().cast("array<string>")) if n in has else F.array().cast("array<string>")
    mode = text("mode")
    direction = F.coalesce(F.when(mode.isin("mirna_to_targets", "gene_to_mirnas"), mode), text("direction"), F.lit("unknown"))
    q = {
        "cancer_name": F.col("cancer.name") if "cancer" in has else F.lit(None).cast("string"),
        "cohort": text("cohort"),
        "novel": F.coalesce("novel", F.lit(False)) if "novel" in has else F.lit(False),
        **{n: words(n) for n in ("phenotype_keywords", "pathway_keywords", "needs_clarification")},
    }
    lead, rest = instructions.split("{items}", 1) if "{items}" in instructions else (instructions, None)
    told = F.lit(lead) if rest is None else F.concat(F.lit(lead), item_noun(direction), F.lit(rest))
    user = F.concat(F.lit("Task: "), task_line(direction), F.lit("\n"), told, F.lit("\n\nQuestion:\n"), F.trim(F.coalesce(text("original_question", "question"), F.lit(""))), F.lit("\n\nContext:\n"), context_lines(q), F.lit("\n\nCards:\n\n"), F.coalesce("_cards", F.lit("")))
    meta = F.struct(*(c for c in specs.columns if c != "query_id"))
    return specs.join(joined, "query_id", "left").select("query_id", F.lit(system).alias("system_prompt"), user.alias("user_prompt"), meta.alias("meta"))
