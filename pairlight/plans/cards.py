"""Evidence cards: a ranked pair as a few compact lines."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.columns import card_whole, number, text_list
from pairlight.functions.scores import cohort_of


def formatter(spec: str) -> Callable[[Column], Column]:
    """Numbers as Python's format gives them, which Java's differs from; batches of Arrow arrays."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, spec) for v in values.to_pylist()], pa.string())

    return run


def cards(shortlist: DataFrame, cohort: str | Column | None = None) -> DataFrame:
    """query_id and rank (if there), name, evidence, notes, mirna_name, gene_symbol of every pair.

    ``cohort`` is a code or a column of codes; its anti-correlation is the one
    that is scored.  Which parts appear depends on the columns of the table.
    """
    g, f3, g2 = formatter("g"), formatter(".3f"), formatter(".2g")
    has = set(shortlist.columns)
    mirna, gene = F.coalesce("mirna_name", F.lit("")), F.coalesce("gene_symbol", F.lit(""))
    name = F.when((gene != "") & (mirna != ""), F.concat(gene, F.lit(" (← "), mirna, F.lit(")"))).when(gene != "", gene).when(mirna != "", mirna).otherwise("UNKNOWN")
    n = lambda c: card_whole(shortlist, c).cast("string")
    on = lambda c: card_whole(shortlist, c) == 1
    value = lambda c: F.lit(None).cast("double") if number(shortlist, c) is None else number(shortlist, c)
    bits = []
    if "mirtarbase_pos" in has:
        bits.append(F.concat(F.lit("miRTarBase(functional="), n("mirtarbase_pos"), F.lit(")")))
    bits.append(F.when(on("support_encori"), F.concat(F.lit("ENCORI(CLIP_sum="), g(F.coalesce(value("clip_exp_sum"), F.lit(0.0))), F.lit(", sites="), n("n_clip_sites"), F.lit(")"))))
    ctx = value("ts_best_contextpp")
    bits.append(F.when(on("support_targetscan"), F.concat(F.lit("TargetScan("), F.coalesce(F.concat(F.lit("best_context++="), f3(ctx), F.lit(", ")), F.lit("")), F.lit("sites="), n("ts_n_sites"), F.lit(")"))))
    bits.append(F.when(on("support_mirdb"), F.concat(F.lit("miRDB(best="), g(F.coalesce(value("mirdb_best_score"), F.lit(0.0))), F.lit(")"))))
    if cohort is not None:
        c = cohort_of(shortlist, cohort)
        code = F.upper(F.lit(cohort) if isinstance(cohort, str) else cohort)
        inner = F.concat_ws(", ", F.concat(F.lit("anti_corr="), F.coalesce(c["anticorr"], F.lit(0)).cast("string")), F.concat(F.lit("rho="), f3(c["rho"])), F.concat(F.lit("p="), g2(c["p"])), F.when(c["repression"] == 1, "repression_flag=1"))
        bits.append(F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("TCGA("), code, F.lit(" "), inner, F.lit(")"))))
    evidence = F.concat_ws("; ", F.concat(F.lit("support_count="), n("support_count")), *bits)
    notes = F.lit(None).cast("string")
    if "cellline_tissue_set" in has:
        t = text_list(shortlist, "cellline_tissue_set")
        notes = F.when(on("support_encori") & (F.size(t) > 0), F.concat(F.lit("ENCORI tissues: "), F.array_join(F.slice(t, 1, 6), ", "), F.when(F.size(t) > 6, " ...").otherwise("")))
    keep = [c for c in ("query_id", "rank") if c in has]
    return shortlist.select(*keep, name.alias("name"), evidence.alias("evidence"), notes.alias("notes"), mirna.alias("mirna_name"), gene.alias("gene_symbol"))
