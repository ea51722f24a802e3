"""Score of a pair from its evidence columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.columns import flag, real, whole


@dataclass(frozen=True)
class Weights:
    """What each part counts in the total. These defaults."""

    support: float = 1.0
    site: float = 1.0
    clip: float = 0.7
    mirdb: float = 0.7
    cohort: float = 0.9
    pathway: float = 0.6
    anticorrelated: float = 0.8
    repression: float = 0.3


def clamp(c: Column, low: float, high: float) -> Column:
    """Between two bounds; the caller has replaced nulls, which greatest and least would skip."""
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def cohort_codes(df: DataFrame) -> list[str]:
    """Codes of all cohorts that the table has columns of."""
    ends = ("_spearman_rho", "_spearman_p", "_anticorrelated", "_repression_evidence", "_pair_expressed")
    return sorted({c[: -len(e)] for c in df.columns for e in ends if c.endswith(e) and len(c) > len(e)})


def cohort_struct(df: DataFrame, code: str) -> Column:
    """One cohort's evidence; which columns there are is settled here, not at run time.

    rho_strength, p, anticorr and repression have their defaults filled in;
    ``expressed`` is null where the table has no such column.
    """
    rho, p = f"{code}_spearman_rho", f"{code}_spearman_p"
    if f"{code}_anticorrelated" in df.columns:
        anti = flag(df, f"{code}_anticorrelated")
    elif rho in df.columns and p in df.columns:
        anti = ((real(df, rho) < 0) & (real(df, p, 1.0) <= 0.05)).cast("int")
    else:
        anti = F.lit(0)
    shown = f"{code}_pair_expressed"
    return F.struct(
        clamp(-real(df, rho), 0.0, 1.0).alias("rho_strength"),
        real(df, rho, None).alias("rho"),
        real(df, p, None).alias("p"),
        anti.alias("anticorr"),
        flag(df, f"{code}_repression_evidence").alias("repression"),
        (flag(df, shown) if shown in df.columns else F.lit(None).cast("int")).alias("expressed"),
    )


#: Prefix of columns that hold the evidence of each row's own cohort, whichever that is.
OWN = "cohort"


def own_struct(df: DataFrame) -> Column:
    """As ``cohort_struct`` from the columns of a row's own cohort; flags that the cohort's table has no column of are null there."""
    rho, p = (F.col(f"{OWN}_{n}") for n in ("spearman_rho", "spearman_p"))
    derived = ((F.coalesce(rho, F.lit(0.0)) < 0) & (F.coalesce(p, F.lit(1.0)) <= 0.05)).cast("int")
    return F.struct(
        clamp(-F.coalesce(rho, F.lit(0.0)), 0.0, 1.0).alias("rho_strength"),
        rho.alias("rho"),
        p.alias("p"),
        F.coalesce(f"{OWN}_anticorrelated", derived).alias("anticorr"),
        flag(df, f"{OWN}_repression_evidence").alias("repression"),
        F.col(f"{OWN}_pair_expressed").alias("expressed"),
    )


def cohort_of(df: DataFrame, code: Column | str | None) -> Column:
    """The struct of a query's cohort: a plain choice for one code, one CASE for a column of codes; null if there is none."""
    codes = cohort_codes(df)
    kind = "struct<rho_strength:double,rho:double,p:double,anticorr:int,repression:int,expressed:int>"
    if isinstance(code, str) and code == OWN:
        return own_struct(df).cast(kind)
    if code is None or not codes:
        return F.lit(None).cast(kind)
    if isinstance(code, str):
        return cohort_struct(df, code.upper()).cast(kind) if code.upper() in codes else F.lit(None).cast(kind)
    return _choose(code, {c: cohort_struct(df, c).cast(kind) for c in codes})


def _choose(code: Column, values: dict[str, Column]) -> Column:
    """The value of a code; of all values only the chosen one is worked out."""
    out = None
    for c, v in values.items():
        out = (F if out is None else out).when(F.upper(code) == c, v)
    return F.lit(None) if out is None else out


def expressed_of(df: DataFrame, code: Column | str | None) -> Column:
    """A query's cohort's pair_expressed flag; null without a cohort, or where the table has no such column."""
    flags = {c: flag(df, f"{c}_pair_expressed") for c in cohort_codes(df) if f"{c}_pair_expressed" in df.columns}
    if code is None or isinstance(code, str):
        return flags.get((code or "").upper(), F.lit(None).cast("int"))
    return _choose(code, flags).cast("int")


def with_scores(df: DataFrame, cohort: Column | str | None, pathway_on: Column, weights: Weights = Weights()) -> DataFrame:
    """Append the score and its eleven parts; ``pathway_on`` says whether a query wants the pathway bonus."""
    df = df.withColumn("_cohort", cohort_of(df, cohort))
    c = F.col("_cohort")
    rho, anti, rep = (F.coalesce(c[n].cast("double"), F.lit(0.0)) for n in ("rho_strength", "anticorr", "repression"))
    hits = "gene_pathway_hits" in df.columns
    parts = {
        "retrieval_support": real(df, "support_count"),
        "retrieval_ts_contrib": clamp(-real(df, "ts_best_contextpp"), 0.0, 2.0),
        "retrieval_clip_contrib": F.log1p(real(df, "clip_exp_sum")) / 5.0,
        "retrieval_mirdb_contrib": real(df, "mirdb_best_score") / 100.0,
        "retrieval_tcga_contrib": rho + weights.anticorrelated * anti + weights.repression * rep,
        "retrieval_tcga_rho_strength": rho,
        "retrieval_tcga_anticorr_flag": anti.cast("int"),
        "retrieval_tcga_repression_flag": rep.cast("int"),
        "retrieval_tcga_p": c["p"],
        "retrieval_pathway_bonus": F.when(pathway_on, clamp(whole(df, "gene_pathway_hits") / 5.0, 0.0, 1.0)).otherwise(F.lit(0.0)) if hits else F.lit(0.0),
    }
    w = {"retrieval_support": weights.support, "retrieval_ts_contrib": weights.site, "retrieval_clip_contrib": weights.clip, "retrieval_mirdb_contrib": weights.mirdb, "retrieval_tcga_contrib": weights.cohort, "retrieval_pathway_bonus": weights.pathway}
    df = df.withColumns(parts)
    total = F.lit(0.0)
    for name, weight in w.items():
        total = total + F.lit(weight) * F.col(name)
    return df.withColumn("retrieval_score", total).drop("_cohort")
