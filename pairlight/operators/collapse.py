"""One row a pair: aggregates chosen from column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.columns import flag, whole
from pairlight.functions.scores import cohort_codes
from pairlight.sources.evidence import prepare

# How each evidence column is collapsed.
LARGEST = ["support_encori", "support_targetscan", "support_mirdb", "mirtarbase_pos", "support_count", "ts_best_percentile", "ts_n_sites", "clip_exp_sum", "clip_exp_max", "n_clip_sites", "mirdb_best_score", "mirdb_mean_score", "mirdb_n_transcripts", "gene_pathway_hits"]
SMALLEST = ["ts_best_contextpp", "ts_best_site"]
SMALLEST_ENDS = ("_spearman_rho", "_spearman_p")
LARGEST_ENDS = ("_anticorrelated", "_repression_evidence", "_pair_expressed", "_gene_expressed", "_mirna_expressed", "_gene_expr_median", "_mirna_expr_median", "_gene_present_frac", "_mirna_present_frac", "_mrna_n_samples", "_mirna_n_samples")
LISTS = ["cellline_tissue_set", "mirtarbase_pmids", "mirtarbase_experiments", "ts_gene_id_base", "entrez_ids"]


def _no_nan(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def place(name: str) -> str:
    """Name of the column that says where a list's value lies."""
    return f"_at_{name}"


def first_places(lists: list[str], order: str = "row_ord") -> list[Column]:
    """For each list column, where its first value lies that isn't null: the least row order, a number as a rule, so that rows aggregate by hash."""
    return [F.min(F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(place(c)) for c in lists]


def fetch_lists(df: DataFrame, rows: DataFrame, lists: list[str], order: str = "row_ord") -> DataFrame:
    """The values of the chosen rows in the stead of their places; an empty list becomes null, later rows are not tried.

    ``rows`` has each row order once.  Only the chosen rows' lists are moved, so this comes
    best after ranking, when few are left.
    """
    for c in lists:
        value = F.when(F.size(c) > 0, F.col(c)) if isinstance(rows.schema[c].dataType, T.ArrayType) else F.col(c)
        # Rows with a null are never chosen.
        values = rows.where(F.col(c).isNotNull()).select(F.col(order).alias(place(c)), value.alias(c))
        df = df.join(values, place(c), "left").drop(place(c))
    return df


def list_columns(df: DataFrame, order: str = "row_ord") -> list[str]:
    """Columns that are collapsed to their first value; without a row order there are none."""
    return [c for c in df.columns if c in LISTS] if order in df.columns else []


def first_values(df: DataFrame, by: list[str], lists: list[str], order: str = "row_ord") -> DataFrame:
    """Of each group the first value that isn't null in row order; if that one is an empty list the result is null."""
    return fetch_lists(df.groupBy(*by).agg(*first_places(lists, order)), df, lists, order)


def rules(df: DataFrame, order: str = "row_ord") -> list[Column]:
    """The aggregate of every column that survives, for lists their places; all others go. Lists need the row order column.

    Rows that are collapsed already have the places themselves.
    """
    out = []
    for c in df.columns:
        if c in map(place, LISTS):
            out.append(F.min(c).alias(c))
        elif c in SMALLEST or c.endswith(SMALLEST_ENDS):
            out.append(F.min(_no_nan(df, c)).alias(c))
        elif c in LARGEST or c.endswith(LARGEST_ENDS):
            out.append(F.max(_no_nan(df, c)).alias(c))
    return out + first_places(list_columns(df, order), order)


def collapse_pairs(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each (mirna_name, gene_symbol); rows with a null key go. Partial aggregation precedes the shuffle."""
    keys = ["mirna_name", "gene_symbol"]
    return fetch_lists(df.dropna(subset=keys).groupBy(*(by or []), *keys).agg(*rules(df)), df, list_columns(df))


def gated_pairs(evidence: DataFrame) -> DataFrame:
    """Evidence with one row for each pair and each outcome of the row gates, instead of any number of them.

    Gates act on rows, so rows go together only where every gate, of whatever threshold and cohort, says the same of
    all of them.  The aggregates are least and greatest values, which may be taken in two steps: scores and results
    of these rows are those of the evidence.  Lists are at their places.
    """
    flags = [c for c in ("mirtarbase_pos", "support_targetscan", "support_encori", "support_mirdb", *(f"{code}_pair_expressed" for code in cohort_codes(evidence))) if c in evidence.columns]
    # One gate asks for a flag of 0, the others for 1.
    gates = [(flag(evidence, c) == (0 if c == "mirtarbase_pos" else 1)).alias(f"_gate_{c}") for c in flags]
    pairs = evidence.groupBy("mirna_name", "gene_symbol", whole(evidence, "support_count").alias("_gate"), *gates).agg(*rules(evidence))
    return prepare(pairs.drop("_gate", *(f"_gate_{c}" for c in flags)))
