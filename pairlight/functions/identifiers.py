"""Names of regulators and genes: normal forms, candidate names by tier, direction of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight.columns import strip

# Species prefixes that are stripped, prefixes that mark a regulator, and prefixes that the table uses.
SPECIES = ("hsa", "mmu", "rno", "dme", "cel", "ath")
MARKS = ("hsa-", "mmu-", "rno-")
TABLE_PREFIXES = ("hsa-", "")
#: Tiers tried in turn, by the arm that the query names.
TIERS = {"given": ("arm", ""), "none": ("-5p", "", "-3p")}


def compact(token: Column) -> Column:
    """Hyphens for underscores, no white space, no species prefix, lower case."""
    c = F.regexp_replace(F.translate(F.coalesce(token, F.lit("")), "_", "-"), r"(?U)\s+", "")
    return F.lower(F.regexp_replace(c, f"(?i)^({'|'.join(SPECIES)})-", ""))


def arm(token: Column) -> Column:
    """'3p' or '5p' if the name ends in one, else null."""
    return F.nullif(F.regexp_extract(compact(token), r"(?:^|-)([35]p)$", 1), F.lit(""))


def base_name(token: Column) -> Column:
    """The name without species and arm, with a hyphen after mir or let, hyphens single and none at the ends."""
    c = F.regexp_replace(compact(token), r"(?:^|-)[35]p$", "")
    c = F.regexp_replace(c, r"^(mir|let)(?=[0-9a-z])", "$1-")
    return F.regexp_replace(F.regexp_replace(c, r"-{2,}", "-"), r"^-|-$", "")


def is_regulator(token: Column) -> Column:
    t = F.lower(token)
    out = t.contains("mir")
    for p in MARKS:
        out = out | t.startswith(p)
    return F.coalesce(out, F.lit(False))


def direction(token: Column) -> Column:
    """Which way a query goes; only the token decides."""
    return F.when(is_regulator(strip(token)), F.lit("mirna_to_targets")).otherwise(F.lit("gene_to_mirnas"))


def candidate_names(token: Column) -> Column:
    """All (tier, name) that may answer a regulator query, lower-cased; lower tiers win. An empty base has none."""
    base, own = base_name(token), arm(token)
    name = lambda tier, prefix, suffix: F.struct(F.lit(tier).alias("tier"), F.lower(F.concat(F.lit(prefix), base, suffix)).alias("name"))
    given = F.array(*(name(i, p, F.concat(F.lit("-"), own) if s == "arm" else F.lit(s)) for i, s in enumerate(TIERS["given"]) for p in TABLE_PREFIXES))
    free = F.array(*(name(i, p, F.lit(s)) for i, s in enumerate(TIERS["none"]) for p in TABLE_PREFIXES))
    none = F.filter(free, lambda x: F.lit(False))
    return F.when(base == "", none).when(own.isNotNull(), given).otherwise(free)
