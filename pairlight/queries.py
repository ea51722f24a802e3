"""Queries over an evidence view of the driver's tables, one or more an operator, with their SQL counterparts.

The view is the same text for Spark and for DuckDB; so are the tables of
planner responses, answers and status entries, all made from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight import columns as C
from pairlight.functions import identifiers as ids
from pairlight.functions.scores import with_scores
from pairlight.operators import retrieve as R
from pairlight.operators.cohorts import read_cohorts, write_cohorts
from pairlight.operators.collapse import collapse_pairs, first_values
from pairlight.plans import answers as A
from pairlight.plans import prompts as P
from pairlight.plans import specs as S
from pairlight.plans.cards import cards as make_cards
from pairlight.plans.chain import job_documents
from pairlight.sources import jobs as J
from pairlight.sources.evidence import numbered, prepare, read_evidence
from pairlight.sources.stages import shared_folder
from pairlight.streaming import requests as Q

M, ARM = "(l_partkey % 40)", "(l_partkey % 3)"
VIEW = {
    "mirna_name": f"CASE WHEN {M} = 7 THEN 'hsa-let-7' WHEN {M} = 8 THEN 'miR-8' ELSE concat('hsa-miR-', {M}) END || CASE WHEN {M} >= 35 THEN '-3p' WHEN {ARM} = 0 AND {M} >= 10 THEN '-5p' WHEN {ARM} = 1 THEN '-3p' ELSE '' END",
    "gene_symbol": "CASE WHEN l_suppkey % 50 = 49 THEN NULL ELSE concat('GENE', l_suppkey % 50) END",
    "mirtarbase_pos": f"CASE WHEN l_returnflag = 'R' OR ({M} = 20 AND {ARM} = 0) THEN 1 ELSE 0 END",
    "support_encori": "CAST(l_linenumber % 2 AS INT)",
    "support_targetscan": "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END",
    "support_mirdb": "CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END",
    "ts_best_contextpp": "CASE WHEN l_quantity > 25 THEN -l_quantity / 20.0 END",
    "ts_n_sites": "CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS INT) % 4 END",
    "clip_exp_sum": "CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice / 1000.0 END",
    "n_clip_sites": "CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END",
    "mirdb_best_score": "CASE WHEN l_discount >= 0.05 THEN 50.0 + l_discount * 500.0 END",
    "gene_pathway_hits": "CAST(l_suppkey % 8 AS INT)",
    "BRCA_spearman_rho": "CASE WHEN l_linestatus = 'O' THEN (l_tax - 0.04) * 10.0 END",
    "BRCA_spearman_p": "CASE WHEN l_linestatus = 'O' THEN l_discount END",
    "BRCA_pair_expressed": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "COAD_spearman_rho": "(0.04 - l_tax) * 10.0",
    "COAD_spearman_p": "l_discount",
    "COAD_anticorrelated": "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END",
    "COAD_repression_evidence": "CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END",
}
VIEW["support_count"] = " + ".join(f"({VIEW[c]})" for c in ("mirtarbase_pos", "support_encori", "support_targetscan", "support_mirdb"))
EV = "ev AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in VIEW.items()) + " FROM lineitem)"

#: query_id, token, its base name, arm, novel, min_support, binding gate, expression gate, cohort, k, pathway mode, least hits
BATCH = [
    ("1", "miR-12", "mir-12", "", True, 1, False, False, "BRCA", 25, "boost", 1),
    ("2", " hsa-miR-5 ", "mir-5", "", False, 2, False, False, "BRCA", 25, "boost", 1),
    ("3", "mir8", "mir-8", "", False, 3, False, False, "BRCA", 25, "boost", 1),
    ("4", "hsa-let-7", "let-7", "", True, 1, False, False, "BRCA", 25, "boost", 1),
    ("5", "hsa_miR_36", "mir-36", "", False, 1, False, False, "COAD", 10, "boost", 1),
    ("6", "miR-20", "mir-20", "", True, 1, False, False, "BRCA", 25, "boost", 1),
    ("7", "miR-20", "mir-20", "", False, 1, False, False, "BRCA", 25, "boost", 1),
    ("8", "miR-99", "mir-99", "", False, 1, False, False, "BRCA", 25, "boost", 1),
    ("9", "miR-12-3p", "mir-12", "3p", False, 1, True, False, "BRCA", 49, "boost", 1),
    ("10", "miR-36-5p", "mir-36", "5p", False, 1, False, False, "BRCA", 25, "boost", 1),
    ("11", "gene3", None, None, False, 1, False, True, "BRCA", 100, "boost", 1),
    ("12", "gene3", None, None, False, 2, False, False, "COAD", 100, "boost", 1),
    ("13", "miR-12-5p", "mir-12", "5p", True, 1, False, False, None, 60, "filter", 5),
    ("14", "miR-12", "mir-12", "", False, 1, False, False, "BRCA", 0, "boost", 1),
]
MAX_K = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS `{n}`" for n, e in VIEW.items()))


def batch(spark: SparkSession) -> DataFrame:
    lit = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper()
    rows = ", ".join("(" + ", ".join(map(lit, (r[0], r[1], *r[4:]))) + ")" for r in BATCH)
    names = "query_id, token, novel, min_support, require_binding_evidence, require_expression, cohort, k, pathway_mode, min_gene_sets"
    return spark.sql(f"SELECT *, TRUE AS pathway_enabled, TRUE AS has_keywords FROM VALUES {rows} AS t({names})")


def _batch_sql(last: str, weights_cohort: bool = True) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()
    rows = ", ".join("(" + ", ".join(map(lit, (r[0], r[1].strip(), *r[2:]))) + ")" for r in BATCH)
    tier = lambda name, t: f"""(CASE q.arm WHEN '' THEN CASE lower({name}) WHEN q.base || '-5p' THEN 0 WHEN 'hsa-' || q.base || '-5p' THEN 0 WHEN q.base THEN 1 WHEN 'hsa-' || q.base THEN 1 WHEN q.base || '-3p' THEN 2 WHEN 'hsa-' || q.base || '-3p' THEN 2 END
        ELSE CASE lower({name}) WHEN q.base || '-' || q.arm THEN 0 WHEN 'hsa-' || q.base || '-' || q.arm THEN 0 WHEN q.base THEN 1 WHEN 'hsa-' || q.base THEN 1 END END)"""  # noqa: E731
    return f"""WITH {EV},
    q(query_id, token, base, arm, novel, ms, binding, expr, cohort, k, pmode, least) AS (VALUES {rows}),
    hit AS (SELECT q.*, ev.*, CASE WHEN q.base IS NULL THEN 0 ELSE {tier('ev.mirna_name', 't')} END AS tier FROM q JOIN ev ON
        CASE WHEN q.base IS NULL THEN upper(ev.gene_symbol) = upper(q.token) ELSE {tier('ev.mirna_name', 't')} IS NOT NULL END
        WHERE (NOT q.novel OR ev.mirtarbase_pos = 0) AND (q.ms <= 0 OR ev.support_count >= q.ms)
          AND (NOT q.binding OR ev.support_targetscan = 1 OR ev.support_encori = 1 OR ev.support_mirdb = 1)
          AND (NOT q.expr OR coalesce(q.cohort, '') <> 'BRCA' OR ev."BRCA_pair_expressed" = 1)),
    best AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM hit),
    win AS (SELECT * FROM best WHERE tier = best),
    names AS (SELECT query_id, string_agg(DISTINCT CASE WHEN base IS NULL THEN token ELSE mirna_name END, ';' ORDER BY CASE WHEN base IS NULL THEN token ELSE mirna_name END) AS matched_query_tokens FROM win GROUP BY query_id),
    pair AS (SELECT query_id, mirna_name, gene_symbol, any_value(cohort) AS cohort, any_value(k) AS k, any_value(pmode) AS pmode, any_value(least) AS least, max(mirtarbase_pos) AS mirtarbase_pos, max(support_encori) AS support_encori,
        max(support_targetscan) AS support_targetscan, max(support_mirdb) AS support_mirdb, max(support_count) AS support_count, min(ts_best_contextpp) AS ts_best_contextpp, max(ts_n_sites) AS ts_n_sites, max(clip_exp_sum) AS clip_exp_sum,
        max(n_clip_sites) AS n_clip_sites, max(mirdb_best_score) AS mirdb_best_score, max(gene_pathway_hits) AS hits, min("BRCA_spearman_rho") AS brho, min("BRCA_spearman_p") AS bp, min("COAD_spearman_rho") AS crho, min("COAD_spearman_p") AS cp,
        max("COAD_anticorrelated") AS canti, max("COAD_repression_evidence") AS crep FROM win WHERE gene_symbol IS NOT NULL GROUP BY query_id, mirna_name, gene_symbol),
    part AS (SELECT *, CASE cohort WHEN 'BRCA' THEN coalesce(brho, 0) WHEN 'COAD' THEN crho ELSE 0 END AS rho, CASE cohort WHEN 'BRCA' THEN bp WHEN 'COAD' THEN cp END AS p,
        CASE cohort WHEN 'BRCA' THEN CASE WHEN coalesce(brho, 0) < 0 AND coalesce(bp, 1) <= 0.05 THEN 1 ELSE 0 END WHEN 'COAD' THEN canti ELSE 0 END AS anticor, CASE cohort WHEN 'COAD' THEN crep ELSE 0 END AS rep
        FROM pair WHERE pmode <> 'filter' OR hits >= least),
    parts AS (SELECT *, CAST(support_count AS DOUBLE) AS s_support, greatest(least(-coalesce(ts_best_contextpp, 0), 2.0), 0.0) AS s_ts, ln(1 + coalesce(clip_exp_sum, 0)) / 5.0 AS s_clip, coalesce(mirdb_best_score, 0) / 100.0 AS s_mirdb,
        greatest(least(-rho, 1.0), 0.0) + 0.8 * anticor + 0.3 * rep AS s_cohort, greatest(least(hits / 5.0, 1.0), 0.0) AS s_path FROM part),
    scored AS (SELECT *, s_support + s_ts + 0.7 * s_clip + 0.7 * s_mirdb + 0.9 * s_cohort + 0.6 * s_path AS score FROM parts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, mirna_name, gene_symbol) AS rank FROM scored),
    top AS (SELECT * FROM ranked WHERE rank <= k)
    {last}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve(prepare(evidence(spark, sf_dir)), batch(spark), max_k=MAX_K)


# Sources and coercions


@query("SELECT l_returnflag, count(*) AS n_rows, sum(l_linenumber) AS n_lines FROM lineitem GROUP BY l_returnflag")
def evidence_scan(spark, sf_dir):
    df = read_evidence(spark, f"{sf_dir}/lineitem.parquet", ordered=True)
    return df.groupBy("l_returnflag").agg(F.count("row_ord").alias("n_rows"), F.sum("l_linenumber").cast("decimal(38,0)").alias("n_lines"))


_MESSY = "CASE l_linenumber % 5 WHEN 0 THEN '1d' WHEN 1 THEN ' 2.5 ' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) ELSE NULL END"


@query(f"""WITH t AS (SELECT l_returnflag, TRY_CAST(trim({_MESSY}) AS DOUBLE) AS x, TRY_CAST(trim({_MESSY}) AS INT) AS i FROM lineitem)
SELECT l_returnflag, sum(coalesce(x, 0.5)) AS real_sum, CAST(sum(CAST(trunc(coalesce(x, -1)) AS BIGINT)) AS BIGINT) AS whole_sum, CAST(sum(CAST(trunc(coalesce(x, 0)) AS INT)) AS BIGINT) AS flag_sum,
CAST(sum(CASE WHEN i IS NULL OR x <> trunc(x) THEN 9 ELSE i END) AS BIGINT) AS card_sum FROM t GROUP BY l_returnflag""")
def coerce_columns(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", f"{_MESSY} AS x")
    return df.groupBy("l_returnflag").agg(F.sum(C.real(df, "x", 0.5)).alias("real_sum"), F.sum(C.whole(df, "x", -1)).alias("whole_sum"), F.sum(C.flag(df, "x")).alias("flag_sum"), F.sum(C.card_whole(df, "x", 9)).alias("card_sum"))


# Filters


def _gate_sql(where: str) -> str:
    return f"WITH {EV} SELECT mirna_name, count(*) AS n_rows FROM ev WHERE {where} GROUP BY mirna_name"


def _gated(df: DataFrame, gate) -> DataFrame:
    return df.where(gate).groupBy("mirna_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query(_gate_sql("mirtarbase_pos = 0"))
def novel_filter(spark, sf_dir):
    df = evidence(spark, sf_dir)
    return _gated(df, R.novel_ok(df, F.lit(True)))


@query(_gate_sql("support_count >= 2"))
def min_support_filter(spark, sf_dir):
    df = evidence(spark, sf_dir)
    return _gated(df, R.support_ok(df, F.lit(2)))


@query(_gate_sql("support_targetscan = 1 OR support_encori = 1 OR support_mirdb = 1"))
def binding_gate(spark, sf_dir):
    df = evidence(spark, sf_dir)
    return _gated(df, R.binding_ok(df, F.lit(True)))


@query(_gate_sql('"BRCA_pair_expressed" = 1'))
def expression_gate(spark, sf_dir):
    df = evidence(spark, sf_dir)
    return _gated(df, R.expression_ok(df, F.lit(True), "BRCA"))


# Identifiers

_TOKEN = "CASE l_linenumber % 5 WHEN 0 THEN upper(mirna_name) WHEN 1 THEN replace(mirna_name, '-', '_') WHEN 2 THEN concat('  ', mirna_name, ' ') WHEN 3 THEN coalesce(gene_symbol, '') ELSE replace(mirna_name, 'miR-', 'mir') END"
_TOKENS_SQL = f"""WITH ev AS (SELECT DISTINCT {VIEW['mirna_name']} AS mirna_name, {VIEW['gene_symbol']} AS gene_symbol, l_linenumber FROM lineitem), t AS (SELECT DISTINCT {_TOKEN} AS token FROM ev),
c AS (SELECT token, regexp_replace(lower(regexp_replace(replace(token, '_', '-'), '\\s+', '', 'g')), '^(hsa|mmu|rno|dme|cel|ath)-', '') AS c FROM t)"""


def _tokens(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr(f"{VIEW['mirna_name']} AS mirna_name", f"{VIEW['gene_symbol']} AS gene_symbol", "l_linenumber").distinct()
    return df.selectExpr(f"{_TOKEN} AS token").distinct()


@query(_TOKENS_SQL + """ SELECT token, trim(regexp_replace(regexp_replace(regexp_replace(c, '(^|-)[35]p$', ''), '^(mir|let)([0-9a-z])', '\\1-\\2'), '-{2,}', '-', 'g'), '-') AS base_name, nullif(regexp_extract(c, '(?:^|-)([35]p)$', 1), '') AS arm FROM c""")
def normalise_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", ids.base_name(F.col("token")).alias("base_name"), ids.arm(F.col("token")).alias("arm"))


@query(_TOKENS_SQL + """ SELECT token, CASE WHEN lower(token) LIKE '%mir%' OR regexp_matches(lower(trim(token)), '^(hsa|mmu|rno)-') THEN 'mirna_to_targets' ELSE 'gene_to_mirnas' END AS direction FROM c""")
def direction(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", ids.direction(F.col("token")).alias("direction"))


@query(_batch_sql("SELECT DISTINCT query_id, CAST(tier AS INT) AS tier, mirna_name FROM win WHERE base IS NOT NULL"))
def resolve_tiers(spark, sf_dir):
    hits = R.matches(prepare(evidence(spark, sf_dir)), R.with_defaults(batch(spark))).where("direction = 'mirna_to_targets'")
    seen = hits.groupBy("query_id", "tier", "mirna_name").agg(F.count(F.lit(1)).alias("n"))
    best = seen.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return seen.join(best, ["query_id", "tier"]).select("query_id", "tier", "mirna_name")


@query(_batch_sql("SELECT query_id, CAST(tier AS INT) AS tier, count(*) AS n_rows FROM hit WHERE base IS NOT NULL GROUP BY query_id, tier"))
def match_mirna(spark, sf_dir):
    hits = R.matches(prepare(evidence(spark, sf_dir)), R.with_defaults(batch(spark)))
    return hits.where("direction = 'mirna_to_targets'").groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n_rows"))


@query(_batch_sql("SELECT query_id, count(*) AS n_rows FROM hit WHERE base IS NULL GROUP BY query_id"))
def match_gene(spark, sf_dir):
    hits = R.matches(prepare(evidence(spark, sf_dir)), R.with_defaults(batch(spark)))
    return hits.where("direction = 'gene_to_mirnas'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"))


# Collapse and scores

_COLLAPSE = {c: ("min" if c in ("ts_best_contextpp",) or c.endswith(("_rho", "_p")) else "max") for c in VIEW if c not in ("mirna_name", "gene_symbol")}
_COLLAPSED_SQL = f"WITH {EV}, pair AS (SELECT mirna_name, gene_symbol, " + ", ".join(f'{f}("{c}") AS "{c}"' for c, f in _COLLAPSE.items()) + " FROM ev WHERE mirna_name IS NOT NULL AND gene_symbol IS NOT NULL GROUP BY mirna_name, gene_symbol)"


@query(_COLLAPSED_SQL + " SELECT mirna_name, gene_symbol, " + ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in _COLLAPSE) + " FROM pair")
def pair_collapse(spark, sf_dir):
    df = collapse_pairs(evidence(spark, sf_dir))
    return df.select("mirna_name", "gene_symbol", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in _COLLAPSE))


_TISSUES = "CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_linenumber = 7 THEN '' ELSE concat('tissue', CAST(l_quantity AS INT) % 5, '|line', l_linenumber) END"
_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"""WITH t AS (SELECT {M} AS m, l_suppkey % 50 AS s, {_TISSUES} AS tissues, {_ROW} FROM lineitem),
r AS (SELECT m, s, tissues, row_number() OVER (PARTITION BY m, s ORDER BY (tissues IS NULL), {_ROW}) AS n FROM t)
SELECT m, s, nullif(tissues, '') AS tissues FROM r WHERE n = 1""", name="first_nonnull")
def first_nonnull_list(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr(f"{M} AS m", "l_suppkey % 50 AS s", f"{_TISSUES} AS text", *_ROW.split(", "))
    df = numbered(df, *_ROW.split(", ")).select("m", "s", "text", "row_ord")
    df = df.withColumn("tissues", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", r"\|")))
    return first_values(df, ["m", "s"], ["tissues"]).select("m", "s", F.array_join("tissues", "|").alias("tissues"))


_PARTS = {"retrieval_support": "s_support", "retrieval_ts_contrib": "s_ts", "retrieval_clip_contrib": "s_clip", "retrieval_mirdb_contrib": "s_mirdb", "retrieval_tcga_contrib": "s_cohort", "retrieval_pathway_bonus": "s_path", "retrieval_score": "score", "retrieval_tcga_p": "p"}


@query(_batch_sql("SELECT query_id, mirna_name, gene_symbol, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in _PARTS.items()) + ", CAST(anticor AS INT) AS retrieval_tcga_anticorr_flag, CAST(rep AS INT) AS retrieval_tcga_repression_flag, round(greatest(least(-rho, 1.0), 0.0), 6) AS retrieval_tcga_rho_strength FROM top"))
def score_components(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "mirna_name", "gene_symbol", *(F.round(n, 6).alias(n) for n in _PARTS), "retrieval_tcga_anticorr_flag", "retrieval_tcga_repression_flag", F.round("retrieval_tcga_rho_strength", 6).alias("retrieval_tcga_rho_strength"))


def _cohort(spark, sf_dir, code):
    df = with_scores(collapse_pairs(evidence(spark, sf_dir)), code, F.lit(False))
    return df.select("mirna_name", "gene_symbol", F.col("retrieval_tcga_anticorr_flag").alias("anticorr"), F.round("retrieval_tcga_contrib", 6).alias("contrib"))


@query(_COLLAPSED_SQL + """, f AS (SELECT *, CASE WHEN coalesce("BRCA_spearman_rho", 0) < 0 AND coalesce("BRCA_spearman_p", 1) <= 0.05 THEN 1 ELSE 0 END AS anticorr FROM pair)
SELECT mirna_name, gene_symbol, anticorr, round(greatest(least(-coalesce("BRCA_spearman_rho", 0), 1.0), 0.0) + 0.8 * anticorr, 6) AS contrib FROM f""")
def cohort_anticorr_derived(spark, sf_dir):
    return _cohort(spark, sf_dir, "BRCA")


@query(_COLLAPSED_SQL + """ SELECT mirna_name, gene_symbol, "COAD_anticorrelated" AS anticorr, round(greatest(least(-"COAD_spearman_rho", 1.0), 0.0) + 0.8 * "COAD_anticorrelated" + 0.3 * "COAD_repression_evidence", 6) AS contrib FROM pair""")
def cohort_anticorr_explicit(spark, sf_dir):
    return _cohort(spark, sf_dir, "COAD")


@query(_batch_sql("SELECT query_id, mirna_name, gene_symbol, round(s_path, 6) AS bonus FROM scored WHERE pmode = 'boost' AND query_id IN ('1', '2', '7')"))
def pathway_boost(spark, sf_dir):
    q = batch(spark).where("query_id IN ('1', '2', '7')").withColumn("k", F.lit(2_000_000_000))
    return R.retrieve(evidence(spark, sf_dir), q).select("query_id", "mirna_name", "gene_symbol", F.round("retrieval_pathway_bonus", 6).alias("bonus"))


@query(_batch_sql("SELECT mirna_name, gene_symbol, CAST(hits AS INT) AS hits FROM scored WHERE query_id = '13'"))
def pathway_filter(spark, sf_dir):
    q = batch(spark).where("query_id = '13'").withColumn("k", F.lit(2_000_000_000))
    return R.retrieve(evidence(spark, sf_dir), q).select("mirna_name", "gene_symbol", F.col("gene_pathway_hits").alias("hits"))


# Top-k


@query(_batch_sql("SELECT CAST(rank AS INT) AS rank, mirna_name, gene_symbol, round(score, 6) AS retrieval_score FROM top WHERE query_id = '1'"))
def topk_single(spark, sf_dir):
    out = R.retrieve_one(evidence(spark, sf_dir), "miR-12", novel=True, min_support=1, cohort="BRCA", k=25, pathway_enabled=True, has_keywords=True)
    return out.select("rank", "mirna_name", "gene_symbol", F.round("retrieval_score", 6).alias("retrieval_score"))


@query(_batch_sql("SELECT query_id, CAST(rank AS INT) AS rank, mirna_name, gene_symbol, round(score, 6) AS retrieval_score FROM top"))
def topk_batch(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "rank", "mirna_name", "gene_symbol", F.round("retrieval_score", 6).alias("retrieval_score"))


@query(_batch_sql("SELECT DISTINCT query_id, matched_query_tokens FROM top JOIN names USING (query_id)"))
def matched_tokens(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "matched_query_tokens").distinct()


@query(_batch_sql("SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM top)"))
def unmatched_queries(spark, sf_dir):
    return R.unmatched(batch(spark), _ranked(spark, sf_dir)).select("query_id")


@query(_batch_sql("SELECT query_id, CAST(rank AS INT) AS rank, mirna_name, gene_symbol, round(score, 6) AS retrieval_score, round(s_cohort, 6) AS retrieval_tcga_contrib, round(p, 6) AS retrieval_tcga_p, CAST(anticor AS INT) AS retrieval_tcga_anticorr_flag FROM top"))
def cohort_table(spark, sf_dir):
    """The batch over evidence whose cohorts are rows of a table of their own: the same pairs and scores as from columns."""
    folder = shared_folder(spark, "cohorts")
    write_cohorts(evidence(spark, sf_dir), folder, collapse=True)
    rows, cohorts = read_cohorts(spark, folder)
    out = R.retrieve(rows, batch(spark), max_k=MAX_K, cohorts=cohorts)
    return out.select("query_id", "rank", "mirna_name", "gene_symbol", *(F.round(c, 6).alias(c) for c in ("retrieval_score", "retrieval_tcga_contrib", "retrieval_tcga_p")), "retrieval_tcga_anticorr_flag")


@query(_batch_sql("SELECT query_id, CAST(rank AS INT) AS rank, mirna_name, gene_symbol, matched_query_tokens FROM top JOIN names USING (query_id) WHERE query_id IN ('8', '14')"))
def empty_shortlist(spark, sf_dir):
    """A name that the table doesn't have and a k of 0: no row, the full schema."""
    out = R.retrieve(evidence(spark, sf_dir), batch(spark).where("query_id IN ('8', '14')"), max_k=MAX_K)
    return out.select("query_id", "rank", "mirna_name", "gene_symbol", "matched_query_tokens")


# Specifications

_N = "CAST(c_custkey % {0} AS VARCHAR(10))"
_RESPONSE = (
    "CASE c_custkey % 6 WHEN 0 THEN concat('```json\n', '{\"mirna\":\"miR-', " + _N.format(40) + ", '\",\"k\":', " + _N.format(60) + ", ',\"novel\":true,\"cancer\":{\"name\":null,\"tcga\":\"brca\"},\"filters\":{\"min_support\":2}}', '\n```') "
    "WHEN 1 THEN concat('Here it is: {\"gene\":\"GENE', " + _N.format(50) + ", '\",\"mode\":\"gene_to_mirnas\",\"k\":\"7\",\"cancer\":null} as asked') "
    "WHEN 2 THEN '{\"mirna\":\"let-7\",\"k\":\"7.9\",\"mode\":\"other\",\"pathway_keywords\":[\"emt\"],\"pathway_filter\":{\"enabled\":true,\"mode\":\"filter\",\"min_gene_sets\":3}}' "
    "WHEN 3 THEN 'no json here' WHEN 4 THEN '{\"mirna\":\"miR-20\",\"filters\":null,\"pathway_filter\":null,\"k\":null}' "
    "ELSE '{\"mirna\":\"\",\"gene\":null,\"query_token\":\"hsa-miR-36-3p\",\"tcga\":\"coad\",\"k\":7.9}' END"
)
_SPEC_SQL = f"""WITH r AS (SELECT c_custkey, {_RESPONSE} AS response FROM customer),
j AS (SELECT c_custkey, TRY_CAST(regexp_extract(response, '(?s)(\\{{.*\\}})', 1) AS JSON) AS v FROM r WHERE response LIKE '%{{%}}%'),
s AS (SELECT CAST(c_custkey AS VARCHAR) AS query_id, coalesce(nullif(v->>'$.mirna', ''), nullif(v->>'$.gene', ''), nullif(v->>'$.query_token', '')) AS token,
upper(CASE WHEN json_type(v, '$.cancer') = 'OBJECT' THEN v->>'$.cancer.tcga' ELSE v->>'$.tcga' END) AS cohort, CASE WHEN v->>'$.mode' IN ('mirna_to_targets', 'gene_to_mirnas') THEN v->>'$.mode' ELSE 'mirna_to_targets' END AS mode,
CAST(CASE WHEN json_type(v, '$.k') = 'VARCHAR' THEN CASE WHEN regexp_full_match(v->>'$.k', '[+-]?[0-9]+') THEN CAST(v->>'$.k' AS INT) ELSE 50 END WHEN (v->>'$.k') IS NULL THEN 50 ELSE trunc(CAST(v->>'$.k' AS DOUBLE)) END AS INT) AS k,
coalesce(CAST(v->>'$.novel' AS BOOLEAN), FALSE) AS novel, coalesce(CAST(v->>'$.filters.min_support' AS INT), 1) AS min_support, coalesce(CAST(v->>'$.pathway_filter.enabled' AS BOOLEAN), FALSE) AS pathway_enabled,
coalesce(v->>'$.pathway_filter.mode', 'boost') AS pathway_mode, coalesce(CAST(v->>'$.pathway_filter.min_gene_sets' AS INT), 1) AS min_gene_sets, (v->>'$.pathway_keywords[0]') IS NOT NULL AS has_keywords FROM j)"""
_SPEC_COLS = ["query_id", "token", "cohort", "k", "novel", "min_support", "pathway_enabled", "pathway_mode", "min_gene_sets", "has_keywords"]


def _specs(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS query_id", "concat('question ', c_custkey) AS question", f"{_RESPONSE} AS response")
    return S.split_rejects(S.normalise_specs(rows))


@query(_SPEC_SQL + " SELECT mode, " + ", ".join(_SPEC_COLS) + " FROM s")
def spec_normalise(spark, sf_dir):
    return S.to_queries(_specs(spark, sf_dir)[0], "mode").select("mode", *_SPEC_COLS)


_REQUESTS = "SELECT CAST(c_custkey AS {0}) AS query_id, concat('question ', c_custkey) AS question, c_custkey % 2 = 0 AS novel, CAST(c_custkey % 7 AS INT) AS k, CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 3 END AS INT) AS min_support, CASE c_custkey % 3 WHEN 0 THEN ' Filter' WHEN 1 THEN 'other' ELSE NULL END AS pathway_mode"


@query(_SPEC_SQL + f", q AS ({_REQUESTS.format('VARCHAR')} FROM customer) SELECT query_id, q.k, q.novel, coalesce(q.min_support, 1) AS min_support, s.pathway_enabled OR q.pathway_mode IS NOT DISTINCT FROM ' Filter' AS pathway_enabled, CASE WHEN q.pathway_mode = ' Filter' THEN 'filter' ELSE s.pathway_mode END AS pathway_mode FROM s JOIN q USING (query_id)")
def spec_overrides(spark, sf_dir):
    req = _customers(spark, sf_dir, _REQUESTS.format("STRING") + " FROM customer")
    return S.to_queries(S.apply_overrides(_specs(spark, sf_dir)[0], req)).select("query_id", "k", "novel", "min_support", "pathway_enabled", "pathway_mode")


@query("SELECT CAST(c_custkey AS VARCHAR) AS query_id, 'response holds no JSON object' AS error FROM customer WHERE c_custkey % 6 = 3")
def spec_rejects(spark, sf_dir):
    return _specs(spark, sf_dir)[1]


# Cards, prompts, answers, jobs

_EVIDENCE_LINE = """concat_ws('; ', 'support_count=' || support_count, 'miRTarBase(functional=' || mirtarbase_pos || ')',
CASE WHEN support_encori = 1 THEN 'ENCORI(CLIP_sum=' || format('{:g}', coalesce(clip_exp_sum, 0)) || ', sites=' || coalesce(n_clip_sites, 0) || ')' END,
CASE WHEN support_targetscan = 1 THEN 'TargetScan(best_context++=' || format('{:.3f}', ts_best_contextpp) || ', sites=' || ts_n_sites || ')' END,
CASE WHEN support_mirdb = 1 THEN 'miRDB(best=' || format('{:g}', mirdb_best_score) || ')' END,
CASE WHEN cohort IS NOT NULL THEN 'TCGA(' || cohort || ' ' || concat_ws(', ', 'anti_corr=' || anticor, 'rho=' || format('{:.3f}', CASE cohort WHEN 'BRCA' THEN brho ELSE crho END), 'p=' || format('{:.2g}', p), CASE WHEN rep = 1 THEN 'repression_flag=1' END) || ')' END)"""


def _cards(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).join(batch(spark).select("query_id", "cohort"), "query_id")
    return make_cards(ranked, F.col("cohort"))


@query(_batch_sql(f"SELECT query_id, CAST(rank AS INT) AS rank, gene_symbol || ' (← ' || mirna_name || ')' AS name, {_EVIDENCE_LINE} AS evidence FROM top"))
def cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("query_id", "rank", "name", "evidence")


_TASKS = "CASE WHEN base IS NULL THEN 'Rank the microRNAs that regulate the gene.' ELSE 'Rank the genes that the microRNA regulates.' END"
_TOLD = P.INSTRUCTIONS.replace("{items}", "' || CASE WHEN base IS NULL THEN 'microRNAs' ELSE 'genes' END || '")


@query(_batch_sql(f"""SELECT query_id, md5('Task: ' || {_TASKS} || chr(10) || '{_TOLD}' || chr(10) || chr(10) || 'Question:' || chr(10) || 'What about ' || any_value(q.token) || '?' || chr(10) || chr(10) || 'Context:' || chr(10) ||
CASE WHEN any_value(q.cohort) IS NULL AND NOT any_value(q.novel) THEN '- nothing given' ELSE concat_ws(chr(10), '- Cancer: ' || any_value(q.cohort), CASE WHEN any_value(q.novel) THEN '- Only pairs without a validated record' END) END ||
chr(10) || chr(10) || 'Cards:' || chr(10) || chr(10) || coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank), '')) AS prompt_md5
FROM q LEFT JOIN (SELECT query_id, rank, 'Candidate: ' || gene_symbol || ' (← ' || mirna_name || ')' || chr(10) || 'Evidence: ' || {_EVIDENCE_LINE} AS block FROM top) b USING (query_id) GROUP BY query_id, base"""))
def prompt_assembly(spark, sf_dir):
    q = batch(spark).withColumn("token", C.strip(F.col("token")))
    specs = q.select("query_id", "novel", "cohort", ids.direction(F.col("token")).alias("mode"), F.concat(F.lit("What about "), "token", F.lit("?")).alias("original_question"))
    return P.prompts(specs, cards=_cards(spark, sf_dir)).select("query_id", F.md5("user_prompt").alias("prompt_md5"))


_ANSWER = "CASE o_orderkey % 9 WHEN 0 THEN '\"plain text\"' WHEN 1 THEN '{\"summary\":\"the summary\"}' WHEN 2 THEN '{\"summary\":\" \",\"raw_text\":\"raw\"}' WHEN 3 THEN '{\"raw_text\":{\"summary\":\"inner\"}}' WHEN 4 THEN '{\"raw_text\":{\"raw_text\":\"deep\"}}' WHEN 5 THEN '{\"raw_text\":{\"raw_text\":{\"summary\":\"deeper\"}}}' WHEN 6 THEN '{\"raw_text\":{\"raw_text\":{\"raw_text\":\"deepest\"}}}' WHEN 7 THEN '{\"summary\":5}' ELSE 'not json' END"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS query_id, CASE o_orderkey % 9 WHEN 0 THEN 'plain text' WHEN 1 THEN 'the summary' WHEN 2 THEN 'raw' WHEN 3 THEN 'inner' WHEN 4 THEN 'deep' WHEN 5 THEN 'deeper' WHEN 6 THEN 'deepest' END AS summary FROM orders")
def answer_extract(spark, sf_dir):
    return A.extract_summaries(_table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS query_id", f"{_ANSWER} AS answer"))


@query("""WITH log AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders), last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM log GROUP BY o_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS query_id, coalesce(s, 'unknown') AS status FROM customer LEFT JOIN last ON c_custkey = o_custkey""")
def latest_status(spark, sf_dir):
    log = _table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS query_id", "o_orderstatus AS status", "o_orderkey AS seq")
    return J.latest_status(log, _table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS query_id"))


@query(_batch_sql("SELECT query_id, count(*) AS n, string_agg(mirna_name || ':' || gene_symbol, ',' ORDER BY rank) AS pairs FROM top GROUP BY query_id"))
def nest_shortlist(spark, sf_dir):
    n = J.nest_shortlist(_ranked(spark, sf_dir))
    return n.select("query_id", F.size("shortlist").cast("long").alias("n"), F.array_join(F.transform("shortlist", lambda x: F.concat_ws(":", x["mirna_name"], x["gene_symbol"])), ",").alias("pairs"))


@query(_batch_sql("SELECT query_id, CAST(rank AS INT) AS rank, mirna_name, gene_symbol, round(score, 6) AS retrieval_score FROM top"))
def unnest_shortlist(spark, sf_dir):
    stored = J.shortlist_json(J.nest_shortlist(_ranked(spark, sf_dir)))
    rows = J.shortlist_from_json(stored, "array<struct<rank:int,mirna_name:string,gene_symbol:string,retrieval_score:double>>")
    return rows.select("query_id", "rank", "mirna_name", "gene_symbol", F.round("retrieval_score", 6).alias("retrieval_score"))


@query(_batch_sql("SELECT query_id, 'done' AS status, count(rank) AS n, coalesce(min(CASE WHEN rank = 1 THEN gene_symbol END), '') AS first_gene FROM q LEFT JOIN top USING (query_id) GROUP BY query_id"))
def result_json(spark, sf_dir):
    docs = J.result_documents(batch(spark), J.nest_shortlist(_ranked(spark, sf_dir)))
    v = docs.select("query_id", F.parse_json("document").alias("v"))
    n = F.size(F.try_variant_get("v", "$.shortlist", "array<variant>")).cast("long")
    return v.select("query_id", F.try_variant_get("v", "$.status", "string").alias("status"), n.alias("n"), F.coalesce(F.try_variant_get("v", "$.shortlist[0].gene_symbol", "string"), F.lit("")).alias("first_gene"))


_STREAMED = "SELECT CAST(c_custkey AS {0}) AS query_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE concat('miR-', c_custkey % 40) END AS question, CAST(CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_custkey % 5 END AS INT) AS k FROM customer"


def _customers(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    _table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(sql)


_STREAM_SQL = f"""WITH {EV}, h AS (SELECT regexp_extract(lower(mirna_name), '^(?:hsa-)?mir-([0-9]+)', 1) AS n, CASE WHEN mirna_name LIKE '%-5p' THEN 0 WHEN mirna_name LIKE '%-3p' THEN 2 ELSE 1 END AS tier, mirna_name, gene_symbol
FROM ev WHERE mirtarbase_pos = 0 AND support_count >= 1 AND lower(mirna_name) LIKE '%mir-%'),
b AS (SELECT n, min(tier) AS tier FROM h GROUP BY n), c AS (SELECT n, count(DISTINCT mirna_name || ' ' || gene_symbol) AS pairs FROM h JOIN b USING (n, tier) WHERE gene_symbol IS NOT NULL GROUP BY n),
r AS ({_STREAMED.format('VARCHAR')})
SELECT r.query_id, CASE WHEN question = ' ' OR k < 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN question = ' ' OR k < 0 THEN 0 ELSE least(k, coalesce(pairs, 0)) END AS n_pairs,
CASE WHEN question = ' ' THEN 'question is empty' WHEN k < 0 THEN 'k is negative' END AS error FROM r LEFT JOIN c ON r.question = 'miR-' || c.n"""


def _answered(spark, sf_dir, times):
    """Requests of all customers, sent so many times, answered in micro-batches and read back with their status."""
    root = shared_folder(spark, "requests")
    ev = prepare(evidence(spark, sf_dir))
    pairs = R.shared_pairs(ev)

    def answer(batch: DataFrame) -> DataFrame:
        return R.retrieve_shared(ev, batch.withColumn("token", F.col("question")), max_k=200, pairs=pairs).select("query_id", "rank", "mirna_name", "gene_symbol")

    for _ in range(times):
        _customers(spark, sf_dir, _STREAMED.format("STRING")).write.mode("append").json(f"{root}/in")
        Q.serve(Q.read_requests(spark, f"{root}/in"), answer, f"{root}/out", f"{root}/log", f"{root}/state").awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    status = J.latest_status(log, spark.read.schema("query_id string").json(f"{root}/in"))
    errors = log.where("error IS NOT NULL").groupBy("query_id").agg(F.max("error").alias("error"))
    found = spark.read.parquet(f"{root}/out").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return status.join(found, "query_id", "left").join(errors, "query_id", "left").select("query_id", "status", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "error")


@query(_STREAM_SQL)
def stream_requests(spark, sf_dir):
    """A request for every customer, streamed from files, answered in micro-batches and read back with its status."""
    return _answered(spark, sf_dir, 1)


@query(_STREAM_SQL)
def stream_resent(spark, sf_dir):
    """The same requests sent again later, in other files, are answered once."""
    return _answered(spark, sf_dir, 2)


# The whole chain, and parts that only show in it


def _chain(spark, sf_dir):
    rows = _customers(spark, sf_dir, f"{_REQUESTS.format('STRING')}, {_RESPONSE} AS response FROM customer")
    outputs = rows.where("CAST(query_id AS INT) % 2 = 0").select("query_id", F.concat(F.lit("answer to "), "question").alias("text"))
    return job_documents(prepare(evidence(spark, sf_dir)), rows.drop("response"), rows.select("query_id", "response"), outputs, max_k=10)


_CHAIN_SQL = _SPEC_SQL + f""", {EV}, rq AS ({_REQUESTS.format('VARCHAR')} FROM customer),
job AS (SELECT query_id, s.token, rq.k, rq.novel, coalesce(rq.min_support, 1) AS ms, s.has_keywords AND (s.pathway_mode = 'filter' OR rq.pathway_mode IS NOT DISTINCT FROM ' Filter') AS filt, s.min_gene_sets AS least FROM s JOIN rq USING (query_id)),
ask AS (SELECT DISTINCT token, novel, ms, filt, least FROM job),
hit AS (SELECT a.*, ev.mirna_name, ev.gene_symbol, ev.gene_pathway_hits AS hits, CASE WHEN token NOT LIKE '%miR%' THEN 0 WHEN token LIKE '%-3p' THEN CASE lower(mirna_name) WHEN lower(token) THEN 0 WHEN replace(lower(token), '-3p', '') THEN 1 END
    ELSE CASE lower(replace(mirna_name, 'hsa-', '')) WHEN lower(token) || '-5p' THEN 0 WHEN lower(token) THEN 1 WHEN lower(token) || '-3p' THEN 2 END END AS tier
    FROM ask a JOIN ev ON (CASE WHEN token LIKE '%miR%' THEN lower(replace(mirna_name, 'hsa-', '')) LIKE replace(replace(lower(token), 'hsa-', ''), '-3p', '') || '%' ELSE gene_symbol = token END)
    AND (NOT a.novel OR mirtarbase_pos = 0) AND (a.ms <= 0 OR support_count >= a.ms)),
best AS (SELECT token, novel, ms, filt, least, min(tier) AS tier FROM hit WHERE tier IS NOT NULL GROUP BY ALL),
pair AS (SELECT token, novel, ms, filt, least, mirna_name, gene_symbol FROM hit JOIN best USING (token, novel, ms, filt, least, tier) WHERE gene_symbol IS NOT NULL GROUP BY ALL HAVING NOT filt OR max(hits) >= least),
n AS (SELECT token, novel, ms, filt, least, count(*) AS n FROM pair GROUP BY ALL)"""


_JOBS_SQL = (
    _CHAIN_SQL + """ SELECT query_id, 'done' AS status, CAST(least(job.k, coalesce(n.n, 0)) AS BIGINT) AS n_pairs, TRUE AS has_prompt, CASE WHEN CAST(query_id AS INT) % 2 = 0 THEN 'answer to question ' || query_id END AS summary, CAST(NULL AS VARCHAR) AS error
FROM job LEFT JOIN n USING (token, novel, ms, filt, least) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'error', NULL, FALSE, NULL, 'response holds no JSON object' FROM customer WHERE c_custkey % 6 = 3"""
)


def _told(docs: DataFrame) -> DataFrame:
    """What stored documents say."""
    v = docs.select("query_id", F.parse_json("document").alias("v"))
    text = lambda p: F.try_variant_get("v", p, "string")
    return v.select("query_id", text("$.status").alias("status"), F.when(text("$.status") == "done", F.size(F.try_variant_get("v", "$.shortlist", "array<variant>"))).cast("long").alias("n_pairs"), text("$.bundle.user_prompt").isNotNull().alias("has_prompt"), text("$.answer.summary").alias("summary"), text("$.error").alias("error"))


@query(_JOBS_SQL)
def job_chain(spark, sf_dir):
    """Requests and planner replies of all customers to stored documents, read back from the sink."""
    path = shared_folder(spark, "documents")
    J.write_documents(_chain(spark, sf_dir), path)
    return _told(spark.read.schema("query_id string, document string").json(path))


@query(_JOBS_SQL)
def stream_jobs(spark, sf_dir):
    """The same through the request stream, whose documents are kept by id."""
    root = shared_folder(spark, "jobs")
    rows = _customers(spark, sf_dir, f"{_REQUESTS.format('STRING')}, {_RESPONSE} AS response FROM customer")
    outputs = rows.where("CAST(query_id AS INT) % 2 = 0").select("query_id", F.concat(F.lit("answer to "), "question").alias("text"))
    rows.drop("response").write.json(f"{root}/in")
    stream = Q.read_requests(spark, f"{root}/in")
    Q.serve_jobs(stream, prepare(evidence(spark, sf_dir)), rows.select("query_id", "response"), f"{root}/documents", f"{root}/log", f"{root}/state", outputs).awaitTermination()
    return _told(J.read_documents(spark, f"{root}/documents"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS query_id, CASE WHEN c_custkey % 10 = 3 THEN 'second' ELSE 'first' END AS document FROM customer UNION ALL SELECT 'new', 'second'")
def rewrite_documents(spark, sf_dir):
    """A tenth of the customers' documents and a new one put a second time: the others stay."""
    path = shared_folder(spark, "documents")
    ids = _customers(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS query_id, c_custkey FROM customer")
    J.put_documents(ids.select("query_id", F.lit("first").alias("document")), path)
    again = ids.where("c_custkey % 10 = 3").select("query_id").unionByName(spark.sql("SELECT 'new' AS query_id"))
    J.put_documents(again.select("query_id", F.lit("second").alias("document")), path)
    return J.read_documents(spark, path)


@query(ORACLES["latest_status"])
def status_snapshot(spark, sf_dir):
    """Orders as a log of ten batches: two snapshots on the way, the look-up reads the second and the batches since."""
    root = shared_folder(spark, "status")
    log = _table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS query_id", "o_orderstatus AS status", "CAST(o_orderkey AS LONG) AS seq", "CAST(NULL AS STRING) AS error", "CAST(NULL AS STRING) AS traceback")
    top = log.agg(F.max("seq")).first()[0]
    log = log.withColumns({"batch_id": F.floor(F.col("seq") * 10 / (top + 1)).cast("long"), "part": F.lit("end")})
    for some in ("batch_id < 4", "batch_id IN (4, 5, 6)", "batch_id > 6"):
        if some != "batch_id < 4":
            J.compact_status(spark, f"{root}/log", f"{root}/snapshot")
        log.where(some).write.mode("append").partitionBy("batch_id", "part").parquet(f"{root}/log")
    return J.status_of(spark, f"{root}/log", f"{root}/snapshot", _table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS query_id"))


@query("""SELECT substr(sha256('{"question":"question ' || c_custkey || '","novel":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"k":' || c_custkey % 7 || ',"min_support":' || CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 3 END ||
',"require_binding_evidence":false,"require_expression":false,"pathway_mode":"' || CASE c_custkey % 3 WHEN 0 THEN ' Filter' WHEN 1 THEN 'other' ELSE 'auto' END || '"}'), 1, 16) AS query_id, 'question ' || c_custkey AS question FROM customer""")
def request_ids(spark, sf_dir):
    rows = _customers(spark, sf_dir, _REQUESTS.format("STRING") + " FROM customer").drop("query_id")
    return S.request_defaults(rows).select("query_id", "question")


@query("SELECT CAST(c_custkey AS VARCHAR) AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'question is empty' WHEN c_custkey % 3 = 1 THEN 'no mirna, gene or query_token' END AS error FROM customer WHERE c_custkey % 3 < 2")
def empty_questions(spark, sf_dir):
    rows = _customers(spark, sf_dir, """SELECT CAST(c_custkey AS STRING) AS query_id, CASE WHEN c_custkey % 3 = 0 THEN ' \t' ELSE 'q' END AS question, CASE WHEN c_custkey % 3 = 1 THEN '{"mirna":""}' ELSE '{"gene":"A"}' END AS response FROM customer""")
    return S.split_rejects(S.normalise_specs(rows))[1]


@query(f"""WITH t AS (SELECT l_suppkey % 50 AS s, {_TISSUES} AS tissues, l_linenumber % 2 AS encori, {_ROW} FROM lineitem), g AS (SELECT s, max(encori) AS encori FROM t GROUP BY s),
r AS (SELECT s, tissues, row_number() OVER (PARTITION BY s ORDER BY (tissues IS NULL), {_ROW}) AS n FROM t)
SELECT 'G' || s AS name, 'support_count=' || encori || '; ENCORI(CLIP_sum=0, sites=0)' AS evidence, 'ENCORI tissues: ' || replace(nullif(tissues, ''), '|', ', ') AS notes FROM r JOIN g USING (s) WHERE n = 1""")
def card_notes(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr("concat('G', l_suppkey % 50) AS gene_symbol", f"{_TISSUES} AS text", "CAST(l_linenumber % 2 AS INT) AS encori", *_ROW.split(", "))
    df = numbered(df, *_ROW.split(", ")).select("gene_symbol", "text", "encori", "row_ord")
    df = df.withColumn("tissues", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", r"\|")))
    one = df.groupBy("gene_symbol").agg(F.max("encori").alias("support_encori"), F.max("encori").alias("support_count")).join(first_values(df, ["gene_symbol"], ["tissues"]), "gene_symbol")
    one = one.select("*", F.col("tissues").alias("cellline_tissue_set"), F.lit(None).cast("string").alias("mirna_name"))
    return make_cards(one).select("name", "evidence", "notes")


@query(f"SELECT query_id, '{P.SYSTEM}' AS system_prompt, novel, cohort, CAST(count(gene_symbol) AS BIGINT) AS n_cards FROM ({_batch_sql('SELECT q.query_id, q.novel, q.cohort, top.gene_symbol FROM q LEFT JOIN top USING (query_id)')}) GROUP BY ALL")
def bundle_meta(spark, sf_dir):
    """Prompts from a shortlist by a builder of one's own, with the specification in the bundle."""
    builder = lambda short: short.select("query_id", "rank", F.col("gene_symbol").alias("name"), F.lit("e").alias("evidence"), F.lit(None).cast("string").alias("notes"))
    out = P.prompts(batch(spark).select("query_id", "novel", "cohort"), shortlist=_ranked(spark, sf_dir), card_builder=builder)
    return out.select("query_id", "system_prompt", "meta.novel", "meta.cohort", F.regexp_count("user_prompt", F.lit("Candidate: ")).cast("long").alias("n_cards"))


@query(_COLLAPSED_SQL + """ SELECT mirna_name, gene_symbol, round(support_count + 0.7 * coalesce(mirdb_best_score, 0) / 100.0, 6) AS retrieval_score FROM pair""")
def absent_columns(spark, sf_dir):
    """A table with few of the optional columns: absent parts count nothing, whatever the cohort."""
    df = evidence(spark, sf_dir).select("mirna_name", "gene_symbol", "support_count", "mirdb_best_score")
    return with_scores(collapse_pairs(df), "BRCA", F.lit(True)).select("mirna_name", "gene_symbol", F.round("retrieval_score", 6).alias("retrieval_score"))
