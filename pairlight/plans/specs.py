"""Query specifications: planner responses and requests to query rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.columns import strip

MODES = ("mirna_to_targets", "gene_to_mirnas")
REQUEST_SCHEMA = "query_id string, question string, novel boolean, k int, min_support int, require_binding_evidence boolean, require_expression boolean, pathway_mode string"
#: What a request has where it says nothing.
REQUEST_DEFAULTS = {"novel": True, "k": 200, "min_support": 1, "require_binding_evidence": False, "require_expression": False, "pathway_mode": "auto"}


def request_defaults(requests: DataFrame) -> DataFrame:
    """Requests with all fields; an id is made from the content where there is none, so a replay gets the same."""
    cols = {n: F.coalesce(F.col(n), F.lit(v)) if n in requests.columns else F.lit(v) for n, v in REQUEST_DEFAULTS.items()}
    out = requests.withColumns(cols)
    made = F.substring(F.sha2(F.to_json(F.struct("question", *cols)), 256), 1, 16)
    given = F.col("query_id") if "query_id" in requests.columns else F.lit(None).cast("string")
    return out.withColumn("query_id", F.coalesce(given, made))


def json_part(text: Column) -> Column:
    """What may be the JSON object in a model's reply: without a fence's first line, from the first { to the last }."""
    s = F.regexp_replace(strip(text), r"^```[^\n]*(\n|$)", "")
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


#: Fields of a reply.
FIELDS = ("mirna", "gene", "query_token", "mode", "tcga", "cancer", "phenotype_keywords", "pathway_keywords", "pathway_filter", "novel", "k", "filters", "needs_clarification")


def _fields(json: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """These fields of a JSON object.  As string, numbers, objects and lists come as their JSON text; as double, only numbers come."""
    return F.from_json(json, ", ".join(f"{n} {kind}" for n in names) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})


def _text(s: Column) -> Column:
    """A scalar as text; objects and arrays, and text that begins like one, are null."""
    return F.when(~s.rlike(r"^[\[{]"), s)


def _int(s: Column, number: Column, default: int) -> Column:
    """Numbers are cut towards zero, truth values are 0 or 1; text has to be a plain integer; anything else is the default."""
    plain = F.when(s.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(s).try_cast("int"))
    return F.coalesce(number.try_cast("int"), plain, F.when(s == "true", 1).when(s == "false", 0), F.lit(default))


def _bool(s: Column, default: bool = False) -> Column:
    """A truth value, text that says one ('true', 'false') or a number; anything else is the default.  So 'false' as text is false, not true for being text."""
    return F.coalesce(s.try_cast("boolean"), s.try_cast("double") != 0, F.lit(default))


def _words(s: Column) -> Column:
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def normalise_specs(responses: DataFrame) -> DataFrame:
    """(query_id, question, response) to typed specifications; ``error`` says why a row is none.

    The cohort is cancer.tcga where cancer is an object, else the top-level tcga
    of older replies.  A null object counts as absent.  Nothing is dropped: see
    ``split_rejects``.
    """
    part = responses.select("query_id", strip(F.coalesce("question", F.lit(""))).alias("original_question"), json_part(F.col("response")).alias("j"))
    part = part.select("query_id", "original_question", _fields(F.col("j"), FIELDS).alias("p"), _fields(F.col("j"), ("k",), "double").alias("pn"))
    inner = {
        "cancer": ("name", "tcga"),
        "pathway_filter": ("enabled", "mode", "min_gene_sets"),
        "filters": ("min_support", "require_binding_evidence", "require_expression"),
    }
    part = part.select("*", *(_fields(F.col(f"p.{f}"), names).alias(f"i_{f}") for f, names in inner.items()), _fields(F.col("p.pathway_filter"), ("min_gene_sets",), "double").alias("n_pathway"), _fields(F.col("p.filters"), ("min_support",), "double").alias("n_filters"))
    at = lambda f, n: F.col(f"i_{f}.{n}")
    part = part.select(
        "query_id",
        "original_question",
        (F.col("p").isNull() | F.col("p._bad").isNotNull()).alias("broken"),
        *(_text(F.col(f"p.{f}")).alias(f) for f in ("mirna", "gene", "query_token", "mode")),
        _text(F.col("p.tcga")).alias("top_tcga"),
        F.coalesce(F.col("p.cancer").startswith("{"), F.lit(False)).alias("nested"),
        F.struct(_text(at("cancer", "name")).alias("name"), _text(at("cancer", "tcga")).alias("tcga")).alias("cancer"),
        *(_words(F.col(f"p.{f}")).alias(f) for f in ("phenotype_keywords", "pathway_keywords", "needs_clarification")),
        F.struct(_bool(at("pathway_filter", "enabled")).alias("enabled"), F.coalesce(_text(at("pathway_filter", "mode")), F.lit("boost")).alias("mode"), _int(at("pathway_filter", "min_gene_sets"), F.col("n_pathway.min_gene_sets"), 1).alias("min_gene_sets")).alias("pathway_filter"),
        _bool(F.col("p.novel")).alias("novel"),
        _int(F.col("p.k"), F.col("pn.k"), 50).alias("k"),
        F.struct(_int(at("filters", "min_support"), F.col("n_filters.min_support"), 1).alias("min_support"), *(_bool(at("filters", n)).alias(n) for n in ("require_binding_evidence", "require_expression"))).alias("filters"),
    )
    token = F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in ("mirna", "gene", "query_token")))
    error = F.when(F.col("original_question") == "", "question is empty").when(F.col("broken"), "response holds no JSON object").when(token.isNull(), "no mirna, gene or query_token").when(F.col("k") < 0, "k is negative")
    cohort = F.upper(F.nullif(F.when(F.col("nested"), F.col("cancer.tcga")).otherwise(F.col("top_tcga")), F.lit("")))
    return part.select(
        "query_id", "original_question", F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(F.lit(MODES[0])).alias("mode"), "mirna", "gene", token.alias("token"),
        "cancer", cohort.alias("cohort"), "phenotype_keywords", "pathway_keywords", "pathway_filter", "novel", "k", "filters", "needs_clarification", error.alias("error"),
    )


def split_rejects(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable specifications, and (query_id, error) of the others."""
    return specs.where("error IS NULL").drop("error"), specs.where("error IS NOT NULL").select("query_id", "error")


def pathway_mode(c: Column) -> Column:
    m = F.lower(strip(F.coalesce(c, F.lit("auto"))))
    return F.when(m.isin("boost", "filter"), m).otherwise(F.lit("auto"))


def apply_overrides(specs: DataFrame, requests: DataFrame) -> DataFrame:
    """A request's k, support, novelty and gates replace the planner's; a pathway mode of boost or filter also turns that on."""
    r = request_defaults(requests).select("query_id", *(F.col(n).alias(f"r_{n}") for n in REQUEST_DEFAULTS))
    mode = pathway_mode(F.col("r_pathway_mode"))
    chosen = mode != "auto"
    pf = F.col("pathway_filter")
    out = specs.join(r, "query_id").withColumns({
        "k": F.col("r_k"),
        "novel": F.col("r_novel"),
        "filters": F.struct(F.col("r_min_support").alias("min_support"), F.col("r_require_binding_evidence").alias("require_binding_evidence"), F.col("r_require_expression").alias("require_expression")),
        "pathway_filter": F.struct((pf["enabled"] | chosen).alias("enabled"), F.when(chosen, mode).otherwise(pf["mode"]).alias("mode"), pf["min_gene_sets"].alias("min_gene_sets")),
    })
    return out.select(*specs.columns)


def to_queries(specs: DataFrame, *keep: str) -> DataFrame:
    """Specifications as the query rows that retrieval takes, with further columns to keep."""
    return specs.select(
        *keep,
        "query_id", "token", "cohort", "novel",
        F.col("filters.min_support").alias("min_support"), F.col("filters.require_binding_evidence").alias("require_binding_evidence"), F.col("filters.require_expression").alias("require_expression"),
        "k", F.col("pathway_filter.enabled").alias("pathway_enabled"), F.col("pathway_filter.mode").alias("pathway_mode"), F.col("pathway_filter.min_gene_sets").alias("min_gene_sets"),
        ((F.size("phenotype_keywords") > 0) | (F.size("pathway_keywords") > 0)).alias("has_keywords"),
    )
