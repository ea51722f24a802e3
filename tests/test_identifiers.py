from pyspark.sql import functions as F

from pairlight.functions import identifiers as ids

VECTORS = [
    ("miR-21", "mir-21", None, True), (" hsa-miR-21-5p ", "mir-21", "5p", True), ("HSA_MIR_21_3P", "mir-21", "3p", True), ("mir21", "mir-21", None, True),
    ("let7a", "let-7a", None, False), ("let-7a", "let-7a", None, False), ("mmu-miR-155", "mir-155", None, True), ("miR - 17", "mir-17", None, True), ("5p", "", "5p", False),
    ("", "", None, False), ("mir--21-", "mir-21", None, True), ("TP53", "tp53", None, False), ("MIR21HG", "mir-21hg", None, True), ("hsa_let_7a", "let-7a", None, False),
]


def test_vectors(spark):
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "t string")
    got = df.select("t", ids.base_name(F.col("t")).alias("b"), ids.arm(F.col("t")).alias("a"), ids.direction(F.col("t")).alias("d")).collect()
    assert [(r.t, r.b, r.a, r.d == "mirna_to_targets") for r in got] == VECTORS


def test_candidates(spark):
    df = spark.createDataFrame([("miR-7",), ("miR-7-3p",), ("5p",)], "t string")
    free, given, none = (r.c for r in df.select(ids.candidate_names(F.col("t")).alias("c")).collect())
    assert [(x.tier, x.name) for x in free] == [(0, "hsa-mir-7-5p"), (0, "mir-7-5p"), (1, "hsa-mir-7"), (1, "mir-7"), (2, "hsa-mir-7-3p"), (2, "mir-7-3p")]
    assert [(x.tier, x.name) for x in given] == [(0, "hsa-mir-7-3p"), (0, "mir-7-3p"), (1, "hsa-mir-7"), (1, "mir-7")]
    assert none == []
