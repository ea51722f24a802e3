import math

import pytest
from pyspark.sql import functions as F

from pairlight import columns as C
from pairlight.sources.evidence import prepare


def test_number_coercions(spark):
    df = spark.createDataFrame([("1d",), (" 2.5 ",), ("abc",), (None,), ("-1.9",)], "x string")
    rows = df.select(C.real(df, "x", 9.0).alias("r"), C.whole(df, "x", 7).alias("w"), C.card_whole(df, "x", 5).alias("c"), C.real(df, "none", 3.0).alias("n")).collect()
    assert [r.r for r in rows] == [9.0, 2.5, 9.0, 9.0, -1.9]
    assert [r.w for r in rows] == [7, 2, 7, 7, -1]
    assert [r.c for r in rows] == [5, 5, 5, 5, 5]
    assert {r.n for r in rows} == {3.0}


def test_nan_is_null(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (1.7,), (math.inf,)], "x double")
    rows = df.select(C.flag(df, "x").alias("f"), C.whole(df, "x", 4).alias("w")).collect()
    assert [r.f for r in rows] == [0, 0, 1, 0]
    assert [r.w for r in rows] == [4, 4, 1, 4]


def test_lists_and_strip(spark):
    df = spark.createDataFrame([(["a", None, "b"], "s", "  x\t"), (None, None, "")], "l array<string>, s string, t string")
    rows = df.select(C.text_list(df, "l").alias("l"), C.text_list(df, "s").alias("s"), C.strip(F.col("t")).alias("t")).collect()
    assert rows[0].l == ["a", "b"] and rows[0].s == ["s"] and rows[0].t == "x"
    assert rows[1].l == [] and rows[1].s == [] and rows[1].t == ""


def test_required_columns(spark):
    with pytest.raises(ValueError, match="support_count"):
        prepare(spark.createDataFrame([("a", "b")], "mirna_name string, gene_symbol string"))
