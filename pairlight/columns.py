"""Coercions of evidence columns: flags, numbers and lists, with NaN and null as one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number; Spark alone would also take '1d'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def require(df: DataFrame, names: list[str]) -> None:
    """Raise if required columns are missing; the message names up to 25 of them."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"evidence lacks the columns {missing[:25]}")


def number(df: DataFrame, name: str) -> Column | None:
    """A column as double with NaN as null; None if the table has no such column."""
    if name not in df.columns:
        return None
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return c.try_cast("double")


def flag(df: DataFrame, name: str) -> Column:
    """0/1 as int; an absent column or a null is 0."""
    c = number(df, name)
    return F.lit(0) if c is None else F.coalesce(c.try_cast("int"), F.lit(0))


def real(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """Double; absent, null, NaN and unreadable give the default."""
    c, d = number(df, name), F.lit(default).cast("double")
    return d if c is None else F.coalesce(c, d)


def whole(df: DataFrame, name: str, default: int = 0) -> Column:
    """Long, cut towards zero; absent, null, unreadable and infinite give the default."""
    c = number(df, name)
    return F.lit(default).cast("long") if c is None else F.coalesce(c.try_cast("long"), F.lit(default).cast("long"))


def card_whole(df: DataFrame, name: str, default: int = 0) -> Column:
    """As ``whole``, but text has to be a plain integer, so '1.5' gives the default."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
        c = F.col(f"`{name}`")
        return F.coalesce(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("long")), F.lit(default).cast("long"))
    return whole(df, name, default)


def text_list(df: DataFrame, name: str) -> Column:
    """A list of strings without nulls; a null is empty, a scalar is a list of one."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.filter(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def strip(c: Column) -> Column:
    """Without white space at both ends, in Unicode's sense; ``trim`` knows the blank only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
