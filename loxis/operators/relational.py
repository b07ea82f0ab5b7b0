"""Relational operators over sets of rows, for use without a query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds; NULL does not."""
    return df.where(condition)


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns; rows that become equal count once."""
    return df.select(*columns).distinct()


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """All columns of both sides where the pairs of columns are equal; the right side's clashing names get a suffix."""
    clash = set(left.columns) & set(right.columns)
    other = right.toDF(*(f"{c}_right" if c in clash else c for c in right.columns))
    cond = [left[a] == other[f"{b}_right" if b in clash else b] for a, b in on]
    return left.join(other, cond)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def aggregate(df: DataFrame, by: list[str], kind: str, column: str | None = None) -> DataFrame:
    """count, sum, min or max for each group, as agg_result."""
    value = F.col(column) if column else F.lit(1)
    made = {"count": F.count(F.lit(1)), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[kind]
    return df.groupBy(*by).agg(made.alias("agg_result"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def semi_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti")
