"""Dated facts: one coherent row each, pairs of anchors, and the earliest event after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_row(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Per key the whole row with the least order (of equals, the least row): never independent minima."""
    row = F.struct(*(F.col(c) for c in columns))
    return df.groupBy(key).agg(F.min_by(row, F.struct(order, row)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def event_dates(dates: DataFrame, *facts: str) -> DataFrame:
    """d_gid, d_type, d_year, d_mon, d_day, d_julianday1: the lower bound of each record's dated fact."""
    rows = dates.where(F.col("d_fact").isin(*facts) & (F.col("d_year") != 0) & (F.col("d_julianday1") != 0))
    return earliest_row(rows, "d_gid", F.col("d_julianday1"), "d_type", "d_year", "d_mon", "d_day", "d_julianday1")


def extreme(dates: DataFrame, fact: str, column: str, largest: bool, name: str) -> DataFrame:
    """d_gid and the least or largest Julian day of a fact; days of 0 are no dates."""
    f = F.max if largest else F.min
    return dates.where((F.col("d_fact") == fact) & (F.col("d_julianday1") > 0)).groupBy("d_gid").agg(f(column).alias(name))


def birth_death(dates: DataFrame) -> DataFrame:
    """d_gid, d_type, d_year, birth, death: the birth's first day and row, and the death's last day."""
    born = dates.where((F.col("d_fact") == "BIRT") & (F.col("d_julianday1") > 0))
    born = earliest_row(born, "d_gid", F.col("d_julianday1"), "d_type", "d_year", "d_julianday1").withColumnRenamed("d_julianday1", "birth")
    return born.join(extreme(dates, "DEAT", "d_julianday2", True, "death"), "d_gid")


def earliest_after(floor: Column, *candidates: Column) -> Column:
    """The least candidate after floor, or null."""
    after = [F.when(c > floor, c) for c in candidates]
    return F.least(*after) if len(after) > 1 else after[0]
