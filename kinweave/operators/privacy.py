"""Row-level policies. `visible` frames hold one row a record: key, visible, label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIVATE = "Private"


def labelled(ranked: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Rank on raw data first; a record that isn't visible keeps its row and gets the private label."""
    label = F.when(F.coalesce("visible", F.lit(False)), F.col("label")).otherwise(F.lit(PRIVATE))
    return ranked.join(visible, key, "left").withColumn("label", label).drop("visible")


def promoted(samples: DataFrame, visible: DataFrame, key: str, group: list[str], order: str, n: int = 3) -> DataFrame:
    """Up to n visible samples a group: the next in order fills the place of one that isn't visible."""
    shown = samples.join(visible.where("visible"), key)
    return shown.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(order, key))).where(F.col("_k") <= n).drop("_k", "visible")


def dropped(rows: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Rows of records that aren't visible go."""
    return rows.join(visible.where("visible").select(key), key, "left_semi")


def redacted(rows: DataFrame, visible: DataFrame, key: str, blanks: dict[str, str | None]) -> DataFrame:
    """Every row stays; of records that aren't visible the given columns get their blank value."""
    seen = F.coalesce("visible", F.lit(False))
    return rows.join(visible.select(key, "visible"), key, "left").withColumns({c: F.when(seen, F.col(c)).otherwise(F.lit(v)) for c, v in blanks.items()}).drop("visible")
