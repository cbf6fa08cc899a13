"""Histograms, spines and what trims or collapses them. Ordered results carry `ord`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.labels import DASH

TRIM_LADDER = (0.01, 0.02, 0.05, 0.10, 0.20)
COLLAPSE_STEPS = (1, 2, 5, 10, 20, 50, 100)
CHUNK_STEPS = (1, 5, 10, 25, 50, 100)


def spine(df: DataFrame, low: int, high: int, step: int = 1, name: str = "ord") -> DataFrame:
    return df.sparkSession.range(low, high + 1, step).select(F.col("id").alias(name))


def fixed_width(df: DataFrame, value: Column, low: int, top: int, width: int, weight: Column | None = None) -> DataFrame:
    """ord, label, n: bands of `width` from low to top, the last open, zero-filled. Values below low count in no band."""
    band = F.when(value >= top, top).when(value >= low, F.floor(value / width) * width).cast("long")
    counts = df.select(band.alias("ord"), (weight if weight is not None else F.lit(1)).alias("w")).where("ord is not null").groupBy("ord").agg(F.sum("w").alias("n"))
    bands = spine(df, low // width * width, top, width)
    label = F.when(F.col("ord") >= top, F.concat(F.lit(str(top)), F.lit("+"))).otherwise(F.concat(F.col("ord"), F.lit(DASH), F.col("ord") + width - 1))
    return bands.join(counts, "ord", "left").select("ord", label.alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def two_sided(df: DataFrame, difference: Column, width: int, top: int) -> DataFrame:
    """ord, left_n, right_n: magnitudes by sign; zero differences count on neither side."""
    size = F.least(F.floor(F.abs(difference) / width) * width, F.lit(top)).cast("long")
    side = df.select(size.alias("ord"), F.signum(difference).alias("s")).where("s <> 0")
    counts = side.groupBy("ord").agg(F.sum((F.col("s") > 0).cast("long")).alias("left_n"), F.sum((F.col("s") < 0).cast("long")).alias("right_n"))
    return spine(df, 0, top, width).join(counts, "ord", "left").select("ord", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def banded(df: DataFrame, band: Column) -> DataFrame:
    return df.groupBy(band.cast("long").alias("band")).agg(F.count("*").alias("n")).where("band is not null")


def slice_between(df: DataFrame, order: str, qualifies: Column) -> DataFrame:
    """Rows from the first to the last that qualify; all rows if none does. For small, aggregated inputs."""
    ends = df.agg(F.min(F.when(qualifies, F.col(order))).alias("_first"), F.max(F.when(qualifies, F.col(order))).alias("_last"))
    return df.crossJoin(F.broadcast(ends)).where(F.col("_first").isNull() | F.col(order).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def drop_zero_ends(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Ends at which all of the values are 0 go; what is 0 throughout stays."""
    return slice_between(df, order, sum((F.col(v) for v in values), F.lit(0)) > 0)


def drop_low_ends(df: DataFrame, order: str, value: str, ratio: float) -> DataFrame:
    top = df.agg(F.max(value).alias("_top"))
    return slice_between(df.crossJoin(F.broadcast(top)), order, F.col(value) >= F.col("_top") * ratio).drop("_top")


def cap_by_trim(df: DataFrame, order: str, value: str, most: int) -> DataFrame:
    """Trim the ends by the first ratio of the ladder that leaves at most `most` rows, else by the last."""
    tops = df.agg(F.max(value).alias("top"))
    tagged = df.crossJoin(F.broadcast(tops)).withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in TRIM_LADDER))))
    w = Window.partitionBy("ratio")
    good = F.col(value) >= F.col("top") * F.col("ratio")
    tagged = tagged.withColumns({"lo": F.min(F.when(good, F.col(order))).over(w), "hi": F.max(F.when(good, F.col(order))).over(w)}).where(F.col(order).between(F.col("lo"), F.col("hi")))
    tagged = tagged.withColumn("left", F.count("*").over(w))
    total = df.agg(F.count("*").alias("total"))
    picked = tagged.agg(F.coalesce(F.min(F.when(F.col("left") <= most, F.col("ratio"))), F.lit(TRIM_LADDER[-1])).alias("pick"))
    out = tagged.crossJoin(F.broadcast(picked)).where("ratio = pick").select(df.columns)
    whole = df.crossJoin(F.broadcast(total)).where(F.col("total") <= most).select(df.columns)
    return whole.unionByName(out.crossJoin(F.broadcast(total)).where(F.col("total") > most).select(df.columns))


def collapse(df: DataFrame, order: str, value: str, most: int, steps=COLLAPSE_STEPS, cumulative: bool = False) -> DataFrame:
    """Rows joined in chunks of the least step that leaves at most `most`; sums, or the last value if cumulative."""
    n = df.agg(F.count("*").alias("rows"))
    need = F.ceil(F.col("rows") / most)
    step = F.coalesce(*(F.when(F.lit(s) >= need, F.lit(s)) for s in steps), need).cast("long")
    w = Window.orderBy(order)  # histograms are small: one row per bin
    chunked = df.withColumn("_k", F.row_number().over(w) - 1).crossJoin(F.broadcast(n.select(step.alias("_step")))).withColumn("chunk", F.floor(F.col("_k") / F.col("_step")))
    total = F.max_by(value, order) if cumulative else F.sum(value)
    return chunked.groupBy("chunk").agg(F.min(order).alias("low"), F.max(order).alias("high"), total.alias(value))
