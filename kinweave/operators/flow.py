"""Pair matrices and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.tables import written


def pair_matrix(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """row_label, col_label, n: the symmetric matrix of the n most frequent labels; a pair with itself counts once."""
    pairs = df.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.count("*").alias("n"))
    pairs = written(pairs, "pairs")  # pairs of labels, used four times
    totals = pairs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("total"))
    best = written(totals.orderBy(F.col("total").desc(), "label").limit(n).select("label"), "labels")
    cells = pairs.join(F.broadcast(best.withColumnRenamed("label", "x")), "x").join(F.broadcast(best.withColumnRenamed("label", "y")), "y")
    both = cells.select(F.explode(F.array_distinct(F.array(F.struct(F.col("x").alias("r"), F.col("y").alias("c")), F.struct(F.col("y").alias("r"), F.col("x").alias("c"))))).alias("p"), "n")
    spine = best.select(F.col("label").alias("row_label")).crossJoin(best.select(F.col("label").alias("col_label")))
    filled = both.select(F.col("p.r").alias("row_label"), F.col("p.c").alias("col_label"), "n")
    return spine.join(filled, ["row_label", "col_label"], "left").select("row_label", "col_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def flows(df: DataFrame, source: str, target: str, order: Column, sample: Column, visible: Column, n: int, samples: int = 3) -> DataFrame:
    """ord, source, target, source_node, target_node, weight, samples: the n heaviest flows, of equals the one met first.

    Samples are the first visible rows of a flow by order; the weight counts all rows. Nodes are numbered by first appearance,
    sources before targets.
    """
    rows = df.select(F.col(source).alias("source"), F.col(target).alias("target"), order.alias("o"), sample.alias("s"), visible.alias("v"))
    sums = rows.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("o").alias("first"))
    best = sums.orderBy(F.col("weight").desc(), "first", "source", "target").limit(n)
    best = written(best.withColumn("ord", F.row_number().over(Window.orderBy(F.col("weight").desc(), "first", "source", "target")).cast("long")), "flows")
    shown = rows.where("v").join(F.broadcast(best.select("source", "target")), ["source", "target"])
    shown = shown.withColumn("k", F.row_number().over(Window.partitionBy("source", "target").orderBy("o", "s"))).where(F.col("k") <= samples)
    lists = shown.groupBy("source", "target").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])).alias("samples"))
    left = best.groupBy("source").agg(F.min("ord").alias("o")).withColumn("source_node", F.row_number().over(Window.orderBy("o")) - 1).drop("o")
    right = best.groupBy("target").agg(F.min("ord").alias("o")).withColumn("k", F.row_number().over(Window.orderBy("o")) - 1).drop("o")
    offset = left.agg(F.count("*").alias("sources"))
    out = best.join(left, "source").join(right, "target").crossJoin(offset).join(lists, ["source", "target"], "left")
    return out.select("ord", "source", "target", F.col("source_node").cast("long").alias("source_node"), (F.col("k") + F.col("sources")).cast("long").alias("target_node"), "weight", F.coalesce("samples", F.lit("")).alias("samples"))
