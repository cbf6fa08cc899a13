"""Series over periods, lags, and clusters anchored at their first member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.tables import Rounds, written


def running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """For an aggregated series: one row per period."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))


def dense(df: DataFrame, order: str, value: str, step: int = 1) -> DataFrame:
    """Periods from the first to the last, missing ones with 0."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo is not null")
    periods = ends.select(F.explode(F.sequence("lo", "hi", F.lit(step).cast(dict(df.dtypes)[order]))).alias(order))
    return periods.join(df, order, "left").select(order, F.coalesce(value, F.lit(0)).alias(value))


def anomalies(df: DataFrame, order: str, value: str, reach: int = 5, least_baseline: float = 2, z: float = 2.0, n: int = 10) -> DataFrame:
    """Periods whose value lies z deviations above the median of a full centred window; the n strongest, by period.

    Whole numbers are summed as decimals, so windows of the same values in another order have the same deviation, and tie.
    """
    w = Window.orderBy(order).rowsBetween(-reach, reach)
    x = F.col(value).cast("decimal(19,0)") if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else F.col(value)
    n_x = 2 * reach + 1
    spread = F.sum(x * x).over(w) * n_x - F.sum(x).over(w) * F.sum(x).over(w)
    sd = F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n_x
    rows = df.withColumns({"w": F.collect_list(value).over(w), "sd": sd}).where(F.size("w") == n_x)
    rows = rows.withColumn("baseline", F.sort_array("w")[reach])
    rows = rows.where((F.col("baseline") >= least_baseline) & (F.col("sd") > 0)).withColumn("z_score", (F.col(value) - F.col("baseline")) / F.col("sd"))
    strongest = rows.where(F.col("z_score") >= z).orderBy(F.col("z_score").desc(), order).limit(n).orderBy(order)
    return strongest.select(order, value, "baseline", (F.col(value) / F.col("baseline")).alias("multiplier"), "z_score")


def gaps(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with the row before them of the same key, as struct `before` (null for the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("before", F.lag(F.struct(*df.columns)).over(w))


def anchored_clusters(df: DataFrame, key: str, at: Column, reach: int, bound: int = 2000) -> DataFrame:
    """key, anchor, size: sets that start at an anchor and hold what lies within `reach` of the anchor, not of each other.

    at is a whole number, null for rows that don't count. Rows are first counted by key and place. A key of at most `bound` places
    is folded in one row; the sets of a longer one are found in parallel, from links between its places, with the same result.
    """
    rows = df.select(F.col(key).alias("k"), at.cast("long").alias("at")).where("at is not null")
    places = rows.groupBy("k", "at").agg(F.count("*").alias("n"))
    long = places.groupBy("k").agg(F.count("*").alias("many")).where(F.col("many") > bound).select("k")
    if long.isEmpty():
        return _folded(places, reach).withColumnRenamed("k", key)
    places, long = written(places, "places"), written(long, "long")
    same = F.col("p.k").eqNullSafe(F.col("l.k"))
    some, rest = (places.alias("p").join(long.alias("l"), same, kind) for kind in ("left_semi", "left_anti"))
    return _folded(rest, reach).unionByName(_linked(written(some, "places"), reach)).withColumnRenamed("k", key)


def _folded(places: DataFrame, reach: int) -> DataFrame:
    """k, anchor, size of keys with few places: a running pass over each key's sorted places."""
    lists = places.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ats"))
    start = F.array().cast("array<struct<anchor:bigint,size:bigint>>")

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (x["at"] - last["anchor"] <= reach)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["anchor"].alias("anchor"), (last["size"] + x["n"]).alias("size"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(x["at"].alias("anchor"), x["n"].alias("size")))))

    return lists.select("k", F.explode(F.aggregate("ats", start, merge)).alias("s")).select("k", "s.anchor", "s.size")


def _linked(places: DataFrame, reach: int) -> DataFrame:
    """k, anchor, size of keys with any number of places, whose rows are spread over slots.

    The next anchor after one is the first place more than `reach` later, and a place more than `reach` after the one before it is
    an anchor whatever came earlier. So every place is linked to the first one beyond its reach, and anchors are what the links
    reach from the starts: links are doubled, then walked from the longest down. Slots are as wide as a reach, so all joins are by
    key and slot, at most two slots apart; a slot has at most reach + 1 places and one anchor.
    """
    width = reach + 1
    slot = F.floor(F.col("at") / width).cast("long") if width > 1 else F.col("at")
    places = places.withColumn("slot", slot)
    ends = places.groupBy("k", "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    same = lambda a, b: F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k"))
    # The place before: in the same slot, else the last of the slot before; further off is out of reach anyway.
    inside = places.withColumn("before", F.lag("at").over(Window.partitionBy("k", "slot").orderBy("at")))
    near = inside.alias("p").join(ends.alias("e"), same("p", "e") & (F.col("p.slot") - 1 == F.col("e.slot")), "left").select("p.*", F.coalesce("p.before", "e.hi").alias("prior"))
    starts = near.where(F.col("prior").isNull() | (F.col("at") - F.col("prior") > reach)).select("k", "at")
    # The first place beyond the reach: in the next slot, from the same offset on, else the first of the one after.
    asked = places.select("k", (F.col("slot") + 1).alias("slot"), (F.col("at") + width).alias("pos"), F.col("at").alias("asker"), F.lit(None).cast("long").alias("place"))
    there = places.select("k", "slot", F.col("at").alias("pos"), F.lit(None).cast("long").alias("asker"), F.col("at").alias("place"))
    later = Window.partitionBy("k", "slot").orderBy(F.col("pos").desc(), F.col("asker").isNotNull())
    first = asked.unionByName(there).withColumn("next", F.last("place", ignorenulls=True).over(later)).where("asker is not null")
    linked = first.alias("f").join(ends.alias("e"), same("f", "e") & (F.col("f.slot") + 1 == F.col("e.slot")), "left")
    links = Rounds("links", 1 << 30)
    jumps = [links.put(linked.select("f.k", F.col("f.asker").alias("at"), F.coalesce("f.next", "e.lo").alias("next")).where("next is not null"))]
    follow = lambda some, jump: some.alias("r").join(jump.alias("j"), same("r", "j") & (F.col("r.at") == F.col("j.at"))).select("r.k", F.col("j.next").alias("at"))
    while not jumps[-1].isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        jumps.append(links.put(a.join(b, same("a", "b") & (F.col("a.next") == F.col("b.at"))).select("a.k", "a.at", "b.next")))
    anchors, reached = Rounds("anchors"), starts
    for jump in reversed(jumps[:-1]):
        reached = anchors.put(reached.unionByName(follow(reached, jump)).distinct())
    marks = written(reached.distinct().withColumn("slot", slot).withColumnRenamed("at", "anchor"), "marks")
    own = places.alias("p").join(marks.alias("m"), same("p", "m") & (F.col("p.slot") == F.col("m.slot")) & (F.col("m.anchor") <= F.col("p.at")), "left").select("p.*", F.col("m.anchor").alias("mine"))
    both = own.alias("p").join(marks.alias("m"), same("p", "m") & (F.col("p.slot") - 1 == F.col("m.slot")), "left")
    return both.select("p.k", F.coalesce("p.mine", "m.anchor").alias("anchor"), "p.n").groupBy("k", "anchor").agg(F.sum("n").alias("size"))
