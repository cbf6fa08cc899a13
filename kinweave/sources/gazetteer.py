"""A tree of places with coordinates, flattened once to paths, so that resolving a place is one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.tables import Rounds, fresh

#: Up to so many paths Spark may choose to broadcast them. More are merged: their files tell little of their size, as paths repeat each other.
FEW = 100_000


def path_of(place: Column) -> Column:
    """Root-first parts of a place written from the smallest part to the largest, blank ones left out."""
    return F.filter(F.reverse(F.transform(F.split(place, ","), lambda p: F.trim(p))), lambda p: p != "")


def flattened(locations: DataFrame) -> DataFrame:
    """path, latitude, longitude of id, parent_id (null or 0 for roots), place, latitude, longitude; rows without either go.

    Of places with one name under one parent the last id counts, and what lies under the others can't be reached. Each round
    puts the path of the place that a path starts under in front of it, so paths grow to twice the levels a round, at any depth. Places
    whose parents run in a ring, or to one that isn't there, never reach a root: where a round brings no new root, they go.
    """
    rows = locations.withColumn("parent_id", F.coalesce("parent_id", F.lit(0))).where("id is not null and id <> 0 and place is not null")
    rows = rows.groupBy("parent_id", "place").agg(F.max(F.struct("id", "latitude", "longitude")).alias("last")).select("parent_id", "place", "last.*")
    rounds, before = Rounds("places"), -1
    now = rounds.put(rows.select("id", F.col("parent_id").alias("under"), F.array("place").alias("path"), "latitude", "longitude"))
    while True:
        left = now.where("under <> 0").count()
        if left in (0, before):
            return now.where("under = 0 and latitude is not null and longitude is not null").select("path", "latitude", "longitude")
        before = left
        above = now.select(F.col("id").alias("under"), F.col("under").alias("top"), F.col("path").alias("front"))
        if left > FEW:
            above = above.hint("merge")
        open_ = now.where("under <> 0").join(above, "under").select("id", F.col("top").alias("under"), F.concat("front", "path").alias("path"), "latitude", "longitude")
        now = rounds.put(now.where("under = 0").unionByName(open_.where(F.size("path") <= (1 << 16))))


def located(df: DataFrame, place: str, flat: DataFrame) -> DataFrame:
    """df with latitude and longitude of a place; null if a part or the coordinates are missing.

    Paths are joined as one text, a third of an array's size in a sort: each part after a comma, which no part of a place holds.
    """
    key, many = fresh("_path", df, flat), flat.limit(FEW + 1).count() > FEW
    text = lambda path: F.array_join(F.transform(path, lambda p: F.concat(F.lit(","), p)), "")
    keyed = flat.where(~F.exists("path", lambda p: p.contains(","))).select(text(F.col("path")).alias(key), "latitude", "longitude")
    return df.withColumn(key, text(path_of(F.col(place)))).join(keyed.hint("merge") if many else keyed, key, "left").drop(key)


def events_of(years: DataFrame, catalogue: DataFrame, n: int = 2, width: int = 32) -> DataFrame:
    """year and the first n keys of a catalogue (ord, key, first, last, countries) whose span holds the year and whose countries
    share one with the row's. Spans are cut into slots of `width` years, one row a slot, for an equi-join; a slot's hits are then
    held against the span itself, so a span of any length costs a row in `width` years."""
    slot = lambda c: F.floor(c / width).cast("int")
    spans = catalogue.where("first <= last").select("ord", "key", F.col("countries").alias("theirs"), "first", "last", F.explode(F.sequence(slot(F.col("first")), slot(F.col("last")))).alias("slot"))
    hits = years.withColumn("slot", slot(F.col("year"))).join(spans, "slot").where("year between first and last").where(F.arrays_overlap("countries", "theirs"))
    return hits.groupBy("year").agg(F.slice(F.transform(F.sort_array(F.collect_set(F.struct("ord", "key"))), lambda x: x["key"]), 1, n).alias("events"))
