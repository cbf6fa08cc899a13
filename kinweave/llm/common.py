"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CHUNK = 256


class BoundedCache(dict):
    """A dict that computes what it lacks; `trim` empties it once it holds more than `limit` entries.

    Values are functions of the key alone, so emptying the cache changes the cost, never a result.
    """

    def __init__(self, make: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; every other column goes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: a transform of one element binds it to a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The elements that step(state, item) -> (next state, array to add) adds along items, state from start on.

    Items are folded in chunks, each with an array of its own, so that an added element is copied few times.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def whole(items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
        zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(items) > 0, F.flatten(F.aggregate(chunks, zero, chunk)["out"])).otherwise(none)

    return let(items, whole)
