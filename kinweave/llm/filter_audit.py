"""Interaction of five filters: what each removes, at each place of each of their 120 orders, and what others would have removed.

A document is a mask of the filters that it fails, so a part of the corpus is at most 32 numbers of documents. Each of these cells
folds along every order: `transform` over the array of orders, `aggregate` along one, with the documents alive or not so far. That
makes 600 structs a cell, weighted by its documents, which are added up element by element over a part's cells.

Identity is by the SHA-256 of a text. A document fails E if its id is above the least id that has its text; that least id comes
from a pre-aggregated minimum, and is joined back by text and id together, so copies of one text, however many, are spread.

Edge cases: a null text is an empty one, which has no words, fails A and is identical to other empty ones; a null source is the
empty string; a document without an id neither fails E nor makes another fail it; repeated rows of one id don't make each other
fail it; labels that are null or not 1 count as not lost; an id with several labels counts as good or toxic if one says so; very
long texts are taken whole; an empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.tables import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed(text: Column) -> Column:
    """A to D as bits 1, 2, 4, 8: under 50 words, few distinct words, many capitals, any of the marks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.struct(F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))
    # One evaluation of the words for both numbers: a lambda over an array of one struct.
    of_words = F.element_at(F.transform(F.array(n), lambda x: F.when(x["words"] < 50, 1).otherwise(0) + F.when(x["distinct"] * 100 < x["words"] * 65, 2).otherwise(0)), 1)
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (of_words + F.when(capitals * 100 > chars * 5, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by what they fail and how they are labelled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failed(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # Rows without an id match nothing; a salt keeps them from meeting in one task.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    one = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    marked = rows.join(known, ["doc_id", "salt"], "left").groupBy("doc_id", "salt", "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))
    marked = written(marked.drop("salt"), "masks")
    first = marked.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rest = marked.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    return rest.select("part", "mask", "good", "toxic", "n").unionByName(marked.where("doc_id is null").select("part", "mask", "good", "toxic", "n"))


def folded(cell: str) -> str:
    """SQL for the 600 structs of a cell (mask, n, good, toxic): an order's five after the other's, weighted by the cell."""
    bit = f"shiftleft(1, locate(f, '{FILTERS}') - 1)"
    fails, alone = f"(({cell}.mask & {bit}) != 0)", f"({cell}.mask = {bit})"
    weight = lambda when, what: f"if({when}, {cell}.{what}, 0L)"
    step = ", ".join(f"'{name}', {value}" for name, value in zip(COUNTS, (weight(f"acc.alive AND NOT {fails}", "n"), weight(f"acc.alive AND {fails}", "n"), weight(f"NOT acc.alive AND {fails}", "n"), weight(alone, "n"), weight(f"acc.alive AND {fails}", "good"), weight(f"acc.alive AND {fails}", "toxic")), strict=True))
    kind = ", ".join(f"{name}: bigint" for name in COUNTS)
    return f"""flatten(transform(orders, o -> aggregate(split(o, ''),
        named_struct('alive', true, 'steps', cast(array() as array<struct<{kind}>>)),
        (acc, f) -> named_struct('alive', acc.alive AND NOT {fails}, 'steps', concat(acc.steps, array(named_struct({step})))),
        acc -> acc.steps)))"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of every part, order and step, with the filter's removals over all orders (shapley)."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    parts = parts.withColumn("orders", F.split(F.lit(",".join(ORDERS)), ","))
    added = ", ".join(f"'{c}', a.{c} + b.{c}" for c in COUNTS)
    zero = ", ".join(f"'{c}', 0L" for c in COUNTS)
    merged = parts.select("part", "orders", F.expr(f"aggregate(cells, array_repeat(named_struct({zero}), {len(ORDERS) * len(FILTERS)}), (acc, cell) -> zip_with(acc, {folded('cell')}, (a, b) -> named_struct({added})))").alias("steps"))
    shapley = F.expr(f"transform(split('{FILTERS}', ''), f -> aggregate(sequence(0, {len(ORDERS) * len(FILTERS) - 1}), 0L, (acc, i) -> acc + if(substring(orders[i div {len(FILTERS)}], i % {len(FILTERS)} + 1, 1) = f, steps[i].removed, 0L)))")
    rows = merged.withColumn("shapley", shapley).select("part", "orders", "shapley", F.posexplode("steps").alias("i", "s"))
    order = F.element_at("orders", (F.floor(F.col("i") / len(FILTERS)) + 1).cast("int"))
    letter = F.substr(order, F.col("i") % len(FILTERS) + 1, F.lit(1))
    return rows.select("part", order.alias("filter_order"), (F.col("i") % len(FILTERS) + 1).cast("int").alias("step"), letter.alias("filter"), *(F.col(f"s.{c}").alias(c) for c in COUNTS), F.element_at("shapley", F.instr(F.lit(FILTERS), letter)).alias("shapley"))
