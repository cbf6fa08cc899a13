"""Rankings with ties in byte order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.operators.tables import fresh, written


def folded_counts(df: DataFrame, value: Column, position: Column, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """key, label, n: values counted by their fold; the label is the spelling met first by position."""
    rows = df.select(value.alias("v"), position.alias("p")).where("v is not null and v <> ''")
    return rows.groupBy(fold(F.col("v")).alias("key")).agg(F.min_by("v", F.struct("p", "v")).alias("label"), F.count("*").alias("n"))


def normalized(df: DataFrame, value: str, normalizer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with key and label of a value. normalizer: from the distinct values (v) to v, key, label, called once for the whole
    column; what it leaves out or null, and every value without one, has its lower case as key and itself as label."""
    if normalizer is None:
        return df.withColumns({"key": F.lower(value), "label": F.col(value)})
    key, label = fresh("_key", df), fresh("_label", df)
    found = normalizer(df.select(F.col(value).alias("v")).where("v is not null").distinct()).select(F.col("v").alias(value), F.col("key").alias(key), F.col("label").alias(label))
    return df.join(found, value, "left").withColumns({"key": F.coalesce(key, F.lower(value)), "label": F.coalesce(label, value)}).drop(key, label)


def merged_keys(df: DataFrame, position: Column) -> DataFrame:
    """key, label, n of rows with key and label (see `normalized`); a key's label is the one met first by position."""
    return df.groupBy("key").agg(F.min_by("label", F.struct(position.alias("p"), F.col("label"))).alias("label"), F.count("*").alias("n"))


def left_wins(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The union of two series by key; where both have one, the left's values."""
    return left.unionByName(right.join(left.select(*keys), list(keys), "left_anti").select(left.columns))


def distinct_total(counts: DataFrame) -> DataFrame:
    """total: the number of keys of folded or other counts."""
    return counts.agg(F.count("*").alias("total"))


def by_shown_label(df: DataFrame, label: Column, n: int) -> DataFrame:
    """ord, label, n of counts (key, n): keys that are shown by one label are summed, and the first n ranked by their sum."""
    return top(df.groupBy(label.alias("label")).agg(F.sum("n").alias("n")), n, F.col("n").desc(), F.col("label")).select("ord", "label", "n")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows (all if n <= 0) with their rank as ord. Only what the limit leaves is numbered in one task."""
    if n <= 0:
        return numbered(df, *order)
    return df.orderBy(*order).limit(n).withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their rank as ord: sorted by ranges, numbered within each, and shifted by the sizes of the ranges before."""
    at, number, many, before = (fresh(c, df) for c in ("_at", "_part", "_n", "_before"))
    parts = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned(at, 33)
    sizes = parts.groupBy(part.alias(number)).agg(F.count("*").alias(many))
    shift = sizes.select(number, (F.sum(many).over(Window.orderBy(number)) - F.col(many)).alias(before))  # one row a partition
    return parts.join(F.broadcast(shift), part == F.col(number)).withColumn("ord", F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, "ord")


def collation(spark: SparkSession, locale: str | None) -> str:
    """The collation of a locale such as sv or de-AT: of language and country if there is one, else of the language, else the root's."""
    parts = (locale or "").replace("_", "-").split("-")
    country = spark._jvm.java.util.Locale("", parts[-1].upper()).getISO3Country() if len(parts) > 1 and len(parts[-1]) == 2 else parts[-1].upper()
    wanted = [f"{parts[0].lower()}_{country}", parts[0].lower()] if parts[0] else []
    known = {r[0] for r in spark.sql("SELECT name FROM collations()").where(F.col("name").isin(wanted)).collect()} if wanted else set()
    return next((w for w in wanted if w in known), "UNICODE")


def label_sorted(df: DataFrame, label: str = "label", last: str | None = None, locale: str | None = None) -> DataFrame:
    """Rows by label in the collation of a locale, of equals in byte order, with the label `last` after all others; ord is their number."""
    pinned = F.when(F.col(label) == last, 1).otherwise(0) if last is not None else F.lit(0)
    return numbered(df, pinned, F.collate(F.col(label), collation(df.sparkSession, locale)), F.col(label))


def top_by_label(df: DataFrame, n: int, label: str, *order: Column) -> DataFrame:
    """The first n rows by order, then shown by label: ord is their place among the labels."""
    return df.orderBy(*order).limit(n).withColumn("ord", F.row_number().over(Window.orderBy(label)).cast("long"))


def dominant(df: DataFrame, key: str, form: str) -> DataFrame:
    """Per key the most frequent form, of equals the least in byte order."""
    counts = df.groupBy(key, form).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(form, F.struct(-F.col("n"), F.col(form))).alias(form))


def record_holder(df: DataFrame, value: Column, key: Column, largest: bool) -> DataFrame:
    """One row: the least or largest value, of equals the least key. Partial minima, no sort."""
    one = df.select(value.alias("value"), key.alias("key")).where("value is not null").agg(F.min(F.struct((-F.col("value") if largest else F.col("value")).alias("v"), F.col("key").alias("key"))).alias("m"))
    return one.select((-F.col("m.v") if largest else F.col("m.v")).alias("value"), F.col("m.key").alias("key")).where("key is not null")


def two_ended(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n least, and the n largest of the others (ties from the largest key). Two bounded heaps, no total sort."""
    short = df.orderBy(value, key).limit(n)
    long_ = df.join(F.broadcast(short.select(key)), key, "left_anti").orderBy(F.col(value).desc(), F.col(key).desc()).limit(n)
    number = lambda d, *o: d.select(key, value, F.row_number().over(Window.orderBy(*o)).cast("long").alias("ord"))
    return number(short, value, key).withColumn("side", F.lit("short")).unionByName(number(long_, F.col(value).desc(), F.col(key).desc()).withColumn("side", F.lit("long")))


def skewed(df: DataFrame, key: str, a: str, b: str, least: int, share: float) -> DataFrame:
    """Groups of at least `least` whose larger part reaches `share`; most skewed first, exact in decimals."""
    total, larger = F.col(a) + F.col(b), F.greatest(a, b)
    kept = df.where((total >= least) & (larger >= share * total))
    return kept.select(key, a, b, total.alias("total"), (larger.cast("decimal(18,0)") / total.cast("decimal(18,0)")).alias("skew"))
