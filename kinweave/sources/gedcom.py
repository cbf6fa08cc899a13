"""Genealogical text files as the engine's tables.

A file is split at its level-0 lines, one record a row; a record's columns are taken from its text with DataFrame functions, only
dates go through an Arrow-batched function, as calendars need arithmetic that Spark lacks. Ids of places are hashes of their
paths, so tables of different files and machines agree without a shared counter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.calendar import MONTHS
from kinweave.functions.text import block_pattern

POINTER = r"@([^@#\n][^@\n]*)@"
NAME_TAGS = ("NAME", "ROMN", "FONE", "_HEB", "_MARNM", "_AKA", "_AKAN")
HEBREW = ("TSH", "CSH", "KSL", "TVT", "SHV", "ADR", "ADS", "NSN", "IYR", "SVN", "TMZ", "AAV", "ELL")
FRENCH = ("VEND", "BRUM", "FRIM", "NIVO", "PLUV", "VENT", "GERM", "FLOR", "PRAI", "MESS", "THER", "FRUC", "COMP")
DATE_SCHEMA = "d_fact string, d_type string, d_year int, d_mon int, d_day int, d_julianday1 int, d_julianday2 int"


def gregorian_jd(y: int, m: int, d: int) -> int:
    y = y + 1 if y < 0 else y
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - yy // 100 + yy // 400 - 32045


def julian_jd(y: int, m: int, d: int) -> int:
    y = y + 1 if y < 0 else y
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - 32083


def french_jd(y: int, m: int, d: int) -> int:
    return y * 1461 // 4 + (m - 1) * 30 + d + 2375474


def _hebrew_elapsed(y: int) -> int:
    months = (235 * y - 234) // 19
    day = months * 29 + (12084 + 13753 * months) // 25920
    return day + ((3 * (day + 1)) % 7 < 3)


def hebrew_new_year(y: int) -> int:
    before, here, after = (_hebrew_elapsed(x) for x in (y - 1, y, y + 1))
    return 347998 + here + (2 if after - here == 356 else 1 if here - before == 382 else 0)


def hebrew_jd(y: int, m: int, d: int) -> int:
    """Months from Tishri; Adar is 6 and Adar Sheni 7, the same month in a common year."""
    start, length = hebrew_new_year(y), hebrew_new_year(y + 1) - hebrew_new_year(y)
    leap = length > 360
    days = [30, 30 if length % 10 == 5 else 29, 29 if length % 10 == 3 else 30, 29, 30, 30 if leap else 0, 29, 30, 29, 30, 29, 30, 29]
    return start + sum(days[: m - 1]) + d - 1


CALENDARS = {
    "@#DGREGORIAN@": (MONTHS, gregorian_jd),
    "@#DJULIAN@": (MONTHS, julian_jd),
    "@#DFRENCH R@": (FRENCH, french_jd),
    "@#DHEBREW@": (HEBREW, hebrew_jd),
}
_PART = re.compile(r"(?:(@#D[A-Z ]+@) *)?(?:(\d{1,2}) +)?(?:([A-Z]{3,4}) +)?(\d{1,4}|[IVX]+)(?:/(\d{1,2}))?( *B\. ?C\.?)?$")
_ROMAN = {"I": 1, "V": 5, "X": 10}


def _year(text: str) -> int:
    if text.isdigit():
        return int(text)
    values = [_ROMAN[c] for c in text]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def parse_part(text: str) -> tuple | None:
    """(calendar, year, month, day, first Julian day, last Julian day) of one date."""
    found = _PART.match(text.strip().upper())
    if not found:
        return None
    calendar = found[1] or "@#DGREGORIAN@"
    if calendar not in CALENDARS:
        return None
    months, jd = CALENDARS[calendar]
    year = (_year(found[4]) + bool(found[5])) * (-1 if found[6] else 1)
    month = months.index(found[3]) + 1 if found[3] in months else 0
    day = int(found[2] or 0) if month else 0
    if not year:
        return None
    following = 1 if year == -1 else year + 1
    if not month:
        return calendar, year, 0, 0, jd(year, 1, 1), jd(following, 1, 1) - 1
    if not day:
        end = jd(following, 1, 1) if month == len(months) else jd(year, month + 1, 1)
        return calendar, year, month, 0, jd(year, month, 1), end - 1
    return calendar, year, month, day, jd(year, month, day), jd(year, month, day)


def parse_date(text: str) -> list[tuple]:
    """One row for a date, two for the ends of a range or period; modifiers and phrases in brackets are left out."""
    text = re.sub(r"\(.*", "", text).strip().upper()
    ends = re.match(r"(?:BET|FROM) +(.*?) +(?:AND|TO) +(.*)", text)
    parts = [ends[1], ends[2]] if ends else [re.sub(r"^(?:ABT|BEF|AFT|CAL|EST|INT|FROM|TO) +", "", text)]
    return [p for p in map(parse_part, parts) if p]


def records(spark: SparkSession, path: str, tree: int) -> DataFrame:
    """tree_id, xref, kind, gedcom of every level-0 record."""
    rows = spark.read.text(path, lineSep="\n0 ").select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^(?:\x{FEFF})?(?:0 )?", "0 ").alias("gedcom"))
    head = r"^0 (?:@([^@]+)@ )?([A-Z_]+)"
    rows = rows.select(F.lit(tree).alias("tree_id"), F.regexp_extract("gedcom", head, 1).alias("xref"), F.regexp_extract("gedcom", head, 2).alias("kind"), F.rtrim("gedcom").alias("gedcom"))
    return rows.where("kind not in ('', 'HEAD', 'TRLR')")


def one(pattern: str) -> Column:
    return F.regexp_extract("gedcom", pattern, 1)


def individuals(rows: DataFrame) -> DataFrame:
    sex = F.coalesce(F.nullif(one(r"\n1 SEX ([A-Z])"), F.lit("")), F.lit("U"))
    return rows.where("kind = 'INDI'").select("tree_id", F.col("xref").alias("i_id"), sex.alias("i_sex"), F.col("gedcom").alias("i_gedcom"))


def families(rows: DataFrame) -> DataFrame:
    listed = F.size(F.regexp_extract_all("gedcom", F.lit(rf"\n1 CHIL {POINTER}"), F.lit(1)))
    stated = one(r"\n1 NCHI (\d{1,4})").try_cast("int")
    return rows.where("kind = 'FAM'").select("tree_id", F.col("xref").alias("f_id"), one(rf"\n1 HUSB {POINTER}").alias("f_husb"), one(rf"\n1 WIFE {POINTER}").alias("f_wife"), F.coalesce(stated, listed).alias("f_numchil"), F.col("gedcom").alias("f_gedcom"))


def links(rows: DataFrame) -> DataFrame:
    pattern = rf"\n[1-9] ([A-Z_]+) {POINTER}"
    both = F.arrays_zip(F.regexp_extract_all("gedcom", F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all("gedcom", F.lit(pattern), F.lit(2)).alias("x"))
    return rows.select("tree_id", F.col("xref").alias("l_from"), F.explode(F.array_distinct(both)).alias("l")).select("tree_id", "l_from", F.col("l.t").alias("l_type"), F.col("l.x").alias("l_to"))


def names(rows: DataFrame) -> DataFrame:
    """Every name form with its number; surname and given names from the lines below their own, else from the slashes.

    A form stands on a level-1 line or, as a variant, on a level-2 line; its parts may stand anywhere in its block.
    """
    tags = "|".join(NAME_TAGS)
    deeper = F.regexp_extract_all("block", F.lit(block_pattern(tags, 2)), F.lit(0))
    forms = F.concat(F.filter(F.array("block"), lambda b: b.rlike(rf"^\n1 (?:{tags}) ")), F.filter(deeper, lambda b: b.rlike(r"^\n2 [A-Z_]+ ")))
    blocks = rows.where("kind = 'INDI'").select("tree_id", F.col("xref").alias("n_id"), F.posexplode(F.regexp_extract_all("gedcom", F.lit(block_pattern("[A-Z_]++")), F.lit(0))).alias("at", "block"))
    each = blocks.select("tree_id", "n_id", "at", F.posexplode(forms).alias("k", "b"))
    numbered = each.withColumn("n_num", F.row_number().over(Window.partitionBy("tree_id", "n_id").orderBy("at", "k")) - 1)
    level = F.when(F.substr("b", F.lit(2), F.lit(1)) == "1", 2).otherwise(3)
    own = lambda tag: F.nullif(F.trim(F.when(level == 2, F.regexp_extract("b", rf"\n2 {tag} ([^\n]*)", 1)).otherwise(F.regexp_extract("b", rf"\n3 {tag} ([^\n]*)", 1))), F.lit(""))
    full = F.regexp_extract("b", r"^\n[12] [A-Z_]+ ([^\n]*)", 1)
    surname = F.coalesce(own("SURN"), F.nullif(F.trim(F.regexp_extract(full, "/([^/]*)/", 1)), F.lit("")), F.lit("@N.N."))
    given = F.coalesce(own("GIVN"), F.nullif(F.trim(F.regexp_replace(full, "/[^/]*/?.*", "")), F.lit("")), F.lit("@P.N."))
    return numbered.select("tree_id", "n_id", "n_num", F.regexp_extract("b", r"^\n[12] ([A-Z_]+)", 1).alias("n_type"), surname.alias("n_surn"), given.alias("n_givn"))


def dates(rows: DataFrame) -> DataFrame:
    """One or two rows for each distinct dated level-1 fact of a record."""
    blocks = F.filter(F.regexp_extract_all("gedcom", F.lit(block_pattern("[A-Z_]++")), F.lit(0)), lambda b: b.contains("\n2 DATE "))
    pairs = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^\n1 ([A-Z_]+)", 1).alias("f"), F.regexp_extract(b, r"\n2 DATE ([^\n]*)", 1).alias("d")))

    @F.pandas_udf(f"array<struct<{DATE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    def parsed(fact: pd.Series, date: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("d_fact", "d_type", "d_year", "d_mon", "d_day", "d_julianday1", "d_julianday2"), (f, *p), strict=True)) for p in parse_date(d)] for f, d in zip(fact, date, strict=True)])

    found = rows.where("kind in ('INDI', 'FAM')").select("tree_id", F.col("xref").alias("d_gid"), F.explode(pairs).alias("p"))
    return found.select("tree_id", "d_gid", F.explode(parsed("p.f", "p.d")).alias("r")).select("tree_id", "d_gid", "r.*").distinct()


def _place_paths(rows: DataFrame) -> DataFrame:
    """tree_id, xref, path: root-first parts of every place and of all that it lies in."""
    found = F.array_distinct(F.regexp_extract_all("gedcom", F.lit(r"\n2 PLAC ([^\n]*)"), F.lit(1)))
    parts = F.filter(F.transform(F.reverse(F.split("place", ",")), lambda p: F.trim(p)), lambda p: p != "")
    split = rows.select("tree_id", "xref", F.explode(found).alias("place")).select("tree_id", "xref", parts.alias("parts")).where("size(parts) > 0")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.slice("parts", F.lit(1), k))
    return split.select("tree_id", "xref", F.explode(prefixes).alias("path"))


def places(rows: DataFrame) -> DataFrame:
    paths = _place_paths(rows).select("tree_id", "path").distinct()
    parent = F.when(F.size("path") > 1, F.xxhash64(F.slice("path", F.lit(1), F.size("path") - 1))).otherwise(F.lit(0))
    return paths.select("tree_id", F.xxhash64("path").alias("p_id"), parent.alias("p_parent_id"), F.element_at("path", -1).alias("p_place"))


def placelinks(rows: DataFrame) -> DataFrame:
    return _place_paths(rows).select("tree_id", F.col("xref").alias("pl_gid"), F.xxhash64("path").alias("pl_p_id")).distinct()


def sources(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'SOUR'").select("tree_id", F.col("xref").alias("s_id"))


def media(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'OBJE'").select("tree_id", F.col("xref").alias("m_id"))


def media_files(rows: DataFrame) -> DataFrame:
    files = F.regexp_extract_all("gedcom", F.lit(block_pattern("FILE")), F.lit(0))
    each = rows.where("kind = 'OBJE'").select("tree_id", F.col("xref").alias("m_id"), F.explode(files).alias("b"))
    return each.select("tree_id", "m_id", F.lower(F.trim(F.regexp_extract("b", r"\n[23] (?:TYPE|MEDI) ([^\n]*)", 1))).alias("source_media_type"))


def other(rows: DataFrame) -> DataFrame:
    return rows.where("kind not in ('INDI', 'FAM', 'SOUR', 'OBJE')").select("tree_id", F.col("xref").alias("o_id"), F.col("kind").alias("o_type"))


TABLES = {"individuals": individuals, "families": families, "link": links, "name": names, "dates": dates, "places": places, "placelinks": placelinks, "sources": sources, "media": media, "media_file": media_files, "other": other}


def read_tree(spark: SparkSession, path: str, tree: int = 1) -> dict[str, DataFrame]:
    """All tables of one file."""
    rows = records(spark, path, tree)
    return {name: build(rows) for name, build in TABLES.items()}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet tables partitioned by tree: a scan of one tree reads only its folders."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy("tree_id").parquet(f"{folder}/{name}.parquet")


def tree_tables(spark: SparkSession, folder: str, tree: int) -> dict[str, DataFrame]:
    """The tables of one tree of a folder, by partition pruning. An unknown name is an error when it is looked up."""
    none = spark.createDataFrame([], "tree_id int, xref string, kind string, gedcom string")
    return {name: spark.read.schema(build(none).schema).parquet(f"{folder}/{name}.parquet").where(F.col("tree_id") == tree) for name, build in TABLES.items()}
