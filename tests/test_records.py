"""Scanning of records: what a block is, dates in words, and blocks of 200,000 lines."""

import time

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.sources import gedcom

MANY = 200_000


def value(spark, record, column):
    return spark.createDataFrame([(record,)], "g string").select(column(F.col("g")).alias("x")).first().x


@pytest.mark.parametrize(
    "record, block",
    [
        ("0 @I@ INDI\n1 BIRT\n2 PLAC A\n3 MAP\n1 DEAT", "\n1 BIRT\n2 PLAC A\n3 MAP"),
        ("0 @I@ INDI\n1 BIRT Y", "\n1 BIRT Y"),
        ("0 @I@ INDI\n1 BIRTH\n2 PLAC A\n1 BIRT\n2 PLAC B", "\n1 BIRT\n2 PLAC B"),
        ("0 @I@ INDI\n1 BIRT\n2 PLAC A\n10 X deep\nloose\n2 DATE 1900\n0 @J@ INDI\n2 PLAC C", "\n1 BIRT\n2 PLAC A\n10 X deep\nloose\n2 DATE 1900"),
        ("0 @I@ INDI\n1 BIRTH", None),
        ("0 @I@ INDI", None),
        ("", None),
        (None, None),
    ],
)
def test_blocks(spark, record, block):
    assert value(spark, record, lambda g: text.event_block(g, "BIRT")) == block


@pytest.mark.parametrize(
    "date, year",
    [("1900", 1900), ("BET 1850 AND 1860", 1850), ("FROM 3 MAY 1850 TO 1860", 1850), ("12 MAR 1900/01", 1901), ("900/01", 900), ("1699/1700", 1700), ("44 B.C.", -44), ("ABT 44 B.C.", -44), ("44 AB.C.", 44), ("INT 1900 (after 1800", 1900), ("(1900)", None), ("MAY", None), ("12345", None), ("1 JAN 0900", 900), ("@#DJULIAN@ 5 MAR 1700", 1700)],
)
def test_years_of_text(spark, date, year):
    assert value(spark, f"0 @I@ INDI\n1 BIRT\n2 PLAC x\n2 DATE {date}\n1 DEAT\n2 DATE 2000", lambda g: text.event_year_of_text(g, "BIRT")) == year


def test_long_blocks(spark):
    """Every function of records on an event with many lines before what is looked for, within a small stack and linear time."""
    filler = F.repeat(F.lit("\n3 CONT some line"), MANY)
    record = F.concat(F.lit("0 @I@ INDI\n1 NAME A /B/\n1 BIRT"), filler, F.lit("\n2 PLAC Here, There\n3 MAP\n4 LATI N1.5\n2 DATE 3 MAY 1850\n2 CAUS old\n1 OCCU smith"), filler, F.lit("\n1 DEAT"), filler, F.lit("\n2 PLAC There\n1 BIRT"), filler, F.lit("\n2 PLAC Third")).alias("g")
    began = time.perf_counter()
    g = F.col("g")
    row = (
        spark.range(1)
        .select(record)
        .select(
            text.has_tag(g, "DEAT").alias("tag"),
            F.length(text.event_block(g, "BIRT")).alias("block"),
            F.size(text.event_blocks(g, "BIRT")).alias("blocks"),
            text.event_place(g, "BIRT").alias("place"),
            text.event_place(g, "DEAT").alias("late"),
            text.event_places(g, "BIRT").alias("places"),
            text.event_year_of_text(g, "BIRT").alias("year"),
            text.sub_value(text.event_block(g, "BIRT"), "CAUS").alias("cause"),
            text.coordinate(text.event_block(g, "BIRT"), "LATI").alias("lat"),
            text.tag_values(g, "OCCU").alias("jobs"),
            text.tag_values(g, "PLAC", 2).alias("all"),
            F.length(text.plain_name(g)).alias("plain"),
        )
        .first()
    )
    assert (row.tag, row.blocks, row.place, row.late, row.places, row.year, row.cause, row.lat, row.jobs) == (True, 2, "Here, There", "There", ["Here, There", "Third"], 1850, "old", 1.5, ["smith"])
    assert row.block > MANY * 17 and row.all == ["Here, There", "There", "Third"] and row.plain > 4 * MANY * 17
    assert time.perf_counter() - began < 60


def test_long_records_are_imported(spark, tmp_path):
    """Many lines within a name, before a date, and in a media file."""
    filler = "\n3 CONT some line" * MANY
    (tmp_path / "long.ged").write_text(f"0 HEAD\n0 @I@ INDI\n1 NAME Ann /Lee/{filler}\n2 GIVN Anna\n2 ROMN Annie /Li/{filler}\n3 SURN Ly\n1 BIRT{filler}\n2 DATE 3 MAY 1850\n2 PLAC X, Y\n1 DEAT\n2 NOTE none\n1 BURI\n2 DATE 1900\n0 @M@ OBJE\n1 FILE a.jpg{filler}\n2 FORM jpg\n3 TYPE Photo\n0 TRLR\n")
    tables = gedcom.read_tree(spark, str(tmp_path / "long.ged"))
    assert [(r.n_num, r.n_type, r.n_givn, r.n_surn) for r in tables["name"].orderBy("n_num").collect()] == [(0, "NAME", "Anna", "Lee"), (1, "ROMN", "Annie", "Ly")]
    assert sorted((r.d_fact, r.d_year, r.d_mon) for r in tables["dates"].collect()) == [("BIRT", 1850, 5), ("BURI", 1900, 0)]
    assert sorted(r.p_place for r in tables["places"].collect()) == ["X", "Y"] and [r.source_media_type for r in tables["media_file"].collect()] == ["photo"]


def test_name_forms(spark, tmp_path):
    """Parts after a source line belong to the name; a variant has its own; forms count in the order of their lines."""
    (tmp_path / "names.ged").write_text("0 @I@ INDI\n1 NAME Ann /Lee/\n2 SOUR @S@\n3 PAGE 4\n2 SURN Leigh\n2 FONE An /Li/\n3 GIVN Aan\n1 SEX F\n1 _MARNM Ann /Ray/\n1 NAME\n1 NAME /Only/\n1 NICK\n2 ROMN Nan\n0 TRLR\n")
    rows = gedcom.read_tree(spark, str(tmp_path / "names.ged"))["name"].orderBy("n_num").collect()
    assert [(r.n_num, r.n_type, r.n_givn, r.n_surn) for r in rows] == [(0, "NAME", "Ann", "Leigh"), (1, "FONE", "Aan", "Li"), (2, "_MARNM", "Ann", "Ray"), (3, "NAME", "@P.N.", "Only"), (4, "ROMN", "Nan", "@N.N.")]
