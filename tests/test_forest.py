"""Metrics of three trees at once equal the union of those of each."""

import pytest
from pyspark.sql import functions as F

from kinweave.plans.forest import Forest
from kinweave.plans.metrics import Tree
from kinweave.sources import gedcom
from tests.test_tree import file_text

METRICS = [("by_century", ("BIRT",)), ("by_century", ("MARR",)), ("by_month", ("BIRT",)), ("births_by_decade", ()), ("cumulative_births", ()), ("age_at_death", ()), ("deaths_pyramid", ()), ("oldest_deceased", (2,)), ("living_and_dead", ()), ("source_coverage", ()), ("children_per_family", ()), ("largest_families", (1,)), ("top_surnames", (2,)), ("top_occupations", (1,)), ("generation_depth", ()), ("islands", ()), ("partner_groups", (2,)), ("wire_rows", ())]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The same ids in all three: one as it is, one with other years and names, one with a person alone."""
    at = tmp_path_factory.mktemp("forest")
    texts = {7: file_text(), 8: file_text().replace("18", "17").replace("/Berg/", "/Thal/").replace("1 CHIL @I3@\n", "").replace("Smith", "smith"), 12: "0 HEAD\n0 @I1@ INDI\n1 NAME A /B/\n1 BIRT\n2 DATE 1700\n0 TRLR\n"}
    for tree, text in texts.items():
        (at / f"{tree}.ged").write_text(text, encoding="utf-8")
        gedcom.write_tables(gedcom.read_tree(spark, str(at / f"{tree}.ged"), tree), str(at / "tables"))
    return str(at / "tables")


@pytest.fixture(scope="module")
def forest(spark, folder):
    return Forest({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("individuals", "families", "link", "name", "dates", "places", "placelinks")})


@pytest.mark.parametrize("name, options", METRICS)
def test_all_trees_at_once(spark, folder, forest, name, options):
    got = getattr(forest, name)(*options)
    columns = [c for c in got.columns if c != "tree_id"]
    expected = []
    for tree in (7, 8, 12):
        one = getattr(Tree(gedcom.tree_tables(spark, folder, tree)), name)(*options)
        assert set(one.columns) - {"tree_id"} == set(columns)
        expected += [(tree, *r) for r in one.select(*columns).collect()]
    assert sorted((tuple(r) for r in got.select("tree_id", *columns).collect()), key=str) == sorted(expected, key=str)


def test_chains_of_all_groups(spark, forest):
    got = {(r.tree_id, r.root): (r.length, r.path) for r in forest.longest_partner_chains().collect()}
    assert got == {}  # the couples of these files are groups of two
    pairs = [(t, f"F{k}", f"I{k}", f"I{k + 1}") for t, n in ((1, 4), (2, 7)) for k in range(1, n)]
    people = spark.createDataFrame([(t, f"I{k}", "M", "") for t, n in ((1, 4), (2, 7)) for k in range(1, n + 1)], "tree_id int, i_id string, i_sex string, i_gedcom string")
    two = Forest({"individuals": people, "families": spark.createDataFrame(pairs, "tree_id int, f_id string, f_husb string, f_wife string")})
    rows = two.longest_partner_chains().orderBy("tree_id").collect()
    assert [(r.tree_id, r.root, r.length, r.path) for r in rows] == [(1, "I1", 4, "I1,I2,I3,I4"), (2, "I1", 7, "I1,I2,I3,I4,I5,I6,I7")]
    assert {tuple(r) for r in two.partner_groups().collect()} == {(1, "I1", 4), (2, "I1", 7)}
    assert two.all.families.where(F.col("f_husb") == "I1").count() == 0
