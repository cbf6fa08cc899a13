"""A small family file through the importer and the metrics."""

import pytest
from pyspark.sql import functions as F

from kinweave.plans.metrics import Tree
from kinweave.sources import gedcom

PEOPLE = [
    ("I1", "M", "Karl Otto /Berg/", "1 JAN 1850", "Bremen, Germany", "3 MAR 1910", "Boston, USA", None, ["F1"]),
    ("I2", "F", "Maria /Feld/", "BET 1852 AND 1854", "Bremen, Germany", "1920", "Boston, USA", None, ["F1"]),
    ("I3", "M", "Karl /Berg/", "5 MAY 1880", "Boston, USA", "6 MAY 1881", "Boston, USA", "F1", []),
    ("I4", "F", "Anna /Berg/", "6 MAY 1880", "Boston, USA", None, None, "F1", ["F2"]),
    ("I5", "M", "José \"Pepe\" /Rey/", "10 JUN 1875", "Madrid, Spain", "11 JUN 1950", "Madrid, Spain", None, ["F2"]),
    ("I6", "F", "Clara /Rey/", "1 FEB 1905", "Madrid, Spain", None, None, "F2", []),
    ("I7", "U", "Nobody", None, None, None, None, None, []),
]
FAMILIES = [("F1", "I1", "I2", ["I3", "I4"], "7 JUL 1878", None), ("F2", "I5", "I4", ["I6"], "1 JUN 1900", "2 JUN 1910")]


def file_text() -> str:
    out = ["0 HEAD", "1 CHAR UTF-8"]
    for xref, sex, name, born, bplace, died, dplace, famc, fams in PEOPLE:
        out += [f"0 @{xref}@ INDI", f"1 NAME {name}", f"1 SEX {sex}"]
        out += ["1 BIRT", f"2 DATE {born}", f"2 PLAC {bplace}"] if born else []
        out += ["1 DEAT", f"2 DATE {died}", f"2 PLAC {dplace}", "2 CAUS Fever"] if died else []
        out += ["1 OCCU Smith", "1 SOUR @S1@"] if sex == "M" else []
        out += [f"1 FAMC @{famc}@"] if famc else []
        out += [f"1 FAMS @{f}@" for f in fams]
    for xref, husb, wife, kids, marr, div in FAMILIES:
        out += [f"0 @{xref}@ FAM", f"1 HUSB @{husb}@", f"1 WIFE @{wife}@", *(f"1 CHIL @{k}@" for k in kids), "1 MARR", f"2 DATE {marr}"]
        out += ["1 DIV", f"2 DATE {div}"] if div else []
    return "\n".join([*out, "0 @S1@ SOUR", "1 TITL Book", "0 @N1@ NOTE text", "0 TRLR", ""])


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    (folder / "a.ged").write_text(file_text(), encoding="utf-8")
    gedcom.write_tables(gedcom.read_tree(spark, str(folder / "a.ged"), 7), str(folder / "tables"))
    return Tree(gedcom.tree_tables(spark, str(folder / "tables"), 7))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_import(tree):
    assert tree.individuals.count() == 7
    assert rows(tree.families, "f_id", "f_husb", "f_wife", "f_numchil") == [("F1", "I1", "I2", 2), ("F2", "I5", "I4", 1)]
    assert rows(tree.dates.where("d_gid = 'I2' and d_fact = 'BIRT'"), "d_year") == [(1852,), (1854,)]
    assert rows(tree.name.where("n_id = 'I1'"), "n_surn", "n_givn") == [("Berg", "Karl Otto")]
    assert {r[0] for r in rows(tree.places.where("p_parent_id = 0"), "p_place")} == {"Germany", "USA", "Spain"}


def test_tallies(tree):
    assert rows(tree.by_century("BIRT"), "century", "n") == [(19, 5), (20, 1)]
    assert dict(rows(tree.by_month("BIRT"), "ord", "n"))[5] == 2
    assert rows(tree.births_by_decade().where("n > 0"), "decade", "n") == [(1850, 2), (1870, 1), (1880, 2), (1900, 1)]
    assert rows(tree.cumulative_births().where("decade = 1900"), "running") == [(6,)]
    assert sum(n for _, n in rows(tree.births_by_zodiac(), "sign", "n")) == 5


def test_lives(tree):
    assert rows(tree.lives, "d_gid", "age") == [("I1", 60), ("I2", 68), ("I3", 1), ("I5", 75)]
    assert rows(tree.oldest_deceased(2), "ord", "xref", "years") == [(1, "I5", 75), (2, "I2", 68)]
    assert rows(tree.child_mortality(), "total", "died", "rate") == [(3, 1, 33.3)]
    assert rows(tree.age_at_death().where("n > 0"), "label", "n") == [("0–9", 1), ("60–69", 2), ("70–79", 1)]


def test_families(tree):
    assert rows(tree.marriage_durations(), "f_id", "years", "reason") == [("F1", 31, "death"), ("F2", 10, "divorce")]
    assert rows(tree.age_at_marriage(), "ord", "husbands", "wives") == [(20, 1, 1), (25, 1, 1)]
    assert rows(tree.multiple_births(), "size", "sets") == [(2, 1)]
    assert rows(tree.family_status(), "bucket", "n") == [("Divorced", 1), ("Single", 2)]
    assert rows(tree.grandchild_families(), "f_id", "n") == [("F1", 1)]
    assert rows(tree.children_per_family().where("n > 0"), "label", "n") == [("1–1", 1), ("2–2", 1)]
    assert rows(tree.couple_age_gaps().where("husband_older > 0"), "ord", "husband_older") == [(0, 2)]


def test_names_and_places(tree):
    assert rows(tree.top_surnames(1), "surname", "n") == [("Berg", 3)]
    assert rows(tree.top_given_names("M"), "form", "n") == [("José", 1), ("Karl", 2), ("Otto", 1), ("Pepe", 1)]
    assert rows(tree.tag_values("OCCU"), "label", "n") == [("Smith", 3)]
    assert rows(tree.top_death_causes(), "label", "n") == [("Fever", 4)]
    assert rows(tree.by_country("BIRT"), "country", "n") == [("Germany", 2), ("Spain", 2), ("USA", 2)]
    assert rows(tree.migration_flows(), "source", "target", "weight", "samples") == [("Germany", "USA", 2, "I1,I2")]
    assert rows(tree.surname_matrix().where("n > 0"), "row_label", "col_label", "n") == [("Berg", "Feld", 1), ("Berg", "Rey", 1), ("Feld", "Berg", 1), ("Rey", "Berg", 1)]


def test_health(tree):
    assert rows(tree.source_coverage(), "value", "total") == [(3, 7)]
    assert rows(tree.generation_depth(), "depth", "n") == [(0, 2), (1, 2), (2, 2)]
    assert rows(tree.top_ancestors(2), "ancestor", "n") == [("I1", 3), ("I2", 3)]
    assert rows(tree.endogamy(), "total") == [(0,)]
    assert rows(tree.islands(), "root", "size") == [("I1", 6), ("I7", 1)]
    assert rows(tree.inventory(), "record", "n") == [("NOTE", 1), ("families", 2), ("individuals", 7), ("media", 0), ("sources", 1)]
    assert rows(tree.generation_length(), "years")[0][0] == pytest.approx(28.4, abs=1)


def test_cohorts_and_trends(tree):
    assert sum(n for *_, n in rows(tree.heatmap("BIRT"), "period", "month", "n")) == 5
    assert rows(tree.winter_peak(), "score", "total") == [(None, 3)]
    assert rows(tree.sibling_death_clusters(), "year") == []
    assert rows(tree.first_child_ages(), "person", "age") == [("I1", 30), ("I2", 28), ("I4", 24), ("I5", 29)]
    assert rows(tree.age_at_first_child(), "ord", "fathers", "mothers") == [(20, 0, 1), (25, 1, 1), (30, 1, 0)]
    assert rows(tree.mean_age_at_first_child(1), "decade", "M", "F") == [(1880, 30.0, 28.0), (1900, 29.0, 24.0)]
    assert rows(tree.widowhood().where("n > 0"), "ord", "n") == [(10, 1)]
    assert rows(tree.remarriage_intervals(), "band") == []
    assert rows(tree.divorce_rate_by_cohort(), "decade") == []
    assert rows(tree.family_sizes_by_decade(), "decade", "one", "two") == [(1870, 0, 1), (1900, 1, 0)]
    assert rows(tree.mean_family_size_by_century(1), "century", "mean") == [(19, 1.5)]
    assert rows(tree.first_children_by_month().where("n > 0"), "ord", "n") == [(2, 1), (5, 1)]
    assert rows(tree.given_name_trends(1).where("n > 0"), "form", "decade", "n") == [("Karl", 1850, 1), ("Karl", 1880, 1)]
    assert rows(tree.given_name_last_year(1), "form", "last_year", "active") == [("Karl", 1880, False)]
    assert rows(tree.name_passdown(1), "century", "sex", "n", "share") == [(19, "F", 1, 0.0), (19, "M", 1, 100.0), (20, "F", 1, 0.0)]


def test_more_of_health(tree):
    assert rows(tree.occupation_inheritance(1), "source", "target", "weight", "samples") == [("Smith", "Smith", 1, "I3")]
    assert rows(tree.residences_by_country(), "country") == []
    assert rows(tree.source_coverage_by_century(5), "century", "n", "cited") == [(19, 5, 3)]
    assert rows(tree.missing_gaps(), "total", "no_birth", "no_birth_place", "no_death", "no_death_place") == [(7, 1, 1, 3, 3)]
    assert rows(tree.ancestor_counts(), "known", "n") == [(0, 4), (2, 2), (4, 1)]
    assert rows(tree.media_by_type(), "n") == []
    holders = dict((r[0], r[1:]) for r in rows(tree.records(), "slot", "value", "key"))
    assert holders["longest_marriage"] == (31, "F1") and holders["oldest_deceased"] == (75, "I5") and holders["youngest_mother"] == (24, "I4")
    assert rows(tree.hero(), "individuals", "families", "covered", "decade_from", "decade_to", "centuries") == [(7, 2, 3, 1850, 1900, 1)]


def test_totals_and_records(tree, spark):
    one = lambda df: tuple(df.first())
    assert [one(f())[0] for f in (tree.total_surnames, tree.total_given_names, tree.total_occupations, tree.total_religions, tree.total_death_causes)] == [3, 8, 1, 0, 1]
    assert one(tree.average_children()) == (1.5,) and one(tree.childless_families()) == (2, 0) and one(tree.living_and_dead()) == (3, 4)
    assert rows(tree.persons_by_sex(), "sex", "n") == [("F", 3), ("M", 3), ("U", 1)]
    assert rows(tree.countries_of("BIRT"), "country", "n") == [("Germany", 2), ("Spain", 2), ("USA", 2)]
    assert [r.xref for r in tree.oldest_living(5).orderBy("ord").collect()] == ["I4", "I6"]
    assert rows(tree.children_of_persons(), "person", "n") == [("I1", 2), ("I2", 2), ("I4", 1), ("I5", 1)]
    assert rows(tree.child_mortality_by_century(3), "century", "total", "died", "rate") == [(19, 3, 1, 33.3)]
    assert sum(r.n for r in tree.death_ages_by_century(4).collect()) == 4
    assert rows(tree.multiple_birth_rates(2), "century", "size", "children", "sets", "total", "rate") == [(19, 2, 2, 1, 2, 100.0)]
    assert one(tree.missing_marriages()) == (4, 0, 4)
    assert rows(tree.wire_rows(), "xref", "label", "birth")[0] == ("I1", "Karl Otto Berg", 1850) and tree.wire_rows().count() == 7
    assert rows(tree.island_ranking(1), "ord", "root", "size", "label", "islands", "persons", "rest") == [(1, "I1", 6, "Berg", 2, 7, 1)]
    assert rows(tree.partnership_reach(), "root") == []
    reach = dict(tree.tables) | {"families": tree.families.unionByName(tree.families.limit(1).selectExpr("tree_id", "'F9' as f_id", "'I3' as f_husb", "'I4' as f_wife", "0 as f_numchil", "'' as f_gedcom"))}
    assert rows(Tree(reach).partnership_reach(), "size", "edges", "hub", "degree", "length", "path", "median_year") == [(3, 2, "I4", 2, 3, "I3,I4,I5", 1880)]
    assert rows(tree.media_by_label(), "label") == []
    port = Tree(tree.tables, occupations=lambda v: v.select("v", F.lit("metal").alias("key"), F.lit("Metal worker").alias("label")))
    assert rows(port.top_occupations(), "label", "n") == [("Metal worker", 3)]
    assert dict((r[0], r[1:]) for r in rows(tree.records(), "slot", "value", "key"))["most_children"] == (2, "I1")
