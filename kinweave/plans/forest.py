"""Metrics of many trees in one set of jobs: the tables hold all trees (tree_id), and every result has its tree_id.

Ids are unique within a tree only, so they are written with their tree in front. Joins by id then stay within a tree, and so do graph
loops, whose number of jobs doesn't depend on the number of trees. A metric is grouped by the tree that its ids name; a first-N list
is ranked within each tree, over slots first, so that a tree with most of the rows is ranked in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import calendar, text
from kinweave.functions.labels import DASH
from kinweave.operators import dates, graph
from kinweave.plans.metrics import DEAD, FORMS, Tree

_MARK = "\x1f"
#: The columns of each table that hold ids of a record or a place of its tree.
IDS = {"individuals": ("i_id",), "families": ("f_id", "f_husb", "f_wife"), "link": ("l_from", "l_to"), "name": ("n_id",), "dates": ("d_gid",), "places": ("p_id", "p_parent_id"), "placelinks": ("pl_gid", "pl_p_id"), "sources": ("s_id",), "media": ("m_id",), "media_file": ("m_id",), "other": ("o_id",)}


def qualified(table: str, df: DataFrame) -> DataFrame:
    """A table with its ids written as tree, mark, id; null, empty and 0 name nothing and stay."""
    own = lambda c: F.when(F.col(c).cast("string").isin("", "0"), F.col(c).cast("string")).otherwise(F.concat(F.col("tree_id").cast("string"), F.lit(_MARK), F.col(c).cast("string")))
    return df.withColumns({c: own(c) for c in IDS[table] if c in df.columns})


class Forest:
    """All trees of a folder's tables. Options are those of `Tree`."""

    def __init__(self, tables: dict[str, DataFrame], **options) -> None:
        self.all = Tree({name: qualified(name, df) for name, df in tables.items()}, **options)
        self.trees = tables["individuals"].select("tree_id").distinct()

    @staticmethod
    def of(df: DataFrame, ident: str, *others: str) -> DataFrame:
        """df with the tree_id that a qualified id names, and that id and others without it."""
        bare = lambda c: F.substring_index(F.col(c), _MARK, -1)
        return df.withColumn("tree_id", F.substring_index(F.col(ident), _MARK, 1).cast("int")).withColumns({c: bare(c) for c in (ident, *others)})

    def tally(self, rows: DataFrame, ident: str, *keys: Column) -> DataFrame:
        return self.of(rows, ident).groupBy("tree_id", *keys).agg(F.count("*").alias("n"))

    def first(self, counts: DataFrame, n: int, *order: Column, slots: int = 64) -> DataFrame:
        """The first n rows of each tree with their rank as ord (all if n <= 0): of each of a tree's slots first, then of what is left."""
        slot = F.pmod(F.xxhash64(*(c for c in counts.columns if c != "tree_id")), F.lit(slots))
        few = counts.withColumn("_slot", slot).withColumn("_k", F.row_number().over(Window.partitionBy("tree_id", "_slot").orderBy(*order)))
        few = few.where(F.col("_k") <= n) if n > 0 else few
        ranked = few.drop("_slot", "_k").withColumn("ord", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order)).cast("long"))
        return ranked.where(F.col("ord") <= n) if n > 0 else ranked

    def bands(self, rows: DataFrame, ident: str, value: Column, low: int, top: int, width: int) -> DataFrame:
        """tree_id, ord, label, n: see `hist.fixed_width`, zero-filled for every tree."""
        band = F.when(value >= top, top).when(value >= low, F.floor(value / width) * width).cast("long")
        counts = self.tally(rows, ident, band.alias("ord"))
        spine = self.trees.select("tree_id", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (low // width * width, top, width)))).alias("ord"))
        label = F.when(F.col("ord") >= top, F.concat(F.lit(str(top)), F.lit("+"))).otherwise(F.concat(F.col("ord"), F.lit(DASH), F.col("ord") + width - 1))
        return spine.join(counts, ["tree_id", "ord"], "left").select("tree_id", "ord", label.alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def dated(self, fact: str) -> DataFrame:
        """The first date of a fact of every record, with its year."""
        return dates.event_dates(self.all.dates, fact).withColumn("year", calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("d_julianday1")))

    def by_century(self, fact: str) -> DataFrame:
        return self.tally(self.dated(fact), "d_gid", calendar.century(F.col("year")).alias("century"))

    def by_month(self, fact: str) -> DataFrame:
        month = calendar.event_month(F.col("d_type"), F.col("d_mon"), F.col("d_julianday1")).cast("long")
        counts = self.tally(self.dated(fact).where("d_mon > 0"), "d_gid", month.alias("ord"))
        spine = self.trees.select("tree_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("ord"))
        return spine.join(counts, ["tree_id", "ord"], "left").select("tree_id", "ord", F.coalesce("n", F.lit(0)).alias("n"))

    def births_by_decade(self) -> DataFrame:
        counts = self.tally(self.dated("BIRT"), "d_gid", calendar.decade(F.col("year")).alias("decade"))
        ends = counts.groupBy("tree_id").agg(F.min("decade").alias("lo"), F.max("decade").alias("hi")).where("lo is not null")
        kind = dict(counts.dtypes)["decade"]
        spine = ends.select("tree_id", F.explode(F.sequence("lo", "hi", F.lit(10).cast(kind))).alias("decade"))
        return spine.join(counts, ["tree_id", "decade"], "left").select("tree_id", "decade", F.coalesce("n", F.lit(0)).alias("n"))

    def cumulative_births(self) -> DataFrame:
        upto = Window.partitionBy("tree_id").orderBy("decade").rowsBetween(Window.unboundedPreceding, 0)  # a row a decade
        return self.births_by_decade().withColumn("running", F.sum("n").over(upto))

    def age_at_death(self) -> DataFrame:
        return self.bands(self.all.lives, "d_gid", F.col("age"), 0, 100, 10)

    def deaths_pyramid(self) -> DataFrame:
        band = F.least(F.floor(F.col("age") / 10) * 10, F.lit(100))
        side = lambda s: F.sum((F.col("i_sex") == s).cast("long"))
        return self.of(self.all.lives, "d_gid").groupBy("tree_id", "century", band.alias("band")).agg(side("M").alias("left_n"), side("F").alias("right_n"))

    def oldest_deceased(self, n: int = 10) -> DataFrame:
        rows = self.of(self.all.lives.where("age > 0"), "d_gid").select("tree_id", F.col("d_gid").alias("xref"), F.col("age").alias("years"), "days")
        return self.first(rows, n, F.col("years").desc(), F.col("days").desc(), F.col("xref"))

    def living_and_dead(self) -> DataFrame:
        dead = text.has_prefix(F.col("i_gedcom"), *DEAD)
        return self.all.individuals.groupBy("tree_id").agg(F.sum((~dead).cast("long")).alias("living"), F.sum(dead.cast("long")).alias("deceased"))

    def source_coverage(self) -> DataFrame:
        cited = self.all.link.where("l_type = 'SOUR'").select(F.col("l_from").alias("i_id"), F.lit(1).alias("hit")).distinct()
        return self.all.individuals.join(cited, "i_id", "left").groupBy("tree_id").agg(F.count("hit").alias("value"), F.count("*").alias("total"))

    def children_per_family(self) -> DataFrame:
        return self.bands(self.all.families, "f_id", F.greatest(F.coalesce("f_numchil", F.lit(0)), F.lit(0)), 0, 10, 1)

    def largest_families(self, n: int = 10) -> DataFrame:
        return self.first(self.of(self.all.families.select("f_id", "f_numchil"), "f_id").select("tree_id", "f_id", "f_numchil"), n, F.col("f_numchil").desc(), F.col("f_id"))

    def top_surnames(self, n: int = 10) -> DataFrame:
        """Ranked by frequency, then shown by name, as in `Tree`."""
        rows = self.all.name.where(F.col("n_type").isin(*FORMS) & ~F.col("n_surn").isin("", "@N.N."))
        best = self.first(self.tally(rows, "n_id", F.col("n_surn").alias("surname")), n, F.col("n").desc(), F.col("surname"))
        return best.withColumn("ord", F.row_number().over(Window.partitionBy("tree_id").orderBy("surname")).cast("long"))

    def top_occupations(self, n: int = 10) -> DataFrame:
        """Keys by lower case; a key's label is the spelling of the least id."""
        rows = self.all.individuals.select("i_id", F.posexplode(text.tag_values(F.col("i_gedcom"), "OCCU")).alias("p", "v"))
        rows = self.of(rows, "i_id").groupBy("tree_id", F.lower("v").alias("key")).agg(F.min_by("v", F.struct("i_id", "p", "v")).alias("label"), F.count("*").alias("n"))
        return self.first(rows, n, F.col("n").desc(), F.col("key"))

    def generation_depth(self) -> DataFrame:
        depths = graph.depths(graph.parent_edges(self.all.parents))
        return self.of(depths, "node").groupBy("tree_id", "depth").agg(F.count("*").alias("n"), F.max("capped").alias("capped"))

    def islands(self) -> DataFrame:
        return self.of(self.all.islands(), "root").select("tree_id", "root", "size")

    def partner_groups(self, least: int = 3) -> DataFrame:
        return self.of(self.all.partner_groups(least), "root").select("tree_id", "root", "size")

    def longest_partner_chains(self) -> DataFrame:
        """tree_id, root, length, path of every partnership group of three or more."""
        edges = self.all.partner_edges()
        roots = graph.roots(edges)
        members = roots.groupBy("root").agg((F.count("*") + 1).alias("size")).where("size >= 3").select("root")
        of = roots.select(F.col("node").alias("u"), "root").unionByName(members.select(F.col("root").alias("u"), "root"))
        inside = edges.join(of, "u").join(members, "root")
        both = inside.select("root", "u", "v").unionByName(inside.select("root", F.col("v").alias("u"), F.col("u").alias("v")))
        bare = F.array_join(F.transform(F.split("path", ","), lambda x: F.substring_index(x, _MARK, -1)), ",")
        return self.of(graph.longest_chain(both), "root").select("tree_id", "root", "length", bare.alias("path"))

    def wire_rows(self) -> DataFrame:
        return self.of(self.all.wire_rows(), "xref")
