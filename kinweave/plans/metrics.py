"""Metrics of one tree, each a DataFrame composed from the operators. `Tree` holds the tables; what a clock or a preference would
give (today as a Julian day, the greatest plausible age, the reference year) is a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import calendar, geo, labels, text
from kinweave.operators import dates, flow, graph, hist, rank, series
from kinweave.operators.tables import written
from kinweave.sources import gazetteer

DEAD = ("DEAT", "BURI", "CREM")
FORMS = ("NAME", "ROMN", "FONE", "_HEB")


def day(c: str) -> Column:
    return calendar.date_of(F.col(c))


@dataclass(frozen=True)
class Bands:
    """What is plausible, in whole years, both ends included."""

    spouse: tuple[int, int] = (10, 90)
    parent: tuple[int, int] = (12, 65)
    marriage: int = 90


@dataclass
class Tree:
    tables: dict[str, DataFrame]
    today: int = 2460000
    max_age: int = 120
    reference_year: int = 2023
    countries: dict[str, str] = field(default_factory=dict)
    bands: Bands = Bands()
    #: From distinct values (v) to v, key, label; values without one keep themselves, by their lower case.
    occupations: Callable[[DataFrame], DataFrame] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.__dict__.get("tables", {}):
            raise AttributeError(name)
        return self.tables[name]

    # Shared frames

    @cached_property
    def lives(self) -> DataFrame:
        """d_gid, i_sex, birth, death, year, century, age, days: births and deaths with death after birth and a plausible age."""
        both = dates.birth_death(self.dates).where("death > birth").join(self.individuals.select(F.col("i_id").alias("d_gid"), "i_sex"), "d_gid")
        rows = both.withColumns({"year": calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("birth")), "age": calendar.whole_years(day("birth"), day("death")), "days": F.col("death") - F.col("birth")})
        return rows.where((F.col("year") != 0) & F.col("age").between(0, self.max_age)).withColumn("century", calendar.century(F.col("year")))

    @cached_property
    def parents(self) -> DataFrame:
        famc = self.link.where("l_type = 'FAMC'").select(F.col("l_from").alias("child"), F.col("l_to").alias("family"))
        couples = self.families.select(F.col("f_id").alias("family"), F.nullif("f_husb", F.lit("")).alias("father"), F.nullif("f_wife", F.lit("")).alias("mother"))
        return graph.parent_map(famc.join(couples, "family"))

    def couples(self) -> DataFrame:
        return self.families.where("f_husb <> '' and f_wife <> ''").select("f_id", "f_husb", "f_wife")

    def extreme(self, fact: str, column: str = "d_julianday1", largest: bool = False, key: str = "d_gid", name: str = "jd") -> DataFrame:
        return dates.extreme(self.dates, fact, column, largest, name).withColumnRenamed("d_gid", key)

    def spouses(self) -> DataFrame:
        """f_id, person, sex: either side of a family, unpivoted, so that joins stay equi-joins."""
        sides = F.explode(F.array(F.struct(F.col("f_husb").alias("person"), F.lit("M").alias("sex")), F.struct(F.col("f_wife").alias("person"), F.lit("F").alias("sex"))))
        return self.families.select("f_id", sides.alias("s")).select("f_id", "s.person", "s.sex").where("person <> ''")

    # Tallies

    def by_century(self, fact: str) -> DataFrame:
        year = calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("d_julianday1"))
        return dates.event_dates(self.dates, fact).groupBy(calendar.century(year).alias("century")).agg(F.count("*").alias("n"))

    def by_month(self, fact: str) -> DataFrame:
        rows = dates.event_dates(self.dates, fact).where("d_mon > 0")
        month = calendar.event_month(F.col("d_type"), F.col("d_mon"), F.col("d_julianday1"))
        counts = rows.groupBy(month.cast("long").alias("ord")).agg(F.count("*").alias("n")).where("ord between 1 and 12")
        return hist.spine(rows, 1, 12).join(counts, "ord", "left").fillna(0, ["n"])

    def births_by_zodiac(self) -> DataFrame:
        rows = dates.event_dates(self.dates, "BIRT").where("d_mon <> 0 and d_day <> 0")
        args = [F.col("d_type"), F.col("d_julianday1")]
        sign = calendar.zodiac(calendar.event_month(args[0], F.col("d_mon"), args[1]), calendar.event_day(args[0], F.col("d_day"), args[1]))
        return rows.groupBy(sign.alias("sign")).agg(F.count("*").alias("n"))

    def births_by_decade(self) -> DataFrame:
        year = calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("d_julianday1"))
        counts = dates.event_dates(self.dates, "BIRT").groupBy(calendar.decade(year).alias("decade")).agg(F.count("*").alias("n"))
        return series.dense(counts, "decade", "n", 10)

    def cumulative_births(self) -> DataFrame:
        return series.running_total(self.births_by_decade(), "decade", "n")

    def age_at_death(self) -> DataFrame:
        return hist.fixed_width(self.lives, F.col("age"), 0, 100, 10)

    def lifespan_by_sex_and_century(self, floor: int = 5) -> DataFrame:
        rows = self.lives.where("i_sex in ('M', 'F') and age > 0").groupBy("century", "i_sex").agg(F.count("*").alias("n"), F.avg("age").alias("mean"))
        shown = rows.withColumn("mean", F.when(F.col("n") >= floor, F.round("mean", 1)).otherwise(0.0))
        return shown.groupBy("century").pivot("i_sex", ["M", "F"]).agg(F.first("mean")).fillna(0.0).where("M > 0 or F > 0")

    def survival_by_century(self, floor: int = 30) -> DataFrame:
        steps = range(0, 101, 10)
        wide = self.lives.groupBy("century").agg(F.count("*").alias("n"), *(F.sum((F.col("age") >= s).cast("long")).alias(f"s{s}") for s in steps)).where(F.col("n") >= floor)
        return wide.select("century", F.explode(F.array(*(F.struct(F.lit(s).alias("age"), F.round(F.col(f"s{s}") * 100.0 / F.col("n"), 1).alias("share")) for s in steps))).alias("x")).select("century", "x.*")

    def deaths_pyramid(self) -> DataFrame:
        band = F.least(F.floor(F.col("age") / 10) * 10, F.lit(100))
        side = lambda s: F.sum((F.col("i_sex") == s).cast("long"))
        return self.lives.groupBy("century", band.alias("band")).agg(side("M").alias("left_n"), side("F").alias("right_n"))

    def child_mortality(self) -> DataFrame:
        full = self.dates.where("d_julianday1 > 0 and d_mon > 0 and d_day > 0")
        born = dates.extreme(full, "BIRT", "d_julianday1", False, "birth").join(dates.extreme(full, "DEAT", "d_julianday1", False, "death"), "d_gid").where("death >= birth")
        died = F.coalesce(F.sum((F.col("death") - F.col("birth") < 1826).cast("long")), F.lit(0))
        return born.agg(F.count("*").alias("total"), died.alias("died")).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("died") * 100.0 / F.col("total"), 1)))

    def mortality_anomalies(self) -> DataFrame:
        native = self.dates.where(F.col("d_type").isin(*calendar.NATIVE) & (F.col("d_fact") == "DEAT") & (F.col("d_year") > 0))
        years = native.groupBy(F.col("d_year").alias("year")).agg(F.countDistinct("d_gid").alias("deaths"))
        return series.anomalies(series.dense(years, "year", "deaths"), "year", "deaths")

    def mortality_events(self, catalogue: DataFrame, least: int = 2, n: int = 2) -> DataFrame:
        """The anomalous years with the events (see `gazetteer.events_of`) of the countries where at least `least` persons died then."""
        anomalies = self.mortality_anomalies()
        native = self.dates.where(F.col("d_type").isin(*calendar.NATIVE) & (F.col("d_fact") == "DEAT")).select("d_gid", F.col("d_year").alias("year"))
        place = self.individuals.select(F.col("i_id").alias("d_gid"), self.country(text.event_place(F.col("i_gedcom"), "DEAT")).alias("country")).where("country is not null")
        died = native.join(anomalies.select("year"), "year", "left_semi").join(place, "d_gid")
        several = died.groupBy("year", "country").agg(F.countDistinct("d_gid").alias("n")).where(F.col("n") >= least)
        found = gazetteer.events_of(several.groupBy("year").agg(F.collect_list("country").alias("countries")), catalogue, n)
        return anomalies.join(found, "year", "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))

    def oldest_deceased(self, n: int = 10) -> DataFrame:
        return rank.top(self.lives.where("age > 0").select(F.col("d_gid").alias("xref"), F.col("age").alias("years"), "days"), n, F.col("years").desc(), F.col("days").desc(), F.col("xref"))

    def living_by_age_band(self) -> DataFrame:
        alive = self.individuals.select(F.col("i_id").alias("d_gid")).join(self.dates.where("d_fact = 'DEAT'"), "d_gid", "left_anti")
        rows = alive.join(self.extreme("BIRT", name="birth"), "d_gid").where(F.col("birth") <= self.today)
        age = calendar.whole_years(day("birth"), calendar.date_of(F.lit(self.today)))
        band = F.when(age <= 17, "0–17").when(age <= 35, "18–35").when(age <= 65, "36–65").otherwise("65+")
        return rows.where(age <= self.max_age).groupBy(band.alias("band")).agg(F.count("*").alias("n"))

    # Marriages and families

    def age_at(self, fact: str, low: int, top: int, width: int, column: str = "d_julianday1", largest: bool = False) -> DataFrame:
        """Husbands' and wives' ages at a family fact, ends at which both are 0 cut off."""
        rows = self.spouses().join(self.extreme(fact, column, largest, "f_id", "at"), "f_id").join(self.extreme("BIRT", key="person", name="birth"), "person").where("at > birth")
        age = calendar.whole_years(day("birth"), day("at"))
        side = lambda s, name: hist.fixed_width(rows.where(F.col("sex") == s), age, low, top, width).select("ord", F.col("n").alias(name))
        return hist.drop_zero_ends(side("M", "husbands").join(side("F", "wives"), "ord"), "ord", "husbands", "wives")

    def age_at_marriage(self) -> DataFrame:
        return self.age_at("MARR", 0, 60, 5, "d_julianday2", True)

    def age_at_divorce(self) -> DataFrame:
        return self.age_at("DIV", 0, 80, 10)

    def marriage_durations(self) -> DataFrame:
        """f_id, days, years, end: from the marriage to the first of divorce and either death after it."""
        rows = self.families.select("f_id", "f_husb", "f_wife").join(self.extreme("MARR", key="f_id", name="marr"), "f_id")
        for fact, key, name in (("DIV", "f_id", "div"), ("DEAT", "f_husb", "husb"), ("DEAT", "f_wife", "wife")):
            rows = rows.join(self.extreme(fact, key=key, name=name), key, "left")
        rows = rows.withColumn("end", dates.earliest_after(F.col("marr"), F.col("div"), F.col("husb"), F.col("wife"))).where("end is not null")
        reason = F.when(F.col("end") == F.col("div"), "divorce").otherwise("death")
        return rows.select("f_id", (F.col("end") - F.col("marr")).alias("days"), calendar.whole_years(day("marr"), day("end")).alias("years"), reason.alias("reason")).where(F.col("years") <= self.bands.marriage)

    def marriage_duration_extremes(self, n: int = 3) -> DataFrame:
        return rank.two_ended(self.marriage_durations(), "days", "f_id", n)

    def couple_age_gaps(self) -> DataFrame:
        rows = self.couples().join(self.extreme("BIRT", key="f_husb", name="his"), "f_husb").join(self.extreme("BIRT", key="f_wife", name="hers"), "f_wife")
        gap = calendar.whole_years(day("his"), day("hers"))
        band = F.least(F.floor(gap / 5) * 5, F.lit(30)).cast("long")
        counts = rows.where("his <> hers").groupBy(band.alias("ord")).agg(F.sum((F.col("his") < F.col("hers")).cast("long")).alias("husband_older"), F.sum((F.col("his") > F.col("hers")).cast("long")).alias("wife_older"))
        return hist.spine(rows, 0, 30, 5).join(counts, "ord", "left").fillna(0)

    def children_per_family(self) -> DataFrame:
        n = F.greatest(F.coalesce("f_numchil", F.lit(0)), F.lit(0))
        return hist.fixed_width(self.families, n, 0, 10, 1)

    def family_status(self) -> DataFrame:
        """bucket, n: every living person once, current before divorced before widowed before single."""
        living = self.individuals.where(~F.expr(" or ".join(f"contains(i_gedcom, '\\n1 {t}')" for t in DEAD)))
        dead = self.individuals.select(F.col("i_id").alias("partner"), text.has_tag(F.col("i_gedcom"), *DEAD).alias("partner_dead"))
        g = F.col("f_gedcom")
        flags = self.families.select("f_id", "f_husb", "f_wife", text.has_tag(g, "MARR").alias("married"), text.has_tag(g, "DIV", "ANUL").alias("ended"))
        fams = self.link.where("l_type = 'FAMS'").select(F.col("l_from").alias("i_id"), F.col("l_to").alias("f_id"))
        of = fams.join(flags, "f_id").withColumn("partner", F.when(F.col("f_husb") == F.col("i_id"), F.col("f_wife")).otherwise(F.col("f_husb"))).join(dead, "partner", "left")
        state = F.when(F.col("ended"), 2).when(F.col("married") & F.col("partner_dead").isNotNull(), F.when(F.col("partner_dead"), 1).otherwise(3)).otherwise(0)
        best = of.groupBy("i_id").agg(F.max(state).alias("s"))
        bucket = F.when(F.col("s") == 3, "Married").when(F.col("s") == 2, "Divorced").when(F.col("s") == 1, "Widowed").otherwise("Single")
        return living.select("i_id").join(best, "i_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))

    def sex_ratio_anomalies(self, least: int = 6, share: float = 0.8, n: int = 10) -> DataFrame:
        children = self.link.where("l_type = 'FAMC'").select(F.col("l_from").alias("i_id"), F.col("l_to").alias("f_id")).distinct().join(self.individuals.select("i_id", "i_sex"), "i_id").join(self.families.select("f_id"), "f_id", "left_semi")
        side = lambda s: F.sum((F.col("i_sex") == s).cast("long"))
        rows = children.groupBy("f_id").agg(side("M").alias("sons"), side("F").alias("daughters"))
        return rank.top(rank.skewed(rows, "f_id", "sons", "daughters", least, share), n, F.col("skew").desc(), F.col("total").desc(), F.col("f_id")).select("ord", "f_id", "sons", "daughters")

    def sibling_gaps(self) -> DataFrame:
        full = self.dates.where("d_mon > 0 and d_day > 0")
        born = dates.extreme(full, "BIRT", "d_julianday1", False, "jd")
        rows = self.link.where("l_type = 'FAMC'").select(F.col("l_to").alias("f_id"), F.col("l_from").alias("d_gid")).distinct().join(born, "d_gid")
        rows = series.gaps(rows.select("f_id", "jd", "d_gid"), "f_id", "jd", "d_gid").where("before is not null")
        return hist.fixed_width(rows, calendar.whole_years(calendar.date_of(F.col("before.jd")), day("jd")), 0, 10, 1)

    def multiple_births(self) -> DataFrame:
        full = self.dates.where("d_mon > 0 and d_day > 0")
        born = dates.extreme(full, "BIRT", "d_julianday1", False, "jd")
        rows = self.link.where("l_type = 'FAMC'").select(F.col("l_to").alias("f_id"), F.col("l_from").alias("d_gid")).distinct().join(born, "d_gid")
        return series.anchored_clusters(rows, "f_id", F.col("jd").cast("long"), 1).where("size >= 2").groupBy("size").agg(F.count("*").alias("sets"))

    def largest_families(self, n: int = 10) -> DataFrame:
        return rank.top(self.families.select("f_id", "f_numchil"), n, F.col("f_numchil").desc(), F.col("f_id"))

    def grandchild_families(self, n: int = 10) -> DataFrame:
        child = self.link.where("l_type = 'CHIL'").select(F.col("l_from").alias("f_id"), F.col("l_to").alias("c"))
        fams = self.link.where("l_type = 'FAMS'").select(F.col("l_from").alias("c"), F.col("l_to").alias("g"))
        many = child.groupBy(F.col("f_id").alias("g")).agg(F.count("*").alias("k"))
        return rank.top(child.join(fams, "c").join(many, "g").groupBy("f_id").agg(F.sum("k").alias("n")), n, F.col("n").desc(), F.col("f_id"))

    # Names

    def top_surnames(self, n: int = 10, least: int = 1) -> DataFrame:
        rows = self.name.where(F.col("n_type").isin(*FORMS) & ~F.col("n_surn").isin("", "@N.N."))
        counts = rows.groupBy(F.col("n_surn").alias("surname")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return rank.top_by_label(counts, n, "surname", F.col("n").desc(), F.col("surname"))

    def first_surnames(self) -> DataFrame:
        """n_id, n_surn of each person's primary name; of several, the least."""
        rows = self.name.where("n_num = 0 and n_surn not in ('', '@N.N.')")
        return rows.groupBy("n_id").agg(F.min("n_surn").alias("n_surn"))

    def total_surnames(self) -> DataFrame:
        rows = self.name.where(F.col("n_type").isin(*FORMS) & ~F.col("n_surn").isin("", "@N.N."))
        return rows.agg(F.countDistinct("n_surn").alias("total"))

    def total_given_names(self) -> DataFrame:
        tokens = self.name.where("n_num = 0 and length(n_givn) > 1").select(F.explode(text.given_tokens(F.col("n_givn"))).alias("form"))
        return tokens.select(text.folded(F.col("form")).alias("key")).agg(F.countDistinct("key").alias("total"))

    def top_given_names(self, sex: str, n: int = 10) -> DataFrame:
        people = self.individuals.where(F.col("i_sex") == sex).select(F.col("i_id").alias("n_id"))
        tokens = self.name.where("n_num = 0 and length(n_givn) > 1").join(people, "n_id", "left_semi").select("n_id", F.explode(text.given_tokens(F.col("n_givn"))).alias("form"))
        keyed = tokens.withColumn("key", text.folded(F.col("form")))
        counts = keyed.select("n_id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"))
        return rank.top(counts.join(rank.dominant(keyed, "key", "form"), "key"), n, F.col("n").desc(), F.col("key"))

    def surname_matrix(self, n: int = 8) -> DataFrame:
        first = self.first_surnames()
        rows = self.couples().join(first.toDF("f_husb", "a"), "f_husb").join(first.toDF("f_wife", "b"), "f_wife")
        return flow.pair_matrix(rows, "a", "b", n)

    def tag_counts(self, *levels: tuple[str, int]) -> DataFrame:
        """key, label, n of the values of tags at their levels, those of the first level first."""
        values = F.concat(*(text.tag_values(F.col("i_gedcom"), tag, level) for tag, level in levels))
        rows = self.individuals.select("i_id", F.posexplode(values).alias("p", "v"))
        return rank.folded_counts(rows, F.col("v"), F.struct("i_id", "p"))

    def tag_values(self, tag: str, n: int = 10) -> DataFrame:
        return self.most(self.tag_counts((tag, 1)), n)

    @staticmethod
    def most(counts: DataFrame, n: int) -> DataFrame:
        return rank.top(counts, n, F.col("n").desc(), F.col("key"))

    def occupation_counts(self) -> DataFrame:
        """key, label, n of every occupation line, by the normalizer where there is one; the label is the one met first."""
        rows = self.individuals.select("i_id", F.posexplode(text.tag_values(F.col("i_gedcom"), "OCCU")).alias("p", "v"))
        rows = rank.normalized(rows, "v", self.occupations)
        return rank.merged_keys(rows, F.struct("i_id", "p"))

    def top_occupations(self, n: int = 10) -> DataFrame:
        return self.most(self.occupation_counts(), n)

    def total_occupations(self) -> DataFrame:
        return rank.distinct_total(self.occupation_counts())

    def religion_counts(self) -> DataFrame:
        """Level-1 religions and those of events (level 2)."""
        return self.tag_counts(("RELI", 1), ("RELI", 2))

    def top_religions(self, n: int = 10) -> DataFrame:
        return self.most(self.religion_counts(), n)

    def total_religions(self) -> DataFrame:
        return rank.distinct_total(self.religion_counts())

    def death_cause_counts(self) -> DataFrame:
        rows = self.individuals.select("i_id", text.sub_value(text.event_block(F.col("i_gedcom"), "DEAT"), "CAUS").alias("v"))
        return rank.folded_counts(rows, F.col("v"), F.col("i_id"))

    def top_death_causes(self, n: int = 10) -> DataFrame:
        return self.most(self.death_cause_counts(), n)

    def total_death_causes(self) -> DataFrame:
        return rank.distinct_total(self.death_cause_counts())

    # Places

    def country(self, place: Column) -> Column:
        """The last part of a place, by the alias map (lower case) where there is one."""
        last = F.trim(F.element_at(F.split(place, ","), -1))
        known = F.create_map(*(F.lit(x) for kv in self.countries.items() for x in kv)) if self.countries else None
        return F.coalesce(F.try_element_at(known, F.lower(last)), last) if known is not None else F.nullif(last, F.lit(""))

    def by_country(self, tag: str) -> DataFrame:
        places = self.individuals.select(self.country(text.event_place(F.col("i_gedcom"), tag)).alias("country")).where("country is not null")
        return rank.top(places.groupBy("country").agg(F.count("*").alias("n")), 0, F.col("n").desc(), F.col("country"))

    def migration_flows(self, n: int = 20) -> DataFrame:
        g = F.col("i_gedcom")
        rows = self.individuals.select("i_id", self.country(text.event_place(g, "BIRT")).alias("a"), self.country(text.event_place(g, "DEAT")).alias("b")).where("a <> b")
        return flow.flows(rows, "a", "b", F.col("i_id"), F.col("i_id"), F.lit(True), n)

    def place_dispersion(self) -> DataFrame:
        found = F.regexp_extract_all("i_gedcom", F.lit(r"\n2 PLAC +([^\n]*)"), F.lit(1))
        n = F.size(F.array_distinct(F.filter(F.transform(found, lambda v: F.trim(v)), lambda p: p != "")))
        return hist.fixed_width(self.individuals.where(n > 0), n, 1, 5, 1)

    def migration_distances(self, floor: int = 5) -> DataFrame:
        """band, n: distances from birth to death. Every step is a column of its own that the next reads by name, and persons without
        a distance go after the count: a filter would be pushed below and repeat all of the reading for each mention."""
        tags = [(t, c) for t in ("BIRT", "DEAT") for c in ("LATI", "LONG")]
        rows = self.individuals.select(*(text.event_block(F.col("i_gedcom"), t).alias(t) for t in ("BIRT", "DEAT")))
        rows = rows.select(*(text.coordinate(F.col(t), c).alias(t + c) for t, c in tags))
        rows = rows.select(geo.haversine_km(*(F.col(t + c) for t, c in tags)).alias("km"))
        counts = rows.groupBy(geo.distance_band(F.col("km")).alias("band")).agg(F.count("km").alias("n")).where("n > 0")
        return counts.withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1)))).where(F.col("all") >= floor).drop("all")

    # Tree health

    def source_coverage(self) -> DataFrame:
        cited = self.individuals.join(self.link.where("l_type = 'SOUR'").select(F.col("l_from").alias("i_id")), "i_id", "left_semi")
        return cited.agg(F.count("*").alias("value")).crossJoin(self.individuals.agg(F.count("*").alias("total")))

    def generation_length(self) -> DataFrame:
        year = text.event_year_of_text(F.col("i_gedcom"), "BIRT")
        born = self.individuals.select("i_id", year.alias("year")).where("year is not null")
        sides = self.spouses().select("f_id", F.col("person").alias("parent"))
        child = self.link.where("l_type = 'CHIL'").select(F.col("l_from").alias("f_id"), F.col("l_to").alias("child"))
        rows = sides.join(child, "f_id").join(born.toDF("parent", "py"), "parent").join(born.toDF("child", "cy"), "child").where("cy > py")
        return rows.agg(F.avg(F.col("cy") - F.col("py")).alias("years"))

    def pedigree_completeness(self, generations: int = 4) -> DataFrame:
        persons = self.individuals.select(F.col("i_id").alias("person"))
        return graph.completeness(self.parents, persons, generations).agg(F.round(F.avg("share"), 4).alias("value"))

    def generation_depth(self) -> DataFrame:
        edges = graph.parent_edges(self.parents)
        return graph.depths(edges).groupBy("depth").agg(F.count("*").alias("n"), F.max("capped").alias("capped"))

    def top_ancestors(self, n: int = 10) -> DataFrame:
        counts = graph.top_descendants(graph.parent_edges(self.parents), n)
        return rank.top(counts, n, F.col("n").desc(), F.col("ancestor"))

    def endogamy(self, generations: int = 4) -> DataFrame:
        couples = self.couples().select(F.col("f_id").alias("couple"), F.col("f_husb").alias("a"), F.col("f_wife").alias("b"))
        rows = graph.shared_ancestry(couples, self.parents, generations).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("endogamous").cast("long")), F.lit(0)).alias("endogamous"))
        return rows.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("endogamous") * 100.0 / F.col("total"), 1)))

    def islands(self) -> DataFrame:
        return self.island_members().groupBy("root").agg(F.count("*").alias("size"))

    def island_members(self) -> DataFrame:
        """node, root of every person."""
        people = self.individuals.select(F.col("i_id").alias("node"))
        child = self.link.where("l_type = 'FAMC'").select(F.col("l_to").alias("f_id"), F.col("l_from").alias("person"))
        member = self.spouses().select("f_id", "person").unionByName(child).join(people.withColumnRenamed("node", "person"), "person", "left_semi").join(self.families.select("f_id"), "f_id", "left_semi")
        low = member.groupBy("f_id").agg(F.min("person").alias("v"))
        return graph.components(member.join(low, "f_id").select(F.col("person").alias("u"), "v"), people)

    def island_ranking(self, n: int = 10) -> DataFrame:
        """ord, root, size, label (the most frequent first surname, of equals the least), islands, persons, rest: the n largest, and totals."""
        members = written(self.island_members(), "islands")
        sizes = members.groupBy("root").agg(F.count("*").alias("size"))
        best = written(rank.top(sizes, n, F.col("size").desc(), F.col("root")), "largest")
        named = members.join(F.broadcast(best.select("root")), "root").join(self.first_surnames().toDF("node", "surname"), "node")
        totals = sizes.agg(F.count("*").alias("islands"), F.sum("size").alias("persons"))
        shown = best.agg(F.sum("size").alias("shown"))
        out = best.join(rank.dominant(named, "root", "surname"), "root", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(shown))
        return out.select("ord", "root", "size", F.coalesce("surname", F.lit("")).alias("label"), "islands", "persons", (F.col("persons") - F.col("shown")).alias("rest"))

    def partnership_reach(self, most: int = 70) -> DataFrame:
        """root, size, edges, hub, degree, length, path, median_year of the largest partnership group of three or more; no row without one.

        median_year: the lower median of its members' birth and death years.
        """
        edges = self.partner_edges()
        roots = written(graph.roots(edges), "roots", merge=True)
        largest = roots.groupBy("root").agg((F.count("*") + 1).alias("size")).where("size >= 3").orderBy(F.col("size").desc(), "root").limit(1)
        largest = written(largest, "largest")  # one row
        of = roots.select(F.col("node").alias("u"), "root").unionByName(largest.select(F.col("root").alias("u"), "root"))
        inside = edges.join(of, "u").join(F.broadcast(largest.select("root")), "root")
        both = written(inside.select("root", "u", "v").unionByName(inside.select("root", F.col("v").alias("u"), F.col("u").alias("v"))), "group")
        members = both.select(F.col("u").alias("d_gid")).distinct()
        years = self.dates.where("d_fact in ('BIRT', 'DEAT') and d_year <> 0").groupBy("d_gid", "d_fact").agg(F.min_by(F.struct("d_type", "d_year", "d_julianday1"), "d_julianday1").alias("r"))
        years = years.join(members, "d_gid", "left_semi").select(calendar.event_year(F.col("r.d_type"), F.col("r.d_year"), F.col("r.d_julianday1")).alias("year"))
        median = years.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY year)").cast("long").alias("median_year"))
        out = largest.join(graph.edge_count(both), "root").join(graph.hub(both), "root").join(graph.longest_chain(both), "root")
        return out.crossJoin(F.broadcast(median))

    def partner_edges(self) -> DataFrame:
        return self.couples().where("f_husb <> f_wife").select(F.greatest("f_husb", "f_wife").alias("u"), F.least("f_husb", "f_wife").alias("v")).distinct()

    def partner_groups(self, least: int = 3) -> DataFrame:
        edges = self.couples().where("f_husb <> f_wife").select(F.col("f_husb").alias("u"), F.col("f_wife").alias("v")).distinct()
        nodes = edges.select(F.explode(F.array("u", "v")).alias("node"))
        return graph.components(edges, nodes).groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= least)

    def longest_partner_chain(self) -> DataFrame:
        edges = self.couples().where("f_husb <> f_wife").select(F.col("f_husb").alias("u"), F.col("f_wife").alias("v")).distinct()
        roots = written(graph.roots(edges), "roots", merge=True)
        largest = roots.groupBy("root").agg(F.count("*").alias("size")).where("size >= 3").orderBy(F.col("size").desc(), "root").limit(1).select("root")
        inside = edges.join(roots.withColumnRenamed("node", "u"), "u").join(F.broadcast(largest), "root")
        return graph.longest_chain(inside.select("root", "u", "v").unionByName(inside.select("root", F.col("v").alias("u"), F.col("u").alias("v"))))

    # Persons and families in numbers

    def countries_of(self, tag: str) -> DataFrame:
        """ord, country, n of the persons linked to a root place in which the first event's place lies."""
        top = self.places.where("p_parent_id = 0").select(F.col("p_id").alias("pl_p_id"), "p_place")
        rows = self.placelinks.join(top, "pl_p_id").join(self.individuals.select(F.col("i_id").alias("pl_gid"), "i_gedcom"), "pl_gid")
        rows = rows.where(text.in_country(text.event_place(F.col("i_gedcom"), tag), F.col("p_place"))).select(self.country(F.col("p_place")).alias("country"))
        return rank.top(rows.groupBy("country").agg(F.count("*").alias("n")), 0, F.col("n").desc(), F.col("country"))

    def average_children(self) -> DataFrame:
        return self.families.agg(F.avg(F.greatest(F.coalesce("f_numchil", F.lit(0)), F.lit(0))).alias("value"))

    def childless_families(self) -> DataFrame:
        none = F.coalesce("f_numchil", F.lit(0)) <= 0
        return self.families.agg(F.sum((~none).cast("long")).alias("with_children"), F.sum(none.cast("long")).alias("without_children"))

    def persons_by_sex(self) -> DataFrame:
        return self.individuals.groupBy(F.when(F.col("i_sex").isin("M", "F"), F.col("i_sex")).otherwise("U").alias("sex")).agg(F.count("*").alias("n"))

    def living_and_dead(self) -> DataFrame:
        dead = text.has_prefix(F.col("i_gedcom"), *DEAD)
        return self.individuals.agg(F.sum((~dead).cast("long")).alias("living"), F.sum(dead.cast("long")).alias("deceased"))

    def children_of_persons(self) -> DataFrame:
        """person, n: the children of all their families together."""
        fams = self.link.where("l_type = 'FAMS'").select(F.col("l_from").alias("person"), F.col("l_to").alias("f_id")).distinct()
        return fams.join(self.families.where("f_numchil > 0").select("f_id", "f_numchil"), "f_id").groupBy("person").agg(F.sum("f_numchil").alias("n"))

    def oldest_living_rows(self) -> DataFrame:
        """xref, years, jd of everyone without a death: what can't be shown is filtered before any limit."""
        alive = self.individuals.where(~text.has_prefix(F.col("i_gedcom"), *DEAD)).select(F.col("i_id").alias("xref"))
        rows = alive.join(self.extreme("BIRT", key="xref", name="jd"), "xref").where(F.col("jd") <= self.today)
        return rows.select("xref", calendar.whole_years(day("jd"), calendar.date_of(F.lit(self.today))).alias("years"), "jd")

    def oldest_living(self, n: int = 10) -> DataFrame:
        return rank.top(self.oldest_living_rows(), n, F.col("years").desc(), F.col("jd"), F.col("xref"))

    def full_dates(self, fact: str, name: str) -> DataFrame:
        """d_gid and the first day of a fact, of complete dates only."""
        return dates.extreme(self.dates.where("d_julianday1 > 0 and d_mon > 0 and d_day > 0"), fact, "d_julianday1", False, name)

    def child_mortality_by_century(self, floor: int = 5) -> DataFrame:
        rows = self.full_dates("BIRT", "birth").join(self.full_dates("DEAT", "death"), "d_gid").where("death >= birth").join(self.born().select("d_gid", "year"), "d_gid").where("year <> 0")
        died = F.sum((F.col("death") - F.col("birth") < 1826).cast("long"))
        counts = rows.groupBy(calendar.century(F.col("year")).alias("century")).agg(F.count("*").alias("total"), died.alias("died")).where(F.col("total") >= floor)
        return counts.withColumn("rate", F.round(F.col("died") * 100.0 / F.col("total"), 1))

    def death_ages_by_century(self, floor: int = 5) -> DataFrame:
        """century, age, n: the ages at death of every century with `floor` of them or more, counted, so that no list is gathered."""
        counts = self.lives.groupBy("century", "age").agg(F.count("*").alias("n"))
        return counts.withColumn("all", F.sum("n").over(Window.partitionBy("century"))).where(F.col("all") >= floor).drop("all")

    def multiple_birth_rates(self, floor: int = 200) -> DataFrame:
        """century, size (5: five or more), children, sets, total, rate: children of multiple births for each hundred dated children."""
        born = self.children().join(self.full_dates("BIRT", "jd"), "d_gid")
        total = born.select("d_gid").distinct().join(self.born().select("d_gid", "year"), "d_gid").groupBy(calendar.century(F.col("year")).alias("century")).agg(F.count("*").alias("total")).where(F.col("total") >= floor)
        sets = series.anchored_clusters(born, "f_id", F.col("jd").cast("long"), 1).where("size >= 2")
        year = calendar.year_of(calendar.date_of(F.col("anchor")))
        counts = sets.groupBy(calendar.century(year).alias("century"), F.least("size", F.lit(5)).alias("size")).agg(F.sum("size").alias("children"), F.count("*").alias("sets"))
        spine = total.crossJoin(F.broadcast(sets.select(F.least("size", F.lit(5)).alias("size")).distinct()))  # four sizes at most
        out = spine.join(counts, ["century", "size"], "left").fillna(0, ["children", "sets"])
        return out.select("century", "size", "children", "sets", "total", F.round(F.col("children") * 100.0 / F.col("total"), 2).alias("rate"))

    def missing_marriages(self) -> DataFrame:
        """total (persons with a family of their own), no_marriage, no_marriage_place (of those with one): the marriage row of the gaps."""
        fams = self.link.where("l_type = 'FAMS'").select(F.col("l_from").alias("i_id"), F.col("l_to").alias("f_id")).distinct()
        g = F.col("f_gedcom")
        of = self.families.select("f_id", text.has_tag(g, "MARR").cast("int").alias("married"), text.event_place(g, "MARR").isNotNull().cast("int").alias("placed"))
        each = fams.join(of, "f_id").groupBy("i_id").agg(F.max("married").alias("married"), F.max("placed").alias("placed"))
        return each.agg(F.count("*").alias("total"), F.sum(1 - F.col("married")).alias("no_marriage"), F.sum(F.col("married") * (1 - F.col("placed"))).alias("no_marriage_place"))

    def wire_rows(self) -> DataFrame:
        """xref, label, sex, birth, death of every person: the label as plain text, the years of their first dates or null."""
        label = F.coalesce(F.min_by(F.concat_ws(" ", F.nullif("n_givn", F.lit("@P.N.")), F.nullif("n_surn", F.lit("@N.N."))), "n_num"), F.lit(""))
        names = self.name.where("n_num = 0").groupBy(F.col("n_id").alias("xref")).agg(label.alias("label"))
        year = lambda fact, name: dates.event_dates(self.dates, fact).select(F.col("d_gid").alias("xref"), calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("d_julianday1")).alias(name))
        rows = self.individuals.select(F.col("i_id").alias("xref"), F.col("i_sex").alias("sex"))
        rows = rows.join(names, "xref", "left").join(year("BIRT", "birth"), "xref", "left").join(year("DEAT", "death"), "xref", "left")
        return rows.select("xref", text.plain_name(F.coalesce("label", F.lit(""))).alias("label"), "sex", "birth", "death")

    # Cohorts, intervals and trends

    def children(self) -> DataFrame:
        """f_id, d_gid of every child once a family."""
        return self.link.where("l_type = 'FAMC'").select(F.col("l_to").alias("f_id"), F.col("l_from").alias("d_gid")).distinct()

    def born(self) -> DataFrame:
        """d_gid, year, month, jd of the lower bound of each birth."""
        rows = dates.event_dates(self.dates, "BIRT")
        args = F.col("d_type"), F.col("d_julianday1")
        return rows.select("d_gid", calendar.event_year(args[0], F.col("d_year"), args[1]).alias("year"), calendar.event_month(args[0], F.col("d_mon"), args[1]).alias("month"), F.col("d_mon"), F.col("d_julianday1").alias("jd"))

    def heatmap(self, fact: str) -> DataFrame:
        """period, month, n: dense periods of a width that keeps the rows at 20 or fewer."""
        rows = dates.event_dates(self.dates, fact).where("d_mon >= 1")
        args = F.col("d_type"), F.col("d_julianday1")
        rows = rows.select(calendar.event_year(args[0], F.col("d_year"), args[1]).alias("year"), calendar.event_month(args[0], F.col("d_mon"), args[1]).cast("long").alias("month")).where(F.col("year") <= self.reference_year)
        ends = rows.agg(F.min("year"), F.max("year")).first()
        width = calendar.pick_period(*ends) if ends[0] is not None else calendar.PERIODS[0]
        counts = rows.groupBy(calendar.period_start(F.col("year"), width).cast("long").alias("period"), "month").agg(F.count("*").alias("n"))
        periods = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("period"))
        spine = periods.select("period", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>")).alias("month"))
        return spine.join(counts, ["period", "month"], "left").fillna(0, ["n"])

    def winter_peak(self, least: int = 12) -> DataFrame:
        months = self.by_month("DEAT").agg(F.sum(F.when(F.col("ord").isin(12, 1, 2), F.col("n")).otherwise(0)).alias("season"), F.sum("n").alias("total"))
        return months.select(F.when(F.col("total") >= least, F.round((F.col("season") / 3.0) / (F.col("total") / 12.0), 2)).alias("score"), "season", "total")

    def sibling_death_clusters(self) -> DataFrame:
        died = self.dates.where("d_fact = 'DEAT' and d_julianday1 <> 0 and d_year > 0").groupBy("d_gid").agg(F.min("d_year").alias("year"))
        k = self.children().join(died, "d_gid").groupBy("f_id", "year").agg(F.count("*").alias("n")).where("n >= 2")
        return k.groupBy("year").agg(F.sum("n").alias("siblings"), F.count("*").alias("families")).where("families >= 2")

    def first_child_ages(self) -> DataFrame:
        """person, sex, year (of the earliest child's birth), age of parents at it, from 12 to 65."""
        child = self.children().join(self.born(), "d_gid").join(self.spouses(), "f_id")
        first = child.groupBy("person", "sex").agg(F.min_by(F.struct("year", "jd"), F.struct("jd", "year")).alias("c"))
        rows = first.join(self.extreme("BIRT", key="person", name="birth"), "person").select("person", "sex", "c.year", calendar.whole_years(day("birth"), calendar.date_of(F.col("c.jd"))).alias("age"), (F.col("c.jd") > F.col("birth")).alias("after"))
        return rows.where(F.col("after") & F.col("age").between(*self.bands.parent)).drop("after")

    def age_at_first_child(self) -> DataFrame:
        rows = self.first_child_ages()
        side = lambda s, name: hist.fixed_width(rows.where(F.col("sex") == s), F.col("age"), 10, 60, 5).select("ord", F.col("n").alias(name))
        return hist.drop_zero_ends(side("M", "fathers").join(side("F", "mothers"), "ord"), "ord", "fathers", "mothers")

    def mean_age_at_first_child(self, floor: int = 5) -> DataFrame:
        rows = self.first_child_ages().groupBy(calendar.decade(F.col("year")).alias("decade"), "sex").agg(F.when(F.count("*") >= floor, F.round(F.avg("age"), 1)).alias("mean"))
        return rows.groupBy("decade").pivot("sex", ["M", "F"]).agg(F.first("mean")).where("M is not null or F is not null")

    def widowhood(self) -> DataFrame:
        last = lambda key, name: self.extreme("DEAT", "d_julianday2", True, key, name)
        rows = self.couples().join(last("f_husb", "his"), "f_husb").join(last("f_wife", "hers"), "f_wife").where("his <> hers")
        return hist.fixed_width(rows, calendar.whole_years(day("his"), day("hers")), 0, 50, 5)

    def remarriage_intervals(self) -> DataFrame:
        """band (0: under 6 months, 1: to 11, 2: to 23 ... 6: 60 and more), n."""
        marr = self.couples().join(self.extreme("MARR", "d_julianday2", True, "f_id", "marr"), "f_id")
        sides = F.explode(F.array(F.struct(F.col("f_husb").alias("person"), F.col("f_wife").alias("spouse")), F.struct(F.col("f_wife").alias("person"), F.col("f_husb").alias("spouse"))))
        rows = series.gaps(marr.select("f_id", "marr", sides.alias("s")).select("s.person", "marr", "f_id", "s.spouse"), "person", "marr", "f_id").where("before is not null")
        rows = rows.select("marr", F.col("before.spouse").alias("spouse")).join(self.extreme("DEAT", "d_julianday2", True, "spouse", "death"), "spouse").where("death <= marr")
        m = calendar.whole_months(day("death"), day("marr"))
        return hist.banded(rows, F.when(m < 6, 0).when(m < 12, 1).when(m < 24, 2).when(m < 36, 3).when(m < 48, 4).when(m < 60, 5).otherwise(6))

    def married(self) -> DataFrame:
        """f_id, year of each family's earliest dated marriage."""
        rows = dates.event_dates(self.dates, "MARR")
        return rows.select(F.col("d_gid").alias("f_id"), calendar.event_year(F.col("d_type"), F.col("d_year"), F.col("d_julianday1")).alias("year"))

    def divorce_rate_by_cohort(self) -> DataFrame:
        ended = self.dates.where("d_fact = 'DIV'").select(F.col("d_gid").alias("f_id")).distinct().withColumn("hit", F.lit(1))
        c = self.married().join(ended, "f_id", "left").groupBy(calendar.decade(F.col("year")).alias("decade")).agg(F.count("*").alias("total"), F.count("hit").alias("divorced"))
        floor = c.agg(F.greatest(F.lit(3), F.floor(F.sum("total") / 100)).alias("floor"))
        kept = c.crossJoin(F.broadcast(floor))
        good = (F.col("divorced") >= 1) & (F.col("total") >= F.col("floor"))
        ends = kept.where(good).agg(F.min("decade").alias("a"), F.max("decade").alias("b"))
        return kept.crossJoin(F.broadcast(ends)).where(F.col("decade").between(F.col("a"), F.col("b"))).select("decade", "total", "divorced", F.round(F.col("divorced") / F.col("total"), 4).alias("rate"))

    def family_sizes_by_decade(self) -> DataFrame:
        n = F.col("f_numchil")
        size = lambda low, high, name: F.sum(n.between(low, high).cast("long")).alias(name)
        rows = self.married().join(self.families.select("f_id", "f_numchil"), "f_id").groupBy(calendar.decade(F.col("year")).alias("decade"))
        return rows.agg(size(1, 1, "one"), size(2, 2, "two"), size(3, 3, "three"), size(4, 1 << 30, "more"))

    def mean_family_size_by_century(self, floor: int = 5) -> DataFrame:
        rows = self.married().join(self.families.select("f_id", "f_numchil"), "f_id").groupBy(calendar.century(F.col("year")).alias("century"))
        return rows.agg(F.count("*").alias("n"), F.avg("f_numchil").alias("mean")).where(F.col("n") >= floor)

    def first_children_by_month(self) -> DataFrame:
        rows = self.children().join(self.born().where("d_mon > 0"), "d_gid").groupBy("f_id").agg(F.min_by("month", F.struct("jd", "d_gid")).alias("month"))
        return hist.spine(rows, 1, 12).join(rows.groupBy(F.col("month").cast("long").alias("ord")).agg(F.count("*").alias("n")), "ord", "left").fillna(0, ["n"])

    def given_names_by_year(self) -> DataFrame:
        """key, form, year of every token of a primary name with a dated birth."""
        first = self.name.where("n_num = 0 and n_type <> '_MARNM'").select(F.col("n_id").alias("d_gid"), F.explode(text.given_tokens(F.col("n_givn"))).alias("form"))
        return first.join(self.born(), "d_gid").select(text.folded(F.col("form")).alias("key"), "form", "year")

    def given_name_trends(self, n: int = 10) -> DataFrame:
        rows = self.given_names_by_year()
        best = rows.groupBy("key").agg(F.count("*").alias("all")).orderBy(F.col("all").desc(), "key").limit(n).join(rank.dominant(rows, "key", "form"), "key").select("key", "form")
        counts = rows.groupBy("key", calendar.decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n")).join(F.broadcast(best), "key", "left_semi")
        span = counts.agg(F.min("decade").alias("a"), F.max("decade").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(10))).alias("decade"))
        return best.crossJoin(F.broadcast(span)).join(counts, ["key", "decade"], "left").fillna(0, ["n"]).select("form", "decade", "n")

    def given_name_last_year(self, n: int = 10) -> DataFrame:
        rows = self.given_names_by_year()
        best = rows.groupBy("key").agg(F.count("*").alias("all"), F.max("year").alias("last_year")).orderBy(F.col("all").desc(), "key").limit(n)
        return best.join(rank.dominant(rows, "key", "form"), "key").select("form", "last_year", (F.col("last_year") >= self.reference_year - 25).alias("active"))

    def name_passdown(self, floor: int = 10) -> DataFrame:
        """century, sex, n, share: of children with a parent of the same sex, those who share a folded given name."""
        names = self.name.where("n_num = 0").select("n_id", F.transform(text.given_tokens(F.col("n_givn")), text.folded).alias("tokens")).where("size(tokens) > 0")
        child = self.children().join(self.individuals.select(F.col("i_id").alias("d_gid"), F.col("i_sex").alias("sex")), "d_gid").join(self.born().select("d_gid", "year"), "d_gid")
        pairs = child.join(self.spouses(), ["f_id", "sex"]).join(names.toDF("d_gid", "own"), "d_gid").join(names.toDF("person", "theirs"), "person")
        rows = pairs.groupBy(calendar.century(F.col("year")).alias("century"), "sex").agg(F.count("*").alias("n"), F.sum(F.arrays_overlap("own", "theirs").cast("long")).alias("hit"))
        return rows.select("century", "sex", "n", F.when(F.col("n") >= floor, F.round(F.col("hit") * 100.0 / F.col("n"), 1)).otherwise(0.0).alias("share"))

    def occupation_inheritance(self, least: int = 2, n: int = 15) -> DataFrame:
        """Trades of parents and children: each pair of distinct folded trades once a child, at least `least` children."""
        trades = rank.normalized(self.individuals.select("i_id", F.posexplode(text.tag_values(F.col("i_gedcom"), "OCCU")).alias("p", "v")), "v", self.occupations)
        label = rank.merged_keys(trades, F.struct("i_id", "p")).select("key", "label")
        own = trades.select("i_id", "key").distinct()
        pairs = graph.parent_edges(self.parents).join(own.toDF("child", "c"), "child").join(own.toDF("parent", "p"), "parent").select("child", "p", "c").distinct()
        named = pairs.join(label.toDF("p", "source"), "p").join(label.toDF("c", "target"), "c")
        heavy = named.groupBy("p", "c").agg(F.count("*").alias("k")).where(F.col("k") >= least)
        return flow.flows(named.join(heavy, ["p", "c"], "left_semi"), "source", "target", F.col("child"), F.col("child"), F.lit(True), n)

    def residences_by_country(self) -> DataFrame:
        rows = self.individuals.select(F.explode(text.event_places(F.col("i_gedcom"), "RESI")).alias("place")).select(self.country(F.col("place")).alias("country"))
        return rank.top(rows.groupBy("country").agg(F.count("*").alias("n")), 0, F.col("n").desc(), F.col("country"))

    def source_coverage_by_century(self, floor: int = 5) -> DataFrame:
        cited = self.link.where("l_type = 'SOUR'").select(F.col("l_from").alias("d_gid")).distinct().withColumn("hit", F.lit(1))
        rows = self.born().join(cited, "d_gid", "left").groupBy(calendar.century(F.col("year")).alias("century")).agg(F.count("*").alias("n"), F.count("hit").alias("cited")).where(F.col("n") >= floor)
        return rows.withColumn("share", F.col("cited") * 100.0 / F.col("n"))

    def missing_gaps(self) -> DataFrame:
        """Counts of persons without births, deaths and their places, in one scan."""
        g = F.col("i_gedcom")
        n = lambda c, name: F.sum(c.cast("long")).alias(name)
        gone = ~text.has_tag(g, "BIRT"), ~text.has_tag(g, "DEAT")
        return self.individuals.agg(F.count("*").alias("total"), n(gone[0], "no_birth"), n(text.event_place(g, "BIRT").isNull(), "no_birth_place"), n(gone[1], "no_death"), n(text.event_place(g, "DEAT").isNull(), "no_death_place"))

    def ancestor_counts(self, generations: int = 4) -> DataFrame:
        persons = self.individuals.select(F.col("i_id").alias("person"))
        return graph.completeness(self.parents, persons, generations).groupBy("known").agg(F.count("*").alias("n"))

    def media_by_type(self) -> DataFrame:
        return rank.top(self.media_file.groupBy("source_media_type").agg(F.count("*").alias("n")), 0, F.col("n").desc(), F.col("source_media_type"))

    def media_by_label(self) -> DataFrame:
        """ord, label, n by label; what has no label of its own is Other, which comes last."""
        counts = self.media_file.groupBy(labels.media_label(F.col("source_media_type")).alias("label")).agg(F.count("*").alias("n"))
        return rank.label_sorted(counts, "label", "Other")

    def records(self) -> DataFrame:
        """slot, value, key of the record holders; a slot without one is missing."""
        d, first = self.marriage_durations(), self.first_child_ages()
        marr = self.spouses().join(self.extreme("MARR", key="f_id", name="at"), "f_id").join(self.extreme("BIRT", key="person", name="birth"), "person").where("at > birth")
        marr = marr.withColumn("age", calendar.whole_years(day("birth"), day("at"))).where(F.col("age").between(*self.bands.spouse))
        spouses = self.link.where("l_type = 'FAMS'").groupBy(F.col("l_from").alias("person")).agg(F.count("*").alias("n")).where("n >= 2")
        slots = [("longest_marriage", d, "years", "f_id", True), ("shortest_marriage", d, "days", "f_id", False), ("oldest_deceased", self.lives.where("age > 0"), "age", "d_gid", True), ("largest_family", self.families.where("f_numchil > 0"), "f_numchil", "f_id", True), ("most_spouses", spouses, "n", "person", True), ("most_children", self.children_of_persons(), "n", "person", True), ("oldest_living", self.oldest_living_rows().where(F.col("years").between(1, self.max_age)), "years", "xref", True)]
        for sex, him, parent in (("M", "husband", "father"), ("F", "wife", "mother")):
            for word, largest in (("youngest", False), ("oldest", True)):
                slots += [(f"{word}_{him}", marr.where(F.col("sex") == sex), "age", "person", largest), (f"{word}_{parent}", first.where(F.col("sex") == sex), "age", "person", largest)]
        out = None
        for slot, rows, value, key, largest in slots:
            one = rank.record_holder(rows, F.col(value).cast("long"), F.col(key), largest).select(F.lit(slot).alias("slot"), "value", "key")
            out = one if out is None else out.unionByName(one)
        return out

    def hero(self) -> DataFrame:
        """individuals, families, covered (persons with a source), decade_from, decade_to, centuries."""
        span = self.births_by_decade().agg(F.min("decade").alias("decade_from"), F.max("decade").alias("decade_to"))
        centuries = F.when(F.col("decade_from").isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil((F.col("decade_to") + 9 - F.col("decade_from")) / 100)))
        one = self.individuals.agg(F.count("*").alias("individuals")).crossJoin(self.families.agg(F.count("*").alias("families"))).crossJoin(self.source_coverage().select(F.col("value").alias("covered")))
        return one.crossJoin(span).withColumn("centuries", centuries.cast("long"))

    def inventory(self) -> DataFrame:
        one = lambda name: self.tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("record"), "n")
        kinds = self.other.groupBy(F.when(F.col("o_type").isin("NOTE", "SNOTE"), "NOTE").otherwise(F.col("o_type")).alias("record")).agg(F.count("*").alias("n"))
        return one("individuals").unionByName(one("families")).unionByName(one("sources")).unionByName(one("media")).unionByName(kinds)
