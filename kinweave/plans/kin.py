"""The metrics of a tree on a tree made from the star-schema tables, each with its SQL oracle.

A customer is a person, an order a family; dates, names, places and record texts are made from keys by rule, the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import labels
from kinweave.operators import graph, hist
from kinweave.plans.forest import Forest
from kinweave.plans.metrics import Tree
from kinweave.plans.star import Tables, kin_edges
from kinweave.sources import gazetteer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GIVEN = ("Anna Maria", "José M", "O'Brien", "Karl II (4th King)", "jose Anna")

# The same tree in SQL.
IND = """ind AS (SELECT c_custkey AS k, 'I' || c_custkey AS i_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, c_mktsegment AS seg, n_name AS nation, r_name AS region, c_custkey % 4 = 0 AS dead, 2378497 + (c_custkey * 7919) % 60000 AS born, 2378497 + (c_custkey * 7919) % 60000 + (c_custkey * 104729) % 36000 AS died, c_custkey % 11 <> 0 AS complete FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
fam AS (SELECT o_orderkey AS o, 'F' || o_orderkey AS f_id, o_custkey AS h, o_custkey + 1 AS w, o_orderkey % 6 AS kids, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588 AS marr, CASE WHEN o_orderkey % 5 = 0 THEN date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588 + (o_orderkey * 31) % 9000 END AS div FROM orders)"""
DAY = "(DATE '1970-01-01' + ({} - 2440588)::INT)"
YEAR = "year" + DAY


def tree(t: Tables) -> Tree:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    nl = "\n"
    person = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    person = person.select(F.concat(F.lit("I"), k).alias("i_id"), k.alias("k"), F.when(k % 2 == 0, "M").otherwise("F").alias("i_sex"), F.col("c_mktsegment").alias("seg"), "n_name", "r_name", (2378497 + k * 7919 % 60000).alias("born"), (k * 104729 % 36000).alias("span"))
    k = F.col("k")
    parts = [F.lit("0 @"), F.col("i_id"), F.lit(f"@ INDI{nl}1 BIRT{nl}2 PLAC "), F.col("n_name"), F.lit(", "), F.col("r_name"), F.lit(f"{nl}3 MAP{nl}4 LATI N"), k % 50, F.lit(f".5{nl}4 LONG W"), k % 90, F.lit(f"{nl}1 OCCU "), F.col("seg"), F.lit(f"{nl}1 RELI R"), k % 3, F.lit(f"{nl}1 BAPM{nl}2 RELI r"), k % 2, F.when(k % 4 == 0, F.concat(F.lit(f"{nl}1 DEAT{nl}2 CAUS C"), k % 5, F.lit(f"{nl}2 PLAC Town, "), F.col("r_name"), F.lit(f"{nl}3 MAP{nl}4 LATI S"), k % 40, F.lit(f"{nl}4 LONG E"), k % 80)).otherwise("")]
    individuals = person.select("i_id", "i_sex", F.concat(*(p.cast("string") for p in parts)).alias("i_gedcom"))
    f_id = F.concat(F.lit("F"), o).alias("f_id")
    spouse = lambda more, name: F.concat(F.lit("I"), F.col("o_custkey") + more).alias(name)
    families = t.orders.select(f_id, spouse(0, "f_husb"), spouse(1, "f_wife"), (o % 6).cast("int").alias("f_numchil"), F.when(o % 3 == 0, "0 @F@ FAM\n1 MARR\n2 PLAC X").otherwise("0 @F@ FAM").alias("f_gedcom"))
    spouses = families.select(F.explode(F.array("f_husb", "f_wife")).alias("l_from"), F.lit("FAMS").alias("l_type"), F.col("f_id").alias("l_to"))
    family = F.concat(F.lit("F"), k * 3)
    child = person.select(F.explode(F.array(F.struct(F.col("i_id").alias("l_from"), F.lit("FAMC").alias("l_type"), family.alias("l_to")), F.struct(family.alias("l_from"), F.lit("CHIL").alias("l_type"), F.col("i_id").alias("l_to")))).alias("x")).select("x.*")
    cited = person.where(k % 5 == 0).select(F.col("i_id").alias("l_from"), F.lit("SOUR").alias("l_type"), F.lit("S1").alias("l_to"))
    epoch = F.lit("1970-01-01").cast("date")

    def dated(df, key, fact, jd, complete):
        at = F.date_add(epoch, (jd - 2440588).cast("int"))
        part = lambda c: F.when(complete, c).otherwise(0)
        return df.select(F.col(key).alias("d_gid"), F.lit(fact).alias("d_fact"), F.lit("@#DGREGORIAN@").alias("d_type"), F.year(at).alias("d_year"), part(F.month(at)).alias("d_mon"), part(F.dayofmonth(at)).alias("d_day"), jd.cast("int").alias("d_julianday1"), jd.cast("int").alias("d_julianday2"))

    marr = F.datediff(F.to_date("o_orderdate"), epoch) + 2440588
    dates = dated(person, "i_id", "BIRT", F.col("born"), k % 11 != 0).unionByName(dated(person.where(k % 4 == 0), "i_id", "DEAT", F.col("born") + F.col("span"), F.lit(True)))
    of_family = t.orders.select(f_id, o.alias("o"), marr.alias("marr"))
    dates = dates.unionByName(dated(of_family, "f_id", "MARR", F.col("marr"), F.lit(True))).unionByName(dated(of_family.where("o % 5 = 0"), "f_id", "DIV", F.col("marr") + F.col("o") * 31 % 9000, F.lit(True)))
    given = F.element_at(F.array(*(F.lit(g) for g in GIVEN)), (k % 5 + 1).cast("int"))
    name = person.select(F.col("i_id").alias("n_id"), F.lit(0).alias("n_num"), F.lit("NAME").alias("n_type"), F.col("seg").alias("n_surn"), given.alias("n_givn"))
    root = t.region.select(F.col("r_regionkey").alias("p_id"), F.lit(-1).alias("p"), F.col("r_name").alias("p_place")).select("p_id", (F.col("p") + 1).alias("p_parent_id"), "p_place")
    links = person.join(root.select("p_id", F.col("p_place").alias("r_name")), "r_name").select(F.col("i_id").alias("pl_gid"), F.col("p_id").alias("pl_p_id"))
    tables = {"individuals": individuals, "families": families, "link": spouses.unionByName(child).unionByName(cited), "dates": dates, "name": name, "places": root, "placelinks": links}
    return Tree(tables, today=2451545)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


WHOLE = "(year({1}) - year({0}) - CASE WHEN month({1}) * 100 + day({1}) < month({0}) * 100 + day({0}) THEN 1 ELSE 0 END)"


@query(f"WITH {IND} SELECT row_number() OVER (ORDER BY count(*) DESC, region) AS ord, region AS country, count(*) AS n FROM ind GROUP BY region")
def tree_countries_by_places(t):
    return tree(t).countries_of("BIRT")


@query(f"WITH {IND}, r AS (SELECT k, 0 AS p, 'R' || k % 3 AS v FROM ind UNION ALL SELECT k, 1, 'r' || k % 2 FROM ind) SELECT row_number() OVER (ORDER BY count(*) DESC, lower(v)) AS ord, lower(v) AS key, arg_min(v, ('I' || k, p)) AS label, count(*) AS n FROM r GROUP BY lower(v)")
def tree_religions(t):
    return tree(t).top_religions()


@query(f"WITH {IND} SELECT (SELECT count(DISTINCT seg) FROM ind) AS surnames, 3 + (SELECT count(*) FROM ind WHERE k < 0) AS religions, (SELECT count(DISTINCT seg) FROM ind) AS occupations, (SELECT count(DISTINCT k % 5) FROM ind WHERE dead) AS causes")
def tree_totals(t):
    m = tree(t)
    one = lambda df, name: df.select(F.col("total").alias(name))
    return one(m.total_surnames(), "surnames").crossJoin(one(m.total_religions(), "religions")).crossJoin(one(m.total_occupations(), "occupations")).crossJoin(one(m.total_death_causes(), "causes"))


@query(f"WITH {IND}, c AS (SELECT seg AS surname, count(*) AS n FROM ind GROUP BY 1 ORDER BY n DESC, surname LIMIT 3) SELECT surname, n, row_number() OVER (ORDER BY surname) AS ord FROM c")
def tree_top_surnames(t):
    return tree(t).top_surnames(3)


@query(f"""WITH {IND}, g AS (SELECT k, sex, unnest([['Anna', 'Maria'], ['José'], ['O''Brien'], ['Karl'], ['jose', 'Anna']][k % 5 + 1]) AS form FROM ind), u AS (SELECT k, form, CASE form WHEN 'José' THEN 'jose' ELSE lower(form) END AS key FROM g WHERE sex = 'M'),
n AS (SELECT key, count(DISTINCT k) AS n FROM u GROUP BY 1), d AS (SELECT key, form FROM (SELECT key, form, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, form) AS r FROM u GROUP BY 1, 2) WHERE r = 1) SELECT row_number() OVER (ORDER BY n DESC, key) AS ord, key, form, n FROM n JOIN d USING (key)""")
def tree_given_names(t):
    return tree(t).top_given_names("M").select("ord", "key", "form", "n")


@query(f"WITH {IND}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE died - born < 1826) AS died FROM ind WHERE dead AND complete) SELECT total, died, round(died * 100.0 / total, 1) AS rate FROM c")
def tree_child_mortality(t):
    return tree(t).child_mortality()


@query(f"WITH {IND} SELECT CASE WHEN {YEAR.format('born')} % 100 = 0 THEN {YEAR.format('born')} // 100 ELSE {YEAR.format('born')} // 100 + 1 END AS century, count(*) AS total, count(*) FILTER (WHERE died - born < 1826) AS died, round(100.0 * count(*) FILTER (WHERE died - born < 1826) / count(*), 1) AS rate FROM ind WHERE dead AND complete GROUP BY 1 HAVING count(*) >= 5")
def tree_child_mortality_by_century(t):
    return tree(t).child_mortality_by_century().withColumn("century", F.col("century").cast("long"))


@query(f"""WITH {IND}, e AS (SELECT f_id, marr, div, x.died AS xd, y.died AS yd FROM fam LEFT JOIN ind x ON x.k = h AND x.dead LEFT JOIN ind y ON y.k = w AND y.dead), m AS (SELECT f_id, marr, div, least(CASE WHEN div > marr THEN div END, CASE WHEN xd > marr THEN xd END, CASE WHEN yd > marr THEN yd END) AS ends FROM e)
SELECT CASE WHEN ends = div THEN 'divorce' ELSE 'death' END AS reason, count(*) AS n, sum(ends - marr)::BIGINT AS days, max({WHOLE.format(DAY.format('marr'), DAY.format('ends'))})::BIGINT AS longest FROM m WHERE ends IS NOT NULL AND {WHOLE.format(DAY.format('marr'), DAY.format('ends'))} <= 90 GROUP BY 1""")
def tree_marriage_durations(t):
    return tree(t).marriage_durations().groupBy("reason").agg(F.count("*").alias("n"), F.sum("days").cast("long").alias("days"), F.max("years").cast("long").alias("longest"))


@query(f"""WITH {IND}, chil AS (SELECT k * 3 AS f, k AS c FROM ind), many AS (SELECT f, count(*) AS n FROM chil GROUP BY 1), fams AS (SELECT o AS g, h AS c FROM fam UNION ALL SELECT o, w FROM fam), r AS (SELECT 'F' || chil.f AS f_id, sum(many.n)::BIGINT AS n FROM chil JOIN fams ON fams.c = chil.c JOIN many ON many.f = fams.g GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, f_id) AS ord, f_id, n FROM r ORDER BY 1 LIMIT 10""")
def tree_grandchild_families(t):
    return tree(t).grandchild_families().select("ord", "f_id", "n")


@query(f"WITH {IND} SELECT ({YEAR.format('marr')} // 10 * 10)::BIGINT AS decade, count(*) FILTER (WHERE kids = 1) AS one, count(*) FILTER (WHERE kids = 2) AS two, count(*) FILTER (WHERE kids = 3) AS three, count(*) FILTER (WHERE kids >= 4) AS more FROM fam GROUP BY 1")
def tree_family_sizes(t):
    return tree(t).family_sizes_by_decade().withColumn("decade", F.col("decade").cast("long"))


@query(f"WITH {IND} SELECT avg(kids) AS mean, count(*) FILTER (WHERE kids > 0) AS with_children, count(*) FILTER (WHERE kids = 0) AS without_children FROM fam")
def tree_children_of_families(t):
    m = tree(t)
    return m.average_children().select(F.col("value").alias("mean")).crossJoin(m.childless_families())


@query(f"WITH {IND} SELECT sex, count(*) AS n, count(*) FILTER (WHERE NOT dead) AS living FROM ind GROUP BY 1")
def tree_persons(t):
    m = tree(t)
    alive = m.oldest_living_rows().join(m.individuals.select(F.col("i_id").alias("xref"), F.col("i_sex").alias("sex")), "xref").groupBy("sex").agg(F.count("*").alias("living"))
    return m.persons_by_sex().join(alive, "sex")


@query(f"WITH {IND}, r AS (SELECT i_id AS xref, {WHOLE.format(DAY.format('born'), DAY.format('2451545'))}::BIGINT AS years, born FROM ind WHERE NOT dead) SELECT row_number() OVER (ORDER BY years DESC, born, xref) AS ord, xref, years FROM r ORDER BY 1 LIMIT 10")
def tree_oldest_living(t):
    return tree(t).oldest_living().select("ord", "xref", F.col("years").cast("long").alias("years"))


@query(f"WITH {IND}, p AS (SELECT h AS k, kids FROM fam UNION ALL SELECT w, kids FROM fam) SELECT n, count(*) AS persons FROM (SELECT k, sum(kids)::BIGINT AS n FROM p WHERE kids > 0 GROUP BY 1) GROUP BY 1")
def tree_children_of_persons(t):
    return tree(t).children_of_persons().groupBy("n").agg(F.count("*").alias("persons"))


@query(f"""WITH {IND}, p AS (SELECT h AS k, o FROM fam UNION SELECT w, o FROM fam), e AS (SELECT k, max(CASE WHEN o % 3 = 0 THEN 1 ELSE 0 END) AS m FROM p GROUP BY 1) SELECT count(*) AS total, sum(1 - m)::BIGINT AS no_marriage, 0::BIGINT AS no_marriage_place FROM e""")
def tree_missing_marriages(t):
    return tree(t).missing_marriages()


@query("WITH e AS (SELECT DISTINCT o_custkey AS u FROM orders), g AS (SELECT u, u - row_number() OVER (ORDER BY u) AS run FROM e) SELECT size, count(*) AS n FROM (SELECT run, count(*) + 1 AS size FROM g GROUP BY 1) WHERE size >= 3 GROUP BY 1")
def tree_partner_groups(t):
    return tree(t).partner_groups().groupBy("size").agg(F.count("*").alias("n"))


@query(f"""WITH {IND}, b AS (SELECT i_id AS xref, sex, seg, {YEAR.format('born')}::BIGINT AS birth, CASE WHEN dead THEN {YEAR.format('died')} END::BIGINT AS death, k FROM ind)
SELECT xref, ['Anna Maria', 'José M', 'O''Brien', 'Karl II (4th King)', 'jose Anna'][k % 5 + 1] || ' ' || seg AS label, sex, birth, death FROM b""")
def tree_wire_rows(t):
    return tree(t).wire_rows().select("xref", "label", "sex", F.col("birth").cast("long").alias("birth"), F.col("death").cast("long").alias("death"))


@query(f"""WITH {IND}, q AS (SELECT (k % 50) + 0.5 AS a, -(k % 90)::DOUBLE AS b, -(k % 40)::DOUBLE AS c, (k % 80)::DOUBLE AS d FROM ind WHERE dead), h AS (SELECT 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) AS km FROM q)
SELECT (CASE WHEN km <= 10 THEN 1 WHEN km <= 50 THEN 2 WHEN km <= 200 THEN 3 WHEN km <= 500 THEN 4 WHEN km <= 1000 THEN 5 ELSE 6 END)::BIGINT AS band, count(*) AS n FROM h GROUP BY 1 HAVING (SELECT count(*) FROM h) >= 5""")
def tree_migration_distances(t):
    return tree(t).migration_distances().withColumn("band", F.col("band").cast("long"))


@query("""WITH y AS (SELECT DISTINCT (year(l_shipdate) // 10 * 10)::BIGINT AS decade, month(l_shipdate) AS m FROM lineitem) SELECT decade, m::BIGINT AS m, decade || 's' AS label, 'Period: ' || decade || '–' || (decade + 9) AS period, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] AS month,
coalesce(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'][m], '') AS spelled, ((decade // 100 + 1) || 'th Century') AS century FROM y WHERE decade // 100 + 1 BETWEEN 4 AND 20""")
def tree_labels(t):
    y = t.lineitem.select((F.floor(F.year("l_shipdate") / 10) * 10).cast("long").alias("decade"), F.month("l_shipdate").cast("long").alias("m")).distinct()
    c = F.floor(F.col("decade") / 100) + 1
    return y.where(c.between(4, 20)).select("decade", "m", labels.decade_label(F.col("decade")).alias("label"), labels.period_label(F.col("decade")).alias("period"), labels.month_name(F.col("m")).alias("month"), labels.spelled(F.col("m")).alias("spelled"), labels.century_long(c).alias("century"))


@query("""WITH g AS (SELECT r_name AS path, r_regionkey * 10.0 AS latitude, r_regionkey * 5.0 AS longitude FROM region UNION ALL SELECT r_name || '|' || n_name, n_nationkey * 2.0, n_nationkey * 3.0 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 <> 0)
SELECT latitude, longitude, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN g ON path = r_name || '|' || n_name GROUP BY 1, 2""")
def tree_located_places(t):
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    top = t.region.select(r.cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("place"), (r * 10.0).alias("latitude"), (r * 5.0).alias("longitude"))
    # Ids of regions must not be 0, which stands for no parent.
    top = top.withColumn("id", F.col("id") + 1)
    low = t.nation.select((n + 1000).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("place"), F.when(n % 4 != 0, n * 2.0).alias("latitude"), F.when(n % 4 != 0, n * 3.0).alias("longitude"))
    flat = gazetteer.flattened(top.unionByName(low))
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == n).join(F.broadcast(t.region), F.col("n_regionkey") == r).select(F.concat_ws(", ", "n_name", "r_name").alias("place"))
    return gazetteer.located(rows, "place", flat).groupBy("latitude", "longitude").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS ord, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT min(ord) AS a, max(ord) AS b FROM h WHERE n >= 0.5 * (SELECT max(n) FROM h)) SELECT ord, n FROM h, e WHERE ord BETWEEN a AND b""")
def tree_low_ends(t):
    months = t.lineitem.groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("ord")).agg(F.count("*").alias("n"))
    return hist.drop_low_ends(months, "ord", "n", 0.5)


# The parents of c are c // 2 and c // 3 (see star): the longest line above c halves it until 1 is left.
@query("WITH RECURSIVE h AS (SELECT c_custkey AS x, 0 AS d FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer) UNION ALL SELECT x // 2, d + 1 FROM h WHERE x > 1) SELECT max(d)::BIGINT + 1 AS generations, (SELECT count(*) FROM customer WHERE c_custkey >= (SELECT pow(2, max(d))::BIGINT FROM h)) AS chains FROM h")
def tree_deepest_chain(t):
    chain = graph.deepest_chain(kin_edges(t))
    return chain.agg(F.count("*").alias("generations"), F.max("chains").alias("chains"))


# Tallies and rankings of the same tree.
CENT = "(CASE WHEN {0} % 100 = 0 THEN {0} // 100 ELSE {0} // 100 + 1 END)"
BORN_YEAR = YEAR.format("born")
BORN, DIED, TODAY = (DAY.format(c) for c in ("born", "died", "2451545"))
LIVES = f"lives AS (SELECT *, {WHOLE.format(BORN, DIED)} AS age, {CENT.format(BORN_YEAR)} AS century, died - born AS days FROM ind WHERE dead AND died > born AND {WHOLE.format(BORN, DIED)} BETWEEN 0 AND 120)"


@query(f"WITH {IND} SELECT {CENT.format(BORN_YEAR)} AS century, count(*) AS n FROM ind GROUP BY 1")
def tree_births_by_century(t):
    return tree(t).by_century("BIRT")


@query(f"WITH {IND}, c AS (SELECT month({BORN}) AS m, count(*) AS n FROM ind WHERE complete GROUP BY 1) SELECT ord, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 13)) AS ord) LEFT JOIN c ON m = ord")
def tree_births_by_month(t):
    return tree(t).by_month("BIRT")


DECADES = f"dec AS (SELECT {BORN_YEAR} // 10 * 10 AS d, count(*) AS n FROM ind GROUP BY 1), filled AS (SELECT x AS decade, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(d) FROM dec), (SELECT max(d) FROM dec) + 10, 10)) AS x) LEFT JOIN dec ON d = x)"


@query(f"WITH {IND}, {DECADES} SELECT decade, n, sum(n) OVER (ORDER BY decade)::BIGINT AS running FROM filled")
def tree_births_by_decade(t):
    return tree(t).cumulative_births()


@query(f"WITH {IND}, {LIVES} SELECT ord, CASE WHEN ord >= 100 THEN '100+' ELSE ord || '–' || ord + 9 END AS label, (SELECT count(*) FROM lives WHERE least(age // 10 * 10, 100) = ord) AS n FROM (SELECT unnest(range(0, 101, 10)) AS ord)")
def tree_ages_at_death(t):
    return tree(t).age_at_death()


@query(f"WITH {IND}, {LIVES}, c AS (SELECT century, count(*) AS total FROM lives GROUP BY 1 HAVING count(*) >= 30) SELECT century, age, round(100.0 * (SELECT count(*) FROM lives WHERE lives.century = c.century AND lives.age >= a.age) / total, 1) AS share FROM c, (SELECT unnest(range(0, 101, 10)) AS age) a")
def tree_survival(t):
    return tree(t).survival_by_century()


@query(f"WITH {IND}, {LIVES} SELECT century, least(age // 10 * 10, 100) AS band, count(*) FILTER (sex = 'M') AS left_n, count(*) FILTER (sex = 'F') AS right_n FROM lives GROUP BY 1, 2")
def tree_deaths_pyramid(t):
    return tree(t).deaths_pyramid()


@query(f"WITH {IND}, {LIVES}, c AS (SELECT century, sex, round(avg(age), 1) AS mean, count(*) AS n FROM lives WHERE age > 0 GROUP BY 1, 2), p AS (SELECT century, coalesce(max(CASE WHEN sex = 'M' AND n >= 5 THEN mean END), 0.0) AS M, coalesce(max(CASE WHEN sex = 'F' AND n >= 5 THEN mean END), 0.0) AS F FROM c GROUP BY 1) SELECT * FROM p WHERE M > 0 OR F > 0")
def tree_lifespans(t):
    return tree(t).lifespan_by_sex_and_century()


@query(f"WITH {IND}, {LIVES} SELECT century, age, n FROM (SELECT century, age, count(*) AS n, sum(count(*)) OVER (PARTITION BY century) AS total FROM lives GROUP BY 1, 2) WHERE total >= 5")
def tree_death_ages(t):
    return tree(t).death_ages_by_century()


@query(f"WITH {IND}, {LIVES} SELECT i_id AS xref, age AS years, days, row_number() OVER (ORDER BY age DESC, days DESC, i_id) AS ord FROM lives WHERE age > 0 ORDER BY ord LIMIT 10")
def tree_oldest_deceased(t):
    return tree(t).oldest_deceased()


@query(f"""WITH {IND}, s AS (SELECT h AS k, f_id, w AS p FROM fam UNION ALL SELECT w, f_id, h FROM fam), x AS (SELECT s.k, max(CASE WHEN f.o % 3 = 0 AND i.k IS NOT NULL THEN CASE WHEN i.dead THEN 1 ELSE 3 END ELSE 0 END) AS state FROM s JOIN fam f USING (f_id) LEFT JOIN ind i ON i.k = s.p GROUP BY 1)
SELECT CASE coalesce(state, 0) WHEN 3 THEN 'Married' WHEN 1 THEN 'Widowed' ELSE 'Single' END AS bucket, count(*) AS n FROM ind LEFT JOIN x USING (k) WHERE NOT dead GROUP BY 1""")
def tree_family_status(t):
    return tree(t).family_status()


@query(f"WITH {IND} SELECT count(*) FILTER (NOT dead) AS living, count(*) FILTER (dead) AS deceased FROM ind")
def tree_living_and_dead(t):
    return tree(t).living_and_dead()


@query(f"WITH {IND}, a AS (SELECT {WHOLE.format(BORN, TODAY)} AS age FROM ind WHERE NOT dead AND born <= 2451545) SELECT CASE WHEN age <= 17 THEN '0–17' WHEN age <= 35 THEN '18–35' WHEN age <= 65 THEN '36–65' ELSE '65+' END AS band, count(*) AS n FROM a WHERE age <= 120 GROUP BY 1")
def tree_living_by_age(t):
    return tree(t).living_by_age_band()


@query(f"WITH {IND} SELECT lower(seg) AS key, arg_min(seg, i_id) AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(seg)) AS ord FROM ind GROUP BY lower(seg)")
def tree_top_occupations(t):
    return tree(t).top_occupations()


@query(f"WITH {IND}, c AS (SELECT i_id, 'C' || k % 5 AS v FROM ind WHERE dead) SELECT lower(v) AS key, arg_min(v, i_id) AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(v)) AS ord FROM c GROUP BY lower(v)")
def tree_top_death_causes(t):
    return tree(t).top_death_causes()


@query(f"WITH {IND} SELECT region AS country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, region) AS ord FROM ind WHERE dead GROUP BY region")
def tree_deaths_by_country(t):
    return tree(t).by_country("DEAT")


@query(f"WITH {IND} SELECT count(*) FILTER (k % 5 = 0) AS value, count(*) AS total FROM ind")
def tree_source_coverage(t):
    return tree(t).source_coverage()


@query(f"WITH {IND} SELECT ord, CASE WHEN ord = 10 THEN '10+' ELSE ord || '–' || ord END AS label, (SELECT count(*) FROM fam WHERE kids = ord) AS n FROM (SELECT unnest(range(0, 11)) AS ord)")
def tree_children_per_family(t):
    return tree(t).children_per_family()


@query(f"WITH {IND} SELECT f_id, kids AS f_numchil, row_number() OVER (ORDER BY kids DESC, f_id) AS ord FROM fam ORDER BY ord LIMIT 10")
def tree_largest_families(t):
    return tree(t).largest_families()


@query(f"WITH {IND}, c AS (SELECT year({DAY.format('marr')}) // 10 * 10 AS decade, count(*) AS total, count(div) AS divorced FROM fam GROUP BY 1), f AS (SELECT greatest(3, sum(total) // 100) AS least FROM c), e AS (SELECT min(decade) AS a, max(decade) AS b FROM c, f WHERE divorced >= 1 AND total >= least) SELECT decade, total, divorced, round(divorced / total, 4) AS rate FROM c, e WHERE decade BETWEEN a AND b")
def tree_divorce_rates(t):
    return tree(t).divorce_rate_by_cohort()


@query(f"WITH {IND}, y AS (SELECT year({DAY.format('marr')}) AS y, kids FROM fam) SELECT {CENT.format('y')} AS century, count(*) AS n, avg(kids) AS mean FROM y GROUP BY 1 HAVING count(*) >= 5")
def tree_family_size_by_century(t):
    return tree(t).mean_family_size_by_century()


@query(f"""WITH {IND}, p AS (SELECT least(a.seg, b.seg) AS x, greatest(a.seg, b.seg) AS y FROM fam JOIN ind a ON a.k = h JOIN ind b ON b.k = w), tot AS (SELECT label, count(*) AS n FROM (SELECT x AS label FROM p UNION ALL SELECT y FROM p WHERE x <> y) GROUP BY 1),
best AS (SELECT label FROM tot ORDER BY n DESC, label LIMIT 4), c AS (SELECT x AS r, y AS c FROM p UNION ALL SELECT y, x FROM p WHERE x <> y) SELECT i.label AS row_label, j.label AS col_label, count(c.r) AS n FROM best i CROSS JOIN best j LEFT JOIN c ON c.r = i.label AND c.c = j.label GROUP BY 1, 2""")
def tree_surname_matrix(t):
    return tree(t).surname_matrix(4)


@query(f"WITH {IND}, {DECADES} SELECT (SELECT count(*) FROM ind) AS individuals, (SELECT count(*) FROM fam) AS families, (SELECT count(*) FROM ind WHERE k % 5 = 0) AS covered, min(decade) AS decade_from, max(decade) AS decade_to, greatest(1, ceil((max(decade) + 9 - min(decade)) / 100))::BIGINT AS centuries FROM filled")
def tree_hero(t):
    return tree(t).hero()


@query(f"WITH {IND}, n AS (SELECT CASE WHEN dead THEN 2 ELSE 1 END AS places FROM ind) SELECT ord, CASE WHEN ord = 5 THEN '5+' ELSE ord || '–' || ord END AS label, (SELECT count(*) FROM n WHERE places = ord) AS n FROM (SELECT unnest(range(1, 6)) AS ord)")
def tree_place_dispersion(t):
    return tree(t).place_dispersion()


@query(f"""WITH {IND}, y AS (SELECT {YEAR.format('died')} AS y, region, i_id FROM ind WHERE dead), d AS (SELECT x AS year, (SELECT count(*) FROM y WHERE y = x) AS deaths FROM (SELECT unnest(range((SELECT min(y) FROM y), (SELECT max(y) FROM y) + 1)) AS x)),
w AS (SELECT year, deaths, list_sort(list(deaths) OVER f)[6] AS baseline, stddev_pop(deaths) OVER f AS sd, count(*) OVER f AS n FROM d WINDOW f AS (ORDER BY year ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
z AS (SELECT year, deaths, baseline, deaths / baseline AS multiplier, (deaths - baseline) / sd AS z_score FROM w WHERE n = 11 AND baseline >= 2 AND sd > 0 QUALIFY row_number() OVER (ORDER BY CASE WHEN (deaths - baseline) / sd >= 2 THEN 0 ELSE 1 END, (deaths - baseline) / sd DESC, year) <= 10),
c AS (SELECT r_regionkey AS ord, 'E' || r_name AS key, 1800 + r_regionkey * 7 AS first, 1960 + r_regionkey * 5 AS last, r_name AS country FROM region),
s AS (SELECT y, region FROM y GROUP BY 1, 2 HAVING count(*) >= 2), h AS (SELECT z.year, key, row_number() OVER (PARTITION BY z.year ORDER BY ord) AS r FROM z JOIN s ON s.y = z.year JOIN c ON z.year BETWEEN first AND last AND country = region)
SELECT year, deaths, baseline, multiplier, z_score, coalesce((SELECT string_agg(key, ',' ORDER BY r) FROM h WHERE h.year = z.year AND r <= 2), '') AS events FROM z WHERE z_score >= 2""")
def tree_mortality_events(t):
    k = F.col("r_regionkey")
    catalogue = t.region.select(k.alias("ord"), F.concat(F.lit("E"), "r_name").alias("key"), (k * 7 + 1800).cast("int").alias("first"), (k * 5 + 1960).cast("int").alias("last"), F.array("r_name").alias("countries"))
    return tree(t).mortality_events(catalogue).withColumn("events", F.array_join("events", ","))


@query(f"""WITH {IND}, t AS (SELECT 1 AS tree_id, * FROM ind UNION ALL SELECT 2, * FROM ind WHERE k % 2 = 0), n AS (SELECT tree_id, seg, count(*) AS n, row_number() OVER (PARTITION BY tree_id ORDER BY count(*) DESC, seg) AS r FROM t GROUP BY 1, 2)
SELECT tree_id, 'births' AS what, {CENT.format(BORN_YEAR)}::VARCHAR AS label, count(*) AS n FROM t GROUP BY tree_id, {CENT.format(BORN_YEAR)} UNION ALL SELECT tree_id, 'living', 'persons', count(*) FILTER (NOT dead) FROM t GROUP BY tree_id
UNION ALL SELECT tree_id, 'surname', seg, n FROM n WHERE r <= 2 UNION ALL SELECT tree_id, 'sources', 'persons', count(*) FILTER (k % 5 = 0) FROM t GROUP BY tree_id""")
def forest_tallies(t):
    """Two trees with the same ids in one set of tables, the second with half of the persons."""
    one = {name: df.withColumn("tree_id", F.lit(1)) for name, df in tree(t).tables.items() if name != "places"}
    half = one["individuals"].where(F.substring("i_id", 2, 20).cast("long") % 2 == 0)
    keys = {"individuals": "i_id", "dates": "d_gid", "name": "n_id", "placelinks": "pl_gid"}
    two = {name: df.join(half.select(F.col("i_id").alias(keys[name])), keys[name], "left_semi") if name in keys else df for name, df in one.items()}
    f = Forest({name: df.unionByName(two[name].withColumn("tree_id", F.lit(2))) for name, df in one.items()})
    parts = [("births", f.by_century("BIRT"), F.col("century").cast("string"), "n"), ("living", f.living_and_dead(), F.lit("persons"), "living"), ("surname", f.top_surnames(2), F.col("surname"), "n"), ("sources", f.source_coverage(), F.lit("persons"), "value")]
    out = None
    for what, df, label, n in parts:
        rows = df.select("tree_id", F.lit(what).alias("what"), label.alias("label"), F.col(n).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
