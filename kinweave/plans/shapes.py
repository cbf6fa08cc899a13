"""Operators on shapes that a plain plan doesn't survive, made from the star-schema tables, each with its SQL oracle: long record
blocks, hubs, long lines, keys with many places, deep gazetteers, spans of events, folded words, and order by locale."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import calendar, labels, text
from kinweave.operators import graph, rank, series
from kinweave.operators.tables import shared_folder
from kinweave.plans import payload
from kinweave.plans.star import PARENTS, Tables, kin_edges, long
from kinweave.sources import gazetteer, gedcom

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""WITH o AS (SELECT o_custkey AS k, string_agg(chr(10) || '2 NOTE o' || o_orderkey || chr(10) || '3 CONT ' || o_orderpriority || chr(10) || '10 X', '' ORDER BY o_orderkey) AS notes, count(*) AS n, min(year(o_orderdate)) AS y FROM orders GROUP BY 1),
r AS (SELECT n_name AS nation, n, y, c_mktsegment AS seg, length(notes) + length(chr(10) || '1 BIRT' || chr(10) || '2 DATE BET ' || y || '/' || (y + 1) % 100 || ' AND 2000' || chr(10) || '2 PLAC ' || n_name || ', R' || chr(10) || '2 CAUS c' || n % 3) AS chars FROM o JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey)
SELECT nation, count(*) AS records, sum(chars)::BIGINT AS chars, nation || ', R' AS place, 2 * count(*) AS places, min(y + 1)::BIGINT AS first_year, max(y + 1)::BIGINT AS last_year, count(DISTINCT n % 3) AS causes, count(DISTINCT seg) AS jobs FROM r GROUP BY nation""")
def record_blocks(t):
    """Records whose birth has a few lines for every order, before its date and place, and a second birth after others."""
    note = F.concat(F.lit("\n2 NOTE o"), "o_orderkey", F.lit("\n3 CONT "), "o_orderpriority", F.lit("\n10 X"))
    lines = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", note.alias("note")))), lambda x: x["note"]).alias("notes"), F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("y"))
    rows = lines.join(t.customer, "c_custkey").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    record = F.concat(F.lit("0 @I@ INDI\n1 BIRTX\n2 PLAC none\n1 BIRT"), F.array_join("notes", ""), F.lit("\n2 DATE BET "), "y", F.lit("/"), (F.col("y") + 1) % 100, F.lit(" AND 2000\n2 PLAC "), "n_name", F.lit(", R\n2 CAUS c"), F.col("n") % 3, F.lit("\n1 OCCU "), "c_mktsegment", F.lit("\n1 DEAT\n2 PLAC X\n1 BIRT\n2 PLAC Second"))
    g = F.col("g")
    found = rows.select(F.col("n_name").alias("nation"), record.alias("g")).select("nation", F.length(text.event_block(g, "BIRT")).alias("chars"), text.event_place(g, "BIRT").alias("place"), F.size(text.event_places(g, "BIRT")).alias("places"), text.event_year_of_text(g, "BIRT").alias("year"), text.sub_value(text.event_block(g, "BIRT"), "CAUS").alias("cause"), text.tag_values(g, "OCCU").alias("jobs"))
    return found.groupBy("nation").agg(F.count("*").alias("records"), F.sum("chars").alias("chars"), F.max("place").alias("place"), F.sum("places").alias("places"), long(F.min("year")).alias("first_year"), long(F.max("year")).alias("last_year"), F.countDistinct("cause").alias("causes"), F.countDistinct(F.col("jobs")[0]).alias("jobs"))


@query("SELECT -1 - c_nationkey::BIGINT AS root, count(*) + 1 AS size FROM customer GROUP BY 1")
def components_hubs(t):
    """Every customer hangs on its nation, a hub smaller than all its leaves."""
    edges = t.customer.select(F.col("c_custkey").alias("u"), (F.lit(-1) - F.col("c_nationkey")).cast("long").alias("v"))
    roots = graph.components(edges, edges.select(F.explode(F.array("u", "v")).alias("node")))
    return roots.groupBy("root").agg(F.count("*").alias("size"))


LINE = "l AS (SELECT c_custkey AS x, row_number() OVER (ORDER BY hash_key, c_custkey) AS rn, count(*) OVER () AS n FROM (SELECT c_custkey, (c_custkey * 7919) % 10007 AS hash_key FROM customer))"


@query(f"""WITH {LINE}, s AS (SELECT arg_min(rn, x) AS s, max(n) AS n FROM l),
f AS (SELECT n, CASE WHEN s - 1 > n - s THEN 1 WHEN s - 1 < n - s THEN n WHEN (SELECT x FROM l WHERE rn = 1) < (SELECT x FROM l WHERE rn = s.n) THEN 1 ELSE n END AS far FROM s),
p AS (SELECT list(x ORDER BY CASE WHEN far = 1 THEN rn ELSE -rn END) AS p FROM l, f)
SELECT len(p)::BIGINT AS length, array_to_string(least(p, list_reverse(p)), ',') AS path FROM p""")
def line_chain(t):
    """All customers in one line of partnerships, in no order of their keys, and the whole of it as the longest chain."""
    at = F.struct((F.col("c_custkey") * 7919 % 10007).alias("h"), F.col("c_custkey").alias("x"))
    placed = rank.numbered(t.customer.select(at.alias("at")), F.col("at")).select(F.col("at.x").alias("x"), F.col("ord"))
    pairs = placed.select(F.col("x").alias("u"), "ord").join(placed.select(F.col("x").alias("v"), (F.col("ord") - 1).alias("ord")), "ord").select(F.lit(0).alias("root"), "u", "v")
    return graph.longest_chain(pairs.unionByName(pairs.select("root", F.col("v").alias("u"), F.col("u").alias("v"))), cap=None).select("length", "path")


@query("""WITH RECURSIVE e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS sec FROM events), r AS (SELECT event_type, min(sec) AS anchor FROM e GROUP BY 1
UNION ALL SELECT r.event_type, (SELECT min(sec) FROM e WHERE e.event_type = r.event_type AND sec > r.anchor + 21600) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.event_type = r.event_type AND sec > r.anchor + 21600))
SELECT r.event_type, count(DISTINCT anchor) AS sets, count(*) AS n, min(anchor) AS first, max(anchor) AS last FROM r JOIN e ON e.event_type = r.event_type AND e.sec BETWEEN r.anchor AND r.anchor + 21600 GROUP BY 1""")
def anchored_long_keys(t):
    """Few keys with all events between them."""
    sets = series.anchored_clusters(t.events, "event_type", F.unix_timestamp("ts"), 21600)
    return sets.groupBy("event_type").agg(F.count("*").alias("sets"), F.sum("size").alias("n"), F.min("anchor").alias("first"), F.max("anchor").alias("last"))


@query("""WITH RECURSIVE g AS (SELECT c_custkey AS id, c_custkey // 2 AS up, ['P' || c_custkey] AS path FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, c.c_custkey // 2, list_append(g.path, 'P' || c.c_custkey) FROM customer c JOIN g ON c.c_custkey // 2 = g.id WHERE c.c_custkey > 1)
SELECT len(path)::BIGINT AS levels, count(*) AS n, sum(id)::BIGINT AS ids FROM g WHERE id % 5 <> 0 GROUP BY 1""")
def deep_places(t):
    """A gazetteer as deep as the tree of halved keys; every place is then looked up by its text, smallest part first."""
    k = F.col("c_custkey")
    places = t.customer.select(k.alias("id"), F.floor(k / 2).alias("parent_id"), F.concat(F.lit("P"), k).alias("place"), F.when(k % 5 != 0, k.cast("double")).alias("latitude"), F.lit(0.0).alias("longitude"))
    ways = F.transform(F.sequence(F.lit(0), F.floor(F.log2(k.cast("double"))).cast("int")), lambda i: F.concat(F.lit("P"), F.floor(k / F.pow(F.lit(2.0), i)).cast("long").cast("string")))
    asked = t.customer.select(F.array_join(ways, ", ").alias("place"))
    found = gazetteer.located(asked, "place", gazetteer.flattened(places)).where("latitude is not null")
    return found.groupBy(F.size(F.split("place", ",")).cast("long").alias("levels")).agg(F.count("*").alias("n"), F.sum("latitude").cast("long").alias("ids"))


@query("""WITH y AS (SELECT year(o_orderdate) AS year, list(DISTINCT n_name) AS countries FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 10 = 0 GROUP BY 1),
c AS (SELECT n_nationkey AS ord, n_name AS key, 1985 + n_nationkey % 11 AS first, 1985 + n_nationkey % 11 + (n_nationkey * 7) % 9 AS last, n_name AS country FROM nation),
h AS (SELECT year, key, row_number() OVER (PARTITION BY year ORDER BY ord) AS r FROM y JOIN c ON year BETWEEN first AND last AND list_contains(countries, country))
SELECT year::BIGINT AS year, string_agg(key, ',' ORDER BY r) AS events FROM h WHERE r <= 2 GROUP BY 1""")
def events_by_year(t):
    k = F.col("n_nationkey")
    rows = t.orders.where("o_orderkey % 10 = 0").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == k)
    years = rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.collect_set("n_name").alias("countries"))
    catalogue = t.nation.select(k.alias("ord"), F.col("n_name").alias("key"), (k % 11 + 1985).alias("first"), (k % 11 + 1985 + k * 7 % 9).alias("last"), F.array("n_name").alias("countries"))
    return gazetteer.events_of(years, catalogue, width=4).select(long("year").alias("year"), F.array_join("events", ",").alias("events"))


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents WHERE lang <> 'en'),
k AS (SELECT lang, w, lower(strip_accents(replace(replace(w, 'ß', 'ss'), 'ẞ', 'SS'))) AS key FROM w), c AS (SELECT lang, key, count(*) AS n, count(DISTINCT w) AS forms FROM k GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, key) AS ord, key, n, forms FROM c QUALIFY ord <= 20""")
def folded_words(t):
    """Words by their folded key, with the number of their spellings."""
    words = t.documents.where("lang <> 'en'").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    forms = words.groupBy("lang", "w").agg(F.count("*").alias("n"))  # spellings are folded once each
    counts = forms.select("lang", text.folded(F.col("w")).alias("key"), "n").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    ranked = counts.withColumn("ord", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")).cast("long"))
    return ranked.where("ord <= 20").select("lang", "ord", "key", "n", "forms")


@query(r"""WITH w AS (SELECT DISTINCT regexp_extract(text, '^\p{L}+') AS label FROM documents WHERE lang IN ('de', 'es')) SELECT row_number() OVER (ORDER BY label = 'Der', label COLLATE sv, label) AS ord, label FROM w WHERE label <> ''""")
def labels_by_locale(t):
    """First words in the order of Swedish, with one pinned last."""
    words = t.documents.where("lang in ('de', 'es')").select(F.regexp_extract("text", r"^\p{L}+", 0).alias("label")).where("label <> ''").distinct()
    return rank.label_sorted(words, "label", "Der", "sv-SE").select("ord", "label")


@query("""SELECT c_custkey AS id, '{"id":' || c_custkey || ',"name":"' || c_name || '","nation":' || CASE WHEN c_nationkey % 3 = 0 THEN 'null' ELSE c_nationkey::VARCHAR END || ',"tags":["' || c_mktsegment || '","a\\"b/é"]}' AS json FROM customer""")
def rows_as_json(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("nation"), F.array("c_mktsegment", F.lit('a"b/é')).alias("tags"))
    return payload.json_rows(rows).select(F.get_json_object("json", "$.id").cast("long").alias("id"), "json")


@query(f"""WITH RECURSIVE {PARENTS}, u AS (SELECT parent AS node, 0 AS d FROM pe UNION SELECT child, 0 FROM pe UNION SELECT pe.child, u.d + 1 FROM u JOIN pe ON pe.parent = u.node),
a AS (SELECT node, max(d) AS d FROM u GROUP BY 1), leaf AS (SELECT node, d FROM a WHERE node NOT IN (SELECT parent FROM pe)), top AS (SELECT min(node) AS node, count(*) AS chains FROM leaf WHERE d = (SELECT max(d) FROM leaf)),
up AS (SELECT child, arg_min(parent, (-d, parent)) AS parent FROM pe JOIN a ON node = parent GROUP BY child),
c AS (SELECT 0 AS ord, node, chains FROM top UNION ALL SELECT ord + 1, parent, chains FROM c JOIN up ON child = node)
SELECT ord::BIGINT AS ord, node, chains FROM c WHERE chains > 0""")
def deepest_chain_nodes(t):
    """The nodes of the deepest chain, from its leaf up."""
    return graph.deepest_chain(kin_edges(t)).select(long("ord").alias("ord"), "node", "chains")


@query("""WITH l AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND year(o_orderdate) % 2 = 0 GROUP BY 1), r AS (SELECT year(l_shipdate)::BIGINT AS year, count(*) AS n FROM lineitem GROUP BY 1)
SELECT year, coalesce(l.n, r.n) AS n, l.n IS NULL AS fallback FROM l FULL JOIN r USING (year)""")
def series_left_wins(t):
    """Orders by year where there are any, shipments for the other years."""
    by = lambda df, at, fallback: df.groupBy(long(F.year(at)).alias("year")).agg(F.count("*").alias("n")).withColumn("fallback", F.lit(fallback))
    return rank.left_wins(by(t.orders.where((F.col("o_orderkey") % 3 == 0) & (F.year("o_orderdate") % 2 == 0)), "o_orderdate", False), by(t.lineitem, "l_shipdate", True), "year")


@query("""WITH c AS (SELECT n_nationkey % 4 AS g, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), k AS (SELECT CASE WHEN g < 2 THEN 'low' ELSE 'high ' || g END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, label) AS ord, label, n FROM k""")
def labels_merged(t):
    """Two keys that are shown by one label count together before the ranking."""
    counts = t.customer.groupBy((F.col("c_nationkey") % 4).alias("key")).agg(F.count("*").alias("n"))
    return rank.by_shown_label(counts, F.when(F.col("key") < 2, "low").otherwise(F.concat(F.lit("high "), "key")), 10)


@query("""WITH y AS (SELECT year(o_orderdate) - 3000 AS y FROM orders UNION ALL SELECT year(o_orderdate) FROM orders), c AS (SELECT CASE WHEN y > 0 THEN (y + 99) // 100 ELSE -((99 - y) // 100) END AS century, count(*) AS n FROM y GROUP BY 1)
SELECT row_number() OVER (ORDER BY century)::BIGINT AS ord, abs(century) || CASE WHEN abs(century) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN abs(century) % 10 = 1 THEN 'st' WHEN abs(century) % 10 = 2 THEN 'nd' WHEN abs(century) % 10 = 3 THEN 'rd' ELSE 'th' END || ' Century' || CASE WHEN century < 0 THEN ' BCE' ELSE '' END AS label, n AS value, n || ' orders' AS tooltip, CASE WHEN century < 0 THEN 'old' ELSE '' END AS class FROM c""")
def century_bars(t):
    """Bars of centuries before and after Christ, with tooltips and classes."""
    years = t.orders.select(F.explode(F.array(F.year("o_orderdate") - 3000, F.year("o_orderdate"))).alias("y"))
    counts = years.groupBy(calendar.century(F.col("y")).alias("century")).agg(F.count("*").alias("n"))
    c = F.col("century")
    return payload.mapped(counts, c, labels.century_long(c), F.col("n"), F.concat("n", F.lit(" orders")), F.when(c < 0, "old").otherwise(""))


@query("""WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS u, 'O' || l_orderkey AS v FROM lineitem WHERE l_orderkey % 50 = 0), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), d AS (SELECT u, count(*) AS degree FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS edges, u AS hub, degree FROM d ORDER BY degree DESC, u LIMIT 1""")
def edges_and_hub(t):
    """Edges of a graph in both directions, and the node with most neighbours."""
    ties = t.lineitem.where("l_orderkey % 50 = 0").select(F.concat(F.lit("S"), "l_suppkey").alias("u"), F.concat(F.lit("O"), "l_orderkey").alias("v")).distinct()
    both = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("root", F.lit(0))
    return graph.edge_count(both).join(graph.hub(both), "root").select("edges", "hub", "degree")


@query("""WITH p AS (SELECT c_custkey AS k, 2378497 + (c_custkey * 7919) % 60000 AS jd, c_mktsegment AS seg, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), n AS (SELECT count(*) AS n FROM orders), d AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588 AS jd FROM orders)
SELECT 'individuals' AS what, count(*) AS n, count(*) FILTER (k % 2 = 0) AS x FROM p UNION ALL SELECT 'families', n, n * 2 FROM n UNION ALL SELECT 'links', (SELECT n FROM n) * 2, 2 UNION ALL SELECT 'names', count(*) * 2, count(DISTINCT seg) FROM p
UNION ALL SELECT 'births', count(*), sum(jd)::BIGINT FROM p UNION ALL SELECT 'marriages', count(*), sum(jd)::BIGINT FROM d UNION ALL SELECT 'places', (SELECT count(DISTINCT (n_name, r_name)) + count(DISTINCT r_name) FROM p), (SELECT count(*) * 2 FROM p)""")
def imported_file(t):
    """Persons and families written as a family file into the shared folder, and what the importer makes of it."""
    epoch, k = F.lit("1970-01-01").cast("date"), F.col("c_custkey")
    day = lambda at: F.concat(F.dayofmonth(at), F.lit(" "), F.upper(F.date_format(at, "MMM")), F.lit(" "), F.year(at))
    born = F.date_add(epoch, (k * 7919 % 60000 + 2378497 - 2440588).cast("int"))
    people = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    person = F.concat(F.lit("0 @I"), k, F.lit("@ INDI\n1 NAME Ann /"), "c_mktsegment", F.lit("/\n2 SOUR @S1@\n2 ROMN An /"), "c_mktsegment", F.lit("/\n1 SEX "), F.when(k % 2 == 0, "M").otherwise("F"), F.lit("\n1 BIRT\n2 DATE "), day(born), F.lit("\n2 PLAC "), "n_name", F.lit(", "), "r_name")
    family = F.concat(F.lit("0 @F"), "o_orderkey", F.lit("@ FAM\n1 HUSB @I"), "o_custkey", F.lit("@\n1 WIFE @I"), F.col("o_custkey") + 1, F.lit("@\n1 MARR\n2 DATE "), day(F.to_date("o_orderdate")))
    path = f"{shared_folder(t._spark)}/family-file-{uuid.uuid4().hex}"
    people.select(person.alias("value")).unionByName(t.orders.select(family.alias("value"))).write.text(path)
    tables = gedcom.read_tree(t._spark, path, 7)
    i, f, links, names, dates, places = (tables[n] for n in ("individuals", "families", "link", "name", "dates", "places"))
    count = lambda c: F.sum(c.cast("long"))
    rows = [
        i.agg(F.count("*"), count(F.col("i_sex") == "M")),
        f.agg(F.count("*"), count(F.col("f_husb") != "") + count(F.col("f_wife") != "")),
        links.where("l_type in ('HUSB', 'WIFE')").agg(F.count("*"), F.countDistinct("l_type")),
        names.agg(F.count("*"), F.countDistinct("n_surn")),
        dates.where("d_fact = 'BIRT'").agg(F.count("*"), F.sum("d_julianday1")),
        dates.where("d_fact = 'MARR'").agg(F.count("*"), F.sum("d_julianday1")),
        places.agg(F.count("*"), F.lit(0)).crossJoin(tables["placelinks"].agg(F.count("*").alias("p"))),
    ]
    out = None
    for what, one in zip(("individuals", "families", "links", "names", "births", "marriages", "places"), rows, strict=True):
        one = one.toDF("n", "x", "p").select("n", F.col("p").alias("x")) if what == "places" else one.toDF("n", "x")
        one = one.select(F.lit(what).alias("what"), long("n").alias("n"), long("x").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out
