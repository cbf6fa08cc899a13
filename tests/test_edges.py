"""Policies, payloads, gazetteer, chains and excerpts on small frames."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinweave.functions import labels, text
from kinweave.operators import graph, privacy, rank, series, tables
from kinweave.plans import payload
from kinweave.sources import gazetteer


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_policies(spark):
    seen = frame(spark, [("a", True, "Ann"), ("b", False, "Bob"), ("c", True, "Cid"), ("d", True, "Dee")], "k string, visible boolean, label string")
    ranked = frame(spark, [("a", 1), ("b", 2), ("x", 3)], "k string, ord int")
    assert [(r.k, r.label) for r in privacy.labelled(ranked, seen, "k").orderBy("ord").collect()] == [("a", "Ann"), ("b", "Private"), ("x", "Private")]
    samples = frame(spark, [("g", k, n) for n, k in enumerate("abcd")], "g string, k string, o int")
    assert [r.k for r in privacy.promoted(samples, seen, "k", ["g"], "o", 2).orderBy("o").collect()] == ["a", "c"]
    assert [r.k for r in privacy.dropped(ranked, seen, "k").collect()] == ["a"]
    rows = privacy.redacted(frame(spark, [("a", "M"), ("b", "F")], "k string, sex string"), seen, "k", {"sex": "U"})
    assert sorted((r.k, r.sex) for r in rows.collect()) == [("a", "M"), ("b", "U")]


def test_payloads(spark):
    matrix = frame(spark, [("a", "a", 1), ("a", "b", 2), ("b", "a", 2), ("b", "b", 0)], "row_label string, col_label string, n long")
    assert payload.chord(matrix) == {"labels": ["a", "b"], "matrix": [[1, 2], [2, 0]]}
    flows = frame(spark, [(1, "x", "y", 0, 1, 5, "I1,I2")], "ord long, source string, target string, source_node long, target_node long, weight long, samples string")
    assert payload.encode(payload.sankey(flows)) == '{"nodes":[{"name":"x"},{"name":"y"}],"links":[{"source":0,"target":1,"value":5,"samples":[{"xref":"I1"},{"xref":"I2"}]}]}'
    line = frame(spark, [(1900, 2.0, None), (1890, 1.0, 3.0)], "d int, m double, f double")
    assert payload.line_chart(line, "d", {"men": "m", "women": "f"})["series"][1]["values"] == [3.0, None]
    bars = frame(spark, [(1, "a", 4), (2, "b", 1)], "ord int, l string, n int")
    assert payload.progress(bars, "l", "n")[1] == {"rank": "02", "label": "b", "value": 1, "percent": 25.0}
    assert payload.progress(bars.limit(0), "l", "n") == []


def test_gazetteer_of_any_depth(spark):
    """Forty levels, blank parts, repeated names, a ring, an orphan, and half a coordinate."""
    deep = [(k, k - 1, f"L{k}", float(k), 0.0) for k in range(1, 41)]
    odd = [(50, 1, "L2", 50.0, 1.0), (51, 50, "Under", 51.0, 1.0), (52, 2, "Gone", 52.0, 1.0), (60, 61, "R", 1.0, 1.0), (61, 60, "S", 1.0, 1.0), (62, 61, "T", 1.0, 1.0), (70, 99, "Orphan", 1.0, 1.0), (71, None, "Half", 1.0, None), (72, 0, None, 1.0, 1.0)]
    flat = gazetteer.flattened(frame(spark, [x for x in deep if x[0] != 2] + [(2, 1, "L2", 2.0, 0.0)] + odd, "id long, parent_id long, place string, latitude double, longitude double"))
    got = {tuple(r.path): r.latitude for r in flat.collect()}
    assert got == {("L1",): 1.0, ("L1", "L2"): 50.0, ("L1", "L2", "Under"): 51.0}
    whole = gazetteer.flattened(frame(spark, deep, "id long, parent_id long, place string, latitude double, longitude double"))
    text_of = lambda n: " , ".join(f"L{k}" for k in range(n, 0, -1))
    rows = gazetteer.located(frame(spark, [(text_of(40),), (text_of(7).replace(",", ",,"),), ("",), (None,), ("L2",)], "p string"), "p", whole).collect()
    assert {r.p: r.latitude for r in rows} == {text_of(40): 40.0, text_of(7).replace(",", ",,"): 7.0, "": None, None: None, "L2": None}


def test_events_of_spans_and_countries(spark):
    """Against a plain search in the catalogue: long spans, years before Christ, ends, and spans the wrong way round."""
    catalogue = [(1, "a", -50, 40, ["DE"]), (2, "b", 31, 32, ["DE", "FR"]), (3, "c", 1, 2000, ["FR"]), (4, "d", 64, 63, ["DE"]), (5, "e", 40, 40, ["DE"])]
    years = [(y, c) for y, c in zip((-51, -50, -1, 31, 32, 33, 40, 41, 63, 2000, 2001), (["DE"], ["DE"], ["FR", "DE"], ["FR"], ["DE"], [], ["DE", "FR"], ["DE"], ["DE"], ["FR"], ["FR"]), strict=True)]
    got = {r.year: r.events for r in gazetteer.events_of(frame(spark, years, "year int, countries array<string>"), frame(spark, catalogue, "ord int, key string, first int, last int, countries array<string>")).collect()}
    plain = {y: [k for _, k, lo, hi, theirs in catalogue if lo <= y <= hi and set(theirs) & set(c)][:2] for y, c in years}
    assert got == {y: e for y, e in plain.items() if e}


def test_locale_order(spark):
    rows = frame(spark, [(x,) for x in ("Zoo", "Öl", "Oma", "Other", "Ähre", "Ast", "ast")], "label string")
    order = lambda locale: [r.label for r in rank.label_sorted(rows, "label", "Other", locale).orderBy("ord").collect()]
    assert order("de-DE") == order(None) == order("xx") == ["Ähre", "ast", "Ast", "Öl", "Oma", "Zoo", "Other"] or order("de")[-1] == "Other"
    assert order("sv") == ["ast", "Ast", "Oma", "Zoo", "Ähre", "Öl", "Other"] and order("sv_SE") == order("sv")
    assert order("de").index("Öl") < order("de").index("Zoo") and order("de").index("Ähre") < order("de").index("Öl")


def test_shown_labels_are_summed(spark):
    counts = frame(spark, [("a", 2), ("b", 3), ("c", 4), ("d", 5)], "key string, n long")
    shown = rank.by_shown_label(counts, F.when(F.col("key").isin("a", "b"), "x").otherwise(F.upper("key")), 2)
    assert [(r.ord, r.label, r.n) for r in shown.orderBy("ord").collect()] == [(1, "D", 5), (2, "x", 5)]


def test_numbers_beside_clashing_names(spark):
    rows = frame(spark, [("b", 1, 2, 3), ("a", 4, 5, 6)], "label string, _at int, _part int, _n int")
    got = rank.numbered(rows, F.col("label"))
    assert got.columns == ["label", "_at", "_part", "_n", "ord"] and [(r.label, r._at, r.ord) for r in got.orderBy("ord").collect()] == [("a", 4, 1), ("b", 1, 2)]


def test_rows_as_json(spark, tmp_path):
    """Compact objects that a JSON reader reads back, from the executors; malformed text is mended, numbers without a form are errors."""
    odd = spark.range(3).select("id", F.expr("cast(unhex(if(id = 0, '61FF62', '2F22C3A9')) as string)").alias("t x"), F.when(F.col("id") == 1, 1.5).alias("n"), F.expr("array(named_struct('k', cast(unhex('80') as string)))").alias("a"), F.expr("map('m', id)").alias("m"))
    payload.write_json(odd, f"file://{tmp_path}/out")
    lines = sorted(line for f in (tmp_path / "out").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines())
    assert [json.loads(x) for x in lines] == [{"id": k, "t x": "a\ufffdb" if k == 0 else '/"é', "n": 1.5 if k == 1 else None, "a": [{"k": "\ufffd"}], "m": {"m": k}} for k in range(3)]
    assert lines[1].startswith('{"id":1,"t x":') and len(list((tmp_path / "out").glob("part-*"))) > 1
    with pytest.raises(Exception, match="finite"):
        payload.json_rows(spark.range(1).select(F.lit(float("nan")).alias("x"))).collect()
    assert spark.range(1).select(payload.attribute(F.lit('{"a":"<b> & \'c\'"}')).alias("x")).first().x == "{&quot;a&quot;:&quot;&lt;b&gt; &amp; &#039;c&#039;&quot;}"
    people = frame(spark, [("I1", "Ann", "F", 1850, None)], "xref string, label string, sex string, birth int, death int")
    assert payload.json_rows(payload.wire_frame(people, "/tree/{xref}?x=1")).first().json == '{"xref":"I1","label":"Ann","sex":"F","birth":1850,"death":null,"url":"/tree/I1?x=1"}'


def test_gazetteer(spark):
    places = frame(spark, [(1, None, "Germany", 51.0, 9.0), (2, 1, "Bremen", 53.0, 8.0), (3, 2, "Mitte", None, None)], "id long, parent_id long, place string, latitude double, longitude double")
    flat = gazetteer.flattened(places)
    rows = gazetteer.located(frame(spark, [("Bremen, Germany",), ("Mitte, Bremen, Germany",), ("Bremen",), ("Germany",)], "p string"), "p", flat)
    assert {r.p: r.latitude for r in rows.collect()} == {"Bremen, Germany": 53.0, "Mitte, Bremen, Germany": None, "Bremen": None, "Germany": 51.0}
    years = frame(spark, [(1850, ["DE"]), (1871, ["DE", "FR"])], "year int, countries array<string>")
    catalogue = frame(spark, [(1, "war", 1870, 1871, ["FR"]), (2, "flu", 1850, 1880, ["DE"]), (3, "frost", 1871, 1871, ["DE"])], "ord int, key string, first int, last int, countries array<string>")
    assert {r.year: r.events for r in gazetteer.events_of(years, catalogue).collect()} == {1850: ["flu"], 1871: ["war", "flu"]}


def test_chains(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("b", "e"), ("l", "l")], "parent string, child string")
    assert [(r.node, r.chains) for r in graph.deepest_chain(edges).orderBy("ord").collect()] == [("d", 1), ("c", 1), ("b", 1), ("a", 1)]
    cycle = frame(spark, [("p", "q"), ("q", "p"), ("q", "r")], "parent string, child string")
    assert {r.node: r.depth for r in graph.depths(cycle).collect()} == {"r": 0, "q": 1, "p": 0}
    star = [("h", x) for x in "abcde"] + [("a", "z")]
    both = frame(spark, [("g", u, v) for u, v in star] + [("g", v, u) for u, v in star], "root string, u string, v string")
    (row,) = graph.longest_chain(both).collect()
    assert (row.length, row.path) == (4, "b,h,a,z")
    assert [(r.low, r.high) for r in graph.excerpt(both, "b,h,a,z", 5).collect()] == [("a", "h"), ("a", "z"), ("b", "h"), ("c", "h")]
    assert [(r.hub, r.degree) for r in graph.hub(both).collect()] == [("h", 5)] and [r.edges for r in graph.edge_count(both).collect()] == [6]
    assert len(graph.excerpt(both, "b", 70).collect()) == 6


def test_depth_is_capped_where_it_equals_the_cap(spark):
    line = frame(spark, [(k, k + 1) for k in range(6)], "parent int, child int")
    got = {r.node: (r.depth, r.capped) for r in graph.depths(line, 5).collect()}
    assert got[0] == (5, True) and got[1] == (5, True) and got[2] == (4, False) and got[6] == (0, False)


def test_graphs_of_nothing(spark):
    none = frame(spark, [], "parent string, child string")
    assert graph.depths(none).count() == graph.descendants(none).count() == graph.deepest_chain(none).count() == 0
    both = frame(spark, [], "root string, u string, v string")
    assert graph.longest_chain(both).count() == graph.excerpt(both, "a").count() == 0


def test_queue_order_decides_equal_ways(spark):
    """Of two ways of one length to a node, the one through the neighbour that entered the queue first."""
    pairs = [("s", "a"), ("s", "b"), ("a", "z"), ("b", "c"), ("z", "t"), ("c", "t")]
    both = frame(spark, [("g", u, v) for u, v in pairs] + [("g", v, u) for u, v in pairs], "root string, u string, v string")
    paths = {r.node: "".join(r.path) for r in graph.walk(both, frame(spark, [("g", "s")], "root string, node string"), "root").collect()}
    assert paths["t"] == "sazt"


def test_clusters_of_a_dense_run(spark):
    rows = frame(spark, [("k", x) for x in (0, 1, 2, 3, 10, 11, 12, 40)] + [("m", None)], "k string, t long")
    got = sorted((r.anchor, r.size) for r in series.anchored_clusters(rows, "k", F.col("t"), 2).collect())
    assert got == [(0, 3), (3, 1), (10, 3), (40, 1)]


# Names and the tokens that must be left of them.
NAMES = [
    ("Anna Maria", ["Anna", "Maria"]), ("José M", ["José"]), ("Hans von", ["Hans"]), ("Anna\t  Maria", ["Anna", "Maria"]), ("@P.N.", []), ("", []), ("   ", []),
    ("John (King)", ["John"]), ("William II", ["William"]), ("Henry VIII", ["Henry"]), ("Abia (Abijah) (4th King) of JUDAH", ["Abia", "JUDAH"]), ("Robert `the Bruce`", ["Robert", "Bruce"]),
    ("Aba (Ava) of ARVERNE", ["Aba", "ARVERNE"]), ("(Miss)", []), ("2nd", []), ("Karl 2ND", ["Karl"]), ("Karl [der Große]", ["Karl"]), ("Karl {der Große}", ["Karl"]), ("Anna (King", ["Anna", "King"]),
    ("O'Brien", ["O'Brien"]), ("Sa'id", ["Sa'id"]), ("Jose\u0301 Maria", ["José", "Maria"]), ("2001 4.", ["2001", "4."]), (None, []),
]
KEYS = [("Łukasz", "lukasz"), ("José", "jose"), ("Jose\u0301", "jose"), ("Weiß", "weiss"), ("Æthel", "aethel"), ("Þór", "thor"), ("Øre", "ore"), ("ﬁn", "fin"), ("ANNA", "anna"), ("Иван", "иван"), ("Nguyễn", "nguyen"), ("x\u0332", "x")]


def test_given_names(spark):
    got = frame(spark, [(k, n) for k, (n, _) in enumerate(NAMES)], "k int, n string").select("k", text.given_tokens(F.col("n")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == [t for _, t in NAMES]
    got = frame(spark, [(k, n) for k, (n, _) in enumerate(KEYS)], "k int, n string").select("k", text.folded(F.col("n")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == [t for _, t in KEYS]


def test_names_and_casts(spark):
    row = frame(spark, [("<b>Ann</b> &amp; &quot;Bo&quot; ", "7", "x", None)], "a string, b string, c string, d string")
    out = row.select(text.plain_name(F.col("a")).alias("a"), text.cast_int(F.col("b")).alias("b"), text.cast_int(F.col("c"), 3).alias("c"), text.cast_string(F.col("d"), "-").alias("d"), text.cast_float(F.col("c")).alias("e")).first()
    assert tuple(out) == ('Ann & "Bo"', 7, 3, "-", None)


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(labels.century_long(F.lit(c))) for c in (21, -3, 112)] == ["21st Century", "3rd Century BCE", "112th Century"]
    assert [one(labels.period_label(F.lit(y), n)) for y, n in ((1900, 1), (1900, 3), (-40, 1), (-40, 2))] == ["Period: 1900–1909", "Period: 1900–1929", "Period: 49–40 BCE", "Period: 49–30 BCE"]
    assert [one(labels.month_number(F.lit(m))) for m in ("JAN", "dec", "X")] == [1, 12, None]
    assert [one(labels.month_name(F.lit(m))) for m in (1, 12, 13)] == ["Jan", "Dec", None]
    periods = labels.zodiac_periods()
    assert list(periods)[0] == "Aries" and periods["Aries"] == "21 Mar – 20 Apr" and periods["Capricornus"] == "21 Dec – 19 Jan" and len(periods) == 12
    assert [one(labels.media_label(F.lit(m))) for m in ("PHOTO", "", "zzz")] == ["Photo", "Other", "Other"]


def test_ranks(spark):
    rows = frame(spark, [("b", 2), ("É", 1), ("Other", 9), ("a", 3), ("e", 0)], "label string, n int")
    assert [r.label for r in rank.label_sorted(rows, "label", "Other").orderBy("ord").collect()] == ["a", "b", "e", "É", "Other"]
    assert [(r.label, r.ord) for r in rank.top(rows, 0, F.col("n").desc()).orderBy("ord").collect()] == [("Other", 1), ("a", 2), ("b", 3), ("É", 4), ("e", 5)]
    assert [(r.label, r.ord) for r in rank.top_by_label(rows, 3, "label", F.col("n").desc()).orderBy("ord").collect()] == [("Other", 1), ("a", 2), ("b", 3)]
    upper = lambda values: values.where("v <> 'b'").select("v", F.upper("v").alias("key"), F.concat(F.lit("~"), "v").alias("label"))
    got = sorted((r.n, r.key, r.label) for r in rank.normalized(frame(spark, [("a", 1), ("b", 2), ("a", 3)], "v string, n int"), "v", upper).collect())
    assert got == [(1, "A", "~a"), (2, "b", "b"), (3, "A", "~a")]
    assert rank.distinct_total(rank.folded_counts(rows, F.col("label"), F.col("n"))).first().total == 5


def test_shared_tables(spark):
    rounds = tables.Rounds("t")
    first = rounds.put(spark.range(3))
    assert first.count() == 3 and rounds.put(first.where("id > 0")).count() == 2
    with pytest.raises(Exception, match="(?i)exist|found|file"):
        first.count()
    before = list(tables._THERE)
    with pytest.raises(ValueError), tables.scratch(spark):
        again = tables.written(spark.range(4), "u")
        assert again.count() == 4 and len(tables._THERE) == len(before) + 1
        raise ValueError
    assert tables._THERE == before
    with pytest.raises(Exception, match="(?i)exist|found|file"):
        again.count()
    assert tables.fresh("_k", frame(spark, [], "_K int, _k_ int")) == "_k__"


def test_folding_equals_the_unicode_library(spark):
    """Every Latin and common character, alone and between letters, random composed and decomposed strings, and other scripts."""
    jvm = spark.sparkContext._jvm
    rules, lower = jvm.com.ibm.icu.text.Transliterator.getInstance("Latin-ASCII; Lower()"), jvm.com.ibm.icu.text.Normalizer
    rng = random.Random(4)
    letters = [chr(c) for lo, hi in ((0xC0, 0x250), (0x250, 0x2B0), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA722, 0xA788), (0xFF21, 0xFF5B), (0x2010, 0x2040), (0x400, 0x460), (0x391, 0x3CA)) for c in range(lo, hi) if unicodedata.category(chr(c)) not in ("Cn", "Zl", "Zp", "Cf")]
    marks = ["\u0300", "\u0301", "\u0308", "\u0323", "\u0331", "\u0327"]
    cases = ["a" + c + "b" for c in letters] + letters + ["".join(rng.choice(letters + ["a", "E", " "]) + "".join(rng.choices(marks, k=rng.choice((0, 0, 1, 2)))) for _ in range(4)) for _ in range(1500)] + ["“Anna”–x…", "ＡＢＣ", "é", "가", "", "plain ASCII"]
    got = frame(spark, list(enumerate(cases)), "k int, t string").select("k", text.folded(F.col("t")).alias("x")).orderBy("k").collect()
    wrong = [(c, r.x, want) for c, r in zip(cases, got, strict=True) if r.x != (want := rules.transliterate(lower.compose(c, False)))]
    assert not wrong, (len(wrong), wrong[:20])
    got = frame(spark, list(enumerate(cases)), "k int, t string").select("k", text.composed(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == [unicodedata.normalize("NFC", c) for c in cases]


def test_many_paths_are_not_broadcast(spark, monkeypatch):
    """A gazetteer with more than a few paths is merged; parts with a comma, blank ones and blank places find nothing."""
    rows = [(1, None, "A", 1.0, 0.0), (2, 1, "B", 2.0, 0.0), (3, None, "A,B", 3.0, 0.0), (4, None, "", 4.0, 0.0), (5, 4, "B", 5.0, 0.0)]
    flat = gazetteer.flattened(frame(spark, rows, "id long, parent_id long, place string, latitude double, longitude double"))
    asked = frame(spark, [("B, A",), (" , A",), ("A,B",), ("",), ("B",), (None,)], "place string")
    for few, way in ((100, "BroadcastHashJoin"), (2, "SortMergeJoin")):
        monkeypatch.setattr(gazetteer, "FEW", few)
        found = gazetteer.located(asked, "place", flat)
        assert {r.place: r.latitude for r in found.collect()} == {"B, A": 2.0, " , A": 1.0, "A,B": None, "": None, "B": None, None: None}
        assert way in found._jdf.queryExecution().executedPlan().toString()
