"""Graph loops and anchored sets against plain loops: random graphs, cycles, long lines, stars and dense runs; rows of the largest tasks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import graph, series


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def skewed(spark):
    """AQE splits what is larger than a few kilobytes, over 16 partitions; yields the shuffle reads of all tasks, by stage."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    seen = {stages().apply(i).stageId() for i in range(stages().size())}

    def reads():
        out, rows = {}, stages()
        for i in range(rows.size()):
            s = rows.apply(i)
            if s.stageId() not in seen and s.shuffleReadRecords():
                tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
                out[s.stageId()] = [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size()) if tasks.apply(k).taskMetrics().isDefined()]
        return out

    yield reads
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def smallest(edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    root = {}
    for s in sorted(near):
        todo = [s] if s not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = s
                todo += near[x]
    return {x: r for x, r in root.items() if x != r}


def lines(n, seed=None):
    order = list(range(n))
    if seed is not None:
        random.Random(seed).shuffle(order)
    return list(zip(order, order[1:], strict=False))


@pytest.mark.parametrize("edges", [[(random.Random(s).randrange(60), random.Random(s + 999).randrange(60)) for s in range(n)] for n in (10, 45, 80)] + [lines(300), lines(300, 1), [(7, x) for x in range(40)], [(1, 1), (2, 3), (3, 2)]], ids=["sparse", "middle", "dense", "line", "shuffled", "star", "loops"])
def test_roots(spark, edges):
    rows = graph.roots(frame(spark, edges, "u int, v int")).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.root for r in rows} == smallest(edges)


def test_roots_of_nothing_and_of_texts(spark):
    assert graph.roots(frame(spark, [], "u string, v string")).collect() == []
    assert {r.node: r.root for r in graph.roots(frame(spark, [("b", "a"), ("c", "b"), ("z", "z")], "u string, v string")).collect()} == {"b": "a", "c": "a"}


def test_a_large_star_is_dealt_out(spark, skewed):
    """The centre of 200,000 edges, neither the smallest node nor the largest: no task reads much more than the others of its stage."""
    n = 200_000
    star = spark.range(n).select(F.when(F.col("id") == n // 2, n).otherwise(F.col("id")).alias("u"), F.lit(n // 2).cast("long").alias("v"))
    rows = graph.roots(star)
    assert rows.where("root = 0").count() == n and rows.count() == n
    large = {k: v for k, v in skewed().items() if sum(v) > n}
    assert large and all(max(v) <= 4 * sorted(v)[len(v) // 2] for v in large.values()), {k: (max(v), sorted(v)[len(v) // 2]) for k, v in large.items()}


def down(edges, cap):
    kids = defaultdict(set)
    for p, c in edges:
        if p != c:
            kids[p].add(c)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    alive = {x: 0 for x in nodes}
    seen, r = set(nodes), 0
    while seen:
        now = {p for p in kids if kids[p] & seen}
        r += 1
        for x in now:
            alive[x] = r
        if now == seen:
            break
        seen = now
    for x in seen:
        alive[x] = max([0, *(alive[c] + 1 for c in kids[x] - seen)])
    return {x: (min(d, cap), d >= cap) for x, d in alive.items()}


def below(edges):
    kids = defaultdict(set)
    for p, c in edges:
        if p != c:
            kids[p].add(c)
    out = {}
    for x in list(kids):
        found, todo = set(), list(kids[x])
        while todo:
            y = todo.pop()
            if y not in found and y != x:
                found.add(y)
                todo += kids.get(y, ())
        out[x] = len(found)
    return out


def random_dag(seed, n=60, m=110):
    rng = random.Random(seed)
    return [tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)]


GRAPHS = {"dag": random_dag(1), "deep": [(k, k + 1) for k in range(24)] + random_dag(2, 24, 20), "cycles": random_dag(3) + [(30, 2), (59, 40), (5, 5)], "ring": [(k, (k + 1) % 7) for k in range(7)] + [(7, 0), (3, 8), (8, 9)], "diamonds": [(k, j) for i in range(6) for k in (3 * i,) for j in (k + 1, k + 2)] + [(j, 3 * i + 3) for i in range(6) for j in (3 * i + 1, 3 * i + 2)]}


@pytest.mark.parametrize("name", GRAPHS)
def test_depths(spark, name):
    for stride in (3,) if name == "cycles" else (16,):
        got = graph.depths(frame(spark, GRAPHS[name], "parent int, child int"), 30, stride).collect()
        assert {r.node: (r.depth, r.capped) for r in got} == down(GRAPHS[name], 30) and len(got) == len({r.node for r in got})


def test_a_deep_line_needs_few_tables(spark, monkeypatch):
    """A line of 100 generations in 13 tables of levels at most; the old way took one a generation."""
    puts = Counter()
    put = graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: (puts.update([self.name]), put(self, df))[1])
    got = {r.node: r.depth for r in graph.depths(frame(spark, [(k, k + 1) for k in range(100)], "parent int, child int")).collect()}
    assert got == {k: 100 - k for k in range(101)} and puts["levels"] <= 13


@pytest.mark.parametrize("name", ["dag", "cycles", "diamonds"])
def test_top_descendants(spark, name):
    """The highest counts are right, and so is every other that is given."""
    exact = below(GRAPHS[name])
    edges = frame(spark, GRAPHS[name], "parent int, child int")
    for k in (3,) if name != "dag" else (1, 500):
        got = {r.ancestor: r.n for r in graph.top_descendants(edges, k, 2).collect()}
        assert all(exact[x] == n for x, n in got.items())
        order = sorted((x for x in exact if exact[x]), key=lambda x: (-exact[x], x))[:k]
        assert sorted(got, key=lambda x: (-got[x], x))[:k] == order


def test_closure_of_some(spark):
    """All pairs of some starts, below others and on a cycle, whatever the steps of a job."""
    edges, exact = frame(spark, GRAPHS["cycles"], "parent int, child int").where("parent <> child"), below(GRAPHS["cycles"])
    got = Counter(r.ancestor for r in graph.closure(edges, frame(spark, [(x,) for x in range(0, 60, 3)], "ancestor int"), 2).collect())
    assert got == {x: n for x, n in exact.items() if x % 3 == 0 and n}


def test_few_closures_are_made(spark, monkeypatch):
    """Three generations of families: descendants are counted for the few that can be among the first, not for all."""
    made = Counter()
    count = graph.closure
    monkeypatch.setattr(graph, "closure", lambda edges, starts, *a: (made.update(n=starts.count()), count(edges, starts, *a))[1])
    rng = random.Random(9)
    edges = [(f"g{i % 300}", f"p{i}") for i in range(900)] + [(f"p{rng.randrange(900) if i > 400 else 7}", f"c{i}") for i in range(2000)]
    got = {r.ancestor: r.n for r in graph.top_descendants(frame(spark, edges, "parent string, child string"), 3).collect()}
    exact = below(edges)
    order = sorted(exact, key=lambda x: (-exact[x], x))[:3]
    assert sorted(got, key=lambda x: (-got[x], x))[:3] == order and made["n"] < len(exact) / 4


def test_nodes_under_many_others_are_not_counted(spark, monkeypatch):
    """Every node's parents are its half and its third, so ways say nothing of the first 50; few of these have under 3 ancestors."""
    counted = []
    reached = graph.reached
    monkeypatch.setattr(graph, "BITS", 10)
    monkeypatch.setattr(graph, "reached", lambda edges, starts, *a: (counted.extend(starts), reached(edges, starts, *a))[1])
    pairs = [(c // d, c) for c in range(2, 8000) for d in (2, 3) if c // d]
    got = {r.ancestor: r.n for r in graph.top_descendants(frame(spark, pairs, "parent int, child int"), 3).collect()}
    exact = below(pairs)
    assert sorted(got, key=lambda x: (-got[x], x))[:3] == sorted(exact, key=lambda x: (-exact[x], x))[:3]
    assert all(exact[x] == n for x, n in got.items()) and len(counted) < 10


def test_cycles_are_not_outranked(spark):
    """A ring of 70 and a line below it: all of the ring have 70 ancestors or more, and as many descendants as each other."""
    pairs = [(k, (k + 1) % 70) for k in range(70)] + [(69, 70)] + [(k, k + 1) for k in range(70, 80)]
    got = {r.ancestor: r.n for r in graph.top_descendants(frame(spark, pairs, "parent int, child int"), 2, 1).collect()}
    assert sorted(got, key=lambda x: (-got[x], x))[:2] == [0, 1] and {got[x] for x in range(70)} == {80}


@pytest.mark.parametrize("many", [1, 62, 63, 130])
def test_reached_by_bits(spark, many):
    """As many starts as one, two and three longs hold, on cycles too."""
    pairs = random_dag(7, 150, 260) + [(140, 2), (100, 30)]
    exact = below(pairs)
    got = {r.ancestor: r.n for r in graph.reached(frame(spark, pairs, "parent int, child int"), list(range(many)), 3).collect()}
    assert got == {x: n for x, n in exact.items() if x < many and n}


def sets(times, reach):
    out, anchor = Counter(), None
    for t in sorted(times):
        if anchor is None or t - anchor > reach:
            anchor = t
        out[anchor] += 1
    return out


@pytest.mark.parametrize("reach", [0, 1, 5, 50])
def test_anchored_sets(spark, reach):
    rng = random.Random(reach)
    rows = [(k, int(rng.gauss(0, 40 * (1 + len(k or ''))))) for k in ("a", "bb", "cccc", None) for _ in range(150)] + [("a", None)]
    bound = 100 if reach > 1 else 1  # of the four keys some are folded, some linked
    got = series.anchored_clusters(frame(spark, rows, "who string, t long"), "who", F.col("t"), reach, bound).collect()
    expected = Counter()
    for k in {k for k, _ in rows}:
        expected.update({(k, a): n for a, n in sets([t for j, t in rows if j == k and t is not None], reach).items()})
    assert Counter({(r.who, r.anchor): r.size for r in got}) == expected and len(got) == len(expected)


def test_anchored_sets_of_one_key_are_spread(spark, skewed):
    """300,000 places of one key a second apart: a chain of 83 sets, in no task as a whole."""
    n = 300_000
    got = series.anchored_clusters(spark.range(n).select(F.lit("k").alias("who"), F.col("id").alias("t")), "who", F.col("t"), 3600).collect()
    assert sorted((r.anchor, r.size) for r in got) == [(a, min(3601, n - a)) for a in range(0, n, 3601)]
    assert all(max(v) < n / 3 for v in skewed().values() if sum(v) >= n)


def test_anomalies_of_equal_windows_tie(spark):
    """Two windows of the same values in another order: the earlier one comes first, whatever the order of the sums."""
    a = [1260, 1380, 1320, 1320, 1320, 1500, 1320, 1260, 1320, 1380, 1200]
    b = [1260, 1260, 1380, 1320, 1200, 1500, 1320, 1320, 1320, 1380, 1320]
    rows = frame(spark, list(enumerate(a + b)), "y int, n long")
    assert [r.y for r in series.anomalies(rows, "y", "n", n=1).collect()] == [5]
    both = series.anomalies(rows, "y", "n").collect()
    assert [r.y for r in both] == [5, 16] and len({r.z_score for r in both}) == 1


def chain_of(edges, cap=100):
    """The longest shortest way by two queues."""
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)

    def ways(start):
        best, now = {start: (start,)}, [start]
        while now:
            new = {}
            for x in now:
                for y in near[x]:
                    if y not in best:
                        new[y] = min(new.get(y, best[x] + (y,)), best[x] + (y,))
            best |= new
            now = list(new)
        return best

    first = ways(min(near))
    most = max(map(len, first.values()))
    second = ways(min(x for x, w in first.items() if len(w) == most))
    most = max(map(len, second.values()))
    cut = [w[-cap:] for w in second.values() if len(w) == most]
    return min(min(w, w[::-1]) for w in cut)


def tangle(seed, n, extra):
    rng = random.Random(seed)
    return [(k, rng.randrange(max(0, k - 6), k)) for k in range(1, n)] + [tuple(rng.sample(range(n), 2)) for _ in range(extra)]


CHAINS = [lines(12, 4), [(k, (k + 1) % 9) for k in range(9)], tangle(1, 40, 0), tangle(2, 40, 3), tangle(3, 30, 12), [(3, 8)], [(0, k) for k in range(1, 6)] + [(5, 9)], [(k, k + 1) for k in range(10)] + [(10, 20), (20, 21), (21, 5), (10, 11), (11, 12)]]


def test_longest_chains(spark):
    rows = [(g, *e) for g, edges in enumerate(CHAINS) for a, b in edges for e in ((a, b), (b, a))]
    for cap in (100, 5):
        got = {r.g: (r.length, r.path) for r in graph.longest_chain(frame(spark, rows, "g int, u int, v int"), "g", cap).collect()}
        expected = {g: chain_of(edges, cap) for g, edges in enumerate(CHAINS)}
        assert got == {g: (len(p), ",".join(map(str, p))) for g, p in expected.items()}


HANDLE = [(k, k + 1) for k in range(20, 50)]
BROOMS = [HANDLE + [(20, x) for x in range(12)], HANDLE + [(50, x) for x in range(12)], HANDLE + [(50, 1), (20, 0), *((0, x) for x in range(60, 72))], HANDLE + [(50, 1), (20, 0), (0, 300), (0, 310), (300, 950), (310, 900)], HANDLE + [(20, 10), (20, 11), (10, 3), (11, 2)]]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_longest_chains_are_whole(spark, kind):
    """Without a cap: trees and tangles, lines with many ends, read from the first node or from the last, and one of several stretches."""
    graphs = [[(f"{u:04}", f"{v:04}") if kind == "string" else (u, v) for u, v in edges] for edges in [*CHAINS, *BROOMS, lines(2500, 6)]]
    rows = [(g, *e) for g, edges in enumerate(graphs) for a, b in edges for e in ((a, b), (b, a))]
    got = {r.g: (r.length, r.path) for r in graph.longest_chain(frame(spark, rows, f"g int, u {kind}, v {kind}"), "g", None).collect()}
    expected = {g: chain_of(edges, len(rows)) for g, edges in enumerate(graphs)}
    assert got == {g: (len(p), ",".join(map(str, p))) for g, p in expected.items()} and got[len(graphs) - 1][0] == 2500


@pytest.mark.parametrize("ends, path", [(range(300), [0, *range(1000, 1500)]), (range(2000, 2300), [1, *range(1498, 999, -1), 0, 2000])])
def test_of_whole_ways_one_is_looked_up(spark, monkeypatch, ends, path):
    """300 equal ways of some 500 nodes, the smallest read from its last or from its first node: only its nodes are joined."""
    looked = []
    joined = graph.joined
    monkeypatch.setattr(graph, "joined", lambda nodes, key: (looked.append(nodes.count()), joined(nodes, key))[1])
    line = list(range(1000, 1500)) if 0 in ends else [0, *range(1000, 1499), 1]
    edges = list(zip(line, line[1:], strict=False)) + [(line[0], x) for x in ends]
    (row,) = graph.longest_chain(frame(spark, [("g", a, b) for e in edges for a, b in (e, e[::-1])], "root string, u int, v int"), cap=None).collect()
    assert (row.length, row.path) == (len(path), ",".join(map(str, path))) and looked == [len(path)]


def test_a_long_line_takes_few_tables(spark, monkeypatch):
    """A line of 5,000 persons in any order, and its last hundred: a walk by levels wrote 10,000 tables."""
    puts = Counter()
    put = graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: (puts.update(n=1), put(self, df))[1])
    line = lines(5000, 3)
    rows = spark.createDataFrame([("g", f"{a:05}", f"{b:05}") for u, v in line for a, b in ((u, v), (v, u))], "root string, u string, v string")
    (row,) = graph.longest_chain(rows).collect()
    assert (row.length, row.path) == (100, ",".join(f"{x:05}" for x in chain_of(line))) and puts["n"] <= 30


def test_a_line_is_drawn_together_once(spark, monkeypatch):
    """A line of 500 in mixed order: its two walks share one set of drawn-together lines."""
    made = Counter()
    lines = graph.lines
    monkeypatch.setattr(graph, "lines", lambda *a: (made.update(["lines"]), lines(*a))[1])
    order = list(range(500))
    random.Random(5).shuffle(order)
    rows = [("g", a, b) for a, b in zip(order, order[1:], strict=False)]
    (row,) = graph.longest_chain(frame(spark, rows + [(g, b, a) for g, a, b in rows], "root string, u int, v int"), cap=600).collect()
    assert [int(x) for x in row.path.split(",")] == min(order, order[::-1]) and made["lines"] == 1


def test_rounds_are_not_broadcast(spark):
    """Tables of a few KB that a loop joins with each other in every round are merged, not sent through the driver."""
    edges = frame(spark, [(k, k // 2) for k in range(1, 300)], "u int, v int")
    plan = graph.roots(edges)._jdf.queryExecution().executedPlan().toString()
    both = graph.Rounds("t", merge=True).put(edges)
    joined = both.join(both.select(F.col("u").alias("v"), F.col("v").alias("w")), "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan + joined and "SortMergeJoin" in joined
