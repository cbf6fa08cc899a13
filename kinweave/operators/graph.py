"""Kinship graphs: parents, ancestors, descendants, depth, components, chains. Loops cut lineage in the shared folder."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.tables import Rounds, written


def parent_map(candidates: DataFrame) -> DataFrame:
    """child, father, mother of the best candidate family: most parents known, of equals the least family.

    candidates: child, family, father, mother. A parent equal to the child is none, and a mother equal to the father neither.
    """
    father = F.when(F.col("father") != F.col("child"), F.col("father"))
    rows = candidates.select("child", "family", father.alias("father"), F.col("mother").alias("m"))
    mother = F.when((F.col("m") != F.col("child")) & ~F.coalesce(F.col("m") == F.col("father"), F.lit(False)), F.col("m"))
    rows = rows.select("child", "family", "father", mother.alias("mother"))
    score = F.col("father").isNotNull().cast("int") + F.col("mother").isNotNull().cast("int")
    best = rows.groupBy("child").agg(F.min_by(F.struct("father", "mother"), F.struct(-score, F.col("family"))).alias("p"))
    return best.select("child", "p.father", "p.mother").where("father is not null or mother is not null")


def parent_edges(parents: DataFrame) -> DataFrame:
    return parents.select("child", F.explode(F.array_distinct(F.array("father", "mother"))).alias("parent")).where("parent is not null")


def pedigrees(parents: DataFrame, generations: int) -> DataFrame:
    """person, gens: one row a person with known parents; gens[k] holds the distinct ancestors k + 1 generations up.

    A person's k-th generation is the union of their parents' generations before it, so each step is two joins of the person
    table with itself, and no row is ever exploded; an array holds 2 ** (k + 1) ancestors at most.
    """
    found = F.array_distinct(F.filter(F.array("father", "mother"), lambda p: p.isNotNull()))
    known = written(parents.select(F.col("child").alias("person"), "father", "mother"), "parents")
    gens = known.select("person", F.array(found).alias("gens"))
    rounds = Rounds("pedigrees")
    for g in range(2, generations + 1):
        last = F.col("gens")[g - 2]
        side = lambda who, name: gens.select(F.col("person").alias(who), last.alias(name))  # noqa: E731, B023
        more = known.join(side("father", "f"), "father", "left").join(side("mother", "m"), "mother", "left")
        none = F.array().cast(dict(gens.select(last.alias("x")).dtypes)["x"])
        above = more.select("person", F.array_union(F.coalesce("f", none), F.coalesce("m", none)).alias("above"))
        gens = rounds.put(gens.join(above, "person").select("person", F.concat("gens", F.array("above")).alias("gens")))
    return gens


def ancestors(parents: DataFrame, generations: int) -> DataFrame:
    """person, gen, ancestor: distinct within a generation; one reached in two generations counts in both."""
    levels = pedigrees(parents, generations).select("person", F.posexplode("gens").alias("k", "level"))
    return levels.select("person", (F.col("k") + 1).alias("gen"), F.explode("level").alias("ancestor"))


def completeness(parents: DataFrame, persons: DataFrame, generations: int) -> DataFrame:
    """person, known, share: ancestors known, and the mean over generations of the known part of 2**gen."""
    size = lambda k: F.size(F.col("gens")[k])
    sums = pedigrees(parents, generations).select("person", sum((size(k) for k in range(generations)), F.lit(0)).cast("long").alias("known"), (sum((size(k) / 2.0 ** (k + 1) for k in range(generations)), F.lit(0.0)) / generations).alias("share"))
    return persons.select("person").join(sums, "person", "left").select("person", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("share", F.lit(0.0)).alias("share"))


def shared_ancestry(couples: DataFrame, parents: DataFrame, generations: int) -> DataFrame:
    """couple, endogamous: of couples who both have known parents, whether they share an ancestor."""
    every = pedigrees(parents, generations).select("person", F.array_distinct(F.flatten("gens")).alias("up"))
    both = couples.join(every.toDF("a", "up_a"), "a").join(every.toDF("b", "up_b"), "b")
    return both.select("couple", F.arrays_overlap("up_a", "up_b").alias("endogamous"))


def depths(edges: DataFrame, cap: int = 100, stride: int = 8) -> DataFrame:
    """node, depth, capped of all nodes of edges (parent, child): the longest way down, leaves 0, clamped to cap; capped: it is cap.

    A node with a way down of r steps has one of r - 1, so nodes with long ways are among those with shorter ones, and only edges
    into them go on. A job finds `stride` further steps: a node carries the most steps found so far, and each step joins the nodes that have just got theirs to their parents. Nodes that never leave are on
    or above a cycle; they can't raise depths, but take the depth below them.
    """
    edges = written(edges.select("parent", "child").where("parent <> child").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    live, levels = Rounds("live"), Rounds("levels", 1 << 30)
    left, before, r, whole = edges, -1, 0, None
    rows = edges.select(F.col("child").alias("node"), F.lit(0).alias("depth")).distinct()
    while True:
        up = left.select(F.col("child").alias("below"), F.col("parent").alias("above"))
        for k in range(r, r + stride):
            both = rows.join(up, F.expr(f"node = below and depth = {k}"), "left")
            each = F.array(F.struct("node", "depth"), F.struct(F.col("above").alias("node"), (F.col("depth") + 1).alias("depth")))
            rows = both.select(F.inline(each)).where("node is not null").groupBy("node").agg(F.max("depth").alias("depth"))
        r += stride
        now = levels.put(rows).where(F.col("depth") == r)
        many = now.count()
        if many in (0, before):
            break
        before, rows = many, now
        if whole is None or 2 * many < whole:  # fewer edges are worth a table where half of the nodes have left
            left, whole = live.put(left.join(now.select(F.col("node").alias("child")), "child", "left_semi")), many
    found = levels.all(edges.sparkSession)
    out = nodes.join(found.groupBy("node").agg(F.max("depth").alias("depth")), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))
    if many:  # the last two rounds are the same nodes
        rest = now.select("node")
        done = out.join(rest, "node", "left_anti")
        below = left.join(rest.withColumnRenamed("node", "child"), "child", "left_semi").join(rest.withColumnRenamed("node", "parent"), "parent", "left_semi").select("parent")
        of = edges.join(rest.withColumnRenamed("node", "parent"), "parent", "left_semi").join(done.select(F.col("node").alias("child"), "depth"), "child").select("parent", (F.col("depth") + 1).alias("depth"))
        cyclic = of.unionByName(below.withColumn("depth", F.lit(0))).groupBy(F.col("parent").alias("node")).agg(F.max("depth").alias("depth"))
        out = done.unionByName(cyclic)
    return out.select("node", F.least("depth", F.lit(cap)).alias("depth"), (F.col("depth") >= cap).alias("capped"))


def descendants(edges: DataFrame) -> DataFrame:
    """ancestor, person: all distinct pairs with a way down, none with itself. A round joins only the pairs new in the one before, and appends what it finds."""
    edges = written(edges.select("parent", "child").where("parent <> child").distinct(), "edges")
    rounds = Rounds("descendants", 1 << 30)
    new = rounds.put(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("person")))
    while not new.isEmpty():
        step = new.join(edges.select(F.col("parent").alias("person"), F.col("child").alias("next")), "person").select("ancestor", F.col("next").alias("person")).where("ancestor <> person").distinct()
        new = rounds.put(step.join(rounds.all(edges.sparkSession), ["ancestor", "person"], "left_anti"))
    return rounds.all(edges.sparkSession)


def closure(edges: DataFrame, starts: DataFrame, stride: int = 5) -> DataFrame:
    """ancestor, person: all distinct pairs with a way down from the nodes of starts (ancestor), none with itself.

    A pair carries the least number of steps found; each of a job's `stride` steps takes the pairs that are new one step further.
    """
    down = edges.select(F.col("parent").alias("above"), F.col("child").alias("below"))
    rounds, r = Rounds("closure"), 1
    rows = rounds.put(starts.join(down, F.col("ancestor") == F.col("above")).select("ancestor", F.col("below").alias("person"), F.lit(1).alias("steps")).distinct())
    while not rows.where(F.col("steps") == r).isEmpty():
        for k in range(r, r + stride):
            both = rows.join(down, F.expr(f"person = above and steps = {k}"), "left")
            each = F.array(F.struct("person", "steps"), F.struct(F.col("below").alias("person"), (F.col("steps") + 1).alias("steps")))
            rows = both.select("ancestor", F.inline(each)).where("person <> ancestor").groupBy("ancestor", "person").agg(F.min("steps").alias("steps"))
        r += stride
        rows = rounds.put(rows)
    return rows.select("ancestor", "person")


def way_counts(edges: DataFrame, most: int, stride: int = 8, limit: int = 120) -> DataFrame:
    """node, bound: ways down from every parent, which its descendants can't exceed, `most` at most.

    Step r counts ways of up to r steps from the counts of step r - 1; a node changes in every step for which it has a way that
    long, so where the last step of a job changes nothing, all ways are counted. What still changes after `limit` steps lies on or
    above a cycle, or above a longer line, and is given `most`.
    """
    rounds, r = Rounds("ways"), 0
    now = rounds.put(edges.groupBy(F.col("parent").alias("node")).agg(F.least(F.count("*"), F.lit(most)).alias("bound")).withColumn("was", F.lit(0).cast("long")))
    while True:
        changes = not now.where("bound <> was").isEmpty()
        if not changes or r >= limit:
            return now.select("node", F.when(F.col("bound") == F.col("was"), F.col("bound")).otherwise(F.lit(most)).alias("bound"))
        for _ in range(stride):
            below = now.select(F.col("node").alias("child"), "bound")
            more = edges.join(below, "child", "left").select(F.col("parent").alias("node"), F.least(F.coalesce("bound", F.lit(0)) + 1, F.lit(most)).alias("more"))
            now = more.groupBy("node").agg(F.least(F.sum("more"), F.lit(most)).alias("bound"))
        r += stride
        now = rounds.put(now.join(below.withColumnRenamed("child", "node").withColumnRenamed("bound", "was"), "node"))


#: Starts that one row's bits can stand for, 62 in each long; what is more is counted by pairs.
BITS, LONGS = 62, 4


def reached(edges: DataFrame, starts: list, stride: int = 5) -> DataFrame:
    """ancestor, n: the number of distinct nodes below each of a few starts, itself not among them.

    A row a node holds a bit for every start above it; each of a job's `stride` steps hands on the rows that have got new bits.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["parent"]
    names = [f"m{i}" for i in range((len(starts) + BITS - 1) // BITS)]
    down = edges.select(F.col("parent").alias("above"), F.col("child").alias("below"))
    own = [(x, *(1 << k % BITS if k // BITS == i else 0 for i in range(len(names)))) for k, x in enumerate(starts)]
    rows = spark.createDataFrame(own, f"node {kind}, " + ", ".join(f"{m} long" for m in names)).withColumn("fresh", F.lit(True))
    rounds = Rounds("reached")
    was = [F.col(m).alias(f"was_{m}") for m in names]
    none = [F.lit(0).cast("long").alias(f"was_{m}") for m in names]
    new = reduce(or_, (F.col(m) != F.col(f"was_{m}") for m in names))
    while not rows.where("fresh").isEmpty():
        for _ in range(stride):
            both = rows.join(down, (F.col("node") == F.col("above")) & F.col("fresh"), "left")
            each = both.select(F.inline(F.array(F.struct("node", *names, *was), F.struct(F.col("below").alias("node"), *names, *none)))).where("node is not null")
            rows = each.groupBy("node").agg(*(F.bit_or(c).alias(c) for m in names for c in (m, f"was_{m}"))).select("node", *names, new.alias("fresh"))
        rows = rounds.put(rows)
    bit = lambda k: F.sum(F.shiftright(F.col(names[k // BITS]), k % BITS).bitwiseAND(1)) - 1
    sums = rows.agg(F.array(*(bit(k) for k in range(len(starts)))).alias("ns")).first().ns
    return spark.createDataFrame([(x, n) for x, n in zip(starts, sums, strict=True) if n], f"ancestor {kind}, n long")


def outranked(edges: DataFrame, nodes: DataFrame, k: int, steps: int = 8) -> DataFrame:
    """node of those of nodes, which holds all ancestors of its own, that have at least k ancestors and lie on no cycle.

    An ancestor of such a node has all of its descendants and the node itself, so k others have more. Ways up are counted first: they
    end where no cycle is met. Then sets of up to k ancestors are handed down for some steps.
    """
    inside = edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
    inside = written(inside.select("parent", "child"), "inside")
    many = 1 << 40
    ends = way_counts(inside.select(F.col("child").alias("parent"), F.col("parent").alias("child")), many).where(F.col("bound") < many).select("node")
    kind = dict(inside.dtypes)["parent"]
    now = inside.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("up", F.array().cast(f"array<{kind}>"))
    for _ in range(min(k, steps)):
        handed = inside.join(now.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), F.explode(F.concat("up", F.array("parent"))).alias("a"))
        found = handed.groupBy("node").agg(F.slice(F.collect_set("a"), 1, k).alias("up"))
        now = now.select("node").join(found, "node", "left").select("node", F.coalesce("up", F.array().cast(f"array<{kind}>")).alias("up"))
    return written(now.where(F.size("up") >= k).join(ends, "node", "left_semi").select("node"), "outranked")


def top_descendants(edges: DataFrame, k: int, ahead: int = 2) -> DataFrame:
    """ancestor, n: distinct descendants of the k nodes that have most, and of others that had to be counted for that.

    Numbers of ways are upper bounds. The ahead * k nodes with the highest ones (all of an equal bound) are counted first; the
    k-th of these counts is a floor, and only nodes whose bound reaches it are counted after. Bounds don't fall on a way up, so of many
    such nodes those with k ancestors among them need no count. Few nodes are counted by bits, many by pairs.
    """
    edges = written(edges.select("parent", "child").where("parent <> child").distinct(), "edges")
    most = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().count()
    bounds = written(way_counts(edges, most), "bounds")
    high = [r.bound for r in bounds.orderBy(F.col("bound").desc()).limit(ahead * k).collect()]
    least = high[-1] if high else 0

    def count(some: DataFrame, from_: int) -> DataFrame | None:
        few = some.limit(BITS + 1).count() <= BITS
        if not few:
            some = some.join(outranked(edges, bounds.where(F.col("bound") >= from_), k), "node", "left_anti")
        starts = [r.node for r in some.select("node").limit(BITS * LONGS + 1).collect()]
        if len(starts) > BITS * LONGS:
            return closure(edges, some.select(F.col("node").alias("ancestor"))).groupBy("ancestor").agg(F.count("*").alias("n"))
        return reached(edges, starts) if starts else None

    first = count(bounds.where(F.col("bound") >= least), least)
    if first is None:  # no edges
        return bounds.select(F.col("node").alias("ancestor"), F.col("bound").alias("n"))
    first = written(first, "counted")
    found = [r.n for r in first.orderBy(F.col("n").desc()).limit(k).collect()]
    floor = found[-1] if len(found) == k else 0
    rest = bounds.where((F.col("bound") < least) & (F.col("bound") >= floor))
    more = None if rest.isEmpty() else count(rest, floor)
    return first if more is None else first.unionByName(more)


def roots(edges: DataFrame, name: str = "components", merge: bool = True) -> DataFrame:
    """node, root of every node of edges (u, v) that reaches a smaller one: root is the smallest.

    A round hooks every node to its smallest neighbour if that is smaller, follows these pointers to their ends (each job makes them
    up to three times as long), and goes on with the edges between different ends only: at most half of the nodes are left.

    Minima are pre-aggregated, and every look-up joins two written tables, one of which has a row a node. So where a node has many
    edges or many pointers to it, nothing but a shuffle lies below either side of the join, and AQE's skew join deals the
    rows of that key out over tasks. merge: as in `Rounds`.
    """
    rounds, maps = Rounds(name, merge=merge), []
    now = rounds.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = Rounds(f"{name}-pointers", merge=merge)
        hook = pointers.put(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
        moves = True
        while moves:
            one, two = hook.select(F.col("node").alias("root"), F.col("root").alias("r2")), hook.select(F.col("node").alias("r2"), F.col("root").alias("r3"))
            hook = pointers.put(hook.select("node", "root").join(one, "root").join(two, "r2").select("node", F.col("r3").alias("root"), (F.col("r2") != F.col("r3")).alias("moves")))
            moves = not hook.where("moves").isEmpty()
        maps.append(hook.where("node <> root").select("node", "root"))
        half = now.join(hook.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").select("a", "v").distinct()  # many edges of one end are now one
        ends = half.join(hook.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        now = rounds.put(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not maps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    full, whole = maps.pop(), Rounds(f"{name}-roots", merge=merge)
    while maps:  # of a round's nodes the later rounds know the ends
        m = maps.pop()
        full = whole.put(m.join(full.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("node", F.coalesce("end", "root").alias("root")).unionByName(full))
    return full


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: root is the smallest node of the component; nodes without an edge are their own."""
    return nodes.select("node").distinct().join(roots(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def walk(both: DataFrame, start: DataFrame, key: str) -> DataFrame:
    """key, node, level, path of a breadth-first walk from start (key, node) along both (key, u, v in both directions).

    A node's path is the least of those that reach it, so levels are entered in the order of a queue whose neighbours are
    sorted. A round joins the last level only; what it meets again lies in that level or in the one before.
    """
    rounds = Rounds("walk", 1 << 30)
    now = rounds.put(start.select(key, "node", F.lit(0).alias("level"), F.array("node").alias("path")))
    seen = now.select(key, "node")
    while not now.isEmpty():
        step = now.join(both.withColumnRenamed("u", "node"), [key, "node"]).select(key, F.col("v").alias("node"), (F.col("level") + 1).alias("level"), F.concat("path", F.array("v")).alias("path"))
        new = step.join(seen, [key, "node"], "left_anti").groupBy(key, "node").agg(F.min("level").alias("level"), F.min("path").alias("path"))
        last, now = now, rounds.put(new)
        seen = last.select(key, "node").unionByName(now.select(key, "node"))
    return rounds.all(both.sparkSession)


def lines(both: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups with every line of nodes that have two neighbours, and are not in keep (key, node), drawn as one edge.

    both: key, u, v, both directions. Returns the edges between the nodes that are left (key, start, first, end, len: from start over
    its neighbour first, len steps) and the nodes on them (key, start, first, pos, node), pos 0 < pos < len. An arc from u to v
    points to the arc before it, and these pointers are followed to their starts, each job making them up to four times as long.
    A group without an end of lines, a ring, needs a node in keep.
    """
    two = both.groupBy(key, "u").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).where("n = 2").join(keep.withColumnRenamed("node", "u"), [key, "u"], "left_anti")
    from_two = two.select(key, "u", F.lit(True).alias("inner"), "a", "b")
    to_two = two.select(key, F.col("u").alias("v"), F.lit(True).alias("on"))
    arcs = both.join(from_two, [key, "u"], "left").join(to_two, [key, "v"], "left")
    before = F.when(F.col("inner"), F.when(F.col("a") == F.col("v"), F.col("b")).otherwise(F.col("a")))
    rounds = Rounds("lines", merge=True)
    now = rounds.put(arcs.select(key, "u", "v", F.coalesce("on", F.lit(False)).alias("on"), F.coalesce(before, "u").alias("hu"), F.when(F.col("inner"), F.col("u")).otherwise(F.col("v")).alias("hv"), F.when(F.col("inner"), 1).otherwise(0).cast("long").alias("off"), F.coalesce("inner", F.lit(False)).alias("moves")))
    while not now.where("moves").isEmpty():
        step = now
        for _ in range(3):
            ahead = now.select(key, F.col("u").alias("hu"), F.col("v").alias("hv"), F.col("hu").alias("hu2"), F.col("hv").alias("hv2"), F.col("off").alias("more"))
            step = step.join(ahead, [key, "hu", "hv"]).select(key, "u", "v", "on", F.col("hu2").alias("hu"), F.col("hv2").alias("hv"), (F.col("off") + F.col("more")).alias("off"), (F.col("more") > 0).alias("moves"))
        now = rounds.put(step)
    named = now.select(key, F.col("hu").alias("start"), F.col("hv").alias("first"), F.col("v").alias("node"), (F.col("off") + 1).alias("pos"), "on")
    edges = named.where("not on").select(key, "start", "first", F.col("node").alias("end"), F.col("pos").alias("len"))
    return edges, named.where("on").select(key, "start", "first", "pos", "node")


def cut(edges: DataFrame, inner: DataFrame, at: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of `lines` with the lines on which a node of at (key, node; one a group) lies cut in two at it."""
    line = [key, "start", "first"]
    hit = written(inner.join(at, [key, "node"]).select(*line, F.col("pos").alias("cut"), F.col("node").alias("x")), "hit")  # both ways of a line
    after = inner.join(hit, line).where(F.col("pos") == F.col("cut") + 1).select(*line, F.col("node").alias("second"))
    hit = written(hit.join(after, line, "left"), "cut")
    rest = F.struct(F.col("x").alias("start"), F.coalesce("second", "end").alias("first"), "end", (F.col("len") - F.col("cut")).alias("len"))
    halves = F.array(F.struct("start", "first", F.col("x").alias("end"), F.col("cut").alias("len")), rest)
    parts = F.when(F.col("cut").isNull(), F.array(F.struct("start", "first", "end", "len"))).otherwise(halves)
    beyond = lambda c, own: F.when(F.col("pos") > F.col("cut"), c).otherwise(F.col(own)).alias(own)
    nodes = inner.join(hit, line, "left").where(F.col("cut").isNull() | (F.col("pos") != F.col("cut")))
    nodes = nodes.select(key, beyond(F.col("x"), "start"), beyond(F.col("second"), "first"), beyond(F.col("pos") - F.col("cut"), "pos"), "node")
    return written(edges.join(hit, line, "left").select(key, F.inline(parts)), "cut-edges", merge=True), nodes


def distances(edges: DataFrame, start: DataFrame, key: str, stride: int = 3) -> DataFrame:
    """key, node, dist, hops from start (key, node) along edges as `lines` gives them: the shortest way, of equals the one whose nodes
    come first in order. hops: (first, to, start, len) of each edge of that way. A job takes `stride` edges more."""
    rounds = Rounds("distances")
    hop = "array<struct<first:{0},to:{0},start:{0},len:bigint>>".format(dict(start.dtypes)["node"])
    rows = rounds.put(start.select(key, "node", F.lit(0).cast("long").alias("dist"), F.array().cast(hop).alias("hops"), F.lit(True).alias("fresh")))
    out = edges.select(F.col(key).alias("k"), F.col("start").alias("from"), "first", "end", "len")
    while not rows.where("fresh").isEmpty():
        for _ in range(stride):
            both = rows.join(out, (F.col(key) == F.col("k")) & (F.col("node") == F.col("from")) & F.col("fresh"), "left")
            own = F.struct("node", F.struct("dist", "hops").alias("way"), F.lit(True).alias("own"))
            far = F.struct(F.col("end").alias("node"), F.struct((F.col("dist") + F.col("len")).alias("dist"), F.concat("hops", F.array(F.struct("first", F.col("end").alias("to"), F.col("from").alias("start"), "len"))).alias("hops")).alias("way"), F.lit(False).alias("own"))
            least = both.select(key, F.inline(F.array(own, far))).where("node is not null").groupBy(key, "node").agg(F.min("way").alias("way"), F.min(F.when(F.col("own"), F.col("way"))).alias("was"))
            rows = least.select(key, "node", "way.dist", "way.hops", (~F.col("way").eqNullSafe(F.col("was"))).alias("fresh"))
        rows = rounds.put(rows)
    return rows.select(key, "node", "dist", "hops")


def smallest(ends: DataFrame, key: str) -> DataFrame:
    """key, last, dist, hops, back: of a group's ways of one length from one node to different ones (key, last, dist, hops) the smallest
    as nodes from either end; back: from the last one.

    Read backwards, ways begin with different nodes; read forwards, all begin with one, and their hops are ordered as their nodes.
    """
    way = ["last", "dist", "hops"]
    both = ends.groupBy(key).agg(F.min(F.struct(*way)).alias("b"), F.min(F.struct("hops", "last", "dist")).alias("f"))
    start = F.coalesce(F.try_element_at("f.hops", F.lit(1))["start"], "f.last")  # a way without a hop is one node
    back = F.col("b.last") < start
    return both.select(key, *(F.when(back, F.col(f"b.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in way), back.alias("back"))


def joined(nodes: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """key, length, path of the ways whose nodes are (key, pos, node): stretches of `size` nodes are joined first, so no task holds a long way's rows."""
    text = lambda at, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda r: r[x]), ",")
    named = nodes.select(key, F.floor(F.col("pos") / size).alias("part"), "pos", F.col("node").cast("string").alias("node"))
    parts = named.groupBy(key, "part").agg(F.count("*").alias("n"), text("pos", "node").alias("text"))
    return parts.groupBy(key).agg(F.sum("n").alias("length"), text("part", "text").alias("path"))


def longest_chain(component: DataFrame, key: str = "root", cap: int | None = 100) -> DataFrame:
    """key, length, path: a longest shortest way of each component by two walks, the first from its smallest node.

    component: key, u, v, both directions. Of the nodes farthest in the first walk the smallest starts the second; of the ways to
    the nodes farthest from it, each read from whichever end makes it smaller, the smallest is returned: whole if cap is None, else
    the last cap nodes of longer ones. Walks go along drawn-together lines, so a line of any length costs a logarithm of jobs, and
    only a way's turns are carried; its nodes are looked up in the end, of whole ways those of the smallest alone.
    """
    both = written(component.select(key, "u", "v").distinct(), "component", merge=True)
    start = written(both.groupBy(key).agg(F.min("u").alias("node")), "start")

    def walked(edges, inner, start):
        ways = distances(edges, start, key)
        on = inner.join(ways.withColumnRenamed("node", "start"), [key, "start"])
        return ways, on.select(key, "node", (F.col("dist") + F.col("pos")).alias("dist"), F.concat("hops", F.array(F.struct("first", F.col("node").alias("to"), "start", F.col("pos").alias("len")))).alias("hops"))

    edges, inner = lines(both, start, key)
    ways, on = walked(edges, inner, start)
    reached = ways.select(key, "node", "dist").unionByName(on.select(key, "node", "dist")).groupBy(key, "node").agg(F.min("dist").alias("dist"))
    far = reached.groupBy(key).agg(F.min_by("node", F.struct(-F.col("dist"), F.col("node"))).alias("node"))
    far = written(far, "far")
    edges, inner = cut(edges, inner, far, key)
    ways, on = walked(edges, inner, far)
    each = ways.unionByName(on).groupBy(key, "node").agg(F.min(F.struct("dist", "hops")).alias("way"))
    each = written(each.select(key, "node", "way.*"), "ways")
    ends = each.join(each.groupBy(key).agg(F.max("dist").alias("dist")), [key, "dist"]).withColumnRenamed("node", "last")
    way = [key, "last", "dist"]
    if cap is None:
        ends, way = written(smallest(ends, key), "smallest"), [*way, "back"]
    hops = ends.select(*way, F.posexplode("hops").alias("k", "h"), "hops")
    at = F.aggregate(F.slice("hops", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda acc, h: acc + h["len"])
    hops = hops.select(*way, "h.*", at.alias("at"))
    if cap is not None:
        hops = hops.where(F.col("at") + F.col("len") > F.col("dist") - cap)
    middle = hops.join(inner, [key, "start", "first"]).where("pos < len").select(*way, (F.col("at") + F.col("pos")).alias("pos"), "node")
    turns = hops.select(*way, (F.col("at") + F.col("len")).alias("pos"), F.col("to").alias("node"))
    first = ends.select(*way, F.lit(0).cast("long").alias("pos"), F.coalesce(F.try_element_at("hops", F.lit(1))["start"], "last").alias("node"))
    nodes = middle.unionByName(turns).unionByName(first)
    if cap is None:
        return joined(nodes.withColumn("pos", F.when(F.col("back"), F.col("dist") - F.col("pos")).otherwise(F.col("pos"))), key)
    nodes = nodes.where(F.col("pos") > F.col("dist") - cap)
    paths = nodes.groupBy(key, "last").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("p"))
    best = paths.groupBy(key).agg(F.min(F.least("p", F.reverse("p"))).alias("p"))
    return best.select(key, F.size("p").cast("long").alias("length"), F.array_join(F.col("p").cast("array<string>"), ",").alias("path"))


def deepest_chain(edges: DataFrame, births: DataFrame | None = None, cap: int = 100, stride: int = 10) -> DataFrame:
    """ord, node, chains: one chain of the greatest number of generations, from its leaf up; chains counts its equals' leaves.

    The leaf is the one born last (births: node, jd), then the smallest; each step goes to the parent with the longest line
    above it, of equals the smallest. Every node's step is found at once; the chain of at most cap is then read `stride` steps a job.
    """
    edges = edges.select("parent", "child").where("parent <> child").distinct()
    above = written(depths(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), cap).select("node", "depth"), "above")
    leaves = above.join(edges.select(F.col("parent").alias("node")), "node", "left_anti")
    top = leaves.agg(F.max("depth").alias("depth"))
    last = written(leaves.join(F.broadcast(top), "depth").select("node"), "leaves")
    dated = last.join(births, "node", "left") if births is not None else last.withColumn("jd", F.lit(0))
    start = dated.orderBy(F.col("jd").desc_nulls_last(), "node").limit(1).collect()
    up = edges.withColumnRenamed("parent", "node").join(above, "node").groupBy("child").agg(F.min_by("node", F.struct(-F.col("depth"), F.col("node"))).alias("up"))
    up = written(up, "up")
    chain, total, kind = [r.node for r in start], last.count(), dict(above.dtypes)["node"]
    while chain and len(chain) <= cap:
        way = edges.sparkSession.createDataFrame([(chain[-1],)], f"n0 {kind}")
        for k in range(stride):
            way = up.toDF(f"n{k}", f"n{k + 1}").join(F.broadcast(way), f"n{k}", "right")  # one row
        row = way.select(*(f"n{k}" for k in range(1, stride + 1))).first()
        more = [x for x in row if x is not None]
        met = next((k for k, x in enumerate(more) if x in chain or x in more[:k]), len(more))
        chain += more[:met]
        if met < stride:
            break
    return edges.sparkSession.createDataFrame([(k, x, total) for k, x in enumerate(chain[: cap + 1])], f"ord int, node {kind}, chains long")


def excerpt(component: DataFrame, chain: str, most: int = 70, key: str = "root") -> DataFrame:
    """key, low, high: edges among the nodes of a chain and those met first around it, at most `most` nodes (the chain's always stay).

    component: key, u, v, both directions, of one group; chain: its nodes, comma-joined. A group of at most `most` nodes is shown
    whole. Otherwise the chain's nodes, sorted, start a breadth-first queue; a step looks up the neighbours of at most `most` nodes.
    """
    both = written(component.select(key, "u", "v").distinct(), "component")
    spark, kinds = both.sparkSession, dict(both.dtypes)
    table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  at most `most` rows, or the chain's
    everyone = [r.u for r in both.select("u").distinct().limit(most + 1).collect()]
    if len(everyone) <= most:
        shown = everyone
    else:
        seeds = table([(x,) for x in dict.fromkeys(chain.split(","))], "s string")
        shown = [r.u for r in both.select("u").distinct().join(seeds, F.col("u").cast("string") == F.col("s")).orderBy("u").select("u").collect()]
        frontier = shown
        while frontier and len(shown) < most:
            near = both.join(table(list(enumerate(frontier)), f"k int, u {kinds['u']}"), "u").join(table([(x,) for x in shown], f"v {kinds['u']}"), "v", "left_anti")
            frontier = [r.v for r in near.groupBy("v").agg(F.min("k").alias("k")).orderBy("k", "v").limit(most - len(shown)).collect()]
            shown = shown + frontier
    inside = both.join(table([(x,) for x in shown], f"u {kinds['u']}"), "u").join(table([(x,) for x in shown], f"v {kinds['u']}"), "v")
    return inside.select(key, F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).distinct().orderBy(key, "low", "high")


def edge_count(both: DataFrame, key: str = "root") -> DataFrame:
    """key, edges of components given in both directions."""
    return both.groupBy(key).agg((F.count("*") / 2).cast("long").alias("edges"))


def hub(both: DataFrame, key: str = "root") -> DataFrame:
    """key, hub, degree: the node of a component with the most neighbours, of equals the smallest."""
    degree = both.groupBy(key, "u").agg(F.count("*").alias("degree"))
    best = degree.groupBy(key).agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("u").alias("u"))).alias("m"))
    return best.select(key, F.col("m.u").alias("hub"), (-F.col("m.d")).alias("degree"))
