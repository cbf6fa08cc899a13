"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of multisets of word shingles, banded, then verified exactly.

A text's multiset holds its shingles of five words (lower case, split at white space) with their counts; a shorter text is one
shingle. Every shingle owns a Poisson process over the axis of weights, cut hierarchically into the intervals [0, 1), [1, 2),
[2, 4), [4, 8) ... of discretised weights. A point of the process has a time, a place on the axis and one of SIZE signature
components; it belongs to a multiset if its place lies below the shingle's count. A component's value is the first point that
belongs. As two multisets share exactly the points below both counts, components agree with probability sum of minima over sum
of maxima. Points are drawn up to a horizon that fills all components of most texts; the others are drawn again to twice that.

Plan: (1) one pass gives each row a 128-bit digest of its words and its band hashes; rows with equal digests are one class, so a
group of copies of any size is one row from here on. Classes are numbered once, as their table is written. (2) In each band
bucket every class pairs with the bucket's smallest (a star, not all pairs) and pairs are verified on their whole texts; the
text of a centre is sent in as many copies as FAN goes into its partners, so that no task gets them all. (3) Components of the
verified pairs are found by large-star and small-star rounds. (4) In buckets that still hold several components, the pairs
across components are verified too: one by one in small buckets, by tiles in large ones (see `tiled`). So no candidate link
that could change a class is lost, while groups already joined emit nothing; components are then found again.

Edge cases: null text is empty; texts without words are alike only if the raw texts are equal; rows with null doc_id take part
and may share a class, whose id is then the smallest doc_id known (null if none is); repeated rows fall in one class; very long
texts are compared whole, like any other; of equal candidates for a star's centre the one with the smallest doc_id, then class
number, is taken (any would do); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import BoundedCache, id_and_text
from kinweave.llm.graph import forest
from kinweave.operators.graph import roots
from kinweave.operators.tables import fresh, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS
SMALL, TILE = 16, 64_000
FAN, SPREAD = 256, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = 2.0**-53


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = np.asarray(x) + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct shingle hashes and counts; a word is hashed once while it stays in the cache."""

    def __init__(self) -> None:
        self.words = BoundedCache(xxhash.xxh3_64_intdigest, 150_000)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        self.words.trim()
        if not len(h):
            return h, np.zeros(0, np.int64)
        wide = min(WORDS, len(h))
        total = h[: len(h) - wide + 1].copy()
        for k in range(1, wide):
            total = total * _ODD + h[k : len(h) - wide + 1 + k]
        return np.unique(mix(total), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SIZE 64-bit values for each multiset; none may be empty."""
    out = np.zeros((len(bags), SIZE), np.uint64)
    todo, horizon = np.arange(len(bags)), SIZE * (np.log(SIZE) + 3)
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        key = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        limit = (horizon / np.array([float(bags[i][1].sum()) for i in todo]))[owner]
        cell, time, value = _points(owner, key, weight, limit)
        first = np.full(len(todo) * SIZE, np.inf)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        found = np.zeros(len(todo) * SIZE, np.uint64)
        found[cell[won]] = value[won]
        out[todo] = found.reshape(-1, SIZE)
        todo = todo[~np.isfinite(first.reshape(-1, SIZE)).all(axis=1)]
        horizon *= 2
    return out


def _points(owner, key, weight, limit):
    """Cells (owner and component), times and hashes of all points that belong, up to each element's time limit."""
    cells, times, values = [], [], []
    level, low, wide = 0, 0, 1
    alive = np.arange(len(key))
    while len(alive):
        seed = mix(key[alive] ^ mix(np.array([level + 1], np.uint64)))
        active, now, n = alive, np.zeros(len(alive)), 0
        while len(active):
            n += 1
            seed = mix(seed + np.uint64(n))
            now = now - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * _ONE) / wide
            inside = now <= limit[active]
            active, now, seed = active[inside], now[inside], seed[inside]
            draw = mix(seed ^ _ODD)
            place = low + (draw >> np.uint64(11)).astype(np.float64) * _ONE * wide
            has = place < weight[active]
            cells.append(owner[active[has]] * SIZE + (mix(draw) % np.uint64(SIZE)).astype(np.int64)[has])
            times.append(now[has])
            values.append(draw[has])
        level, low, wide = level + 1, max(1, low * 2), max(1, low * 2)
        alive = alive[weight[alive] > low]
    return np.concatenate(cells), np.concatenate(times), np.concatenate(values)


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS hashes for each row, each of ROWS components and the band's number."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h ^ parts[:, :, r])
    return h.view(np.int64)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, k, t, t2, d1, d2 (128-bit digest of the words), n (shingles), bands of every row."""

    def run(batches):
        shingle = Shingler()
        for b in batches:
            ids, texts = [b.column(x) for x in ("doc_id", "k", "t", "t2")], b.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                digests, bags = [], []
                for t in texts[at : at + 512]:
                    words = t.lower().split()
                    digests.append(xxhash.xxh3_128_intdigest("\0".join(words) if words else "\0\0" + t))
                    bags.append(shingle(words))
                full = [i for i, x in enumerate(bags) if len(x[0])]
                keys = [None] * len(bags)
                if full:
                    for i, row in zip(full, bands(signatures([bags[i] for i in full])).tolist(), strict=True):
                        keys[i] = row
                low = (1 << 64) - 1
                d1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                d2 = np.array([d & low for d in digests], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(x[at : at + 512] for x in ids), pa.array(d1), pa.array(d2), pa.array([int(x[1].sum()) for x in bags], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "k", "t", "t2", "d1", "d2", "n", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, k long, t long, t2 long, d1 long, d2 long, n long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, s) of classes whose texts reach SIMILARITY, as a and b. texts: c and text of each class, once.

    s deals the partners of a: the text of a goes to each s that it has, and no key holds more than the partners of one.
    """
    with_b = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
    centres = pairs.select("a", "s").distinct().join(texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_b.join(centres, ["a", "s"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        shingle, last, bag = Shingler(), None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, bag = a[i].as_py(), shingle(ta[i].as_py().lower().split())
                keep.append(overlap(bag, shingle(tb[i].as_py().lower().split())) >= SIMILARITY)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def dealt(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows joined to buckets by band, over SPREAD slots of c: a large bucket's rows would else be one key."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return rows.withColumn("slot", F.pmod(F.xxhash64("c"), F.lit(SPREAD)).cast("int")).join(buckets.withColumn("slot", slots), ["band", "slot"]).drop("slot")


def tiled(texts: DataFrame, large: DataFrame) -> DataFrame:
    """A forest (a, b) of all links within the large buckets: rows band, c, n, root of buckets with several components.

    Such buckets hold texts that share much and yet mostly don't link, so pairs are neither listed nor sampled. Buckets that share
    classes are one cluster, its classes are sorted by size and cut into tiles of about TILE shingles, and tiles meet unless their
    sizes are too far apart or all their classes are joined already: a tile reaches some cells of a logarithmic scale of sizes,
    and is met by the later tiles that start in them. Two tiles' overlaps are one product of 0-1 matrices over (shingle,
    occurrence); what leaves the task is a spanning forest.
    """
    heads = large.groupBy("band").agg(F.min("c").alias("v"))
    clusters = roots(dealt(large, heads).select(F.col("c").alias("u"), "v"), "clusters", merge=False)
    members = large.select("c", "n", "root").distinct().join(clusters.toDF("c", "cluster"), "c", "left")
    members = members.withColumn("cluster", F.coalesce("cluster", "c"))
    cells = members.groupBy("cluster", "n").agg(F.count("*").alias("many"))
    before = F.sum(F.col("many") * F.col("n")).over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = members.join(cells, ["cluster", "n"]).withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("c"), F.col("many")) * F.col("n")) / TILE))

    def elements(batches):
        shingle = Shingler()
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                keys, counts = shingle(t.lower().split())
                nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                out.append(mix(np.repeat(keys, counts) + nth.astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(out, pa.binary())], names=["c", "elements"])

    sets = texts.join(large.select("c").distinct(), "c", "left_semi").mapInArrow(elements, "c long, elements binary")
    tiles = placed.join(sets, "c").groupBy("cluster", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("root"), F.max("root").alias("other"), F.collect_list(F.struct("c", "elements")).alias("rows"))
    tiles = written(tiles, "tiles")
    cell = lambda size: F.floor(F.log(size) / F.log(F.lit(1 / SIMILARITY))).cast("int")
    slots = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    ends = tiles.select("cluster", "tile", "high", "root", "other", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") / SIMILARITY))).alias("cell")).withColumn("slot", slots)
    later = tiles.select("cluster", F.col("tile").alias("tile_b"), F.col("low").alias("low_b"), F.col("root").alias("root_b"), F.col("other").alias("other_b"), cell(F.col("low")).alias("cell"), F.pmod("tile", F.lit(SPREAD)).cast("int").alias("slot"))
    joined = (F.col("root") == F.col("other")) & (F.col("root_b") == F.col("other_b")) & (F.col("root") == F.col("root_b"))
    meets = ends.join(later, ["cluster", "cell", "slot"]).where((F.col("tile") <= F.col("tile_b")) & (F.col("high") >= SIMILARITY * F.col("low_b")) & ~joined).select("cluster", "tile", "tile_b")
    pairs = meets.join(tiles.select("cluster", "tile", "rows"), ["cluster", "tile"]).join(tiles.select("cluster", F.col("tile").alias("tile_b"), F.col("rows").alias("rows_b")), ["cluster", "tile_b"])

    def compare(batches):
        for b in batches:
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                sides = [r["rows"], r["rows_b"]] if r["tile"] != r["tile_b"] else [r["rows"]]
                ids = np.array([x["c"] for side in sides for x in side], np.int64)
                i, j = close([[np.frombuffer(x["elements"], np.uint64) for x in side] for side in sides])
                root = forest(len(ids), i, j)
                off = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[off]]), pa.array(ids[off])], names=["a", "b"])

    return pairs.select("tile", "tile_b", "rows", "rows_b").mapInArrow(compare, "a long, b long")


def close(sides: list[list[np.ndarray]], chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (over both sides together) of the pairs of sets that reach SIMILARITY: across the two sides, or within the one."""
    sets = [x for side in sides for x in side]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    split = len(sides[0]) if len(sides) > 1 else 0
    both = np.zeros((split or len(sets), len(sets) - split), np.float32)
    for at in range(0, len(names), chunk):
        s = slice(*np.searchsorted(column, [at, at + chunk]))
        x = np.zeros((len(sets), chunk), np.float32)
        x[owner[s], column[s] - at] = 1
        both += x[: split or len(sets)] @ x[split:].T
    i, j = np.nonzero(both >= SIMILARITY * (size[: split or len(sets), None] + size[None, split:] - both))
    j = j + split
    return (i, j) if split else (i[i < j], j[i < j])


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, k, t, c (number of its exact class), n_copies (rows of that class), root, class_id, kept for every row; links: verified pairs a, b of numbers c, enough to join each class.

    root: the same 32 hexadecimal digits for all rows of a group, and for no others: the least digest of its words. class_id: the
    group's smallest doc_id, null if it has none. kept: the row is the one of its group with the smallest doc_id, or with the
    smallest text hash if the group has no doc_id.
    """
    rows = written(digested(docs), "digests")
    classes = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("k", "t", "t2")).alias("one"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # whoever reads the table reads the same numbers
    members = classes.where("bands is not null").select("c", "doc_id", "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min(F.struct("doc_id", "c", "n")).alias("m"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(buckets, "band").select("band", "c", "n", F.col("m.c").alias("a"), F.col("m.n").alias("n_a"), "size"), "buckets")
    texts = written(_texts(docs, classes, shared.select("c").distinct()), "texts")
    alike = F.least("n", "n_a") >= SIMILARITY * F.greatest("n", "n_a")
    stars = shared.where(F.col("c") != F.col("a")).where(alike).groupBy("a", F.col("c").alias("b")).agg(F.max("size").alias("size"))
    stars = written(stars.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / FAN)).alias("s")), "stars")
    links = written(verified(stars, texts), "links")
    found = roots(links.select(F.col("a").alias("u"), F.col("b").alias("v")), merge=False)
    # Buckets whose members are not all joined: the pairs across components.
    labelled = shared.select("band", "c", "n", "size").join(found.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    several = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    left = written(dealt(labelled, several), "several")
    small = left.where(F.col("size") <= SMALL)
    x, y = small.select("band", F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a")), small.select("band", F.col("c").alias("b"), "n", "root")
    across = x.join(y, "band").where("a < b and r_a <> root").where(alike).select("a", "b").distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = written(across.join(tried, ["a", "b"], "left_anti").withColumn("s", F.lit(0)), "across")
    more = written(tiled(texts, left.where(F.col("size") > SMALL)), "links").unionByName(written(verified(across, texts), "links"))
    found = roots(found.toDF("u", "v").unionByName(more.toDF("u", "v")), merge=False)
    named = classes.join(found.toDF("c", "r"), "c", "left").withColumn("r", F.coalesce("r", "c"))
    digest = F.min(F.struct("d1", "d2"))
    smallest = named.groupBy("r").agg(F.min("doc_id").alias("class_id"), F.min("one.t").alias("first_t"), digest.alias("d"))
    root = F.lower(F.concat(*(F.lpad(F.hex(f"d.{x}"), 16, "0") for x in ("d1", "d2"))))
    named = named.join(smallest.select("r", "class_id", "first_t", root.alias("root")), "r").select("d1", "d2", "c", "root", "class_id", "first_t", "n_copies")
    kept = F.when(F.col("class_id").isNull(), F.col("t") == F.col("first_t")).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
    out = rows.select("doc_id", "k", "t", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "k", "t", "c", "n_copies", "root", "class_id", kept.alias("kept"))
    return out, links.unionByName(more)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """c and text of the wanted classes, each once: of repeated rows one is taken, as they have the same text."""
    ids = classes.join(wanted, "c", "left_semi").select("c", "one.k", "one.t", "one.t2")
    return keyed(docs).join(ids, ["k", "t", "t2"]).groupBy("c").agg(F.first("text").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with k (doc_id, or the least long for null), t and t2 (a 128-bit hash of the text) to find a row again."""
    return id_and_text(docs).withColumns({"k": F.coalesce("doc_id", F.lit(-(1 << 63))), "t": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, all its columns: the one with the smallest doc_id; of rows repeated with that id, one.

    Groups without any doc_id keep one of their rows by text. Helper columns get names that docs doesn't have.
    """
    members, _ = near_duplicates(docs)
    k, t = fresh("_k", docs), fresh("_t", docs)
    # The row to keep of each group, named by k and t.
    chosen = members.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "k", "t")).alias("one"))
    chosen = written(chosen.select(F.col("one.k").alias(k), F.col("one.t").alias(t)), "chosen")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    kept = docs.withColumns({k: key[0], t: key[1]}).join(chosen, [k, t], "left_semi")
    repeated = members.groupBy(F.col("k").alias(k), F.col("t").alias(t)).count().where("count > 1").select(k, t)
    repeated = written(repeated.join(chosen, [k, t], "left_semi"), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, [k, t], "left_anti").unionByName(kept.join(repeated, [k, t], "left_semi").dropDuplicates([k, t]))
    return once.select(docs.columns)
