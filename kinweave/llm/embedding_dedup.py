"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared within a label by cosine, in double precision. Equal vectors are one class with a multiplicity, so copies
cost one row; classes are numbered once, as their table is written. Classes are ordered by the grid cell of their unit vectors'
leading principal coordinates and cut into tiles of about TILE_FLOATS components. Unit vectors that link lie within
sqrt(2 - 2 * threshold) of one another, so two tiles meet only if the boxes of their leading coordinates do: a tile looks up the
cells of the first two coordinates that it can reach. In a pair of tiles the leading coordinates are accumulated first; the rest
of a product is at most the product of the suffix norms, so a pair whose bound stays below the threshold stops there, and the
next coordinates, twice as many, are added for the others, until the dimensions are used up. Those left whose sum is next to the
threshold get their exact cosine. Counts and components are kept up block by block, and a pair of tiles returns counts and a
spanning forest of its links, never the links themselves.

The principal axes come from a sample of at most SAMPLE vectors and SAMPLE_FLOATS components (the documented bounds). They are
an orthogonal change of basis: they decide what is skipped, never what links.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows whose label or vec_id is null,
link with nothing (n_links 0, component_id their own vec_id); vectors of different lengths don't link, however long they are;
pairs at exactly the threshold link; repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.graph import Components
from kinweave.operators.graph import roots
from kinweave.operators.tables import written

THRESHOLD = 0.98
TILE_FLOATS, LEAST_TILE, BLOCK = 1 << 19, 64, 512
LEAD = 16
BOX, GRID = 8, 3
SAMPLE, SAMPLE_FLOATS = 10_000, 8_000_000
SPREAD = 32
SLACK = 1e-9
DENSE = 8


def axes(sample: np.ndarray) -> np.ndarray:
    """Columns: the principal axes of unit vectors, the widest first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a power of two goes first, so that no square leaves the range of doubles."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def reach_of(threshold: float) -> float:
    """The largest distance of two unit vectors whose cosine reaches the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6


def cuts(d: int) -> list[int]:
    """Numbers of leading dimensions after which pairs are dropped: LEAD, then twice as many each time, then all."""
    out = [min(LEAD, d)]
    while out[-1] < d:
        out.append(min(2 * out[-1], d))
    return out


def blocks(a: np.ndarray, b: np.ndarray, basis: np.ndarray, same: bool, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers of a, row numbers of b, mask) of the blocks with pairs of at least threshold; of one tile with itself, each pair once."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    oa, ob = np.argsort(ra[:, 0], kind="stable"), np.argsort(rb[:, 0], kind="stable")
    steps, reach = cuts(a.shape[1]), reach_of(threshold)
    rest = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0))
    rest_a, rest_b = [rest(ra, k) for k in steps], [rest(rb, k) for k in steps]
    exact = lambda i, j: np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
    for s in range(0, len(a), BLOCK):
        x = oa[s : s + BLOCK]
        for t in range(s if same else 0, len(b), BLOCK):
            y = ob[t : t + BLOCK]
            if rb[y[0], 0] - ra[x[-1], 0] > reach or ra[x[0], 0] - rb[y[-1], 0] > reach:
                continue
            sums = ra[x, : steps[0]] @ rb[y, : steps[0]].T
            may = sums + np.multiply.outer(rest_a[0][x], rest_b[0][y]) >= threshold - SLACK
            if same and s == t:
                may = np.triu(may, 1)
            for n in range(1, len(steps)):
                if not may.any():
                    break
                low, high = steps[n - 1], steps[n]
                if may.sum() * DENSE > may.size:  # most pairs are alive: a product of blocks costs less than one pair by pair
                    sums += ra[x, low:high] @ rb[y, low:high].T
                else:
                    i, j = np.nonzero(may)
                    sums[i, j] += np.einsum("ij,ij->i", ra[x[i], low:high], rb[y[j], low:high])
                may &= sums + np.multiply.outer(rest_a[n][x], rest_b[n][y]) >= threshold - SLACK
            # All dimensions are summed up: only sums next to the threshold need the product in the original basis.
            i, j = np.nonzero(may & (sums < threshold + SLACK))
            for part in range(0, len(i), BLOCK * BLOCK // DENSE):
                k = slice(part, part + BLOCK * BLOCK // DENSE)
                may[i[k], j[k]] = exact(x[i[k]], y[j[k]])
            if may.any():
                yield x, y, may


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of a, of b) of all pairs of `blocks`."""
    pairs = [(x[i], y[j]) for x, y, mask in blocks(a, b, basis, same, threshold) for i, j in [np.nonzero(mask)]]
    i, j = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (list(zip(*pairs, strict=True)) or [[], []]))
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def bases_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes for each dimension of the sample."""
    widest = classes.agg(F.max(F.size("embedding"))).first()[0]
    if not widest:
        return {}
    rows = max(1, min(SAMPLE, SAMPLE_FLOATS // widest))
    column = classes.orderBy(F.xxhash64("h1")).limit(rows).select("embedding").toArrow().column("embedding").combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
    lengths = np.diff(ends, prepend=0)
    of = lambda d: flat[((ends - d)[lengths == d][:, None] + np.arange(d)).ravel()].reshape(-1, d)
    return {int(d): axes(unit(of(d))) for d in np.unique(lengths)}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    # Casting the array as a whole keeps null components, which `exists` then finds.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda x: x != 0)
    # Copies share a key of 128 bits: two hashes over different orders of the parts.
    keyed = rows.where(valid).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", F.lit(1), "label")})
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    bases = spark.sparkContext.broadcast(bases_of(classes))
    reach = reach_of(threshold)

    def basis_of(d: int) -> np.ndarray:
        return bases.value.get(d, np.eye(d))

    def project(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("embedding"))
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            lengths, lead = np.diff(starts), np.zeros((b.num_rows, BOX))
            for d in np.unique(lengths):
                which = np.flatnonzero(lengths == d)
                x = flat[(starts[which][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                k = min(BOX, int(d))
                lead[which, :k] = unit(x) @ basis_of(int(d))[:, :k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(lead.ravel(), BOX).cast(pa.list_(pa.float64()))], names=[*b.schema.names, "lead"])

    sized = classes.select("c", "copies", F.struct("label", F.size("embedding").alias("d")).alias("g"), "embedding")
    fields = "c long, copies long, g struct<label: {}, d: int>, embedding array<double>, lead array<double>".format(dict(rows.dtypes)["label"])
    cell = F.transform(F.slice("lead", 1, GRID), lambda p: F.floor(p / reach).cast("int"))
    placed = written(sized.mapInArrow(project, fields).withColumn("cell", cell), "placed")
    # Tiles: a label has few cells, as coordinates lie in [-1, 1]; they are counted and summed up in order; a full cell is cut by a hash.
    cells = placed.groupBy("g", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("g", "cell", "n", before.alias("before"))
    size = F.greatest(F.floor(F.lit(TILE_FLOATS) / F.col("g.d")), F.lit(LEAST_TILE))
    tiled = placed.join(cells, ["g", "cell"]).withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("c"), F.col("n"))) / size))
    edge = lambda f, name: F.array(*(f(F.col("lead")[k]) for k in range(BOX))).alias(name)
    packed = tiled.groupBy("g", "tile").agg(edge(F.min, "low"), edge(F.max, "high"), F.collect_list(F.struct("c", "copies", "embedding")).alias("rows"))
    packed = written(packed, "tiles")
    pairs = meeting(packed.select("g", "tile", "low", "high"), reach)
    left = pairs.join(packed.select("g", "tile", "rows"), ["g", "tile"])
    pairs = left.join(packed.select("g", F.col("tile").alias("tile_b"), F.col("rows").alias("rows_b")), ["g", "tile_b"])

    def compare(batches):
        for b in batches:
            names = b.schema.names
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                parts = []
                for name in ("rows", "rows_b"):
                    inner = one.column(names.index(name)).flatten()
                    parts.append((inner.field(0).to_numpy(), inner.field(1).to_numpy(), inner.field(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(inner), -1)))
                (ca, na, xa), (cb, nb, xb) = parts
                same = one.column(names.index("tile"))[0].as_py() == one.column(names.index("tile_b"))[0].as_py()
                ids, copies = (ca, na) if same else (np.concatenate([ca, cb]), np.concatenate([na, nb]))
                count, components = np.zeros(len(ids), np.int64), Components(len(ids))
                for x, y, mask in blocks(xa, xb, basis_of(xa.shape[1]), same, threshold):
                    y = y if same else y + len(ca)
                    count[x] += mask @ copies[y]
                    count[y] += copies[x] @ mask
                    i, j = np.nonzero(mask & np.not_equal.outer(components.find(x), components.find(y)))
                    components.join(x[i], y[j])
                has = np.flatnonzero(count)
                root = components.find(np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(count[has]), pa.array(ids[root[has]])], names=["u", "n", "v"])

    found = written(pairs.select("tile", "tile_b", "rows", "rows_b").mapInArrow(compare, "u long, n long, v long"), "links")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    named = classes.select("h1", "h2", "c", "vec_id", "copies").join(roots(found.select("u", "v"), "vector-components", merge=False).toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = named.join(counts.select(F.col("u").alias("c"), "n"), "c", "left")
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linking = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    others = rows.where(F.coalesce(~valid, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def meeting(tiles: DataFrame, reach: float) -> DataFrame:
    """g, tile, tile_b (tile <= tile_b) of the pairs of tiles (g, tile, low, high) whose boxes lie within reach.

    A tile stands in the cells of the first two coordinates that its box covers, and looks into those that it reaches. SPREAD
    deals the tiles of a cell, so that a label or cell with most of the tiles is more than one key.
    """
    at = lambda x: F.floor(x / reach).cast("int")

    def covered(more: float) -> Column:
        x, y = (F.sequence(at(F.col("low")[k] - more), at(F.col("high")[k] + more)) for k in (0, 1))
        return F.explode(F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.struct(i.alias("x"), j.alias("y"))))))

    ends = tiles.select("g", "tile", "low", "high", covered(reach).alias("cell")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    later = tiles.select("g", F.col("tile").alias("tile_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), covered(0.0).alias("cell"), F.pmod("tile", F.lit(SPREAD)).cast("int").alias("slot"))
    gaps = (F.greatest(F.lit(0.0), F.col("low_b")[k] - F.col("high")[k], F.col("low")[k] - F.col("high_b")[k]) for k in range(BOX))
    near = reduce(lambda total, gap: total + gap * gap, gaps, F.lit(0.0)) <= reach * reach
    return ends.join(later, ["g", "cell", "slot"]).where((F.col("tile") <= F.col("tile_b")) & near).select("g", "tile", "tile_b").distinct()
