"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut after sentence ends, and every 32 words where a sentence is longer. Each paragraph,
with its occurrence number in the text, has a 64-bit digest. A digest goes to one cell of each of three parts of the sketch; a
cell holds how many digests it has and the exclusive-or of them and of their check hashes. Sketches of two versions subtract
cell by cell, so equal paragraphs cancel, and cells left with one digest are peeled until all differing digests are out. If
peeling stops early, both sketches are made anew, larger, as often as it takes. Likeness is shared over all paragraphs of both texts.

A fingerprint is a text's sketch in hexadecimal, of `cells_for` its number of paragraphs: large enough to peel when about half of
them differ. Cell numbers are the low bits of a digest, so a sketch folds into any smaller one, and texts of different lengths
are compared at the smaller size first. Equal texts have equal fingerprints.

Edge cases: null text is empty and has no paragraphs; two texts without paragraphs have likeness 1, one with and one without 0;
null doc_ids come first in the order of documents; rows that repeat a doc_id are ordered by their text's hash, so that rows that
are equal in both follow one another; very long texts are taken whole, and their sketches grow with them; a single row's next
document is itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_and_text, partitions
from kinweave.operators.tables import written

CELLS, GROWTH = 8, 4
BITS = 21  # of a digest's 64 for each part's cell number; more cells take a hash of it
WORDS = 32
PARAGRAPH = re.compile(r"[^\n]+?(?:[.!?](?=\s)|$)", re.MULTILINE)
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def paragraphs(text: str) -> list[str]:
    out = []
    for found in PARAGRAPH.findall(text):
        words = found.split()
        out += [" ".join(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
    return out


def digests(text: str) -> list[int]:
    """Distinct elements: 64 bits of digest below 32 bits of check hash. A paragraph's second occurrence has another than its first."""
    seen: Counter = Counter()
    out = []
    for p in paragraphs(text):
        d = xxhash.xxh3_64_intdigest(p, seen[p])
        seen[p] += 1
        out.append(check(d) << 64 | d)
    return list(dict.fromkeys(out))


def cells_for(n: int) -> int:
    """Cells a part, a power of two: three quarters of the paragraphs or more, so that a sketch peels if as many differ as it has."""
    return max(CELLS, 1 << max(0, (3 * n // 4 - 1)).bit_length())


def check(digest: int) -> int:
    return ((digest ^ digest >> 31) * _ODD & _MASK) >> 32


class Sketch:
    """Three parts of `cells` cells, a power of two: element counts, and exclusive-ors of the elements."""

    def __init__(self, cells: int, items=()) -> None:
        self.cells = cells
        self.count, self.sums = [0] * (3 * cells), [0] * (3 * cells)
        self.add(items, 1)

    def places(self, x: int) -> tuple[int, int, int]:
        cells, low = self.cells, self.cells - 1
        if cells <= 1 << BITS:
            return x & low, cells + (x >> BITS & low), 2 * cells + (x >> 2 * BITS & low)
        raw = (x & _MASK).to_bytes(8, "little")
        return tuple(part * cells + (xxhash.xxh3_64_intdigest(raw, part) & low) for part in range(3))

    def add(self, items, sign: int) -> None:
        cells, count, sums = self.cells, self.count, self.sums
        if cells > 1 << BITS:
            for x in items:
                for p in self.places(x):
                    count[p] += sign
                    sums[p] ^= x
            return
        low, third = cells - 1, 2 * cells
        for x in items:
            a, b, c = x & low, cells + (x >> 21 & low), third + (x >> 42 & low)
            count[a] += sign
            count[b] += sign
            count[c] += sign
            sums[a] ^= x
            sums[b] ^= x
            sums[c] ^= x

    def folded(self, cells: int) -> Sketch:
        """The same elements in fewer cells."""
        if cells == self.cells:
            return self
        out = Sketch(cells)
        for part in range(3):
            for at in range(part * self.cells, (part + 1) * self.cells, cells):
                for k in range(cells):
                    out.count[part * cells + k] += self.count[at + k]
                    out.sums[part * cells + k] ^= self.sums[at + k]
        return out

    def hex(self) -> str:
        return b"".join(struct.pack("<iQI", n, x & _MASK, x >> 64) for n, x in zip(self.count, self.sums, strict=True)).hex()

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.cells)
        out.count = [x - y for x, y in zip(self.count, other.count, strict=True)]
        out.sums = [x ^ y for x, y in zip(self.sums, other.sums, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """Elements that only the first and only the second had, or None if some stay entangled. Uses the sketch up."""
        only, other = [], []
        count, sums = self.count, self.sums
        todo = [i for i, n in enumerate(count) if n == 1 or n == -1]
        while todo:
            at = todo.pop()
            n, x = count[at], sums[at]
            if n != 1 and n != -1 or x >> 64 != check(x & _MASK):
                continue
            (only if n == 1 else other).append(x)
            for p in self.places(x):
                sums[p] ^= x
                count[p] = left = count[p] - n
                if left == 1 or left == -1:
                    todo.append(p)
        return None if any(count) or any(sums) else (only, other)


def difference(a: list[int], b: list[int], sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> tuple[list[int], list[int]]:
    """Elements only in a and only in b, by subtraction and peeling; GROWTH times the cells after each failure.

    The first try takes the sketches as they are, at the smaller one's size (sketches of more than 2 ** BITS cells a part don't
    fold, and are made anew at that size).
    """
    sketch_a, sketch_b = sketch_a or Sketch(cells_for(len(a)), a), sketch_b or Sketch(cells_for(len(b)), b)
    cells = min(sketch_a.cells, sketch_b.cells)
    sized = lambda s, items: s.folded(cells) if s.cells == cells or s.cells <= 1 << BITS else Sketch(cells, items)
    left = sized(sketch_a, a).minus(sized(sketch_b, b))
    while (found := left.peel()) is None:
        cells *= GROWTH
        left = Sketch(cells, a)
        left.add(b, -1)
    return found


def likeness(a: list[int], b: list[int], sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> float:
    if not a and not b:
        return 1.0
    only_a, only_b = difference(a, b, sketch_a, sketch_b)
    shared = len(a) - len(only_a)
    return shared / (len(a) + len(only_b))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _place(key: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as byte strings in the same order."""
    both = np.stack([key.astype(np.int64), t.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, copies, bucket, turn, key, t: buckets hold ranges of (doc_id, hash of the text), and turn 1 is a copy of the
    row that follows a bucket's last.

    Bounds of the ranges come from a sample of 20 rows a bucket, four buckets a shuffle partition; they decide where rows go, never
    what follows what. As the hash takes part, rows with null or equal ids spread over buckets too; rows equal in both are first
    counted (copies), pre-aggregated where they lie. In a bucket, sorted by turn, key and t, each row of turn 0 is followed by
    its next document. Only whole rows travel, once.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "t": F.xxhash64("text"), "copies": F.lit(1).cast("long")})
    repeated = rows.groupBy("key", "t").count().where("count > 1").select("key", "t")
    if not repeated.isEmpty():
        repeated = written(repeated, "repeated")
        once = rows.join(repeated, ["key", "t"], "left_semi").groupBy("key", "t").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
        rows = rows.join(repeated, ["key", "t"], "left_anti").unionByName(once)
    n = 4 * partitions(spark)
    sample = rows.select("key", "t").orderBy(F.xxhash64("t", "key")).limit(20 * n).toArrow()
    known = np.sort(_place(sample.column("key").to_numpy(), sample.column("t").to_numpy()))
    bounds = np.unique(known[:: max(1, len(known) // n)])[1:]

    @F.pandas_udf("int")
    def bucket(key, t):
        return key.__class__(np.searchsorted(bounds, _place(key.to_numpy(), t.to_numpy()), "right"))

    # The first row of every bucket that has rows: no more than there are bounds.
    least = rows.select("key", "t").withColumn("bucket", bucket("key", "t")).groupBy("bucket").agg(F.min(F.struct("key", "t")).alias("m"))
    first = {r.bucket: (r.m.key, r.m.t) for r in least.collect()}
    order = sorted(first)
    before = {first[b]: order[k - 1] for k, b in enumerate(order)}  # the first of all follows the last

    @F.pandas_udf("array<int>")
    def also(key, t):
        return key.__class__([[before[x]] if x in before else [] for x in zip(key.tolist(), t.tolist(), strict=True)])

    slots = F.concat(F.array(F.struct(bucket("key", "t").alias("bucket"), F.lit(0).alias("turn"))), F.transform(also("key", "t"), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("turn"))))
    return rows.withColumn("slot", F.explode(slots)).select("doc_id", "key", "t", "text", "copies", "slot.bucket", "slot.turn")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def row(one, following, same=False):
            doc, text, its, sketch = one
            new = edited(text, following[1])
            digested = its if new == text else digests(new)
            new_sketch = sketch if new == text else Sketch(cells_for(len(digested)), digested)
            like = 1.0 if same else likeness(its, following[2], sketch, following[3])
            return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), sketch.hex(), new_sketch.hex(), likeness(its, digested, sketch, new_sketch), like

        for b in batches:
            out = []
            for i, text, copies, bucket, turn in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "copies", "bucket", "turn")), strict=True):
                here = digests(text)
                one = (i, text, here, Sketch(cells_for(len(here)), here))
                if last and last[0] == bucket:
                    out.append(row(last[1], one))
                last = (bucket, one) if turn == 0 else None
                if turn == 0 and copies > 1:
                    itself = row(one, one, True)
                    for at in range(1, copies, 10_000):
                        yield batch([itself] * min(10_000, copies - at))
            yield batch(out)

    rows = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "turn", "key", "t")
    return rows.select("doc_id", "text", "copies", "bucket", "turn").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
