"""Phrase collocations: counts of all phrases by weighted acyclic automata, scored by the parts that they are cut into.

Every word starts a path: itself and up to three words after it within its piece. A shard (some documents of one task) sorts its
paths and builds a transducer from them: an acyclic automaton over the shard's sorted words that adds up, at the end of a path,
how often it occurs, and in which equal states are one state. A transducer is cut at common boundaries into ranges of paths; the
pieces of a range meet in one task, which takes the union: words get common numbers, equal paths one summed weight. The
occurrences of a phrase are then the sum over the range of paths that begin with it; a phrase that goes on into the next range
has a part of its sum in each, added by a last aggregate. Composing the phrases with those sums gives the counts of their parts.

Paths, not phrases, are shuffled: one a word, less what repeats in a shard, at a few bytes each. The boundaries come from a
bounded sample (SAMPLE documents, PER_DOCUMENT paths of each) and only decide how even the ranges are, never what is counted.

Edge cases: null and empty texts have no words; a null lang is `und`, an empty one stays empty; A to Z are lowered, other letters
keep their case; a piece without separators is taken whole, however long; repeated rows count each time; null ids don't matter;
phrases of equal score and count are in the order of their bytes; a lang without candidates has no rows, nor has an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.tables import written

DEPTH = 4
#: Words of a shard; bytes of text taken apart at once; characters of text that a range stands for.
SHARD_WORDS, BLOCK, RANGE_CHARS = 1_500_000, 4 << 20, 8_000_000
SAMPLE, PER_DOCUMENT, CUT_BYTES = 1000, 100, 64
LOW = np.uint64(0xFFFFFFFF)
#: What parts pieces (as the byte `.`), what parts words (as a space), and the letters that are lowered.
_BYTES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91)), b"." * 10 + b" " + bytes(range(97, 123)))


class Words(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.translate(_BYTES).replace(b".", b" . ").split(b" ")), np.uint32)

    def sorted(self) -> tuple[list[bytes], np.ndarray]:
        """The words in the order of their bytes, and each number's rank among them, from 1."""
        words = sorted(w for w in self if w not in (b".", b""))
        rank = np.zeros(len(self), np.uint64)
        rank[[self[w] for w in words]] = np.arange(1, len(words) + 1)
        return words, rank


def blocks(texts: list[str]):
    """The texts as bytes with ends of pieces between them, BLOCK bytes at once or as many as a longer piece has."""
    held, size = [], 0
    for t in texts:
        data = t.encode()
        at = 0
        while len(data) - at > BLOCK:
            end = max(data.rfind(c, at, at + BLOCK) for c in (b".", b",", b"\n", b"!", b"?", b";", b":"))
            if end < at:
                end = min((p for c in (b".", b",", b"\n", b"!", b"?", b";", b":") if (p := data.find(c, at + BLOCK)) >= 0), default=len(data) - 1)
            yield data[at : end + 1]
            at = end + 1
        held.append(data[at:])
        size += len(data) - at
        if size > BLOCK:
            yield b".".join(held)
            held, size = [], 0
    yield b".".join(held)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; np.unique hashes first, which is slower where most values differ."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def combined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One number a path that sorts like its four ranks, and the sorted pairs of ranks that its halves stand for."""
    first, second = (a.astype(np.uint64) << np.uint64(32) | b for a, b in (columns[:2], columns[2:]))
    known = distinct(np.concatenate([first, second]))
    return np.searchsorted(known, first).astype(np.uint64) << np.uint64(32) | np.searchsorted(known, second).astype(np.uint64), known


def taken_apart(keys: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    a, b = known[keys >> np.uint64(32)], known[keys & LOW]
    return [c.astype(np.uint32) for c in (a >> np.uint64(32), a & LOW, b >> np.uint64(32), b & LOW)]


def paths(ranks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct paths (four columns of ranks, 0 beyond the end of a piece) of words in text order, and their counts."""
    n = len(ranks)
    if not ranks.any():
        return [np.zeros(0, np.uint32)] * DEPTH, np.zeros(0, np.int64)
    r = np.concatenate([ranks, np.zeros(DEPTH - 1, np.uint64)])
    pair = np.where(r[:-1] > 0, r[:-1] << np.uint64(32) | r[1:], np.uint64(0))
    known = distinct(pair)
    place = np.searchsorted(known, pair).astype(np.uint64)
    keys = place[:n] << np.uint64(32) | np.where(r[1 : n + 1] > 0, place[2 : n + 2], np.uint64(0))
    keys = np.sort(keys[ranks > 0])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return taken_apart(keys[first], known), np.diff(np.append(first, len(keys)))


def united(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths in any order, repeated ones too, as sorted distinct ones with summed weights."""
    if not len(weights):
        return columns, weights
    keys, known = combined(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return taken_apart(keys[first], known), np.add.reduceat(weights[order], first)


def registered(starts: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of states with arcs (label, value) from `starts` on: the number of each state's first equal, and which states are those firsts.

    States are told apart by a hash of their arcs, and states of one hash are then compared arc by arc.
    """
    many = np.diff(np.append(starts, len(labels)))
    state = np.repeat(np.arange(len(starts)), many)
    nth = np.arange(len(labels)) - starts[state]
    mixed = (labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (values.astype(np.uint64) + nth.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    _, first, inverse = np.unique(np.add.reduceat(mixed ^ mixed >> np.uint64(32), starts), return_index=True, return_inverse=True)
    equal = first[inverse]
    same = many[equal] == many
    if same.all():
        twin = starts[equal][state] + nth
        same = (labels[twin] == labels) & (values[twin] == values)
    if not same.all():
        equal = np.arange(len(starts))
    return equal, equal == np.arange(len(starts))


@dataclass
class Transducer:
    """words: sorted. many[d]: arcs of each state at depth d; labels[d]: their words' ranks, 0 the end; target[d]: the state at
    depth d + 1 that an arc goes to, at the last depth its weight. States are numbered by their first use, and there is one root."""

    words: list[bytes]
    many: list[np.ndarray]
    labels: list[np.ndarray]
    target: list[np.ndarray]

    @classmethod
    def of(cls, words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> Transducer:
        """Built from sorted distinct paths, from their ends up: the states of a depth are known once those below them are."""
        many, labels, target = [], [], []
        values, rows = weights.astype(np.uint64), np.arange(len(weights))
        for d in reversed(range(DEPTH)):
            label = columns[d][rows]
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for c in columns[:d]:
                c = c[rows]
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            equal, kept = registered(starts, label, values)
            size = np.diff(np.append(starts, len(rows)))
            arcs = np.repeat(kept, size)
            many.insert(0, size[kept].astype(np.uint32))
            labels.insert(0, label[arcs].astype(np.uint32))
            target.insert(0, values[arcs])
            values, rows = (np.cumsum(kept) - 1)[equal].astype(np.uint64), rows[starts]
        return cls(words, many, labels, target)

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Back to sorted distinct paths and weights."""
        states, columns = np.zeros(1, np.int64), []
        for d in range(DEPTH):
            starts = np.concatenate([[0], np.cumsum(self.many[d], dtype=np.int64)])[:-1]
            size = self.many[d][states].astype(np.int64)
            arcs = np.repeat(starts[states] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
            columns = [np.repeat(c, size) for c in columns] + [self.labels[d][arcs]]
            states = self.target[d][arcs].astype(np.int64)
        return columns, states

    def packed(self) -> bytes:
        """Numbers by planes of bytes, targets that are the next new state as 0, and the words, compressed."""
        parts = []
        for d in range(DEPTH):
            target = self.target[d]
            if d < DEPTH - 1:
                seen = np.maximum.accumulate(np.concatenate([[-1], target.astype(np.int64)]))
                target = np.where(target.astype(np.int64) > seen[:-1], 0, target.astype(np.int64) + 1)
            parts += [self.many[d], self.labels[d], target.astype(np.uint64)]
        head = np.array([len(p) for p in parts], np.uint32).tobytes()
        return zstandard.compress(head + b"".join(p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts) + b"\n".join(self.words), 3)

    @classmethod
    def unpacked(cls, blob: bytes) -> Transducer:
        raw = zstandard.decompress(blob)
        sizes, at = np.frombuffer(raw, np.uint32, 3 * DEPTH).tolist(), 12 * DEPTH
        many, labels, target = [], [], []
        for k, n in enumerate(sizes):
            kind = np.dtype(np.uint64 if k % 3 == 2 else np.uint32)
            part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)
            at += n * kind.itemsize
            if k % 3 == 2 and k // 3 < DEPTH - 1:
                part = np.where(part == 0, np.cumsum(part == 0) - 1, part.astype(np.int64) - 1).astype(np.uint64)
            (many, labels, target)[k % 3].append(part)
        return cls(raw[at:].split(b"\n"), many, labels, target)


def cut(words: list[bytes], columns: list[np.ndarray], bound: tuple[bytes, ...]) -> int:
    """How many of the sorted paths lie before a bound: up to four words, the empty word before all others."""
    lo, hi = 0, len(columns[0])
    for c, b in zip(columns, bound, strict=False):
        k = bisect_left(words, b) + 1 if b else 0
        left = lo + int(np.searchsorted(c[lo:hi], c.dtype.type(k)))
        if b and (k > len(words) or words[k - 1] != b):
            return left
        lo, hi = left, lo + int(np.searchsorted(c[lo:hi], c.dtype.type(k), "right"))
    return lo


def shards(bounds: list[tuple]):
    """A function over batches (lang, text) that gives the packed pieces (part, lang, piece) of their transducers."""

    def flush(vocabulary: Words, held: dict[str, list[np.ndarray]]):
        words, rank = vocabulary.sorted()
        for lang, numbers in held.items():
            columns, weights = paths(rank[np.concatenate(numbers)])
            lo, hi = bisect_left(bounds, (lang,)), bisect_left(bounds, (lang + "\0",))
            ends = [0, *(cut(words, columns, b[1:]) for b in bounds[lo:hi]), len(weights)]
            for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                if i < j:
                    mine = [c[i:j] for c in columns]
                    used = np.zeros(len(words) + 1, bool)
                    for c in mine:
                        used[c] = True
                    used[0] = False
                    short = np.cumsum(used, dtype=np.uint32)
                    yield lo + k, lang, Transducer.of([words[w - 1] for w in np.flatnonzero(used)], [short[c] for c in mine], weights[i:j]).packed()

    def run(batches):
        vocabulary, held, size = Words(), {}, 0

        def out():
            rows = list(flush(vocabulary, held))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["part", "lang", "piece"])

        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            by: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(t)
            for lang, some in by.items():
                for block in blocks(some):
                    numbers = vocabulary.numbers(block)
                    numbers = numbers[numbers != vocabulary[b""]]
                    held.setdefault(lang, []).append(np.append(numbers, np.uint32(0)))
                    size += len(numbers)
                    if size >= SHARD_WORDS:
                        yield out()
                        vocabulary, held, size = Words(), {}, 0
        if held:
            yield out()

    return run


def union(least: int):
    """A function over the pieces of a range that gives (lang, phrase, size, count): phrases with at least that many occurrences, the
    first and the last of every size whatever their count, as they may go on in other ranges, and all words as the empty phrase."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        by: dict[str, list[bytes]] = {}
        for lang, piece in zip(table.column("lang").to_pylist(), table.column("piece").to_pylist(), strict=True):
            by.setdefault(lang, []).append(piece)
        for lang, blobs in by.items():
            some = [Transducer.unpacked(b) for b in blobs]
            words = sorted({w for t in some for w in t.words})
            number = {w: k for k, w in enumerate(words, 1)}
            parts, weights = [], []
            for t in some:
                rank = np.array([0, *map(number.__getitem__, t.words)], np.uint32)
                columns, w = t.paths()
                parts.append([rank[c] for c in columns])
                weights.append(w)
            columns, weight = united([np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(weights))
            found.append((lang, "", 0, int(weight.sum())))
            new = np.zeros(len(weight), bool)
            new[:1] = True
            for d in range(DEPTH):
                new[1:] |= columns[d][1:] != columns[d][:-1]
                starts = np.flatnonzero(new)
                sums = np.add.reduceat(weight, starts)
                wanted = sums >= least
                wanted[[0, -1]] = True
                wanted &= columns[d][starts] > 0
                for k in np.flatnonzero(wanted):
                    found.append((lang, b" ".join(words[int(c[starts[k]]) - 1] for c in columns[: d + 1]).decode(), d + 1, int(sums[k])))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["lang", "phrase", "size", "f"])

    return run


def boundaries(rows: DataFrame) -> list[tuple]:
    """Bounds (lang, up to four words) of ranges of about RANGE_CHARS characters of text each, from the documented sample."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    ranges = -(-(total.chars or 0) // RANGE_CHARS)
    if ranges < 2:
        return []

    def some(batches):
        for b in batches:
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                vocabulary = Words()
                numbers = vocabulary.numbers(text.encode())
                back = list(vocabulary)
                numbers = numbers[numbers != vocabulary[b""]]
                starts = np.flatnonzero(numbers)
                for i in starts[:: len(starts) // PER_DOCUMENT + 1]:
                    path = [back[x][:CUT_BYTES].hex() for x in numbers[i : i + DEPTH].tolist()]
                    end = next((k for k, x in enumerate(numbers[i : i + DEPTH]) if x == 0), DEPTH)
                    out.append((lang, ",".join(path[:end]), len(starts) / min(len(starts), PER_DOCUMENT)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["lang", "path", "stands"])

    sample = rows.sample(fraction=min(1.0, SAMPLE / total.n), seed=7).mapInArrow(some, "lang string, path string, stands double").toArrow().to_pylist()
    sample = sorted((r["lang"], tuple(bytes.fromhex(w) for w in r["path"].split(",")), r["stands"]) for r in sample)
    ends = np.cumsum([r[2] for r in sample])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges) if sample else []
    return sorted({(sample[k][0], *sample[k][1]) for k in at})


def counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, phrase, size, f of every phrase of one to four words that occurs `least` times; the empty phrase counts all words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(shards(boundaries(rows)), "part int, lang string, piece binary")
    phrases = pieces.groupBy("part").applyInArrow(union(least), "lang string, phrase string, size int, f long")
    return phrases.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, covered: tuple[int, int] = (80, 100)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each lang's `top` phrases of two to four words by the score of their weakest cut.

    cut is the number of words before that cut; covered: a phrase goes if a longer one around it has that share of its occurrences.
    """
    known = written(counts(docs, least), "phrases")
    words = F.split("phrase", " ")
    candidates = known.where("size > 1")
    k = F.col("cut")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("right"))
    part = lambda name, count: known.where("size between 1 and 3").select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    composed = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = composed.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    around = known.where("size > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (wide("longer") * covered[1] < wide("a") * covered[0]))
    rows = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.col("m.cut").alias("cut"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    few = rows.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("k", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("k") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
