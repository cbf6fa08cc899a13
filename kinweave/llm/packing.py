"""Best-fit packing: best-two-fit over the histogram of lengths.

Documents are tokenised and cut into pieces of at most `capacity` tokens. Pieces of equal length are interchangeable, so the
plan needs only the histogram of lengths: at most `capacity` rows, whatever the corpus. On the driver, the longest length left
starts a sequence, which is filled greedily with the longest that fits; then the sequence's smallest piece is replaced by the
two unpacked lengths that fill the expanded gap best, if they fill it more tightly. The same pattern is repeated as often as
the counts allow. A pattern uses up a class of lengths to less than one use, so there are O(capacity) patterns with at most
sqrt(2 * capacity) distinct lengths each: the plan's size is bounded by the capacity alone, and so may be broadcast. Each piece
then gets its rank within its length (ranks are counted in hash buckets, so a length that a third of all pieces have is spread
over all tasks), and its rank names its sequence and offset.

Tokens: the vocabulary's own rules, computed word by word. Texts of ordinary Latin letters go through a cache of distinct
chunks and a byte-pair engine over the vocabulary's ranks; any other text goes to the tokenizers library whole. Both give the
library's ids.

Edge cases: null text is empty, and an empty text is its end token alone; rows with null doc_id are packed too; repeated rows
are packed as often as they occur; very long texts are cut into as many pieces as they need; ties between pieces of one length go by
bucket, then doc_id and piece; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import BoundedCache, id_and_text, partitions
from kinweave.operators.tables import written

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
# Texts of these characters only are split and folded alike by Python and by the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-§«¬®¯°±´¶·»¿À-ÿĀ-įĲ-ňŊ-ž‐-‧€]*\Z")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """ids(text): the library's ids for a word-ended byte-pair vocabulary, as little-endian 32-bit bytes."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, alphabet, suffix = spec["model"]["vocab"], printable_bytes(), spec["model"]["end_of_word_suffix"]
        # The end of a word is the byte 255, which UTF-8 lacks. Ids are also the order of merges: bytes, last bytes of words, merges.
        self.engine = tiktoken.Encoding("word", pat_str=".+", mergeable_ranks={self._bytes(t, alphabet, suffix): i for t, i in vocab.items()}, special_tokens={})._core_bpe
        self.chunks = BoundedCache(self._chunk, limit)

    @staticmethod
    def _bytes(token: str, alphabet: dict[str, int], suffix: str) -> bytes:
        ends = token.endswith(suffix)
        return bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token)) + b"\xff" * ends

    def _chunk(self, chunk: str) -> bytes:
        encode = self.engine.encode_single_piece
        if chunk.isalpha():
            return array("I", encode(chunk.encode() + b"\xff")).tobytes()
        return b"".join([array("I", encode(w.encode() + b"\xff")).tobytes() for w in PIECE.findall(chunk)])

    def ids(self, text: str) -> bytes:
        if PLAIN.match(text) and not any(s in text for s in self.special):
            out = b"".join(map(self.chunks.__getitem__, text.lower().split(" ")))
            self.chunks.trim()
            return out
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


@cache  # once per Python worker
def tokenizer_at(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's pieces; all but a row's last hold capacity tokens."""

    def run(batches):
        tokenizer = tokenizer_at(public_tokenizers.path(vocabulary))
        end = np.array([END], np.uint32).tobytes()
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokenizer.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, uses, first sequence, offset) by length and rank, and the number of sequences.

    A row places the ranks from its first on, until the next row's: `uses` of them go to each sequence, side by side.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    ranked = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    while len(lengths := np.flatnonzero(left)):
        free = left.copy()
        used: dict[int, int] = {}
        gap = capacity
        at = len(lengths) - 1
        while gap and at >= 0:
            length = int(lengths[at])
            if n := int(min(free[length], gap // length if used else 1)):
                used[length] = used.get(length, 0) + n
                free[length] -= n
                gap -= n * length
            if used and gap < lengths[0]:
                break
            at = min(at, int(np.searchsorted(lengths, gap, "right")) - 1) if free[length] and gap >= length else min(at - 1, int(np.searchsorted(lengths, gap, "right")) - 1)
        if gap and sum(used.values()) > 1:
            small = min(used)
            two = _best_two(lengths, free, gap + small, small)
            if two:
                used[small] -= 1
                if not used[small]:
                    del used[small]
                for length in two:
                    used[length] = used.get(length, 0) + 1
        times = int(min(left[x] // n for x, n in used.items()))
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, int(ranked[length]), n, sequence, offset))
            ranked[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _best_two(lengths: np.ndarray, free: np.ndarray, room: int, small: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum within room, if that is more than small."""
    have = lengths[(free[lengths] > 0) & (lengths < room)]
    if not len(have):
        return None
    mate = np.searchsorted(have, room - have, "right") - 1
    other = have[np.maximum(mate, 0)]
    alone = (other == have) & (free[have] < 2)  # one piece can't be used twice: its mate is the next shorter
    other = np.where(alone, have[np.maximum(mate - 1, 0)], other)
    valid = (mate >= 0) & ~(alone & (mate < 1))
    total = np.where(valid, have + other, 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(other[best])) if total[best] > small else None


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    buckets = max(partitions(spark), sum(histogram.values()) // 50_000)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(counts, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    table = spark.sparkContext.broadcast(rows)

    def run(batches):
        plan_rows = table.value
        keys = plan_rows[:, 0] << 48 | plan_rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = plan_rows[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            step = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + step // row[:, 2]), pa.array(row[:, 4] + step % row[:, 2] * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return place(written(pieces(docs, capacity), "pieces"), capacity)
