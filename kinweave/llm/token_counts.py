"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies, and summed.

A byte-level vocabulary splits a text into pre-tokens that are tokenised apart, so a document's count is the sum over its
pre-tokens of frequency times pieces; ids are never made. Plan: (1) one pass over the texts turns blocks of documents into
postings: for each distinct pre-token of a block, which of its documents have it and how often. Pre-tokens that are entries of
the vocabulary are a table of the vocabulary's size, so they are joined inside this pass, and only their sums leave it. The
others are packed by a hash of the pre-token: a row holds a block's postings of one hash bucket. (2) A bucket's task sees all
its pre-tokens, counts each distinct one once, and joins the counts to the postings by a hash table; a pre-token has one entry
for each block, however many documents have it. (3) Blocks sum up pieces times frequency.

Texts that hold one of the vocabulary's special strings are cut at them first, as the library does; each counts one.

Edge cases: null text is empty and counts 0; rows with null doc_id are counted too; repeated rows are counted each; very long
texts are counted whole (one may fill a block); ties between merges go by the order of the vocabulary's ids; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import BoundedCache, id_and_text, partitions
from kinweave.operators.tables import written
from kinweave.llm.packing import printable_bytes

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
BLOCK_BYTES = 8_000_000
# Fixed value: the pattern of the byte-level pre-tokeniser.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def piece_counter(path: str):
    """f(UTF-8 pre-tokens) -> their numbers of pieces, by byte-pair merging in the order of the vocabulary's ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = printable_bytes()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
    encode = tiktoken.Encoding("byte", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def count(tokens: list[bytes]) -> list[int]:
        return [len(encode(t)) for t in tokens]

    return count


@cache  # once per Python worker
def vocabulary_counts(path: str) -> dict[str, int]:
    """Pieces of every vocabulary entry that is text: a table no larger than the vocabulary."""
    from tokenizers import Tokenizer, decoders

    library = Tokenizer.from_file(path)
    decoder = decoders.ByteLevel()
    entries = [decoder.decode([t]) for t in library.get_vocab(with_added_tokens=False)]
    entries = [e for e in entries if e and "�" not in e and PATTERN.fullmatch(e)]
    return dict(zip(entries, piece_counter(path)([e.encode() for e in entries]), strict=True))


class PreTokens:
    """Counter of a text's pre-tokens. A chunk up to a single space before a word never shares a pre-token with its neighbours."""

    def __init__(self, limit: int = 200_000) -> None:
        self.chunks = BoundedCache(lambda c: tuple(PATTERN.findall(c)), limit)

    def __call__(self, text: str) -> Counter:
        parts = text.split(" ")
        if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
            return Counter(PATTERN.findall(text))
        out: Counter = Counter(self.chunks[parts[0]])
        for chunk, n in Counter(parts[1:]).items():
            for token in self.chunks[" " + chunk]:
                out[token] += n
        self.chunks.trim()
        return out


def postings(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of blocks. bucket -1: who has the ids and which are null, often has n_bytes and the tokens counted so far. Other buckets:
    tokens and lengths are the block's pre-tokens of that bucket and their bytes; sizes, who, often their postings; all compressed."""
    buckets = partitions(docs.sparkSession)

    def run(batches):
        path = public_tokenizers.path(vocabulary)
        known, split = vocabulary_counts(path), PreTokens()
        marks = special_strings(path)
        cut = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("tokens", "lengths", "sizes", "who", "often"))])
        squeeze = zstandard.ZstdCompressor(level=3).compress
        task, nth = TaskContext.get().partitionId(), 0

        def block_rows(ids, sizes, sums, where):
            nonlocal nth
            block = task << 32 | nth
            nth += 1
            nulls = [i is None for i in ids]
            rows = [(block, -1, b"", b"", b"", np.array([[i or 0 for i in ids], nulls], np.int64).tobytes(), np.array([sizes, sums], np.int64).tobytes())]
            dealt: dict[int, list[bytes]] = defaultdict(list)
            for token in where:
                raw = token.encode()
                dealt[zlib.crc32(raw) % buckets].append(raw)
            for bucket, tokens in dealt.items():
                found = [where[t.decode()] for t in tokens]
                numbers = lambda x, t=np.uint32: squeeze(np.fromiter(x, t).tobytes())
                rows.append((block, bucket, squeeze(b"".join(tokens)), numbers(map(len, tokens)), numbers(len(w) for w, _ in found), numbers((n for w, _ in found for n in w), np.uint16), numbers(n for _, o in found for n in o)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        ids, sizes, sums, total = [], [], [], 0
        where: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                size, done = len(text.encode()), 0
                parts = [text]
                if cut and cut.search(text):
                    parts = cut.split(text)
                    done = len(parts) - 1
                for part in parts:
                    for token, n in split(part).items() if part else ():
                        pieces = known.get(token)
                        if pieces is None:
                            w, o = where[token]
                            w.append(len(ids))
                            o.append(n)
                        else:
                            done += n * pieces
                ids.append(i)
                sizes.append(size)
                sums.append(done)
                total += size
                if total >= BLOCK_BYTES or len(ids) >= 20_000:
                    yield from block_rows(ids, sizes, sums, where)
                    ids, sizes, sums, total = [], [], [], 0
                    where.clear()
        if ids:
            yield from block_rows(ids, sizes, sums, where)

    return id_and_text(docs).mapInArrow(run, "block long, bucket int, tokens binary, lengths binary, sizes binary, who binary, often binary")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    rows = written(postings(docs, vocabulary), "postings")

    def count(batches):
        count_of = piece_counter(public_tokenizers.path(vocabulary))
        known: dict[bytes, int] = {}
        squeeze, expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for tokens, lengths in zip(b.column("tokens").to_pylist(), b.column("lengths").to_pylist(), strict=True):
                tokens, ends = expand(tokens), np.cumsum(np.frombuffer(expand(lengths), np.uint32)).tolist()
                here = [tokens[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                if len(known) > 400_000:
                    known.clear()
                new = [t for t in here if t not in known]
                known.update(zip(new, count_of(new), strict=True))
                out.append(squeeze(np.fromiter(map(known.__getitem__, here), np.uint32, len(here)).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary()), *(b.column(c) for c in ("sizes", "who", "often"))], names=["block", "pieces", "sizes", "who", "often"])

    dealt = rows.where("bucket >= 0").repartition("bucket")
    counted = dealt.mapInArrow(count, "block long, pieces binary, sizes binary, who binary, often binary")
    heads = rows.where("bucket < 0").select("block", F.lit(None).cast("binary").alias("pieces"), "sizes", "who", "often")

    def total(batches):
        """Rows come sorted by block, each block's documents first."""
        block, ids, nulls, sizes, sums = None, None, None, None, None
        expand = zstandard.ZstdDecompressor().decompress

        def finished():
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), pa.array(sizes), pa.array(sums), pa.array(sums > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("block", "pieces", "sizes", "who", "often")]
            for of, pieces, many, who, often in zip(*columns, strict=True):
                if pieces is None:
                    if ids is not None:
                        yield finished()
                    block = of
                    ids, nulls = np.frombuffer(who, np.int64).reshape(2, -1)
                    sizes, sums = np.frombuffer(often, np.int64).reshape(2, -1)
                    sums = sums.copy()
                elif block == of:
                    each = np.repeat(np.frombuffer(expand(pieces), np.uint32), np.frombuffer(expand(many), np.uint32)).astype(np.int64)
                    np.add.at(sums, np.frombuffer(expand(who), np.uint16), each * np.frombuffer(expand(often), np.uint32))
                else:
                    raise ValueError("postings of a block without documents")
        if ids is not None:
            yield finished()

    grouped = counted.unionByName(heads).repartition("block").sortWithinPartitions("block", F.col("pieces").isNotNull())
    return grouped.mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
