"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the sum of the vectors of its character n-grams (and of the whole word), a document's the mean over
all of its n-grams, and a linear softmax over two classes reads it. As that mean is linear, a trained model folds into one
number an n-gram, so scoring a word is a sum and scoring a document a sum over its words: one pass, nothing shuffled.

The sampled rows are taken apart on the executors, which also count in how many of them each n-gram occurs: the driver gets word
hashes and counts of each sampled document, and the n-grams worth learning of each distinct word, never a text. While
training, n-grams are known by 64-bit hashes; those learnt are then named.

Edge cases: null and empty texts, and texts without words, have no n-grams and get the score of the bias alone; very long texts
are scored whole; rows whose doc_id is null are scored like any other, count as not held out and are never learnt from; repeated
rows are scored each, and an id that repeats is learnt from once, by its text with the smallest hash; labels that are null or not
0 or 1 are ignored; a doc_id with both labels counts as toxic; ties in the order of the sample go to the smaller id; with no
label of one of the classes every score is that class's share (0 without labels); an empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import BoundedCache, id_and_text
from kinweave.operators.tables import written

WORD = re.compile(r"\w+")
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 6000
MIN_DOCS = 8


def grams(word: str) -> list[str]:
    """A lower-case word with end marks, and its 4- and 5-grams."""
    marked = f"<{word}>"
    n = len(marked)
    return [marked, *(marked[i : i + size] for size in (4, 5) for i in range(n - size + 1))]


def hashed(word: str) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, grams(word))), np.uint64)


@dataclass
class Model:
    """weight: what an n-gram adds to the toxic side of the softmax; a document's logit is bias + mean of its n-grams' weights."""

    bias: float
    weight: dict[str, float]

    def scorer(self):
        weight = self.weight

        def of_word(word: str) -> complex:
            found = grams(word)
            return complex(sum([weight[g] for g in found if g in weight]), len(found))

        words = BoundedCache(of_word, 100_000)

        def of_chunk(chunk: str) -> complex:
            return sum(map(words.__getitem__, WORD.findall(chunk.lower())), 0j)

        known = BoundedCache(of_chunk, 150_000)

        def score(text: str) -> float:
            both = sum(map(known.__getitem__, text.split(" ")), 0j)
            known.trim()
            words.trim()
            logit = self.bias + (both.real / both.imag if both.imag else 0.0)
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


@dataclass
class Sample:
    """What training reads. toxic, total: label and number of n-grams of a document. doc, word, count: one entry a document and
    distinct word of it. of_word, gram: one entry a word and n-gram of it that is learnt, words in order. names: those n-grams in text."""

    toxic: np.ndarray
    total: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray
    of_word: np.ndarray
    gram: np.ndarray
    names: np.ndarray


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes and counts of a text's distinct words, and the words."""
    found = Counter(WORD.findall(text.lower()))
    return np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64), np.array(list(found.values()), np.int32), list(found)


def size_of(word: str) -> int:
    """How many n-grams a word has."""
    return 1 + max(0, len(word) - 1) + max(0, len(word) - 2)


def sampled(toxic, total, sizes, words, counts, keys, many, gram, names) -> Sample:
    """words, counts: hashes and counts of all documents' words, `sizes` of them each. keys: words with learnt n-grams, gram those
    n-grams as numbers of names, `many` of them each. Words without any are left out."""
    order = np.argsort(keys)
    starts = np.concatenate([[0], np.cumsum(many)])[order]
    many = many[order]
    of_word = np.repeat(np.arange(len(order), dtype=np.int32), many)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(len(of_word))
    keys = keys[order]
    word = np.searchsorted(keys, words)
    known = keys[np.minimum(word, max(0, len(keys) - 1))] == words if len(keys) else np.zeros(len(words), bool)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return Sample(np.array(toxic, np.float64), np.maximum(np.array(total, np.float32), 1), doc[known], word[known].astype(np.int32), counts[known].astype(np.float32), of_word, gram[at], names)


def train(texts: list[str], toxic: list[int], **options) -> Model:
    """A model from texts at hand: `learn` on their sample."""
    parts = [words_of(t) for t in texts]
    known = {int(h): hashed(w).tolist() for hashes, _, names in parts for h, w in zip(hashes, names, strict=True)}
    often = Counter(g for hashes, *_ in parts for g in {g for h in hashes.tolist() for g in known[h]})
    names = np.sort(np.array([g for g, n in often.items() if n >= MIN_DOCS], np.uint64))
    place = {g: k for k, g in enumerate(names.tolist())}
    text = {h: g for _, _, words in parts for w in words for h, g in zip(hashed(w).tolist(), grams(w), strict=True) if h in place}
    lists = [[place[g] for g in gs if g in place] for gs in known.values()]
    some = np.array([bool(x) for x in lists], bool)
    flat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)])
    total = [sum(n * size_of(w) for n, w in zip(counts.tolist(), words, strict=True)) for _, counts, words in parts]
    keys = np.array(list(known), np.uint64)[some]
    return learn(sampled(toxic, total, [len(p[0]) for p in parts], flat(0, np.uint64), flat(1, np.int32), keys, np.array([len(x) for x in lists if x], np.int64), np.array([g for x in lists for g in x], np.int32), [text[h] for h in place]), **options)


class Sums:
    """Sums of values[source] by id: the ids come sorted, so each has one stretch of the gathered values."""

    def __init__(self, ids: np.ndarray, source: np.ndarray, size: int) -> None:
        self.starts = np.flatnonzero(np.diff(ids, prepend=-1))
        self.at, self.source, self.size = ids[self.starts], source.astype(np.intp), size

    def __call__(self, values: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """values: one row a dimension."""
        out = np.zeros((len(values), self.size), np.float32)
        if len(self.at):
            for k, row in enumerate(values):
                each = row.take(self.source)
                out[k, self.at] = np.add.reduceat(each if weight is None else each * weight, self.starts)
        return out


def learn(sample: Sample, dim: int = 2, epochs: int = 90, rate: float = 0.1, decay: float = 1e-4, scale: float = 100.0, seed: int = 7) -> Model:
    """N-gram vectors and softmax together, by full-batch Adam on the mean cross entropy plus decay times the squared vectors.

    N-grams found in fewer than MIN_DOCS texts keep the zero vector.
    """
    y = sample.toxic
    if not len(y) or y.min() == y.max():
        return Model(float(np.clip(np.log(y.mean() / (1 - y.mean())), -30, 30)) if len(y) and 0 < y.mean() < 1 else (30.0 if len(y) and y.mean() == 1 else -30.0), {})
    # What is learnt from a few documents is noise: rarer n-grams count in the mean with a vector of zero.
    doc, word, of_word, flat, names = sample.doc, sample.word, sample.of_word, sample.gram, sample.names
    n_words = int(of_word[-1]) + 1 if len(of_word) else 0
    share = sample.count / sample.total[doc]
    by_gram, by_word = np.argsort(flat, kind="stable"), np.argsort(word, kind="stable")
    to_word, to_doc = Sums(of_word, flat, n_words), Sums(doc, word, len(y))
    from_doc, from_word = Sums(word[by_word], doc[by_word], n_words), Sums(flat[by_gram], of_word[by_gram], len(names))
    del flat, of_word, by_gram
    share_by_word = share[by_word]
    rng = np.random.default_rng(seed)
    vec = np.ascontiguousarray(rng.normal(0, 0.01, (len(names), dim)).T, np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    onehot = np.stack([1 - y, y], axis=1).astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vec, out, bias)]
    scale = np.float32(scale)
    for step in range(1, epochs + 1):
        means = to_doc(to_word(vec), share) * scale
        logits = means.T @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) / np.float32(len(y))
        to_vec = from_word(from_doc(out @ g.T * scale, share_by_word)) + 2 * np.float32(decay) * vec
        for param, grad, (m, v) in zip((vec, out, bias), (to_vec, means @ g, g.sum(axis=0)), state, strict=True):
            m += np.float32(0.1) * (grad - m)
            v += np.float32(0.001) * (grad * grad - v)
            param -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    toward = out[:, 1] - out[:, 0]
    return Model(float(bias[1] - bias[0]), dict(zip(names, (toward @ vec * scale).tolist(), strict=True)))


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_SAMPLE, clean_rows: int = CLEAN_SAMPLE) -> Model:
    """Learn from at most toxic_rows and clean_rows labelled ids (the documented bounds), spread evenly by a hash of the id.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 take part. No more ids than that are broadcast, and one text of each is
    taken apart on the executors; its word counts, and each distinct word's n-grams once, come to the driver as numbers.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean_rows))
    one = id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def apart(batches):
        for b in batches:
            parts = [words_of(t) for t in b.column("text").to_pylist()]
            raw = ([x.tobytes() for x in c] for c in ([p[0] for p in parts], [p[1] for p in parts]))
            total = [sum(n * size_of(w) for n, w in zip(counts.tolist(), words, strict=True)) for _, counts, words in parts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(total, pa.int64()), *(pa.array(c, pa.binary()) for c in raw), pa.array([p[2] for p in parts], pa.list_(pa.string()))], names=["doc_id", "toxic", "total", "hashes", "counts", "words"])

    def spread(batches):
        known = BoundedCache(hashed, 150_000)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                each = [np.unique(np.concatenate([known[w] for w in words])) for words in b.column("words").slice(at, 256).to_pylist() if words]
                known.trim()
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    rows = written(one.mapInArrow(apart, "doc_id long, toxic int, total long, hashes binary, counts binary, words array<string>"), "sample")
    often = rows.select("words").mapInArrow(spread, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    names = np.sort(often.select("gram").toArrow().column("gram").to_numpy().view(np.uint64))

    def subwords(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            found = []
            for w in words:
                g = hashed(w)
                k = np.searchsorted(names, g)
                found.append(k[names[np.minimum(k, len(names) - 1)] == g].astype(np.int32) if len(names) else np.zeros(0, np.int32))
            batch = pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(w) for w in words], pa.uint64()).view(pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["hash", "grams"])
            yield batch.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    def named(batches):
        done: set[int] = set()
        for b in batches:
            out = {}
            for w in b.column("word").to_pylist():
                g = hashed(w)
                k = np.searchsorted(names, g)
                for i in np.flatnonzero(names[np.minimum(k, len(names) - 1)] == g) if len(names) else ():
                    if int(k[i]) not in done:
                        out[int(k[i])] = grams(w)[i]
            done.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.string())], names=["k", "gram"])

    distinct = rows.select(F.explode("words").alias("word")).distinct()
    text = distinct.mapInArrow(named, "k int, gram string").groupBy("k").agg(F.min("gram").alias("gram")).toArrow()
    text = dict(zip(text.column("k").to_pylist(), text.column("gram").to_pylist(), strict=True))
    words = distinct.mapInArrow(subwords, "hash long, grams binary").toArrow()
    table = rows.select("doc_id", "toxic", "total", "hashes", "counts").orderBy("doc_id").toArrow()

    def numbers(column, kind):
        """All numbers of a binary column, and how many each row has, without an object a row."""
        parts = [(np.frombuffer(c.buffers()[2], np.uint8), np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in column.chunks if len(c) and c.buffers()[2]]
        flat = [raw[at[0] : at[-1]].view(kind) for raw, at in parts]
        return np.concatenate([np.zeros(0, kind), *flat]), np.concatenate([np.zeros(0, np.int64), *(np.diff(at) // np.dtype(kind).itemsize for _, at in parts)])

    gram, many = numbers(words.column("grams").cast(pa.binary()), np.int32)
    hashes, sizes = numbers(table.column("hashes").cast(pa.binary()), np.uint64)
    counts, _ = numbers(table.column("counts").cast(pa.binary()), np.int32)
    keys = words.column("hash").to_numpy().view(np.uint64)
    sample = sampled(table.column("toxic").to_pylist(), table.column("total").to_pylist(), sizes, hashes, counts, keys, many, gram, [text[k] for k in range(len(names))])
    del words, table, text, gram, hashes, counts, keys
    return learn(sample)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def run(batches):
        of = model.scorer()
        for b in batches:
            scores = [of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs).withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, that the model does not predict as toxic."""

    def run(batches):
        of = model.scorer()
        for b in batches:
            yield b.filter(pa.array([of(t or "") < 0.5 for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
