"""Quality by Bradley-Terry ranking: a document's score is linear in features of its text, learnt from pairs of a good and a low one.

A pair says that the good document ranks above the low one, with the probability that a logistic function gives of the difference of
their scores; weights are those that make the pairs likeliest, by Newton steps on feature differences with a ridge. The threshold is a quantile of the scores: the one with the fewest
mistakes, where each class counts with its share of all labels. Scores are mapped to (0, 1) so that it becomes CUT.

Features are shares of bytes and words in the text (capitals, marks, digits, repeats, distinct words, lengths), of the whole text
and of the worst of its stretches, so a long document with a bad stretch shows it. Nothing but the text is read.

Edge cases: null and empty texts have features 0 and get the score that these give; very long texts are taken in blocks, whole; rows
whose doc_id is null are scored like any other, count as not held out and are never learnt from; repeated rows are scored each, and an
id that repeats is learnt from once, by its text with the smallest hash; labels that are null or not 0 or 1 are ignored; an id with
both labels counts as low; ties in the order of the sample go to the smaller id; with no label of one of the classes every score
is the share of good ones (1 without labels); an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_and_text

#: Documents of each class that training reads at most, pairs that each of them is in at least, and the score at the threshold.
SAMPLE, PAIRS, CUT = 4000, 8, 0.3
BLOCK, STRETCH = 1 << 22, 1 << 10


def _class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256)
    flags[list(chars)] = 1
    return flags


#: Kinds of bytes: capitals, small letters, letters beyond ASCII, digits, marks of tables and noise, loud marks, sentence marks, line ends.
KINDS = np.stack([_class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(128, 256))), _class(b"0123456789"), _class(b"#$%&*|<>{}[]^~@=+\\_/"), _class(b"!?"), _class(b".,;:'\"()-"), _class(b"\n\r")], axis=1)
SIZE = 3 * KINDS.shape[1] + 7


def features(text: str) -> np.ndarray:
    data = text.encode()
    out = np.zeros(SIZE)
    if not data:
        return out
    codes = np.frombuffer(data, np.uint8)
    stretches = -(-len(codes) // STRETCH)
    shares = np.zeros((stretches, KINDS.shape[1]))
    total = np.zeros(256)
    for k in range(0, len(codes), BLOCK):  # a block is a whole number of stretches
        part = codes[k : k + BLOCK]
        at = np.arange(len(part)) // STRETCH
        many = np.bincount(at * 256 + part, minlength=(int(at[-1]) + 1) * 256).reshape(-1, 256)
        total += many.sum(axis=0)
        shares[k // STRETCH : k // STRETCH + len(many)] = many @ KINDS / many.sum(axis=1, keepdims=True)
    whole = total @ KINDS / len(codes)
    full = shares[:-1] if stretches > 1 else shares  # a short rest says little
    words, repeats, last, held = Counter(), 0, None, 0
    while held < len(data):
        end = len(data) if len(data) - held <= BLOCK else max(data.rfind(b" ", held, held + BLOCK), data.rfind(b"\n", held, held + BLOCK)) + 1
        end = end if end > held else held + BLOCK
        some = data[held:end].split()
        words.update(some)
        repeats += sum(map(eq, some, some[1:])) + (bool(some) and some[0] == last)
        last, held = some[-1] if some else last, end
    n = words.total()
    each = KINDS.shape[1]
    out[:each], out[each : 2 * each], out[2 * each : 3 * each] = whole, np.sqrt(whole), full.max(axis=0)
    out[3 * each :] = [np.log1p(n), *((len(words) / n, np.log1p(len(words)) / np.log1p(n), repeats / n, max(words.values()) / n, min(len(data) / n, 100) / 10, sum(c for w, c in words.items() if w[:1].isupper()) / n) if n else (0,) * 6)]
    return out


@dataclass
class Ranking:
    """A score is weight times (features - mean) / spread; threshold is the score, at a quantile of all, from which documents are good."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    threshold: float = 0.0
    quantile: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold gives CUT."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


@dataclass
class Constant:
    """What is left where one class has no labels."""

    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def preferences(good: int, low: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a good, of a low one): everyone in PAIRS of them at least, partners drawn evenly."""
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(np.arange(good), PAIRS), rng.integers(0, good, low * PAIRS)])
    b = np.concatenate([rng.integers(0, low, good * PAIRS), np.repeat(np.arange(low), PAIRS)])
    return a, b


def learn(good: np.ndarray, low: np.ndarray, low_share: float, ridge: float = 1e-3, steps: int = 25) -> Ranking:
    """Weights from pairs of rows of good and low, and the threshold at the best quantile of the scores of both, weighted by class."""
    both = np.concatenate([good, low])
    spread = both.std(axis=0)
    model = Ranking(both.mean(axis=0), np.where(spread > 1e-9, spread, np.inf), np.zeros(good.shape[1]))
    a, b = preferences(len(good), len(low))
    d = (good[a] - low[b]) / model.spread
    w = model.weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.weight = w
    raw = model.raw(both)
    order = np.argsort(raw, kind="stable")
    raw, is_low = raw[order], (np.arange(len(both)) >= len(good))[order]
    each = np.where(is_low, low_share / len(low), (1 - low_share) / len(good))
    # Mistakes at the quantile after each score: good ones below, low ones above. Of equals the one in the widest gap.
    wrong = np.cumsum(np.where(is_low, 0, each))[:-1] + low_share - np.cumsum(np.where(is_low, each, 0))[:-1]
    gap = np.diff(raw)
    k = int(np.lexsort((-gap, wrong.round(12)))[0])
    model.quantile = float(np.cumsum(each)[k])
    model.threshold = float((raw[k] + raw[k + 1]) / 2)
    return model


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Ranking | Constant:
    """Learn from at most `rows` labelled ids of each class (the documented bound), spread evenly by a hash of the id; the share of
    low ones is that of all labels. Only ids whose crc32(doc_id as text) mod 5 is not 0 take part.

    No more ids than that are broadcast; features are computed on the executors, and one row of numbers an id comes to the driver.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
        .where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 0))
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
    )
    many = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    if not many.get(0) or not many.get(1):
        return Constant(float(not many.get(0)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("good = 1").orderBy(*order).limit(rows).unionByName(known.where("good = 0").orderBy(*order).limit(rows))

    def run(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), b.column("h"), pa.array(x, pa.binary())], names=["doc_id", "good", "h", "x"])

    some = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "good", F.xxhash64("text").alias("h"), "text")
    found = some.mapInArrow(run, "doc_id long, good int, h long, x binary").groupBy("doc_id", "good").agg(F.min_by("x", "h").alias("x")).orderBy("doc_id").toArrow()
    x = np.array([np.frombuffer(v) for v in found.column("x").to_pylist()]).reshape(-1, SIZE)
    good = np.array(found.column("good").to_pylist(), bool)
    if good.all() or not good.any():  # labels without documents
        return Constant(float(good.all()))
    return learn(x[good], x[~good], many[0] / (many[0] + many[1]))


def score(docs: DataFrame, model: Ranking | Constant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, SIZE)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs).withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranking | Constant) -> DataFrame:
    """The rows of docs, all their columns, whose score is at the threshold or above."""

    def run(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]).reshape(-1, SIZE)
            yield b.filter(pa.array(model.scores(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
