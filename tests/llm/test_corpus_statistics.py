"""Phrase collocations, the quality ranking and the filter audit against brute force, with odd texts, ties, repeats and other columns."""

import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

from kinweave.llm import collocations, filter_audit, quality

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\ta  b,\nA b;c", "a b a b a b. a b!", "Ä é\x1cx y\x00z ä É", "日本語 😀 日本語 😀", "x." * 50, "w " * 3000, "THE END & $ # OF " * 20, "a b a b a b. a b!"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 4 == 3 else "" if i % 4 == 2 else "en", None if i % 3 else "s", i) for i, t in enumerate(ODD)]
    rows += [(None, "a b a b a b. a b!", "en", "s", 1), (None, None, "en", "", 1), (5, ODD[5], "en", "t", 1), (40, "a", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, f long")


def mined(df, least, top=2000):
    f, n = Counter(), Counter()
    for r in df.select("lang", "text").collect():
        lang, text = "und" if r.lang is None else r.lang, re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    often = {(lang, p): c for (lang, p), c in f.items() if len(p) > 1 and c >= least}
    covered = set()
    for (lang, p), c in often.items():
        covered |= {(lang, p[i : i + k]) for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 80 * f[lang, p[i : i + k]]}
    rows = []
    for lang in sorted(n):
        mine = []
        for (at, p), a in often.items():
            if at == lang and (lang, p) not in covered:
                score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        rows += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1)]
    return sorted(rows)


def found(df, **options):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize("which, least, ranges, words", [("odd", 2, 16_000_000, 4_000_000), ("odd", 2, 40, 10), ("docs", 30, 16_000_000, 4_000_000), ("docs", 4, 50_000, 20_000)])
def test_collocations(request, monkeypatch, which, least, ranges, words):
    """Also with ranges of a few paths and shards of a few words, and blocks that cut texts."""
    monkeypatch.setattr(collocations, "RANGE_CHARS", ranges)
    df = request.getfixturevalue(which)
    # Workers read these from the module anew, so they are set by the functions that make the tasks.
    make = collocations.shards

    def small(bounds):
        run = make(bounds)

        def inner(batches):
            collocations.SHARD_WORDS, collocations.BLOCK = words, 1000 if words < 100_000 else 4 << 20
            yield from run(batches)

        return inner

    monkeypatch.setattr(collocations, "shards", small)
    assert found(df, least=least) == mined(df, least)


def test_collocations_take_the_first(docs):
    assert found(docs, least=5, top=7) == mined(docs, 5, 7)


def test_collocations_of_nothing(none):
    assert found(none) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """A count times the scale passes 2 ** 63."""
    big = 10**16
    rows = [("en", "", 0, 5 * big), ("en", "x y", 2, big - 1), ("en", "x", 1, big), ("en", "y", 1, 3 * big + 1)]
    monkeypatch.setattr(collocations, "counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, size int, f long"))
    r = collocations.collocations(spark.range(0)).first()
    assert (r.a, r.l, r.r, r.n, r.score) == (big - 1, big, 3 * big + 1, 5 * big, 2_000_000 * (big - 1) // (4 * big + 1))


def test_transducers_give_back_their_paths():
    rng = np.random.default_rng(3)
    for size, kinds in ((1, 1), (50, 3), (5000, 5), (5000, 2000)):
        ranks = rng.integers(0, kinds + 1, size).astype(np.uint64)
        ranks[0] = 1
        columns, weights = collocations.paths(ranks)
        brute = Counter()
        for i in np.flatnonzero(ranks):
            path = []
            for x in ranks[i : i + 4].tolist():
                if not x:
                    break
                path.append(x)
            brute[tuple(path + [0] * (4 - len(path)))] += 1
        assert list(zip(*(c.tolist() for c in columns), strict=True)) == sorted(brute) and dict(zip(zip(*(c.tolist() for c in columns), strict=True), weights.tolist(), strict=True)) == brute
        words = [f"w{k:05}".encode() for k in range(kinds)]
        made = collocations.Transducer.of(words, columns, weights)
        assert sum(len(x) for x in made.labels[3:]) <= len(weights)
        again = collocations.Transducer.unpacked(made.packed())
        assert again.words == words
        back, w = again.paths()
        assert all((x == y).all() for x, y in zip(back, columns, strict=True)) and (w == weights).all()
        doubled, twice = collocations.united([np.concatenate([c, c]) for c in columns], np.concatenate([weights, weights]))
        assert all((x == y).all() for x, y in zip(doubled, columns, strict=True)) and (twice == 2 * weights).all()


def test_equal_states_are_one():
    """Two words with the same paths after them share every state below."""
    columns = [np.array(c, np.uint64) for c in ([1, 1, 2, 2], [3, 4, 3, 4], [5, 5, 5, 5], [6, 6, 6, 6])]
    made = collocations.Transducer.of([b"a", b"b", b"c", b"d", b"e", b"f"], columns, np.array([2, 2, 2, 2]))
    assert [len(m) for m in made.many] == [1, 1, 1, 1] and made.target[3].tolist() == [2]


def audited(docs, labels):
    rows = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    good, toxic = ({r.doc_id for r in labels.collect() if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails, out = [], {}
    for i, part, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        fails.append((part, {f for f, x in zip("ABCDE", tests, strict=True) if x}, i in good, i in toxic))
    total = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, bad, g, x in fails:
            at = next((k for k, f in enumerate(order) if f in bad), 5)
            for k, f in enumerate(order):
                c = out.setdefault((part, order, k + 1), [0] * 6)
                c[0] += at > k
                c[1] += at == k
                c[2] += f in bad and at < k
                c[3] += bad == {f}
                c[4] += at == k and g
                c[5] += at == k and x
            if at < 5:
                total[part, order[at]] += 1
    return sorted((*key, *c, total[key[0], key[1][key[2] - 1]]) for key, c in out.items())


def test_filter_audit(spark, odd, docs, labels):
    marks = spark.createDataFrame([(0, 1, 0, "x"), (0, 0, 1, "y"), (5, 1, None, "z"), (11, None, 1, "z"), (None, 1, 1, "n"), (99, 1, 1, "n")], "doc_id long, quality int, toxic int, text string")
    for df, known in ((odd, marks), (docs.where("doc_id % 7 < 3").unionByName(docs.where("doc_id = 3")), labels)):
        rows = sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(df, known).collect())
        assert rows == audited(df, known)


def test_filter_audit_of_nothing(none, labels):
    assert filter_audit.audit(none, labels).collect() == []


def test_filter_audit_without_labels(odd, labels):
    rows = filter_audit.audit(odd, labels.limit(0)).collect()
    assert rows and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def held(i):
    return i is not None and crc32(str(i).encode()) % 5 == 0


def plain_features(text):
    """The features with plain loops."""
    data = text.encode()
    if not data:
        return [0.0] * quality.SIZE
    kind = lambda part: [sum(b in kinds for b in part) / len(part) for kinds in ({i for i in range(256) if quality.KINDS[i, k]} for k in range(8))]
    stretches = [kind(data[k : k + 1024]) for k in range(0, len(data), 1024)]
    whole, words = kind(data), data.split()
    worst = [max(s[k] for s in (stretches[:-1] or stretches)) for k in range(8)]
    n, each = len(words), Counter(words)
    rest = [np.log1p(n)] + ([len(each) / n, np.log1p(len(each)) / np.log1p(n), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(each.values()) / n, min(len(data) / n, 100) / 10, sum(w[:1].isupper() for w in words) / n] if n else [0] * 6)
    return [*whole, *np.sqrt(whole), *worst, *rest]


def test_quality(monkeypatch, docs, labels, odd, none):
    model = quality.fit(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    expected = Counter()
    for r in odd.select("doc_id", "text").collect():
        x = (np.array(plain_features(r.text or "")) - model.mean) / model.spread
        raw = sum(a * b for a, b in zip(x, model.weight, strict=True)) - model.threshold
        expected[r.doc_id, round(1 / (1 + np.exp(-np.clip(raw + np.log(0.3 / 0.7), -30, 30))), 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in rows) == expected
    assert quality.score(none, model).collect() == []
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_of_long_texts_in_blocks(monkeypatch):
    text = "Some words, some more. " * 500 + "LOUD & BAD!! " * 300 + "end"
    whole = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK", 2048)
    assert np.allclose(quality.features(text), whole) and np.allclose(whole, plain_features(text))


def test_quality_of_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, low = [r.predicted for r in scored if r.quality == 1], [r.predicted for r in scored if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) > 500 and sum(low) <= 0.02 * len(low) and len(low) > 100


def test_quality_without_both_classes(spark, docs, labels):
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().collect()} == {1.0}
    bad = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, bad)).select("score").distinct().collect()} == {0.0}
    elsewhere = spark.createDataFrame([(-i, i % 2) for i in range(1, 50)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, elsewhere)).collect()} <= {0, 1}


def test_preferences_hold_after_learning():
    rng = np.random.default_rng(5)
    good, low = rng.normal(1, 1, (300, 4)), rng.normal(0, 1, (200, 4))
    model = quality.learn(good, low, 0.4)
    a, b = quality.preferences(300, 200)
    assert len(a) == 4000 and set(a) == set(range(300)) and set(b) == set(range(200))
    assert (model.raw(good)[a] > model.raw(low)[b]).mean() > 0.85 and 0 < model.quantile < 1
