"""License scans by a trained paragraph classifier, in DataFrame functions only.

Paragraphs (lines) are scored by a multinomial logistic regression over sparse word 1- and 2-grams whose classes are licence
families and `unknown`. Probabilities are calibrated by temperature. A paragraph states a licence if the probability of all
families together reaches the threshold that tells most held-out statements from talk about licences; of the families that the
templates confirm the most probable is taken. A template confirms its family if at least CONFIRM of its words occur in the
paragraph (one of two words stands there in one piece) and a name of the family stands there in one piece, so that a GNU Lesser General Public License is no GNU General
Public License. Positions are code points of the line.

The model is fitted on the driver from paragraphs made by rule from the templates, a fixed number of them, independent of the
corpus; weights exist for the n-grams of the examples only (some thousands at most, a constant of the plan). What can't be
confirmed is not scored: `gate` finds a word in every text that can be.

Lines are hard-wrapped in many files. Lines without a family of their own are joined in windows of 2 to WINDOW lines that cross
neither a line without a word nor one with a family. From each line on, the shortest window with the largest share of a
template is a paragraph, if its first line is needed for that share; of those with a family the leftmost that don't overlap are
taken. Its span goes from its first line to its last.

Edge cases: null text is empty and has no paragraph; rows with null doc_id are scanned too; repeated rows give repeated
results; very long texts and lines are scanned whole, in time linear in the lines; of families with equal probability the first
in the order of TEMPLATES is taken; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import folded, id_and_text, let

CONFIRM = 0.8
WINDOW = 8
BUCKETS = 4096
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*|\?"
# Short statements of public licences, in their usual words.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license apache", "spdx-license-identifier apache-2.0", "released under the apache license 2.0", "license apache-2.0", "is apache licensed"],
    "mit": ["released under the mit license", "licensed under the mit license", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "license mit", "is mit licensed"],
    "bsd": ["released under the bsd license", "licensed under the bsd 3-clause license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause", "use of this source code is governed by a bsd-style license", "license bsd-3-clause", "is bsd licensed"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "released under the gnu general public license", "licensed under the gpl version 2", "you can redistribute it and or modify it under the terms of the gnu general public license", "spdx-license-identifier gpl-3.0-only", "spdx-license-identifier gpl-3.0-or-later", "spdx-license-identifier gpl-2.0-only", "spdx-license-identifier gpl-2.0-or-later", "spdx-license-identifier gpl-2.0", "spdx-license-identifier gpl-3.0", "released under the gpl", "licensed under the gnu gpl version 3", "licensed under the gplv3", "licensed under the gplv2", "license gpl-3.0"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "released under the lgpl license", "spdx-license-identifier lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx-license-identifier lgpl-2.1-or-later", "spdx-license-identifier lgpl-3.0-only", "spdx-license-identifier lgpl-3.0-or-later", "licensed under the lgplv3", "license lgpl-3.0"],
    "agpl": ["licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "spdx-license-identifier agpl-3.0-only", "spdx-license-identifier agpl-3.0-or-later", "released under the agpl license", "licensed under the agplv3", "license agpl-3.0"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license 2.0", "spdx-license-identifier mpl-2.0", "released under the mpl 2.0", "license mpl-2.0"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the eclipse public license version 2.0", "spdx-license-identifier epl-2.0", "spdx-license-identifier epl-1.0", "license epl-2.0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "licensed under the isc license", "spdx-license-identifier isc", "license isc", "is isc licensed"],
    "zlib": ["this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "released under the zlib license", "licensed under the zlib license", "spdx-license-identifier zlib", "license zlib"],
    "bsl-1.0": ["distributed under the boost software license version 1.0", "licensed under the boost software license", "spdx-license-identifier bsl-1.0", "license bsl-1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx-license-identifier unlicense", "license unlicense"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0", "licensed under a cc-by license", "licensed under the creative commons attribution 4.0 license", "license cc-by-4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 license", "spdx-license-identifier cc-by-sa-4.0", "licensed under a cc-by-sa license", "licensed under the creative commons attribution-sharealike 4.0 license", "license cc-by-sa-4.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 license", "spdx-license-identifier cc-by-nc-4.0", "licensed under a cc-by-nc license", "licensed under the creative commons attribution-noncommercial 4.0 license", "license cc-by-nc-4.0"],
    "cc0": ["released under cc0 1.0 universal public domain dedication license", "dedicated to the public domain under cc0 license", "spdx-license-identifier cc0-1.0", "released under cc0 1.0", "license cc0-1.0"],
    "proprietary": ["copyright all rights reserved", "proprietary and confidential unauthorized copying prohibited copyright all rights reserved"],
}
# Names of the families as whole words of a paragraph, one space apart; licence texts have a phrase of their own.
NAMES = {
    "apache-2.0": r"apache licen[sc]e|apache-2\.0|apache software licen[sc]e|apache 2\.0|apachev2|apache v2|apache public licen[sc]e|apache licen[sc]ed|apache|apache-license",
    "mit": r"mit|expat|permission is hereby granted free|hereby granted free of charge|charge to any person obtaining",
    "bsd": r"bsd|bsd-[234]-clause|bsd-style|redistribution and use in source|source and binary forms|2-clause bsd|3-clause bsd",
    "gpl": r"gnu general public|gnu gpl|gpl|gplv[123]|gpl-[123]|gpl-[123]\.0(?:-only|-or-later)?|gnu public licen[sc]e",
    "lgpl": r"gnu lesser general public|gnu library general public|lesser general public|gnu lgpl|lgpl|lgplv[23]|lgpl-[23](?:\.[01])?(?:-only|-or-later)?",
    "agpl": r"gnu affero general public|affero general public|gnu agpl|agpl|agplv[13]|agpl-[13](?:\.0)?(?:-only|-or-later)?",
    "mpl": r"mozilla public|mpl|mpl-[12]\.[01]|mplv2|mpl2",
    "epl": r"eclipse public|epl|epl-[12]\.0|eplv[12]",
    "isc": r"isc|permission to use copy modify and",
    "zlib": r"zlib|without any express or implied|to anyone to use this software|alter it and redistribute it",
    "bsl-1.0": r"boost software|bsl-1\.0|boost licen[sc]e",
    "unlicense": r"unlicense|free and unencumbered software|unencumbered software",
    "cc-by": r"cc by|cc-by|cc-by-[1234]\.0|commons attribution (?:[1234]\.0|international|unported|licen[sc]e|(?:version )?[1234]\.0)",
    "cc-by-sa": r"cc by-sa|cc-by-sa|cc-by-sa-[1234]\.0|commons attribution-sharealike|commons attribution share-?alike|commons attribution share alike",
    "cc-by-nc": r"cc by-nc|cc-by-nc|cc-by-nc-[1234]\.0|commons attribution-noncommercial|commons attribution non-?commercial",
    "cc0": r"cc0|cc0-1\.0|creative commons zero",
    "proprietary": r"all rights reserved|rights reserved|proprietary|copyright",
}
# Sentences around a statement or a name (as {}) that make it talk about a licence.
TALK = ["is software {} better than", "what does it mean that code is {} ?", "which projects are {} ?", "he read about the {} in a book", "should we choose the {} or another ?", "the history of the {} is long", "please compare the {} with the others", "an article about {} appeared", "the discussion of the {} went on", "why the {} matters to companies", "the lawyer wrote that the {} is hard to read", "people argue that the {} is too strict", "differences between the {} and other licenses", "her talk explains the {} to students", "we are thinking of moving to the {} next year", "if it were {} we would use it", "this is not {}", "hardly anyone understands the {}", "students debate whether code {} can be sold", "the court ruled on the {} last week", "can i sell code {} ?", "do you prefer the {} ?", "how does the {} differ from the others", "many developers think the {} is popular", "software {} was used by most companies in the survey", "she teaches a course on the {}", "the report counts how many projects are {}", "questions about {} come up often", "he asked if the program was {}", "they refused to have it {}", "our blog reviews the {} and its rivals", "the debate over the {} versus others", "i do not know if this is {}", "are programs {} more secure ?", "some say {} means free", "the number of packages {} grew", "who wrote the {} ?", "when was the {} published ?", "the meeting about {} is on monday", "avoid code {} in products"]
# Words around a statement that leave it one.
AROUND = ["", "this project is", "this file is part of the project and is", "the source code is", "copyright c 2020 the authors", "all files in this directory are", "see the license file for details", "this program is", "unless otherwise noted this work is", "copyright 2019 by the contributors", "either version 3 of the license or at your option any later version", "you may obtain a copy of the license at", "a copy is in the file license", "this library is free software", "as published by the free software foundation", "code in this repository is", "except where otherwise noted content on this site is", "can be found in the license file", "the documentation is", "author and contributors", "provided that the following conditions are met", "and associated documentation files the software to deal in the software without restriction", "provided that the above copyright notice and this permission notice appear in all copies", "subject to the following restrictions", "which accompanies this distribution and is available at", "version 2.1 or newer", "version 3", "see copying", "the toolkit is", "the server is"]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def examples(n: int = 16, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(class, words): templates with words added before, after and within; and paragraphs that only sound like licences."""
    rng = random.Random(seed)
    filler = "the this project file software work document code data text it is and of for in our all page author years team new".split()
    word = lambda: rng.choice(filler) if rng.random() < 0.5 else "".join(rng.choice("abcdefghilmnoprstuw") for _ in range(rng.randint(2, 9)))
    noise = lambda k: [word() for _ in range(rng.randint(0, k))]
    out = []
    for family, templates in TEMPLATES.items():
        for k in range(n * len(templates)):
            words = words_of(templates[k % len(templates)])
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), word())
            before, after = words_of(rng.choice(AROUND)), words_of(rng.choice(AROUND))
            out.append((family, noise(8) + words + noise(8) if k % 2 else before + noise(2) + words + after))
    talk = ["license to drive", "driving licence", "licensed physician", "license plate", "marriage license", "copyright law", "copyright debate", "with permission", "asked permission", "warranty card", "extended warranty", "fishing licence office", "public library", "general public", "software license fees", "license server is down", "version 2.0 of the plan", "mit campus", "apache helicopter", "gnu antelope", "creative commons room", "mozilla meeting", "bsd conference"]
    for k in range(3 * n * len(TEMPLATES)):
        out.append((UNKNOWN, noise(12) + (words_of(talk[k % len(talk)]) if k % 3 else []) + noise(12) + [word()]))
    statements = [t for ts in TEMPLATES.values() for t in ts]
    for k in range(3 * n * len(TALK)):
        said = words_of(rng.choice(statements))
        said = said if rng.random() < 0.6 else said[-rng.randint(1, 4) :]
        out.append((UNKNOWN, noise(3) + words_of(TALK[k % len(TALK)].replace("{}", " ".join(said))) + noise(5)))
    return out


@dataclass
class Classifier:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias)
        for g in grams_of(words):
            if g in self.weights:
                z = z + np.array(self.weights[g])
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


@cache
def classifier(epochs: int = 600, rate: float = 0.5, decay: float = 1e-4, least: int = 4) -> Classifier:
    data = examples()
    classes = [UNKNOWN, *TEMPLATES]
    fit, held = [d for k, d in enumerate(data) if k % 5], [d for k, d in enumerate(data) if not k % 5]
    seen = Counter(g for _, w in fit for g in set(grams_of(w)))
    names = sorted(g for g, n in seen.items() if n >= least)
    index = {g: k for k, g in enumerate(names)}

    def matrix(rows):
        x = np.zeros((len(rows), len(names)), np.float32)
        for r, (_, w) in enumerate(rows):
            for g in grams_of(w):
                if g in index:
                    x[r, index[g]] += 1
        return x, np.array([classes.index(c) for c, _ in rows])

    x, y = matrix(fit)
    onehot = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(epochs):
        g = (softmax(x @ w + b) - onehot) / len(x)
        w -= rate * (x.T @ g * 10 + decay * w)
        b -= rate * g.sum(axis=0)
    hx, hy = matrix(held)
    z = hx @ w + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
    temperature = float(min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss))
    p = softmax(z / temperature)
    # The threshold with the most held-out examples right, each class of statements and talk weighing the same.
    mass = p[:, 1:].sum(axis=1)
    right = lambda t: (mass[hy > 0] >= t).mean() + (mass[hy == 0] < t).mean()
    threshold = float(max(np.arange(0.5, 1.0, 0.01), key=right))
    return Classifier(classes, {g: [round(float(v), 4) for v in w[k]] for g, k in index.items()}, [round(float(v), 4) for v in b], temperature, threshold)


def classify(text: str) -> tuple[str, float]:
    """Family (or unknown) and its probability of one paragraph, in Python and without a gate; `scan` is its DataFrame form."""
    words = words_of(text)
    model = classifier()
    p = model.probabilities(words)
    families = [f for f in TEMPLATES if stated(f, words)]
    if not families or 1 - p[0] < model.threshold:
        return UNKNOWN, float(p[0])
    family = max(families, key=lambda f: p[model.classes.index(f)])
    return family, float(p[model.classes.index(family)])


def stated(family: str, words: list[str]) -> bool:
    """A name of the family stands in words, and a template confirms it; one of two words in one piece."""
    text, has = " ".join(words), set(words)
    if not re.search(name_pattern(family), text):
        return False
    sets = {t: set(words_of(t)) for t in TEMPLATES[family]}
    return any(f" {t} " in f" {text} " if len(w) == 2 else len(has & w) >= CONFIRM * len(w) for t, w in sets.items())


def name_pattern(family: str) -> str:
    return f"(?:^| )(?:{NAMES[family]})(?: |$)"


def confirmed(family: str, words: list[str]) -> bool:
    """Enough words of a template are there, in any order: what `gate` must not miss."""
    has = set(words)
    return any(len(has & set(t)) >= CONFIRM * len(set(t)) for t in map(words_of, TEMPLATES[family]))


@cache
def gate() -> str:
    """A pattern that occurs in the lower case of every text that a template confirms.

    A template of n words that asks for m of them leaves out n - m at most, so one of any n - m + 1 of them is there; the
    longest are taken, as they are rare. A word is a whole token, so neither a letter nor a digit is next to it.
    """
    words = set()
    for t in (set(words_of(t)) for ts in TEMPLATES.values() for t in ts):
        m = next(k for k in range(len(t) + 1) if k >= CONFIRM * len(t))
        words.update(sorted(t, key=lambda w: (-len(w), w))[: len(t) - m + 1])
    return f"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in sorted(words))})(?![a-z0-9])"


def _literal(value, kind: str) -> Column:
    """A constant map or array: folded once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_license, families, findings of every row of docs.

    families: distinct families in byte order, comma-joined. findings: family:start:end by start, comma-joined.
    """
    model = classifier()
    table = [[] for _ in range(BUCKETS)]
    for gram, v in model.weights.items():
        table[zlib.crc32(gram.encode()) % BUCKETS].append({"g": gram, "v": v})
    table = _literal(table, "array<array<struct<g:string,v:array<double>>>>")
    bias = _literal(model.bias, "array<double>")
    names = _literal(list(TEMPLATES), "array<string>")
    long = {f: [w for w in (sorted(set(words_of(t))) for t in ts) if len(w) > 2] for f, ts in TEMPLATES.items()}
    pairs = {f: "|".join(re.escape(t) for t in ts if len(set(words_of(t))) == 2) or "(?!)" for f, ts in TEMPLATES.items()}
    templates = {f: _literal(sets, "array<array<string>>") for f, sets in long.items()}
    df = id_and_text(docs).withColumn("lines", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n")))

    def words_in(paragraph: Column) -> Column:
        return F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0))

    def shares(words: Column) -> Column:
        """The largest share of a template in words, for each family that is named there (0 for the others)."""
        share = lambda f: F.coalesce(F.array_max(F.transform(templates[f], lambda t: F.size(F.array_intersect(t, words)) / F.size(t))), F.lit(0.0))
        pair = lambda f, text: text.rlike(f"(?:^| )(?:{pairs[f]})(?: |$)")
        return let(F.array_join(words, " "), lambda text: F.array(*(F.when(pair(f, text), 1.0).when(text.rlike(name_pattern(f)), share(f)).otherwise(0.0) for f in TEMPLATES)))

    def scores(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, k: F.concat_ws(" ", a, F.element_at(words, (k + 2).cast("int"))))
        cell = lambda g: F.element_at(table, (F.pmod(F.crc32(g), F.lit(BUCKETS)) + 1).cast("int"))
        vectors = F.flatten(F.transform(F.concat(words, pairs), lambda g: F.filter(cell(g), lambda e: e["g"] == g)))
        total = F.aggregate(vectors, bias, lambda acc, e: F.zip_with(acc, e["v"], lambda a, b: a + b))
        return F.transform(total, lambda z: z / model.temperature)

    def judged(words: Column, share: Column) -> Column:
        """The family of a paragraph whose shares reach CONFIRM for one at least, or UNKNOWN."""

        def family(z: Column) -> Column:
            top = F.array_max(z)
            exps = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            sure = 1 - F.exp(z[0] - top) / exps >= model.threshold
            of = F.transform(share, lambda s, k: F.when(s >= CONFIRM, F.struct(F.element_at(z, (k + 2).cast("int")).alias("z"), (-k).alias("k"))))
            best = F.array_max(F.filter(of, lambda x: x.isNotNull()))
            return F.when(sure, F.element_at(names, (1 - best["k"]).cast("int"))).otherwise(UNKNOWN)

        return F.when(F.array_max(share) >= CONFIRM, let(scores(words), family)).otherwise(UNKNOWN)

    def family_of(paragraph: Column) -> Column:
        return F.when(F.lower(paragraph).rlike(gate()), let(words_in(paragraph), lambda w: let(shares(w), lambda s: judged(w, s)))).otherwise(UNKNOWN)

    gated = F.lower("text").rlike(gate())
    df = df.withColumn("own", F.when(gated, F.transform("lines", family_of)).otherwise(F.array().cast("array<string>")))
    ends = F.zip_with("own", F.when(F.size("own") > 0, F.col("lines")).otherwise(F.array().cast("array<string>")), lambda f, x: (f != UNKNOWN) | ~x.rlike("[A-Za-z0-9]"))
    df = df.withColumn("ends", ends)
    spot = "struct<first:int,last:int,family:string>"

    def window(k: Column) -> Column:
        """The window from line k (from 1) on that has the largest share of a template, or null."""
        paragraph = lambda first, n: F.array_join(F.slice("lines", first, n), "\n")
        share = lambda first, n: let(words_in(paragraph(first, n)), lambda w: F.array_max(shares(w)))
        stop = F.array_position(F.slice("ends", k, WINDOW), True).cast("int")
        most = F.when(stop > 0, stop - 1).otherwise(F.least(F.lit(WINDOW), F.size("lines") - k + 1))

        def best(n: Column) -> Column:
            sizes = F.transform(F.sequence(F.lit(2), n), lambda m: F.struct(share(k, m).alias("share"), (-m).alias("m")))
            first = let(F.array_max(sizes), lambda b: F.when((b["share"] >= CONFIRM) & (share(k + 1, -b["m"] - 1) < b["share"]), -b["m"]))
            return let(first, lambda m: F.when(m.isNotNull(), F.struct(k.alias("first"), (k + m - 1).alias("last"), family_of(paragraph(k, m)).alias("family"))))

        # A word is no more than its line's, so no window reaches a share that its longest form doesn't; names grow likewise.
        return let(most, lambda n: F.when((n > 1) & F.lower(paragraph(k, n)).rlike(gate()) & (share(k, n) >= CONFIRM), best(n)))

    wide = F.transform("ends", lambda e, k: F.when(~e, window((k + 1).cast("int"))))
    wide = F.filter(wide, lambda w: w.isNotNull() & (w["family"] != UNKNOWN))
    df = df.withColumn("wide", F.when(F.size("ends") > 1, wide).otherwise(F.array().cast(f"array<{spot}>")))
    taken = folded(F.col("wide"), F.lit(0), lambda last, w: (F.when(w["first"] > last, w["last"]).otherwise(last), F.when(w["first"] > last, F.array(w)).otherwise(F.array().cast(f"array<{spot}>"))), spot)
    single = F.filter(F.transform("own", lambda f, k: F.struct((k + 1).cast("int").alias("first"), (k + 1).cast("int").alias("last"), f.alias("family"))), lambda f: f["family"] != UNKNOWN)
    df = df.withColumn("placed", F.array_sort(F.concat(single, taken)))
    # Where lines start: the lengths of those before, and their line ends.
    starts = folded(F.transform("lines", F.length), F.lit(0), lambda at, n: (at + n + 1, F.array(at)), "int")
    df = df.withColumn("starts", F.when(F.size("placed") > 0, starts).otherwise(F.array().cast("array<int>")))
    at = lambda k: F.element_at("starts", k)
    found = F.transform("placed", lambda f: F.struct(at(f["first"]).alias("start"), (at(f["last"]) + F.length(F.element_at("lines", f["last"]))).alias("end"), f["family"].alias("family")))
    df = df.withColumn("found", found)
    return df.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_paragraphs"),
        F.size("found").cast("long").alias("n_license"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda f: f["family"])))).alias("families"),
        F.concat_ws(",", F.transform("found", lambda f: F.concat_ws(":", f["family"], f["start"], f["end"]))).alias("findings"),
    )
