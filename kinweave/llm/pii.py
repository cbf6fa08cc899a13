"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans, which may overlap: the base patterns of each kind, and looser forms (addresses with
"at" and "dot" spelt out, numbers grouped like telephone or card numbers without their marks, hexadecimal addresses). Base
matches that pass their checks always stay. The other candidates get features of format (digits, groups, checksum, length) and
context (words before, neighbours), boosted trees score them, and a candidate is redacted if its calibrated probability reaches
its kind's threshold and it overlaps no span that stays.

Trees, calibration and thresholds are fitted on the driver from labelled phrases made by rule (`examples`), a fixed number of
them, independent of the corpus. On the executors all is regular expressions, array functions and CASE expressions; no row is
shuffled.

    email, ip, card, phone   in this order; leftmost and not overlapping within a kind, failing matches are dropped.

The patterns below are the base patterns with possessive repeats and a look-behind where a run's later starts cannot match
if its first can't, so that Java's matcher neither recurses nor starts a long run anew at each of its characters.

Edge cases: null text is empty and has no span; rows with null doc_id are scanned too; repeated rows give repeated results;
very long texts are scanned whole, in time linear in their matches but for a sort; spans of a kind with one start come by their end; an empty table gives no rows; other columns
are ignored, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.boosting import Boosted, boost
from kinweave.llm.common import folded, id_and_text, let

KINDS = ("email", "ip", "card", "phone")
# A previous match may end inside a run of local-part characters, where the next match may then start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){2}[./_\x20-]{1,3}[0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\(?[0-9]{2,4}\)?[\x20./-]{1,2}){2,3}[0-9]{3,5}(?![0-9])",
}
# What must occur for a base match that passes its check, and for a loose match; texts without it are not searched.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
NEEDS = {"email": r"@|\bat\b", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": "[0-9]{3}", "phone": "[0-9]{2}"}
# Words before a candidate that speak for its kind, and those that speak for other numbers.
FOR = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b", "ip": r"(?i)\b(?:ip|address|host|server|client|login|ping)\b", "card": r"(?i)\b(?:card|visa|credit|debit|mastercard|amex|payment|account)\b", "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|dial|ring|sms|text)\b"}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|page|pages|section|chapter|figure|date|serial|part|model|build|score|between|total|year|years|since|room|item)\b"
CONTEXT = 32
DATED = r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}"
DOMAIN = r"(?i)(?:\.|dot\)?\]?\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"
MARKED = r"@|[(\[]at[)\]]|\bdot\b"
FEATURES = ("digits", "length", "others", "groups", "luhn", "for", "against", "alike", "joined", "dated", "domain", "marked")


@dataclass
class Judge:
    trees: Boosted
    slope: float
    shift: float
    threshold: float


def features_of(kind: str, value: str, before: str, after: str) -> list[float]:
    """The features in Python, for training; `features` is their DataFrame form (a test holds them together)."""
    digits = re.sub("[^0-9]", "", value)
    groups = [g for g in re.split("[^0-9A-Za-z]+", value) if g]
    return [
        float(len(digits)),
        float(len(value)),
        float(len(re.sub("[0-9A-Za-z]", "", value))),
        float(len(groups)),
        float(luhn(digits)),
        float(bool(re.search(FOR[kind], before))),
        float(bool(re.search(AGAINST, before))),
        float(len({len(g) for g in groups})),
        float(bool(re.search(r"[0-9A-Za-z_.,:/-]\Z", before)) or bool(re.search(r"\A[0-9A-Za-z_:/-]", after))),
        *(float(bool(re.search(p, value))) for p in (DATED, DOMAIN, MARKED)),
    ]


def features(kind: str, c: Column) -> list[Column]:
    value, before, after = c["value"], c["before"], c["after"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")
    number = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    return [
        F.length(digits).cast("double"),
        F.length(value).cast("double"),
        F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")).cast("double"),
        F.size(groups).cast("double"),
        number(passes_luhn(digits)),
        number(before.rlike(FOR[kind])),
        number(before.rlike(AGAINST)),
        F.size(F.array_distinct(F.transform(groups, F.length))).cast("double"),
        number(before.rlike(r"[0-9A-Za-z_.,:/-]\z") | after.rlike(r"\A[0-9A-Za-z_:/-]")),
        *(number(value.rlike(p)) for p in (DATED, DOMAIN, MARKED)),
    ]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def passes_luhn(digits: Column) -> Column:
    """Of a string of digits; true for the empty one."""
    parts = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    worth = F.transform(parts, lambda d, k: F.when(k % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def examples(kind: str, n: int = 400, seed: int = 11) -> tuple[list[list[float]], list[int]]:
    """Labelled candidates by rule: about half are personal data in a loose form, the others lookalikes."""
    rng = random.Random(f"{kind}{seed}")
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    good = {"email": ["Mail me: ", "contact ", "write to ", "e-mail "], "ip": ["host ", "server ", "client address "], "card": ["card ", "Visa number ", "credit card: ", "payment "], "phone": ["call ", "Tel. ", "phone: ", "my mobile is ", "fax "]}[kind]
    bad = ["order ", "invoice no. ", "version ", "ISBN ", "pages ", "between ", "serial ", "date ", "score "]
    x, y = [], []
    for k in range(n):
        real = k % 2 == 0
        before = rng.choice(good if real and rng.random() < 0.8 else bad if not real and rng.random() < 0.7 else [f"{word()} ", f"{word()}, {word()} "])
        after = rng.choice([" ", ".", ",", f" {word()}"])
        sep = rng.choice([" ", "-", "."])
        if kind == "email":
            if real:
                at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", "(dot)")])
                value = f"{word()}{rng.choice(['', '.' + word(), digits(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
            else:
                end = word()
                value = f"{word()} at {word()}{rng.choice(['. ', '. ', ' . ', ' dot '])}{rng.choice([end, end.capitalize()])}"
                value += rng.choice(["", "", f". {word()}"])
                before, after = rng.choice([before, f"{word()} {word()} "]), f" {word()}"
        elif kind == "ip":
            value = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4 if real else rng.randint(1, 2))) for _ in range(8))
        elif kind == "card":
            body = digits(15)
            value = body + next(d for d in "0123456789" if luhn(body + d) == real)
            s = rng.choice([".", "/", "_", "  "])
            value = s.join(value[i : i + 4] for i in range(0, 16, 4))
        elif real:
            value = rng.choice([f"({digits(3)}) {digits(3)}{sep}{digits(4)}", sep.join([digits(3), digits(3), digits(4)]), sep.join([digits(4), digits(3), digits(4)])])
        else:
            value = rng.choice([f"{rng.choice(['19', '20'])}{digits(2)}-{digits(2)}-{digits(3)}", sep.join([digits(2), digits(2), digits(3)]), sep.join([digits(4), digits(4), digits(4)]), f"{digits(3)} {digits(3)} {digits(3)}"])
            after = rng.choice([after, f"-{digits(2)}", "/"])
        x.append(features_of(kind, value, before, after))
        y.append(int(real))
    return x, y


@cache
def judges(precision: float = 0.98) -> dict[str, Judge]:
    """Per kind: trees from one half of the examples; calibration and threshold from the other, at the given precision."""
    out = {}
    for kind in KINDS:
        x, y = (np.array(a, np.float64) for a in examples(kind))
        fit = np.arange(len(y)) % 4 < 2
        trees = boost(x[fit], y[fit])
        raw, truth = trees.raw(x[~fit]), y[~fit]
        slope, shift = 1.0, 0.0
        for _ in range(200):  # Platt's logistic calibration
            p = 1 / (1 + np.exp(-(slope * raw + shift)))
            slope, shift = slope - 0.02 * float(((p - truth) * raw).mean()), shift - 0.02 * float((p - truth).mean())
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        cuts = [c for c in np.arange(0.5, 1.0, 0.01) if (chosen := p >= c).any() and truth[chosen].mean() >= precision]
        out[kind] = Judge(trees, slope, shift, float(cuts[0]) if cuts else 1.1)
    return out


SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, value, before, after) of a pattern's matches, from what lies between them.

    before and after are the CONTEXT characters before a match and the 4 behind it (fewer, where a shorter match ends first; a
    LOOSE match of any kind has 4 or more).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    following = let(zipped, lambda z: F.transform(F.slice(z, 1, F.size(z) - 1), lambda m, k: F.struct(m["gap"].alias("gap"), m["value"].alias("value"), let(F.element_at(z, (k + 2).cast("int")), lambda n: F.left(F.concat(n["gap"], F.coalesce(n["value"], F.lit(""))), F.lit(4))).alias("after"))))

    def step(state: Column, m: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(m["gap"])
        end = start + F.length(m["value"])
        before = F.right(F.concat(state["tail"], m["gap"]), F.lit(CONTEXT))
        tail = F.right(F.concat(before, m["value"]), F.lit(CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail")), F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), before.alias("before"), m["after"].alias("after")))

    spans = folded(following, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, SPAN)
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def free(spans: Column, kept: Column) -> Column:
    """Those of spans that overlap none of kept, in order of their starts: two passes along both."""
    marked = lambda a, mine: F.transform(a, lambda m: F.struct(m["start"].alias("start"), F.lit(mine).alias("mine"), m.alias("m")))
    none = F.array().cast(f"array<{SPAN}>")
    both = lambda some: F.array_sort(F.concat(marked(kept, False), marked(some, True)))

    def behind(last: Column, x: Column) -> tuple[Column, Column]:
        m = x["m"]
        return F.when(x["mine"], last).otherwise(F.greatest(last, m["end"])), F.when(x["mine"] & (m["start"] >= last), F.array(m)).otherwise(none)

    def ahead(next_: Column, x: Column) -> tuple[Column, Column]:
        m = x["m"]
        return F.when(x["mine"], next_).otherwise(m["start"]), F.when(x["mine"] & (m["end"] <= next_), F.array(m)).otherwise(none)

    first = folded(both(spans), F.lit(0), behind, SPAN)
    return F.reverse(let(first, lambda f: folded(F.reverse(both(f)), F.lit(2**31 - 1), ahead, SPAN)))


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(16, 19) & passes_luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _passes(kind: str, m: Column) -> Column:
    return valid(kind, m["value"])


def _chosen(kind: str, m: Column) -> Column:
    """The candidate's calibrated probability reaches the threshold."""
    judge = judges()[kind]
    return 1 / (1 + F.exp(-(judge.trees.column(features(kind, m)) * judge.slope + judge.shift))) >= judge.threshold


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, n_added, spans of every row of docs."""
    df = id_and_text(docs)
    for kind in KINDS:
        df = df.withColumn(f"base_{kind}", matches(F.col("text"), BASE[kind], BASE_NEEDS[kind]))
        df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", partial(_passes, kind)))
        df = df.withColumn(f"loose_{kind}", matches(F.col("text"), LOOSE[kind], NEEDS[kind]))
    kept = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    df = df.withColumn("kept", kept)
    for kind in KINDS:
        # Most rows have no loose match, and then the trees aren't reached.
        df = df.withColumn(f"added_{kind}", F.when(F.size(f"loose_{kind}") > 0, F.filter(free(F.col(f"loose_{kind}"), F.col("kept")), partial(_chosen, kind))).otherwise(F.col(f"loose_{kind}")))
    shown = lambda kind, spans: F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))
    base = F.concat_ws(",", *(shown(k, f"base_{k}") for k in KINDS))
    every = F.concat_ws(",", *(shown(k, F.array_sort(F.concat(f"base_{k}", f"added_{k}"))) for k in KINDS))
    return df.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), sum((F.size(f"added_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_added"), every.alias("spans"))
