"""Secret scans by assignment-aware lexing.

A text is lexed for assignments of source and configuration syntax (name = value, name: value, "name": "value", name := value,
name => value, name: Type = value, target["name"] = value). A typed name is bound besides what stands before the sign. Values are quoted literals, sums of quoted literals, bare words, or names bound earlier in the text,
whose literals are then propagated. A literal is scored by the words of every name that it reaches, its length and its mix of
characters; placeholders and references score nothing, nor do values with spaces unless they are quoted and one of their names
alone scores SPACED or more (pass phrases). Literals of THRESHOLD or more become spans of kind `lexed`, beside the
base spans, which always stay:

    assign, access, hex   fixed patterns, leftmost and not overlapping within a kind; those that fail the length are dropped.

A bare word ends at the next sign of assignment or at `&` (signs that only pad its end stay), and an annotation is no longer than
TYPE_LENGTH, so every character is looked at a bounded number of times: time is linear in the text.

Edge cases: null text is empty and has no span; very long texts are scanned whole; rows with null doc_id are scanned too; repeated
rows give repeated results; spans with one start come in the order of KINDS, then by end; an empty table gives no rows; other
columns are ignored (redact keeps them all, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_and_text

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 1.0
SPACED = 1.0
TYPE_LENGTH = 200
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words of names and what they add to the score of a literal.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.4, "client": 0.1}
PLACEHOLDER = re.compile(r"(?ai:changeme|change_me|example|placeholder|redacted|none|null|true|false|undefined|your[_-]?\w*|x+|\*+|\.+|todo)\Z")
NAME = re.compile(r"[A-Za-z_][\w.\-]*\Z", re.ASCII)
BEFORE = re.compile(r"[A-Za-z0-9_.\-]", re.ASCII)
AFTER = re.compile(r"""[ \t]*(?:(["'`])((?:\\.|(?!\1)[^\\\n])*)\1|([A-Za-z0-9_./+~!@#$%^*\-]+(?:={1,2}(?![A-Za-z0-9_./+=~!@#$%^&*"'`\-]))?))""")
PLUS = re.compile(r"""[ \t]*\+[ \t]*(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
# A type once its bracketed parts and the spaces about its signs are out.
BRACKETS = re.compile(r"\[[^\[\]<>()]*\]|<[^\[\]<>()]*>|\([^\[\]<>()]*\)")
SIGNS = re.compile(r"[ \t]*([|&?!*])[ \t]*")
TYPE = re.compile(r"""[&*]*(?:'\w+[ ]+)?(?:(?:mut|dyn|const)[ ]+)*["']?[A-Za-z_](?:[\w.?!|&*"']|::)*\Z""", re.ASCII)
TYPED = re.compile(r"""[\w.?!|&*"'\[\]<>(), \t]""", re.ASCII)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def word_before(text: str, end: int) -> tuple[str, int]:
    """The word that ends at `end`, perhaps quoted or after spaces, and where it starts."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    left = end
    while left and BEFORE.match(text[left - 1]):
        left -= 1
    return text[left:end], left


def subscript(text: str, end: int) -> str:
    """The last key of a target whose bracket closes before `end`; the target's own name if the key is a number."""
    at = end - 1
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\"'`":
        opened = text.rfind(text[at - 1], 0, at - 1)
        key = text[opened + 1 : at - 1]
        before = opened - (opened > 0 and text[opened - 1] in "bfru")
        while before > 0 and text[before - 1] in " \t":
            before -= 1
        return key if before > 0 and text[before - 1] in "[,(" and "\n" not in key else ""
    key, left = word_before(text, at)
    if NAME.match(key):
        return key
    return word_before(text, left - 1)[0] if left and text[left - 1] == "[" else ""


def typed_name(text: str, at: int) -> str:
    """The name before a type annotation that ends before the sign at `at`; empty if there is none."""
    left, least = at, max(0, at - TYPE_LENGTH)
    while left > least and (TYPED.match(text[left - 1]) or text[left - 2 : left] == "::" and left > 2):
        left -= 2 if text[left - 1] == ":" else 1
    if not left or text[left - 1] != ":":
        return ""
    kind, inner = text[left:at].strip(), None
    while inner != kind:
        inner, kind = kind, BRACKETS.sub("", kind)
    end = left - 1 - (left > 1 and text[left - 2] in "?!")
    name = word_before(text, end)[0] if TYPE.match(SIGNS.sub(r"\1", kind).strip()) else ""
    return name if NAME.match(name) else ""


def assignments(text: str):
    """(name, kind, value, start, end) of every assignment, for each name that it binds: kind is literal or word; the span is the value's."""
    for op in re.finditer(r"[:=]", text):
        at = op.start()
        if at and text[at - 1] in ":=<>!" or text[at : at + 2] in ("==", "::"):
            continue
        end = at
        while end and text[end - 1] in " \t":
            end -= 1
        if end and text[end - 1] == "]":
            names = [subscript(text, end)]
        else:
            name = word_before(text, end)[0]
            names = [name if NAME.match(name) else ""]
        if text[at] == "=":
            names.append(typed_name(text, at))
        names = [n for n in dict.fromkeys(names) if n]
        if not names:
            continue
        found = AFTER.match(text, at + 1 + (text[at + 1 : at + 2] in ("=", ">")))
        if not found:
            continue
        if found[1]:
            parts, start, stop = [found[2]], found.start(2), found.end(2)
            more = PLUS.match(text, found.end())
            while more:
                parts.append(more[2])
                stop = more.end(2)
                more = PLUS.match(text, more.end())
            value = "".join(parts)
            yield from ((name, "literal", value, start, stop) for name in names)
        else:
            yield from ((name, "word", found[3], found.start(3), found.end(3)) for name in names)


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    return sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts))


def value_score(value: str, spaced: bool = False) -> float:
    """0 for what can't be a secret (with spaces only if spaced), else up to 1 by length and the mix of characters."""
    if len(value) < 6 or " " in value and not (spaced and value.strip()) or "${" in value or "{{" in value or value[0] in "<$%" or PLACEHOLDER.match(value):
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * mixed + 0.025 * min(len(value), 20))


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    known: dict[str, tuple[str, int, int]] = {}
    score: dict[tuple[str, int, int], float] = {}
    for name, kind, value, start, end in assignments(text):
        bound = known.get(value) if kind == "word" else None
        known[name] = literal = bound or (value, start, end)
        score[literal] = max(score.get(literal, 0.0), name_score(name))
    worth = {literal: value_score(literal[0], points >= SPACED) for literal, points in score.items()}
    return [("lexed", s, e) for (value, s, e), points in score.items() if points and points * (0.5 + worth[value, s, e]) >= THRESHOLD and worth[value, s, e] >= 0.5]


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, both by start, then kind. A lexed span within a base span adds nothing and goes."""
    base = base_spans(text)
    starts, ends = [b[1] for b in base], [0, *accumulate((b[2] for b in base), max)]
    # The widest end of the base spans that start no later tells whether one of them holds the span.
    more = [s for s in lexed_spans(text) if ends[bisect_right(starts, s[1])] < s[2]] if ":" in text or "=" in text else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans of every row of docs."""

    def run(batches):
        for b in batches:
            found = [spans_of(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in every) for _, every in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha), pa.array([joined(every) for _, every in found])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at, till = [], 0, 0
    for _, start, end in spans_of(text)[1]:
        if start >= till:
            out += [text[at:start], mark]
        at = till = max(till, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by a mark and n_chars, where there is one, set anew; all rows and columns stay."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            new = [None if t is None else redacted(t) for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            k = b.schema.get_field_index("n_chars")
            if k >= 0:
                olds = columns[k].to_pylist()
                columns[k] = pa.array([o if t == n else len(n) for t, n, o in zip(texts, new, olds, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
