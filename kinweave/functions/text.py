"""Scanning of line-oriented genealogical records, and of names within them."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What is no given name (initials and particles, regnal numerals, ordinals), and what is blanked before the split.
_PARTICLE = r"^(?:[A-Z]|[a-z]{1,3})$"
_ROMAN = r"^[IVXLCDM]{2,}$"
_ORDINAL = r"(?i)^\d+(?:st|nd|rd|th)$"
_NOISE = r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|[(){}\[\]`\"]"
#: Where letters, marks of writing and their compatibility forms lie that fold to plain ones: Latin to general punctuation and
#: symbols, phonetic and later Latin letters, ligatures, and full-width forms.
_FOLDED_RANGES = ((0x80, 0x370), (0x1D00, 0x1DC0), (0x1E00, 0x1F00), (0x2000, 0x2C00), (0x2C60, 0x2C80), (0x2E00, 0x3040), (0x3200, 0x3400), (0xA700, 0xA800), (0xAB30, 0xAB70), (0xFB00, 0xFB07), (0xFE10, 0xFE70), (0xFF00, 0xFFF0))


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What the Unicode library of Spark's JVM makes of single characters by its rule set Latin-ASCII: those that become one
    character, and those that become several or none. Read once a session; the expressions built from it run without it."""
    chars = [c for lo, hi in _FOLDED_RANGES for c in map(chr, range(lo, hi)) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Mn", "Me") and c not in "\u2028\u2029\x85"]
    rules = SparkSession.active()._jvm.com.ibm.icu.text.Transliterator.getInstance("Latin-ASCII")
    plain = rules.transliterate("\n".join(chars)).split("\n")
    found = {c: p for c, p in zip(chars, plain, strict=True) if c != p}
    return {c: p for c, p in found.items() if len(p) == 1}, {c: p for c, p in found.items() if len(p) != 1}


def has_tag(record: Column, *tags: str) -> Column:
    """Level-1 tag followed by a space, a line end or the end."""
    return record.rlike(r"\n1 (?:" + "|".join(map(re.escape, tags)) + r")(?: |\n|$)")


def has_prefix(record: Column, *tags: str) -> Column:
    """Level-1 line that begins with a tag, whatever follows it."""
    return reduce(or_, (record.contains(f"\n1 {t}") for t in tags))


def block_pattern(tag: str, level: int = 1) -> str:
    """A line of that level whose tag matches, with the lines up to the next one of its level or above.

    All repeats are possessive: they never give anything back, so a match needs one pass and no stack, however long a block is.
    """
    above = "".join(map(str, range(level + 1)))
    return rf"\n{level} (?:{tag})(?=[ \n]|\z)[^\n]*+(?:\n(?![{above}] )[^\n]*+)*+"


def event_block(record: Column, tag: str) -> Column:
    """The first level-1 block of a tag with its subordinate lines, or null."""
    return F.nullif(F.regexp_extract(record, block_pattern(re.escape(tag)), 0), F.lit(""))


def event_blocks(record: Column, tag: str) -> Column:
    return F.regexp_extract_all(record, F.lit(block_pattern(re.escape(tag))), F.lit(0))


def sub_value(block: Column, tag: str) -> Column:
    """First level-2 value of a block, trimmed; null if blank."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"\n2 {re.escape(tag)} +([^\n]*)", 1)), F.lit(""))


def event_place(record: Column, tag: str) -> Column:
    return sub_value(event_block(record, tag), "PLAC")


def event_places(record: Column, tag: str) -> Column:
    return F.filter(F.transform(event_blocks(record, tag), lambda b: sub_value(b, "PLAC")), lambda p: p.isNotNull())


def tag_values(record: Column, tag: str, level: int = 1) -> Column:
    found = F.regexp_extract_all(record, F.lit(rf"(?m)^{level} {re.escape(tag)} (.*)$"), F.lit(1))
    return F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: v != "")


def event_year_of_text(record: Column, tag: str) -> Column:
    """Signed year of a block's date text: the part before AND or TO, without what follows a bracket. Of a dual year the first
    counts, and one more where that has four digits; of several numbers the last."""
    date = F.regexp_replace(sub_value(event_block(record, tag), "DATE"), r"\(.*", "")
    date = F.element_at(F.split(date, r"\s+(?:AND|TO)\s+", 2), 1)
    later = F.when(date.rlike(r"[0-9]{4}/[0-9]"), 1).otherwise(0)
    runs = F.regexp_extract_all(F.regexp_replace(date, "([0-9]+)/[0-9]+", "$1"), F.lit(r"(?<![0-9])[0-9]{1,4}(?![0-9])"), F.lit(0))
    year = F.try_element_at(runs, F.lit(-1)).cast("int") + later
    return F.when(date.rlike(r"\bB\.C\."), -year).otherwise(year)


def coordinate(block: Column, tag: str) -> Column:
    """LATI or LONG at level 4, south and west negative; the block is read once."""
    found = F.regexp_extract(block, rf"\n4 {re.escape(tag)} +([NSEW][0-9]+(?:\.[0-9]+)?)", 1)
    return F.translate(found, "SWNE", "--").try_cast("double")


def composed(value: Column) -> Column:
    """Characters in their composed form (NFC), by the Unicode library of Spark's JVM; texts without marks or later letters as they are."""
    whole = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(False))
    return F.when(value.rlike(r"[\p{M}\x{0340}-\x{037E}\x{1100}-\x{11FF}\x{1F00}-\x{2FFF}\x{F900}-\x{FB4F}]"), F.coalesce(whole, value)).otherwise(value)


def given_tokens(given: Column) -> Column:
    """Tokens of a given name, composed, without bracketed parts, double quotes and backticks, initials, short particles,
    all-capital roman numerals and ordinals. Apostrophes are letters; a stray bracket is a space."""
    tokens = F.split(F.trim(F.regexp_replace(composed(F.trim(given)), _NOISE, " ")), r"\s+")
    keep = F.filter(tokens, lambda t: (t != "") & ~t.rlike(_PARTICLE) & ~t.rlike(_ROMAN) & ~t.rlike(_ORDINAL))
    return F.when(F.trim(given).isin("", "@P.N.") | given.isNull(), F.array().cast("array<string>")).otherwise(keep)


def folded(token: Column) -> Column:
    """Lower-case key in plain letters: what the rule set Latin-ASCII and lower-casing make of the composed token. Letters, signs and
    quotes with a plain form take it, marks on Latin letters go, and other scripts keep their form and their marks."""
    single, several = _folds()
    out = F.translate(composed(token), "".join(single), "".join(single.values()))
    known = F.from_json(F.lit(json.dumps(several)), F.lit("map<string,string>"))
    each = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    out = F.when(out.rlike("[" + "".join(several) + "]"), each).otherwise(out)
    out = F.lower(F.when(token.rlike(r"[^\x00-\x7F]"), out).otherwise(token))
    return F.when(out.rlike(r"\p{M}"), F.regexp_replace(out, r"(?<=\p{IsLatin})\p{M}+", "")).otherwise(out)


def plain_name(name: Column) -> Column:
    """A record's name without tags, with the usual entities decoded, trimmed."""
    out = F.regexp_replace(name, "<[^>]*>", "")
    # Entities of markup; the ampersand's comes last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def cast_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def cast_string(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def cast_float(value: Column) -> Column:
    """Null for what is no number."""
    return value.try_cast("double")


def in_country(place: Column, country: Column) -> Column:
    """The place is the country, or its last comma-separated part is."""
    p = F.trim(place)
    return (p == country) | p.endswith(F.concat(F.lit(", "), country))
