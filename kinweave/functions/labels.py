"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.calendar import MONTHS, ZODIAC_ENDS

DASH = "–"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def century_label(century: Column) -> Column:
    return F.concat(_ordinal(F.abs(century)), F.lit(" cent."), F.when(century < 0, " BCE").otherwise(""))


def decade_label(decade: Column) -> Column:
    return F.concat(F.abs(decade).cast("string"), F.lit("s"), F.when(decade < 0, " BCE").otherwise(""))


def _ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def century_long(century: Column) -> Column:
    return F.concat(_ordinal(F.abs(century)), F.lit(" Century"), F.when(century < 0, " BCE").otherwise(""))


def period_label(start: Column, decades: int = 1) -> Column:
    """First and last year of as many decades, counted from a decade's start; before year 1 the years count down."""
    before = F.concat(F.lit("Period: "), (9 - start).cast("string"), F.lit(DASH), (-start - (decades - 1) * 10).cast("string"), F.lit(" BCE"))
    after = F.concat(F.lit("Period: "), start.cast("string"), F.lit(DASH), (start + decades * 10 - 1).cast("string"))
    return F.when(start < 0, before).otherwise(after)


def month_number(code: Column) -> Column:
    """1 to 12 of a month's three-letter code in any case; null for others."""
    n = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.upper(F.trim(code)))
    return F.when(n > 0, n.cast("int"))


def month_name(number: Column) -> Column:
    """The three-letter abbreviation of a month's number; null for others."""
    return F.try_element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), F.when(number.between(1, 12), number.cast("int")))


def zodiac_periods() -> dict[str, str]:
    """Sign to its first and last day, from Aries on."""
    months = [m.capitalize() for m in MONTHS]
    ends = [e for e, _ in ZODIAC_ENDS]
    out = {}
    for k, (end, sign) in enumerate(ZODIAC_ENDS[:-1]):
        first = ends[k - 1] + 1 if k else ends[-2] + 1
        out[sign] = f"{first % 100} {months[first // 100 - 1]} {DASH} {end % 100} {months[end // 100 - 1]}"
    signs = list(out)
    at = signs.index("Aries")
    return {s: out[s] for s in signs[at:] + signs[:at]}


# Media types and what they are called.
MEDIA = {"audio": "Audio", "book": "Book", "card": "Card", "certificate": "Certificate", "coat": "Coat of arms", "document": "Document", "electronic": "Electronic", "fiche": "Microfiche", "film": "Microfilm", "magazine": "Magazine", "manuscript": "Manuscript", "map": "Map", "newspaper": "Newspaper", "photo": "Photo", "tombstone": "Tombstone", "video": "Video", "painting": "Painting", "other": "Other"}


def media_label(kind: Column) -> Column:
    """Unknown and blank types are Other."""
    out = F.lit("Other")
    for token, label in MEDIA.items():
        out = F.when(F.lower(F.trim(kind)) == token, label).otherwise(out)
    return out


def spelled(n: Column) -> Column:
    out = F.when(n == 1, NUMBERS[0])
    for k, word in enumerate(NUMBERS[1:], 2):
        out = out.when(n == k, word)
    return out.otherwise(n.cast("string"))
