"""Dates hidden in free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: month names, also accepted by their first three letters
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
EDGE = r"^[\s.,;]+|[\s.,;]+$"
# fixed values: phrases that end the date part of a text
CLOCK = (r"(?i)at\s+\d+[:.]\d+.*", r"(?i)from\s+\d+[:.]\d+.*")
DAYTIME = r"(?i)in the (midnight|morning|night).*"
DAYTIME_AUDIT = r"(?i)in the (midnight|morning|night|afternoon|evening).*"
# fixed values: the forms of dates in texts
ORDINAL = r"(?i)(\d+)(st|nd|rd|th)"
RANGE = r"(\d{1,2})\s*[-&/]\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
RANGE_START = r"^(\d+)\s*[-&/]\s*\d+\s+([A-Za-z]+)\s+(\d{4})"
RANGE_AUDIT = (
    r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:-|to|&|and)\s*(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{4})"
)
DAY = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
DAY_AUDIT = r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{4})"
ISO = r"(\d{4})-(\d{2})-(\d{2})"


def _month_map() -> Column:
    """Full and three-letter month names to their numbers."""
    pairs = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])}
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in (kv[0], str(kv[1]))])


def _by_pattern(text: Column, pattern: str, day: int, month: int, year: int) -> Column:
    """Real calendar date or NULL; ``31 February`` is NULL.

    Texts without a match are filtered before parsing, since a failed parse
    costs far more than the match.
    """
    def part(g: int) -> Column:
        return F.regexp_extract(text, pattern, g)

    number = F.try_element_at(_month_map(), F.lower(part(month)))
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", part(year), number, part(day)), "yyyy-M-d"))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(ISO), F.try_to_date(F.regexp_extract(text, ISO, 0), "yyyy-MM-dd"))


def _last_date(parts: Column, clean, parse) -> Column:
    """First non-NULL date of the cleaned parts, read from the right."""
    cleaned = F.transform(F.reverse(parts), clean)
    found = F.filter(F.transform(cleaned, parse), lambda d: d.isNotNull())
    return F.get(found, F.lit(0))


def _known(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~F.upper(trimmed).isin("", "NA", "NAN"), trimmed)


def _strip(text: Column, patterns) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def event_date(text: Column, range_end: bool = True) -> Column:
    """Date of an event text; the last comma part that parses wins.

    Clock phrases are cut to the end of the whole text before it is split. A
    day range stands for its last day, or its first with ``range_end=False``.
    """
    plain = F.regexp_replace(_known(text), ORDINAL, "$1")
    plain = F.regexp_replace(_strip(plain, (*CLOCK, DAYTIME)), EDGE, "")

    if range_end:
        return _last_date(
            F.split(plain, ","), lambda p: F.trim(p),
            lambda p: F.coalesce(_by_pattern(p, RANGE, 2, 3, 4), _by_pattern(p, DAY, 1, 2, 3), _iso(p)))
    return _last_date(
        F.split(plain, ","),
        lambda p: F.regexp_replace(F.regexp_replace(p, EDGE, ""), RANGE_START, "$1 $2 $3"),
        lambda p: F.coalesce(_by_pattern(p, DAY, 1, 2, 3), _iso(p)))


def audit_date(text: Column) -> Column:
    """Date by the audit rules: split first, clean each part, wider ranges."""
    return _last_date(
        F.split(_known(text), ","),
        lambda p: F.regexp_replace(_strip(p, (*CLOCK, DAYTIME_AUDIT)), EDGE, ""),
        lambda p: F.coalesce(_by_pattern(p, RANGE_AUDIT, 2, 3, 4), _by_pattern(p, DAY_AUDIT, 1, 2, 3), _iso(p)))


def date_status(text: Column, date: Column, cutoff_year: int) -> Column:
    """usable / suspicious / ambiguous / undated."""
    low = F.lower(text)
    vague = low.contains("week") | low.contains("mid")
    return (
        F.when(F.year(date) > cutoff_year, F.lit("suspicious"))
        .when(date.isNotNull(), F.lit("usable"))
        .when(F.coalesce(_known(text).isNotNull() & vague, F.lit(False)), F.lit("ambiguous"))
        .otherwise(F.lit("undated"))
    )
