"""Cleanup of ruling text and small string functions; all are native column expressions.

Patterns carry ``(?U)``, so that classes such as white space and word boundaries are those of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: garbled character sequences and what they stand for, longest first
GARBLED = [
    ("â\u0080\u009c", "“"),
    ("â\u0080\u009d", "”"),
    ("â\u0080\u0098", "‘"),
    ("â\u0080\u0099", "’"),
    ("â\u0080\u0093", "–"),
    ("â\u0080\u0094", "—"),
    ("â\u0080¦", "…"),
    ("â\u0080¢", "•"),
    ("Â§", "§"),
    ("Â¶", "¶"),
    ("Â ", " "),
    ("¿", "'"),
    (" ", " "),
]

# fixed values: lines that hold a page number only
PAGE_NUMBER_LINES = [
    r"(?iU)^\s*page\s+\d+\s+of\s+\d+\s*$",
    r"(?U)^\s*-{1,2}\s*\d+\s*-{1,2}\s*$",
    r"(?U)^\s*\d{1,3}\s*$",
]

# fixed values: lines of headers and instructions; the last is a beginning
BOILERPLATE_LINES = [
    r"(?iU)^\s*SUPERIOR\s+COURT\s+OF\s+(?:THE\s+STATE\s+OF\s+)?CALIFORNIA\s*$",
    r"(?iU)^\s*COUNTY\s+OF\s+\w[\w\s]*$",
    r"(?iU)^\s*(?:DEPARTMENT|DEPT\.?)\s+\S+\s*$",
    r"(?iU)^\s*(?:parties\s+who\s+intend\s+to\s+submit|if\s+you\s+intend\s+to\s+submit|unless\s+.*\s+notif(?:y|ies)"
    r"|parties\s+should\s+notify|the\s+court\s+will\s+prepare|if\s+the\s+parties\s+neither)",
]


def fix_encoding(text: Column) -> Column:
    """Replace garbled sequences; no replacement makes or breaks another."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), GARBLED, text)


def drop_lines(text: Column, patterns: list[str]) -> Column:
    """``text`` without the lines that one of the patterns finds."""
    lines = F.split(text, "\n", -1)
    for p in patterns:
        lines = F.filter(lines, _misses(p))
    return F.array_join(lines, "\n")


def _misses(pattern: str):
    return lambda line: ~F.regexp_like(line, F.lit(pattern))


def strip_page_numbers(text: Column) -> Column:
    """C02."""
    return drop_lines(text, PAGE_NUMBER_LINES)


def strip_boilerplate(text: Column) -> Column:
    """C03."""
    return drop_lines(text, BOILERPLATE_LINES)


def collapse_blank_lines(text: Column) -> Column:
    """No blanks at line ends, at most two blank lines in a row, none around the text."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n")
    return F.regexp_replace(joined, r"(?U)\A\s+|\s+\z", "")


def clean_ruling_text(text: Column) -> Column:
    """All of the above in turn; null if nothing is left."""
    return F.nullif(collapse_blank_lines(strip_boilerplate(strip_page_numbers(fix_encoding(text)))), F.lit(""))


def squeeze(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def title_case(text: Column) -> Column:
    """C20: each run of letters starts with a capital, also after an apostrophe, a hyphen or a digit."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group matched first; null if it didn't match or matched nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def display_paragraphs(text: Column) -> Column:
    """Paragraphs for display: garbled text mended, page numbers gone, lines of a paragraph joined by spaces."""
    lines = F.transform(F.split(strip_page_numbers(fix_encoding(text)), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    parts = F.split(strip(F.array_join(lines, "\n")), "\n{2,}", -1)
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")


def truncate_text(text: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis, cut at the last space if that lies beyond the half."""
    head = F.substring(text, 1, most)
    space = F.length(head) - F.locate(" ", F.reverse(head))  # characters before the last space
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space > most / 2), F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))
