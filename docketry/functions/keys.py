"""Derived keys, hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import squeeze, strip, title_case

# fixed values: file extensions of the archive, and how a document format is stored
EXTENSIONS = {"html": "html", "pdf": "pdf", "docx": "docx", "text": "txt"}
STORED_FORMATS = {"html": "html", "pdf": "pdf", "docx": "docx", "text": "txt"}


def _lookup(value: Column, table: dict[str, str], other: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, value), F.lit(other))


def court_code(state: Column, county: Column) -> Column:
    return F.replace(F.lower(F.concat_ws("-", state, county)), F.lit(" "), F.lit("-"))


def court_name(court: Column, county: Column) -> Column:
    return F.concat(court, F.lit(", County of "), county)


def case_key(case_number: Column) -> Column:
    """Case number without spaces and hyphens, in lower case."""
    return F.regexp_replace(F.lower(strip(case_number)), "[ -]", "")


def case_number_or_unknown(case_number: Column, document_id: Column) -> Column:
    return F.coalesce(F.nullif(case_number, F.lit("")), F.concat(F.lit("UNKNOWN-"), document_id))


def stored_format(content_format: Column) -> Column:
    return _lookup(content_format, STORED_FORMATS, "html")


def normalize_judge(raw: Column) -> Column:
    """``LAST, FIRST`` becomes ``First Last``."""
    name = squeeze(raw)
    last, first = F.trim(F.substring_index(name, ",", 1)), F.trim(F.substr(name, F.locate(",", name) + 1))
    return title_case(F.when(F.contains(name, F.lit(",")), F.concat_ws(" ", first, last)).otherwise(name))


def content_hash(content: Column) -> Column:
    """C14."""
    return F.sha2(content.cast("binary"), 256)


def content_changed(content: Column, old_hash: Column) -> Column:
    """C15."""
    return content_hash(content) != old_hash


def archive_key(state: Column, county: Column, court: Column, captured: Column, document_id: Column, content_format: Column) -> Column:
    """Where the archive keeps a document."""
    folder = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    day = F.date_format(captured, "yyyy/MM/dd")
    name = F.concat(document_id, F.lit("."), _lookup(content_format, EXTENSIONS, "bin"))
    return F.concat_ws("/", folder(state), folder(county), folder(court), F.lit("raw"), day, name)


def parse_timestamp(value: Column) -> Column:
    """C17: ISO date and time; null if it is none."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def parse_date(value: Column) -> Column:
    """C17: the date of an ISO date or date and time; null if it is none."""
    return parse_timestamp(value).cast("date")


def parse_long_date(value: Column) -> Column:
    """``March 3, 2026``, with or without the comma."""
    raw = squeeze(value)
    return F.coalesce(F.try_to_timestamp(raw, F.lit("MMMM d, yyyy")), F.try_to_timestamp(raw, F.lit("MMMM d yyyy"))).cast("date")


def parse_short_date(value: Column) -> Column:
    """``03/04/26`` or ``03/04/2026``; two digits from 69 on are of the last century."""
    two = F.regexp_extract(value, r"^(\d{2}/\d{2}/)(\d{2})$", 2)
    century = F.when(two == "", None).when(two >= "69", F.lit("19")).otherwise(F.lit("20"))
    full = F.when(century.isNotNull(), F.concat(F.substring(value, 1, 6), century, two)).otherwise(value)
    return F.try_to_timestamp(full, F.lit("MM/dd/yyyy")).cast("date")


def retry_delay(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before a try, doubling each time up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
