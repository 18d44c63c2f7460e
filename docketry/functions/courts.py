"""Fields of each source's documents (R01 to R11): patterns and court houses, as builders of columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.keys import parse_long_date, parse_short_date
from docketry.functions.text import found, squeeze, strip, title_case

# fixed values: patterns of the sources
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
LONG_DATE = rf"((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
LA_OPTION = r"^([^,]+),([^,]+),(\d{2}/\d{2}/\d{4})$"
LA_OPTION_TEXT = r"\(([^:]+):\s+Dept\.\s+([^)]+)\)\s+(.+)"
LA_CASE_NUMBER = r"(?U)Case Number:\s*(\w+)"
LA_ERROR = "We're sorry"
ORANGE_LINK = r"(?iU)^([A-Z][A-Z\s']+),\s*([^-]+?)\s*-\s*Dept\.?\s*(\S+)"
RIVERSIDE_LINK = r"(?iU)Department\s+(\S+)\s*-\s*Honorable\s+(.+)"
RIVERSIDE_DATE = rf"(?iU)(?:Tentative Rulings\s+(?:for\s+)?|No Tentative Rulings\s+){LONG_DATE}"
SB_LINK = r"(?i)CV([A-Z]\d+)\d{6}\.pdf"
SB_FILE_DATE = r"(?i)CV[A-Z]\d+(\d{6})\.pdf$"
SB_JUDGE = r"(?iU)Department\s+\S+?\s*[-–—]\s*Judge\s+([^\n]+)"
SB_HONORABLE = r"(?iU)BEFORE THE HONORABLE\s+([^\n]+)"
SF_LINK = r"(?U)^(\d{3})\s+Tentative\s+Rulings"
SF_FILE_DATE = r"(\d{1,2}\.\d{2}\.\d{4})\.pdf$"
SF_JUDGE = r"(?iU)Presiding:\s+([A-Z][^\n]+)"
SC_JUDGE = r"(?iU)Honorable\s+([A-Z][^\n,]+?),?\s+Presiding"
SC_DEPARTMENT = r"(?mU)^Department\s+(\d+)$"
SC_CASE_LINE = r"(?U)(?:LINE\s+)?(?:\d+[,;]?\s+)?\d{2}CV\d{6}\s+([^\n]+?)(?:\s{2,})[^\n]+"
SC_VERSUS = r"(?mU)(?:^|\n)\s*([A-Z][^\n]{3,}?\s+v[s]?\.?\s+[A-Z][^\n]{3,})"
SC_OUTCOME = r"(?iU)\b(GRANTED|DENIED|SUSTAINED|OVERRULED|MOOT|OFF\s+CALENDAR)\b"
SC_MOTION = (
    r"(?iU)\b(Demurrer|Motion\s+to\s+(?:Compel|Dismiss|Strike|Quash|Stay|Vacate|Set\s+Aside)|Summary\s+Judgment|Summary\s+Adjudication"
    r"|(?:Petition|Motion)\s+(?:to\s+Compel\s+)?(?:Arbitration|Writ\s+of\s+Attachment)|Writ\s+of\s+Attachment|(?:Temporary\s+)?Restraining\s+Order"
    r"|Preliminary\s+Injunction|Compromise\s+of\s+Minor(?:'s)?\s+Claim|(?:Hearing(?:\s+on)?:?\s+)?Compromise\s+of\s+Minor(?:'s)?\s+Claim)\b"
)
FAMILY_TITLE = r"(?mU)^\d+\s+([A-Z][A-Z'\s-]+(?:V\.|v\.)\s+[A-Z][A-Z'\s-]+?)(?:\s+(?:[A-Z][a-z]|No\s|TENTATIVE)|\s*$)"
FAMILY_OUTCOME = r"(?iU)\b(GRANTED|DENIED|CONTINUED|MOOT|OFF\s+CALENDAR)\b"
FAMILY_MOTION = r"(?U)\b((?:MOTION|Motion)\s+(?:for|to|re)\s+[^\n.;]+)"
PROBATE_JUDGE = r"(?iU)HON\.\s+(?:Judge|Commissioner)\s+([^\n]+)"
PROBATE_DATE = r"(?U)Date:\s*(\d{2}/\d{2}/\d{2,4})"
PROBATE_TITLE = r"(?mU)^\d+\s+([A-Za-z][^\n]+?)(?:\s+(?:TENTATIVE|Tentative)|\s*$)"
PROBATE_MOTION = r"(?iU)\b(MOTION[S]?\s+(?:FOR|TO)\s+[^\n(]+)"
PROBATE_DEPARTMENT = r"(?iU)DEPARTMENT\s+(CM\d+)"
CASE_NUMBERS = {
    "la": LA_CASE_NUMBER,
    "oc_civil": r"(\b\d{2,4}-\d{8}\b)",
    "oc_family": r"(\b\d{2}D\d{6}\b)",
    "oc_probate": r"(\b0\d{7}\b)",
    "riverside": r"(\bCV[A-Z]{2,4}\d{6,8}\b)",
    "san_bernardino": r"(\bCIV[A-Z]{2}\d{5,8}\b)",
    "san_francisco": r"(\bF[A-Z]{2}-\d{2}-\d{6}\b)",
    "santa_clara": r"(\b\d{2}CV\d{6}\b)",
}
# fixed values: department prefixes and court houses, in order; "" stands for any other
COURTHOUSES = {
    "oc_civil": [("CX", "Complex Civil Department"), ("CM", "Costa Mesa Justice Center"), ("N", "North Justice Center"), ("W", "West Justice Center"), ("", "Central Justice Center")],
    "oc_family": [("L", "Lamoreaux Justice Center"), ("N", "North Justice Center"), ("W", "West Justice Center"), ("", "Central Justice Center")],
    "riverside": [("PS", "Palm Springs Courthouse"), ("MV", "Moreno Valley Courthouse"), ("M", "Murrieta Courthouse"), ("C", "Corona Courthouse")],
    "san_bernardino": [("S", "San Bernardino Justice Center"), ("R", "Rancho Cucamonga Justice Center")],
    "san_francisco": [("", "San Francisco Courthouse")],
}
RIVERSIDE_NUMBERED = "Hall of Justice"


def courthouse(source: str, department: Column) -> Column:
    """The court house of a department; null if the source doesn't tell."""
    code, out = F.upper(strip(department)), None
    for prefix, name in COURTHOUSES[source]:
        hit = F.startswith(code, F.lit(prefix))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(code.rlike("^[0-9]+$"), RIVERSIDE_NUMBERED) if source == "riverside" else out


def case_numbers(text: Column, source: str) -> Column:
    """All case numbers, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CASE_NUMBERS[source])))


def capitals_to_title(name: Column) -> Column:
    """Title case for names written in capitals only."""
    return F.when((name == F.upper(name)) & (name != F.lower(name)), title_case(name)).otherwise(name)


def last_first_link(link: Column) -> dict[str, Column]:
    """``LAST, First - Dept X``."""
    last, first = title_case(strip(found(link, ORANGE_LINK, 1))), strip(found(link, ORANGE_LINK, 2))
    return {"judge_name": F.concat(first, F.lit(" "), last), "department": found(link, ORANGE_LINK, 3)}


def la_option(value: Column) -> dict[str, Column]:
    """Court house code, department and date of a drop-down value; null if it has another form."""
    bare = strip(value)
    return {
        "courthouse_code": found(bare, LA_OPTION, 1),
        "department": found(bare, LA_OPTION, 2),
        "hearing_date": F.try_to_timestamp(found(bare, LA_OPTION, 3), F.lit("MM/dd/yyyy")).cast("date"),
    }


def sc_outcome(text: Column) -> Column:
    raw = found(text, SC_OUTCOME)
    return F.when(F.lower(raw).startswith("off"), "Off calendar").otherwise(F.upper(raw))


def sc_motion(text: Column) -> Column:
    raw = squeeze(found(text, SC_MOTION))
    return F.concat(F.upper(F.substring(raw, 1, 1)), F.substr(raw, F.lit(2)))


def sc_title(text: Column) -> Column:
    line = squeeze(found(text, SC_CASE_LINE))
    return F.coalesce(F.when(F.char_length(line) > 3, line), F.substring(squeeze(found(text, SC_VERSUS)), 1, 200))


def family_motion(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\bRFO\b"), "Request for Order").otherwise(F.substring(strip(found(text, FAMILY_MOTION)), 1, 100))


def dashes(text: Column) -> Column:
    return F.translate(text, "–—", "--")


@dataclass(frozen=True)
class CourtSource:
    """How a source's documents give their fields: builders from the text, and from the link's text or file name."""

    scraper_id: str
    from_text: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    from_link: Callable[[Column], dict[str, Column]] | None = None
    houses: str | None = None


def _group(pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda text: strip(found(text, pattern, group))


def _long_date(pattern: str = LONG_DATE) -> Callable[[Column], Column]:
    return lambda text: parse_long_date(found(text, pattern))


SOURCES: dict[str, CourtSource] = {
    "la": CourtSource("ca-la-tentatives-civil", {"judge_name": lambda t: squeeze(found(t, r"(?isU)([^\n]+?)\s+Judge of the Superior Court"))}),
    "oc_civil": CourtSource("ca-oc-tentatives-civil", {"hearing_date": _long_date()}, last_first_link, "oc_civil"),
    "oc_family": CourtSource(
        "ca-oc-tentatives-family",
        {
            "hearing_date": _long_date(), "case_title": lambda t: squeeze(found(t, FAMILY_TITLE)),
            "outcome": lambda t: F.upper(found(t, FAMILY_OUTCOME)), "motion_type": family_motion,
        },
        last_first_link, "oc_family",
    ),
    "oc_probate": CourtSource(
        "ca-oc-tentatives-probate",
        {
            "judge_name": lambda t: capitals_to_title(strip(found(t, PROBATE_JUDGE))), "department": _group(PROBATE_DEPARTMENT),
            "hearing_date": lambda t: parse_short_date(found(t, PROBATE_DATE)), "case_title": lambda t: squeeze(dashes(found(t, PROBATE_TITLE))),
            "motion_type": lambda t: F.substring(squeeze(F.regexp_replace(found(t, PROBATE_MOTION), r"(?U)\s*\(ROA.*", "")), 1, 100),
            "outcome": lambda t: F.upper(found(t, FAMILY_OUTCOME)),
        },
        None, "oc_civil",
    ),
    "riverside": CourtSource(
        "ca-riverside-tentatives-civil", {"hearing_date": _long_date(RIVERSIDE_DATE)},
        lambda x: {"department": found(x, RIVERSIDE_LINK, 1), "judge_name": strip(found(x, RIVERSIDE_LINK, 2))}, "riverside",
    ),
    "san_bernardino": CourtSource(
        "ca-sb-tentatives-civil", {"judge_name": lambda t: F.coalesce(strip(found(t, SB_JUDGE)), title_case(strip(found(t, SB_HONORABLE))))},
        lambda x: {"department": found(x, SB_LINK), "hearing_date": F.try_to_timestamp(F.regexp_replace(found(x, SB_FILE_DATE), r"(\d{4})(\d\d)", "$120$2"), F.lit("MMddyyyy")).cast("date")},
        "san_bernardino",
    ),
    "san_francisco": CourtSource(
        "ca-sf-tentatives-family", {"judge_name": lambda t: capitals_to_title(F.rtrim(strip(found(t, SF_JUDGE)), F.lit(")")))},
        lambda x: {"department": found(x, SF_LINK), "hearing_date": F.try_to_timestamp(found(x, SF_FILE_DATE), F.lit("M.dd.yyyy")).cast("date")}, "san_francisco",
    ),
    "santa_clara": CourtSource(
        "ca-sc-tentatives-civil",
        {"judge_name": lambda t: squeeze(found(t, SC_JUDGE)), "department": _group(SC_DEPARTMENT), "hearing_date": _long_date(), "outcome": sc_outcome, "motion_type": sc_motion, "case_title": sc_title},
    ),
}
FIELDS = ("judge_name", "department", "hearing_date", "outcome", "motion_type", "case_title")


def extract_fields(source: str, text: Column, link: Column | None = None) -> dict[str, Column]:
    """All fields of a source's document.  What the link tells comes first, except where the text replaces a
    placeholder; a value that neither has is null."""
    spec = SOURCES[source]
    linked = spec.from_link(link) if spec.from_link is not None and link is not None else {}
    kinds = {"hearing_date": "date"}
    out = {}
    for name in FIELDS:
        parts = [linked[name]] if name in linked else []
        parts += [spec.from_text[name](text)] if name in spec.from_text else []
        out[name] = F.coalesce(*parts, F.lit(None).cast(kinds.get(name, "string")))
    numbers = case_numbers(text, source)
    out |= {"case_number": F.try_element_at(numbers, F.lit(1)), "all_case_numbers": numbers}
    out["courthouse"] = courthouse(spec.houses, out["department"]) if spec.houses else F.lit(None).cast("string")
    return out
