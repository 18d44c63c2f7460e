"""Classifiers, names, titles, cleanup, sources and display by example."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import classify, courts, display, keys, stem, text, titles

OUTCOMES = {
    "The motion for summary judgment is GRANTED.": "granted", "GRANTED in part and DENIED in part": "granted_in_part", "denied\nin part": "denied_in_part",
    "Motion is moot; hearing continued": "moot", "off-calendar": "off_calendar", "OFF CALENDAR": "off_calendar", "offcalendar": "off_calendar",
    "matter submitted": "submitted", "SUSTAINED": None, "ungranted": None, "": None,
}
MOTIONS = {
    "Motion for Summary Adjudication": "msj_partial", "partial summary judgment": "msj_partial", "summary judgment": "msj", "motion to dismiss": "mtd",
    "Motion in Limine": "mil", "Demurrer to complaint": "demurrer", "anti-SLAPP": "anti_slapp", "antislapp": "anti_slapp",
    "petition for writ of mandamus": "petition_writ_of_mandate", "petition": "petition", "motion for attorney's fees": "motion_for_attorney_fees",
    "motion to set aside default": "motion_to_set_aside_default", "demurrers": None,
}
JUDGES = {
    "William A. Crowfoot Judge of the Superior Court": "William A. Crowfoot", "JARED D. MOSES\tJUDGE OF THE SUPERIOR COURT": "JARED D. MOSES",
    "Department S22 – Judge Bobby P. Luna": "Bobby P. Luna", "BEFORE THE HONORABLE  JOSEPH  WIDMAN\nx": "JOSEPH WIDMAN", "Presiding: BOBBY P. LUNA": "BOBBY P. LUNA",
    "presiding: someone": None, "Department 1 - Honorable John A. Smith": "John A. Smith", "JUDICIAL OFFICER : Ann Lee": "Ann Lee",
    "the Hon. Mary Smith-Jones ruled": "Mary Smith-Jones", "Judge: Ann B. Lee": "Ann B. Lee", "the judge ruled": None,
}
NAMES = {"Smith, John A.": "John A. Smith", "CROWFOOT, WILLIAM A.": "William A. Crowfoot", "  john   smith ": "John Smith", "o'neil, mary": "Mary O'Neil", "cher": "Cher"}
CLEAN = {
    "Page 2 of 5\nText": "Text", "a\n- 3 -\nb\n12\n1234": "a\nb\n1234", "SUPERIOR COURT OF THE STATE OF CALIFORNIA\nCounty of Los Angeles\nDept. 4\nIT IS SO": "IT IS SO",
    "If you intend to submit on this\nx": "x", "a  \n\n\n\n\n\nb \n": "a\n\n\nb", "Â§ 5 it¿s": "§ 5 it's", "\n \n": None, "": None,
}
CAPTION = "SUPERIOR COURT OF CALIFORNIA\nCOUNTY OF LOS ANGELES\n\nJANE DOE,\nan individual,\n   Plaintiff,\n   vs.\n\nCITY OF PASADENA, a public entity,\n   Defendant.\n"
TITLES = {
    CAPTION: "Jane Doe v. City Of Pasadena", "ACME CORP., Plaintiff(s), v. BOB ROE, Defendant(s).": "Acme Corp v. Bob Roe",
    "CASE NAME: Porsche Leasing Ltd. et al. v. Tsisana Mikia, et al.": "Porsche Leasing Ltd. et al. v. Tsisana Mikia, et al", "CASE TITLE: Motion only": None,
    "MOVING PARTY: Defendant Acme Corp\nRESPONDING PARTY: Plaintiffs John Doe and Jane Doe": "Acme Corp v. John Doe And Jane Doe",
    "MOVING PARTY: Acme\nRESPONDING PARTY: No opposition filed": None, "Plaintiff's motion v. the world": None,
}


def column(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", build(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize(
    ("build", "cases"),
    [(classify.outcome, OUTCOMES), (classify.motion_type, MOTIONS), (classify.judge_name, JUDGES), (keys.normalize_judge, NAMES), (text.clean_ruling_text, CLEAN), (titles.case_title, TITLES)],
)
def test_examples(spark, build, cases):
    assert column(spark, [*cases, None], build) == [*cases.values(), None]


def test_display(spark):
    assert column(spark, ["motion_to_strike", "anti_slapp", "msj", None], display.format_motion_type) == ["Motion to Strike", "Anti-SLAPP", "MSJ", "Not classified"]
    assert column(spark, ["granted_in_part", None], display.format_outcome) == ["Granted In Part", "Not classified"]
    assert column(spark, ["osc", None], display.format_label) == ["Osc", "—"]
    assert column(spark, ["one two three", "abcdefghij", "short"], lambda c: text.truncate_text(c, 9)) == ["one two…", "abcdefghi…", "short"]
    assert column(spark, ["a\nb\n\n\n 3 \nc  \n\n"], text.display_paragraphs) == [["a b", "c"]]


def test_sources(spark):
    got = lambda source, body, link=None: spark.range(1).select(
        *[c.alias(n) for n, c in courts.extract_fields(source, F.lit(body), F.lit(link) if link else None).items()]
    ).first()
    r = got("oc_civil", "February 24, 2026 30-12345678 and 30-12345678", "SMITH, Jane A. - Dept. CX101")
    assert (r.judge_name, r.department, r.courthouse, r.hearing_date, r.case_number, len(r.all_case_numbers)) == ("Jane A. Smith", "CX101", "Complex Civil Department", datetime.date(2026, 2, 24), "30-12345678", 1)
    r = got("oc_family", "1 BAEZ V. BAEZ\n25D006297 RFO\nOFF CALENDAR March 4 2026")
    assert (r.case_title, r.case_number, r.outcome, r.motion_type, r.hearing_date) == ("BAEZ V. BAEZ", "25D006297", "OFF CALENDAR", "Request for Order", datetime.date(2026, 3, 4))
    r = got("oc_probate", "HON. Judge ERIN ROWE\nDEPARTMENT CM3\nDate: 03/04/26\n1 Fard – Trust TENTATIVE\n01157766\nMOTION FOR FEES (ROA 12) DENIED")
    assert (r.judge_name, r.department, r.hearing_date, r.case_title, r.motion_type, r.outcome) == ("Erin Rowe", "CM3", datetime.date(2026, 3, 4), "Fard - Trust", "MOTION FOR FEES", "DENIED")
    r = got("riverside", "Tentative Rulings for March 2, 2026 CVPS2306157", "Department PS1 - Honorable A. Lee")
    assert (r.courthouse, r.judge_name, r.hearing_date, r.case_number) == ("Palm Springs Courthouse", "A. Lee", datetime.date(2026, 3, 2), "CVPS2306157")
    r = got("san_bernardino", "BEFORE THE HONORABLE JOSEPH WIDMAN\nCIVSB2416631", "x/CVS24030426.pdf")
    assert (r.department, r.judge_name, r.hearing_date, r.courthouse) == ("S24", "Joseph Widman", datetime.date(2026, 3, 4), "San Bernardino Justice Center")
    r = got("san_francisco", "Presiding: BOBBY P. LUNA)\nFDI-22-123456", "403 Tentative Rulings 3.03.2026.pdf")
    assert (r.department, r.judge_name, r.hearing_date, r.case_number) == ("403", "Bobby P. Luna", datetime.date(2026, 3, 3), "FDI-22-123456")
    r = got("santa_clara", "Department 16\nHonorable Eunice Lee, Presiding\nDATE: March 3, 2026\nLINE 1 24CV443183 Roe vs Doe   demurrer\noff calendar")
    assert (r.department, r.judge_name, r.case_title, r.motion_type, r.outcome) == ("16", "Eunice Lee", "Roe vs Doe", "Demurrer", "Off calendar")


def test_dates(spark):
    assert column(spark, ["2026-03-05", "2026-03-05T10:00:00", "nope", ""], keys.parse_date) == [datetime.date(2026, 3, 5)] * 2 + [None] * 2
    assert column(spark, ["03/04/26", "03/04/2026", "03/04/85", "13/40/26"], keys.parse_short_date) == [datetime.date(2026, 3, 4)] * 2 + [datetime.date(1985, 3, 4), None]


def test_stems():
    pairs = {"caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "agreed": "agre", "hopping": "hop", "hoping": "hope", "consigned": "consign", "knightly": "knight", "generously": "generous", "relational": "relat", "skies": "sky", "happy": "happi", "rulings": "rule", "motions": "motion", "judgments": "judgment"}
    assert {w: stem.stem(w) for w in pairs} == pairs


def test_title_case_is_that_of_python(spark):
    words = ["o'neil smith-jones", "MC DONALD 3rd", "éCOLE d'été", "a.b. c", ""]
    assert column(spark, words, text.title_case) == [w.title() for w in words]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB 1\n\t-PageofDEPT. ", max_size=40), min_size=1, max_size=20))
def test_cleanup_twice_is_cleanup_once(spark, values):
    once = column(spark, values, lambda c: text.collapse_blank_lines(text.strip_page_numbers(c)))
    assert column(spark, once, lambda c: text.collapse_blank_lines(text.strip_page_numbers(c))) == once
