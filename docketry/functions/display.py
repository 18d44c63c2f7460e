"""What a reader sees: labels, dates, headings, and the state of a search page in its address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that labels write in capitals, words that stay small within a label, special labels
CAPITALS = ("msj", "mtd", "mil")
SMALL_WORDS = ("to", "for", "of", "in", "on", "the", "a", "an")
SPECIAL = {"anti_slapp": "Anti-SLAPP"}
STATE_KEYS = ("q", "county", "judge", "dateFrom", "dateTo", "motion", "outcome")


def format_date(day: Column) -> Column:
    """C08."""
    return F.date_format(day, "MMM d, yyyy")


def _words(value: Column, small: bool) -> Column:
    def word(x: Column, i: Column) -> Column:
        label = F.when(x.isin(*CAPITALS), F.upper(x))
        if small:
            label = label.when((i > 0) & x.isin(*SMALL_WORDS), x)
        return label.otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))

    return F.array_join(F.transform(F.split(value, "_", -1), word), " ")


def format_outcome(value: Column) -> Column:
    """C09."""
    return F.coalesce(F.initcap(F.replace(value, F.lit("_"), F.lit(" "))), F.lit("Not classified"))


def format_motion_type(value: Column) -> Column:
    """C10."""
    special = F.when(value.isNull(), F.lit("Not classified"))
    for k, label in SPECIAL.items():
        special = special.when(value == k, label)
    return special.otherwise(_words(value, small=True))


def format_label(value: Column) -> Column:
    """C11."""
    return F.coalesce(_words(value, small=False), F.lit("—"))


def case_heading(title: Column, number: Column, case_id: Column) -> Column:
    """Title, else number, else the id."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(title), blank(number), F.concat(F.lit("Case "), case_id.cast("string")))


def judge_label(name: Column) -> Column:
    """C12."""
    return F.concat(F.lit("Judge "), name)


def search_address(**state: Column) -> Column:
    """The query part of a search page's address; absent and blank values are left out."""
    parts = [F.when(F.coalesce(state[k], F.lit("")) != "", F.concat(F.lit(k + "="), F.url_encode(state[k]))) for k in STATE_KEYS if k in state]
    return F.concat_ws("&", *parts)


def search_state(address: Column) -> dict[str, Column]:
    """Values by key; ``motion`` and ``outcome`` are lists without blanks."""
    url = F.concat(F.lit("http://x/?"), address)
    one = lambda k: F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit(""))
    out = {k: F.url_decode(one(k)) for k in STATE_KEYS}
    for k in ("motion", "outcome"):
        out[k] = F.filter(F.split(out[k], ",", -1), lambda x: x != "")
    return out
