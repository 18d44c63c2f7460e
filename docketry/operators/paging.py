"""Filters, orders and keyset pages of list queries."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.ordering import number_in_groups

# fixed values: page sizes
DEFAULT_PAGE, LARGEST_PAGE = 20, 100


def page_size(first: int | None) -> int:
    """Absent is the default; anything else is held between 1 and the largest."""
    return DEFAULT_PAGE if first is None else min(max(1, first), LARGEST_PAGE)


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """One condition for each value given; absent and empty values filter nothing."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == F.lit(value))
    return df


def date_range(df: DataFrame, name: str, date_from: str | None = None, date_to: str | None = None, not_after: str | None = None) -> DataFrame:
    """Inclusive bounds; ``not_after`` is a further upper one."""
    if date_from:
        df = df.where(F.col(name) >= F.lit(date_from).cast("date"))
    for bound in (date_to, not_after):
        if bound:
            df = df.where(F.col(name) <= F.lit(bound).cast("date"))
    return df


def unexpired(df: DataFrame, name: str = "expires_at", now: Column | None = None) -> DataFrame:
    """Rows that expire later than now; those that say nothing are gone."""
    return df.where(F.col(name) > (F.current_timestamp() if now is None else now))


def keyset(columns: list[str], values: list, descending: bool) -> Column:
    """Rows after ``values`` in the order of ``columns``, as bounds that reach the file scan."""
    after = (lambda c, v: c < v) if descending else (lambda c, v: c > v)
    reach = (lambda c, v: c <= v) if descending else (lambda c, v: c >= v)
    out = after(F.col(columns[-1]), F.lit(values[-1]))
    for c, v in list(zip(columns, values))[-2::-1]:
        out = reach(F.col(c), F.lit(v)) & (after(F.col(c), F.lit(v)) | out)
    return out


def encode_cursor(values: list) -> str:
    """Values of the sort columns as base64 of JSON."""
    return base64.b64encode(json.dumps(values, default=str, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> list:
    values = json.loads(base64.b64decode(cursor, validate=True))
    if not isinstance(values, list):
        raise ValueError("a cursor holds a list")
    return values


def cursor_column(*columns: str) -> Column:
    """The cursor of each row."""
    return F.base64(F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(F.struct(F.col(c).cast("string").alias("v"))) for c in columns]), F.lit("]")).cast("binary"))


@dataclass
class Page:
    """``rows`` is lazy and holds one row more than the page; :meth:`fetch` drops it and tells of it."""

    rows: DataFrame
    size: int
    keys: list[str]

    def fetch(self) -> dict:
        """The page's rows (``size`` at most), cursors and whether more follow."""
        got = self.rows.collect()
        rows = got[: self.size]
        cursors = [encode_cursor([r[k] for k in self.keys]) for r in rows]
        return {"rows": rows, "cursors": cursors, "has_next": len(got) > self.size, "end": cursors[-1] if cursors else None}


def page(df: DataFrame, keys: list[str], descending: bool, first: int | None = None, after: str | None = None) -> Page:
    """The rows after a cursor in order of ``keys``, and one more."""
    if after:
        values = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, decode_cursor(after))]
        df = df.where(keyset(keys, values, descending))
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    size = page_size(first)
    return Page(df.orderBy(*order).limit(size + 1), size, keys)


def all_pages(df: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Each row's page number within its group, for all pages at once; a large group is many tasks."""
    numbered = number_in_groups(df, group, order, "page_no")
    return numbered.withColumn("page_no", F.ceil(F.col("page_no") / F.lit(size)).cast("int"))
