"""Date functions. Unreadable dates give null; nothing raises."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def _first(c: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)).cast("date")) for shape, fmt in patterns])


#: Accepted shapes and their formats.
ISO = (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")
ISO_SLASH = (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d")
US = (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy")
LONG_MONTH = (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy")
SHORT_MONTH = (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy")
DAY_MONTH = (r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$", "d MMMM yyyy")


def timeline_date(c: Column) -> Column:
    return _first(F.trim(c), [ISO, ISO_SLASH, US, LONG_MONTH, SHORT_MONTH])


def claim_date(c: Column) -> Column:
    """A date in one of six forms, a year alone or the first year of 19xx or 20xx in the text as its 1 January."""
    t = F.trim(c)
    year = F.regexp_extract(t, r"\b(19\d{2}|20\d{2})\b", 1)
    alone = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")).try_cast("date"))
    return F.coalesce(_first(t, [ISO, US, LONG_MONTH, SHORT_MONTH, DAY_MONTH]), alone, F.when(year != "", F.concat(year, F.lit("-01-01")).try_cast("date")))


def text_date(c: Column) -> Column:
    """The first m/d/y of a text as yyyy-mm-dd without a look at the calendar, else its first year's 1 January; a string."""
    hit = F.regexp_extract(c, r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", 1)
    m, d, y = (F.split(hit, "/")[i] for i in range(3))
    full = F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < 40, "20").otherwise("19"), y)).otherwise(F.lpad(y, 4, "0"))
    year = F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1)
    return F.when(hit != "", F.concat_ws("-", full, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).when(year != "", F.concat(year, F.lit("-01-01")))


def bucket(c: Column, unit: str = "month") -> Column:
    """day, month or year; an unknown unit is a month."""
    return F.date_format(c, {"day": "yyyy-MM-dd", "year": "yyyy"}.get(unit, "yyyy-MM"))


_MENTION = ArrayType(StructType([StructField("date", StringType()), StructField("raw", StringType()), StructField("position", IntegerType()), StructField("context", StringType())]))
_FAMILIES = [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{4}/\d{2}/\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b"]
_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%B %d, %Y"]


@F.pandas_udf(_MENTION)
def date_mentions(texts: pd.Series) -> pd.Series:
    """Every date in a text with its place and 180 characters around, in order of date, then place."""
    from datetime import datetime

    compiled = [(re.compile(p), f) for p, f in zip(_FAMILIES, _FORMATS, strict=True)]

    def of(text: str | None) -> list[tuple[str, str, int, str]]:
        out = []
        for pattern, fmt in compiled:
            for m in pattern.finditer(text or ""):
                try:
                    day = datetime.strptime(m[0], fmt).date().isoformat()
                except ValueError:
                    continue
                around = re.sub(r"\s+", " ", text[max(0, m.start() - 180) : m.end() + 180]).strip()
                out.append((day, m[0], m.start(), around))
        return sorted(set(out), key=lambda x: (x[0], x[2]))

    return texts.map(of)
