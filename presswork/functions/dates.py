"""Dates in paths, titles and bodies, feed dates, and cron schedules. All times are UTC."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SEPARATORS = r"[\s\-–—:·|,]+"


def _iso(year: Column, month: Column, day: Column) -> Column:
    """y-mm-dd where the parts are in range; months aren't held to their lengths."""
    y, m, d = (F.expr("x").cast("int") if isinstance(x, str) else x.cast("int") for x in (year, month, day))
    ok = y.between(1970, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%d-%02d-%02d", y, m, d))


def _number(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def _month(name: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(place > 0, place)


def path_date(path: Column) -> Column:
    found = [F.regexp_extract(path, r"/([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})/", i) for i in (1, 2, 3)]
    return _iso(*map(_number, found))


# Forms of a date phrase: year first in numbers, day first, month first. What may stand between the day and the year of the
# last form is not the same at the two ends of a title.
_NAME = "[A-Za-z]{3,9}"
_PHRASE = rf"[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}\s+{_NAME}\s+[0-9]{{4}}|{_NAME}\s+[0-9]{{1,2}}%s[0-9]{{4}}"
_AT_START, _AT_END = _PHRASE % r",\s*", _PHRASE % r",?\s+"


def _phrase_date(phrase: Column) -> Column:
    """The date that a phrase of any form stands for; null where it has no such month or day."""
    numbers = F.split(phrase, "-")
    named = _iso(_number(F.right(phrase, F.lit(4))), _month(F.regexp_extract(phrase, _NAME, 0)), _number(F.regexp_extract(phrase, r"(?<![0-9])[0-9]{1,2}(?![0-9])", 0)))
    return F.when(F.size(numbers) == 3, _iso(*(_number(F.try_element_at(numbers, F.lit(i))) for i in (1, 2, 3)))).otherwise(named)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _for(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that it uses many times, and that is worked out once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def leading_date(text: Column) -> Column:
    """struct(iso, rest) of a date at the start of a title, even if glued to it; null without one."""

    def read(x: Column) -> Column:
        rest = _stripped(F.regexp_replace(F.substr(x.title, F.length(x.phrase) + 1), "^" + _SEPARATORS, ""))
        return F.struct(F.when(x.phrase != "", _phrase_date(x.phrase)).alias("iso"), rest.alias("rest"))

    t = _stripped(text)
    found = _for(F.struct(t.alias("title"), F.regexp_extract(t, f"^(?:{_AT_START})", 0).alias("phrase")), read)
    return _for(found, lambda d: F.when(d.iso.isNotNull(), d))


def trailing_date(text: Column) -> Column:
    """struct(iso, rest) of the last date phrase of a title; null without one.

    The phrase is cut off only where it looks appended: glued to the end, or before read-time marks. Where a lone
    number of up to three digits would be left at the end, it may belong to the date, and the title stays whole.
    """

    def read(x: Column) -> Column:
        after = F.call_function("substring_index", x.title, x.phrase, F.lit(-1))
        before = F.left(x.title, F.length(x.title) - F.length(after) - F.length(x.phrase))
        glued = (after == "") & before.rlike(r"(?U)\S$")
        title = _stripped(F.regexp_replace(before, _SEPARATORS + "$", ""))
        unclear = (title == "") | title.rlike(r"(^|[\s\-–—:·|,])[0-9]{1,3}$")
        rest = F.when((glued | after.rlike(r"(?i)^\s*(/|min read|[0-9]+\s*min)")) & ~unclear, title).otherwise(x.title)
        return F.struct(_phrase_date(x.phrase).alias("iso"), rest.alias("rest"))

    t = _stripped(text)
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(f"({_AT_END})"), F.lit(1)), F.lit(-1))
    found = _for(F.struct(t.alias("title"), last.alias("phrase")), read)
    return _for(found, lambda d: F.when(d.iso.isNotNull(), d))


def written_date(text: str) -> str | None:
    """The first written-out date in a body, month first, else day first."""
    for pattern in (rf"\b(?:{LONG_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+(?:{LONG_MONTHS})\s+\d{{4}}\b"):
        if found := re.search(pattern, text):
            return found.group()
    return None


def parse_date(text: Column) -> Column:
    """A timestamp of ISO, RFC 822 and written-out dates; null for anything else. Weekday names are ignored."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/M/d", "yyyy-M-d"]
    return F.coalesce(F.expr("try_cast(null as timestamp)"), F.when(t.rlike(r"^[0-9]{4}(-[0-9]{2}){1,2}"), F.try_to_timestamp(t)), *(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def ttl_minutes(schedule: Column) -> Column:
    n = F.regexp_extract(schedule, r"^\*/([0-9]+) \* \* \* \*$", 1)
    return F.when(n != "", F.greatest(n.cast("int"), F.lit(1))).otherwise(15)


def retry_after_ms(header: str | None, body_hint: float | None = None, default: float = 25, cap: float = 60, now: datetime | None = None) -> int:
    """Milliseconds to wait before a request is tried again: the header's seconds or date, else the body's hint, else the default."""
    seconds = None
    if header:
        if re.fullmatch(r"\s*\d+(\.\d+)?\s*", header):
            seconds = float(header)
        else:
            from email.utils import parsedate_to_datetime

            try:
                seconds = (parsedate_to_datetime(header).replace(tzinfo=None) - (now or datetime.utcnow())).total_seconds()
            except (TypeError, ValueError):
                seconds = None
    seconds = body_hint if seconds is None else seconds
    return round(1000 * min(cap, max(0, default if seconds is None else seconds)))


def cron_field(spec: str, low: int, high: int) -> Callable[[int], bool]:
    """Whether a value fits a field: `*`, `*/n` (multiples of n), `a-b`, `a-b/n`, a list of numbers, a number; anything else never fits."""
    spec = spec.strip()
    if spec == "*":
        return lambda v: True
    if m := re.fullmatch(r"\*/(\d+)", spec):
        step = max(1, int(m[1]))
        return lambda v: v % step == 0
    if m := re.fullmatch(r"(\d+)-(\d+)(?:/(\d+))?", spec):
        first, last, step = int(m[1]), int(m[2]), max(1, int(m[3] or 1))
        return lambda v: first <= v <= last and (v - first) % step == 0
    if re.fullmatch(r"\d+(,\d+)*", spec):
        values = {int(x) for x in spec.split(",")}
        if len(values) > 1 and not all(low <= v <= high for v in values):
            return lambda v: False
        return lambda v: v in values
    return lambda v: False


def is_cron(expression: str) -> bool:
    """Whether all five fields can match something in their range."""
    parts = expression.split()
    ranges = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    return len(parts) == 5 and all(any(map(cron_field(p, a, b), range(a, b + 1))) for p, (a, b) in zip(parts, ranges, strict=True))


@lru_cache(1024)
def _fitting(expression: str) -> tuple[list[int], Callable[[date], bool]]:
    """(minutes of a day, whether a day fits) of a schedule."""
    fields = (expression.split() + ["*"] * 5)[:5]
    minute, hour, dom, month, dow = (cron_field(p, *r) for p, r in zip(fields, [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)], strict=True))
    either = fields[2] != "*" and fields[4] != "*"

    @lru_cache(64)
    def fits(day: date) -> bool:
        weekday = day.isoweekday() % 7
        on_dom, on_dow = dom(day.day), dow(weekday) or (weekday == 0 and dow(7))
        return month(day.month) and ((on_dom or on_dow) if either else (on_dom and on_dow))

    return [60 * h + m for h in range(24) if hour(h) for m in range(60) if minute(m)], fits


def next_run(expression: str, after: datetime) -> datetime:
    """The first minute after `after` that fits; an hour later if none does in five years. Days go by either field if both are set."""
    minutes, fits = _fitting(expression)
    begin = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    first, day = bisect_left(minutes, 60 * begin.hour + begin.minute), begin.date()
    for _ in range(5 * 366 + 1 if minutes else 0):
        if first < len(minutes) and fits(day):
            return datetime(day.year, day.month, day.day, *divmod(minutes[first], 60))
        first, day = 0, day + timedelta(days=1)
    return after + timedelta(hours=1)


def _next_cron_run(schedule: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or pd.isna(a) else next_run(s, a.to_pydatetime()) for s, a in zip(schedule, after, strict=True)], dtype="datetime64[ns]")


def next_cron_run(schedule: Column, after: Column) -> Column:
    return F.pandas_udf(_next_cron_run, "timestamp")(schedule, after)
