"""Relative time expressions resolved to inclusive windows against an anchor date, as Column expressions.

Weeks run from Monday to Sunday. The first rule that fits wins, in the order of ``resolve``. Nulls give nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple": 2, "few": 3}
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
TOLERANCE = {"day": 0, "week": 3, "month": 10, "year": 10}
# In this order: "christmas" is found in "christmas eve" first.
HOLIDAYS = {
    "valentine's day": (2, 14), "valentines day": (2, 14), "christmas": (12, 25), "christmas day": (12, 25), "christmas eve": (12, 24),
    "new year's day": (1, 1), "new years day": (1, 1), "new year's eve": (12, 31), "halloween": (10, 31), "independence day": (7, 4),
    "fourth of july": (7, 4), "july 4th": (7, 4), "st patrick's day": (3, 17), "st patricks day": (3, 17), "boxing day": (12, 26), "juneteenth": (6, 19),
}

#: ASCII word boundaries, whatever the engine takes for letters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries between ASCII letters, digits and underscores and anything else, whatever the version of Java takes them to be."""
    return pattern.replace(r"\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")




def _window(label: Column | str, start: Column, end: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(label.alias("label"), start.cast("date").alias("start"), end.cast("date").alias("end"))


def weekday(date: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(date) + 1


def iso_week(date: Column) -> Column:
    """Label of the ISO week, such as 2024-W05."""
    thursday = F.date_add(date, 4 - weekday(date))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def last_weekend(anchor: Column) -> Column:
    """Saturday and Sunday before this week's Monday; from a weekend day, those of a week earlier. Both are the Saturday 2 days before Monday."""
    saturday = F.date_sub(F.date_sub(anchor, weekday(anchor) - 1), 2)
    return _window("last weekend", saturday, F.date_add(saturday, 1))


def last_weekday(anchor: Column, number: int) -> Column:
    """The day of that name before the anchor, never the anchor itself."""
    back = F.pmod(weekday(anchor) - number - 1, F.lit(7)) + 1
    day = F.date_sub(anchor, back)
    return _window(f"last {WEEKDAYS[number - 1]}", day, day)


def ago(text: Column, anchor: Column) -> Column:
    pattern = rf"{LEFT}(\d{{1,6}}|{'|'.join(NUMBERS)})\s+(day|week|month|year)s?\s+ago{RIGHT}"
    count, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(count, r"^\d+$", 0), F.lit("")), F.lit("999999")).cast("int"), pairs(NUMBERS)[count])
    center = F.date_sub(anchor, (n * pairs(DAYS)[unit]).cast("int"))
    tolerance = pairs(TOLERANCE)[unit]
    label = F.concat(count, F.lit(" "), unit, F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(count != "", _window(label, F.date_sub(center, tolerance), F.date_add(center, tolerance)))


def last_month(anchor: Column) -> Column:
    start = F.add_months(F.trunc(anchor, "month"), -1)
    return _window("last month", start, F.last_day(start))


def last_week(anchor: Column) -> Column:
    start = F.date_sub(F.date_sub(anchor, weekday(anchor) - 1), 7)
    return _window("last week", start, F.date_add(start, 6))


def last_year(anchor: Column) -> Column:
    y = F.year(anchor) - 1
    return _window("last year", F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))


def in_month(anchor: Column, month: int) -> Column:
    """Of the anchor's year, or of the year before if the month is still ahead."""
    start = F.make_date(F.year(anchor) - F.when(F.month(anchor) < month, 1).otherwise(0), F.lit(month), F.lit(1))
    return _window(MONTHS[month - 1], start, F.last_day(start))


def holiday(anchor: Column, name: str) -> Column:
    """Of the anchor's year, or of the year before if it is still ahead."""
    m, d = HOLIDAYS[name]
    day = F.make_date(F.year(anchor), F.lit(m), F.lit(d))
    day = F.when(day > anchor, F.make_date(F.year(anchor) - 1, F.lit(m), F.lit(d))).otherwise(day)
    return _window(name, day, day)


def resolve(text: Column, anchor: Column) -> Column:
    """Struct of label, start and end of the first relative expression in ``text``, or null."""
    t, a = F.lower(text), anchor.cast("date")
    word = lambda p: t.rlike(rf"{LEFT}(?:{p}){RIGHT}")
    past = t.rlike(rf"{LEFT}last |this past ")
    rules: list[tuple[Column, Column]] = [
        (word("yesterday"), _window("yesterday", F.date_sub(a, 1), F.date_sub(a, 1))),
        (word("today"), _window("today", a, a)),
        (word("last weekend|this past weekend|over the weekend"), last_weekend(a)),
    ]
    rules += [(past & word(name), last_weekday(a, k + 1)) for k, name in enumerate(WEEKDAYS)]
    back = ago(t, a)
    rules += [(back.isNotNull(), back), (word("last month"), last_month(a)), (word("last week"), last_week(a)), (word("last year"), last_year(a))]
    rules += [(word(f"(?:in|last|during) {name}"), in_month(a, k + 1)) for k, name in enumerate(MONTHS)]
    rules += [(t.contains(name), holiday(a, name)) for name in HOLIDAYS]
    found = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None))
    return F.when(a.isNotNull() & text.isNotNull(), found)


def in_window(date: Column, window: Column) -> Column:
    """Whether a date text lies in the window; texts of month precision count if the month touches it."""
    d, start, end = F.substring(date, 1, 10), window["start"].cast("string"), window["end"].cast("string")
    by_month = (d >= F.substring(start, 1, 7)) & (d <= F.substring(end, 1, 7))
    return F.coalesce(F.when(F.length(d) == 7, by_month).otherwise((d >= start) & (d <= end)), F.lit(False))


def months_named(text: Column) -> Column:
    """Numbers of the months whose names occur in the text, also within other words."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(m), F.lit(k + 1)) for k, m in enumerate(MONTHS)]))
