"""Dates and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_STARTS = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]  # days before each month in a leap year


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def iso_weekday(ts) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(_c(ts)) + 1


def sunday_weekday(ts) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(_c(ts)) - 1


def local_time(ts, offset_hours) -> Column:
    return F.timestamp_seconds(F.unix_seconds(_c(ts)) + (_c(offset_hours) * 3600).cast("long"))


def forecast_cycles(now, hours: int = 30, every: int = 6) -> Column:
    """Cycle times at multiples of `every` hours in the last `hours`, newest first."""
    step = every * 3600
    newest = F.floor(F.unix_seconds(_c(now)) / step) * step
    oldest = F.ceil((F.unix_seconds(_c(now)) - hours * 3600) / step) * step
    return F.transform(F.reverse(F.sequence(oldest.cast("long"), newest.cast("long"), F.lit(step).cast("long"))), lambda s: F.timestamp_seconds(s))


def day_of_year(month, day) -> Column:
    """1 to 366 on a calendar that always has 29 February."""
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_STARTS]), _c(month).cast("int")) + _c(day).cast("int")


def parse_windows(text) -> Column:
    """Array of (opens, closes) days of the year from text such as 5/15-11/30; other text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(\d{1,2}/\d{1,2}\s*-\s*\d{1,2}/\d{1,2})"), 1)

    def day(t, k):
        part = F.trim(F.element_at(F.split(t, "-"), k))
        return day_of_year(F.split(part, "/")[0], F.split(part, "/")[1])

    return F.transform(found, lambda t: F.struct(day(t, 1).alias("opens"), day(t, 2).alias("closes")))


def window_days(opens, closes) -> Column:
    """Days of a season; a season that closes before it opens runs over the new year."""
    o, c = _c(opens), _c(closes)
    return F.when(o <= c, F.sequence(o, c)).otherwise(F.concat(F.sequence(o, F.lit(366)), F.sequence(F.lit(1), c)))


SPANS = "array<struct<a:int,b:int>>"


def _spans(opens, closes) -> Column:
    """A season as one or two runs of days within the year."""
    span = lambda x, y: F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"))
    return F.when(opens <= closes, F.array(span(opens, closes))).otherwise(F.array(span(F.lit(1), closes), span(opens, F.lit(366)))).cast(SPANS)


def season_intersection(windows) -> Column:
    """Windows of the days that all given windows share, cyclic over the year: [(opens, closes)], by opening.

    Runs of days are cut with one another, joined where they touch, and the last is joined to the
    first over the new year.
    """
    year = F.array(F.struct(F.lit(1).alias("a"), F.lit(366).alias("b"))).cast(SPANS)
    both = lambda y, p: F.struct(F.greatest(y["a"], p["a"]).alias("a"), F.least(y["b"], p["b"]).alias("b"))
    cut = lambda s, x: F.filter(F.flatten(F.transform(s, lambda y: F.transform(_spans(x["opens"], x["closes"]), lambda p: both(y, p)))), lambda z: z["a"] <= z["b"])

    def join(s, x):
        last = F.try_element_at(s, F.lit(-1))
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))).cast(SPANS)
        return F.when(F.coalesce(last["b"] + 1 >= x["a"], F.lit(False)), F.concat(F.slice(s, 1, F.size(s) - 1), longer)).otherwise(F.concat(s, F.array(x).cast(SPANS)))

    def over_new_year(s):
        first, last = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(-1))
        one = F.array(F.struct(last["a"].alias("a"), first["b"].alias("b"))).cast(SPANS)
        whole = F.when((F.size(s) > 1) & (first["a"] == 1) & (last["b"] == 366), F.concat(F.slice(s, 2, F.size(s) - 2), one)).otherwise(s)
        return F.transform(whole, lambda x: F.struct(x["a"].alias("opens"), x["b"].alias("closes")))

    common = F.aggregate(_c(windows), year, cut)
    return F.aggregate(F.sort_array(common), F.array().cast(SPANS), join, over_new_year)


def longest_window(windows) -> Column:
    """The window with most days, the earliest of equals."""
    n = lambda x: F.pmod(x["closes"] - x["opens"], F.lit(366)) + 1
    return F.element_at(F.array_sort(_c(windows), lambda a, b: F.when(n(a) != n(b), n(b) - n(a)).otherwise(a["opens"] - b["opens"])), 1)


def fahrenheit(c) -> Column:
    return _c(c) * 9 / 5 + 32


def mph(kmh) -> Column:
    return _c(kmh) * 0.621371


def compass(degrees) -> Column:
    """One of sixteen points."""
    names = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(F.floor(_c(degrees) / 22.5 + 0.5), F.lit(16)).cast("int") + 1)


def pm25_band(value) -> Column:
    """Air-quality band of a concentration."""
    v = _c(value)
    return F.when(v.isNull(), None).when(v <= 9.0, "good").when(v <= 35.4, "moderate").when(v <= 55.4, "unhealthy_sensitive").when(v <= 125.4, "unhealthy").when(v <= 225.4, "very_unhealthy").otherwise("hazardous")
