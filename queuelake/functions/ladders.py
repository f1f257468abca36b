"""Ladders, rounding and rules on columns. Thresholds are fixed values of the service that is re-expressed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the crowd levels, in percent of the baseline.
CROWD = [(60, "very_low"), (89, "low"), (110, "moderate"), (150, "high"), (200, "very_high")]
#: Upper bounds of the levels of a relative index.
RELATIVE = [(0.8, "very_low"), (0.92, "low"), (1.02, "moderate"), (1.12, "high")]


def ladder(x: Column, steps: list[tuple[float, str]], top: str) -> Column:
    out = F.lit(top)
    for bound, name in reversed(steps):
        out = F.when(x <= bound, name).otherwise(out)
    return F.when(x.isNull(), "unknown").otherwise(out)


def crowd_level(percent: Column) -> Column:
    return ladder(percent, CROWD, "extreme")


def relative_level(index: Column) -> Column:
    return ladder(index, RELATIVE, "very_high")


def comparison(percent: Column) -> Column:
    return ladder(percent, [(60, "much_lower"), (89, "lower"), (110, "typical"), (150, "higher")], "much_higher")


def trend(now: Column, before: Column, least: float = 5, share: float = 0.1) -> Column:
    """up or down if the change exceeds both ``least`` and a share of what was."""
    bound = F.greatest(F.lit(least), before * share)
    return F.when(now.isNull() | before.isNull(), "stable").when(now - before > bound, "up").when(before - now > bound, "down").otherwise("stable")


def crowd_score(p50: Column) -> Column:
    return F.round(F.least(F.greatest(p50 / 10, F.lit(1.0)), F.lit(5.0)), 1)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def recommendation(level: Column, holiday: Column, vacation: Column, bridge: Column, weather: Column) -> Column:
    """Points for a visit: quiet days gain, days off and bad weather lose."""
    base = F.when(level == "very_low", 5).when(level == "low", 4).when(level == "moderate", 3).when(level == "high", 2).otherwise(1)
    off = F.when(holiday, 1).otherwise(0) + F.when(vacation, 1).otherwise(0) + F.when(bridge, 1).otherwise(0)
    wet = F.when(weather >= 95, 2).when(weather >= 61, 1).otherwise(0)
    points = base - F.least(off, F.lit(2)) - wet
    return F.when(points >= 4, "highly_recommended").when(points >= 3, "recommended").when(points >= 2, "neutral").when(points >= 1, "avoid").otherwise("strongly_avoid")


def closing_after_opening(opens: Column, closes: Column) -> Column:
    """A closing time before its opening is of the next day."""
    return F.when(closes < opens, closes + F.expr("INTERVAL 1 DAY")).otherwise(closes)


def consensus(waits: Column) -> Column:
    """One source: to the nearest five; two: their mean; three: the pair that agrees within five, else the median."""
    w = F.array_sort(F.filter(waits, lambda x: x.isNotNull()))
    five = lambda x: (F.floor((x + 2.5) / 5) * 5).cast("int")
    a, b, c = (F.get(w, i) for i in range(3))
    three = F.when((b - a <= 5) & (b - a <= c - b), five((a + b) / 2)).when(c - b <= 5, five((b + c) / 2)).otherwise(five(b.cast("double")))
    return F.when(F.size(w) == 0, None).when(F.size(w) == 1, five(a.cast("double"))).when(F.size(w) == 2, five((a + b) / 2)).otherwise(three)


def easter(year: Column) -> Column:
    """The date of Easter Sunday (Gregorian), by integer arithmetic."""
    i = lambda c: F.floor(c).cast("int")
    a, b, c = year % 19, i(year / 100), year % 100
    d = (19 * a + b - i(b / 4) - i((b - i((b + 8) / 25) + 1) / 3) + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * i(c / 4) - d - c % 4) % 7
    f = d + e - 7 * i((a + 11 * d + 22 * e) / 451) + 114
    return F.make_date(year, i(f / 31), f % 31 + 1)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1).when(month.isin(6, 7, 8), 2).otherwise(3)


def temperature_at(low: Column, high: Column, hour: Column, warmest: int = 15) -> Column:
    """Between the day's low and high along a cosine."""
    return low + (high - low) * (1 + F.cos((hour - warmest) / 24 * 2 * 3.141592653589793)) / 2


def region_code(code: Column) -> Column:
    """DE-BY, de_by -> BY; a code without a country stays."""
    return F.upper(F.regexp_extract(code, r"^(?:[A-Za-z]{2}[-_])?(.*)$", 1))


def slug(text: Column) -> Column:
    """Lower case without accents; what is no letter or digit becomes one dash."""
    plain = F.replace(F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def out_of_season(month: Column, curated: Column, detected: Column, out_since: Column) -> Column:
    """A curated list of months beats a detected one; without any, a marked date of going out of season decides."""
    months = F.coalesce(curated, detected)
    return F.when(months.isNotNull(), ~F.array_contains(months, month)).otherwise(out_since.isNotNull())


def resolved(*sources: Column) -> Column:
    return F.coalesce(*sources)


def day_type(school: Column, public: Column, weekend: Column, month: Column) -> Column:
    return F.when(school, "school").when(public, "public").when(weekend, "weekend").when(month.isin(6, 7, 8, 12), "peak_month").otherwise("regular")


def decayed(score: Column, days: Column, rate: float = 0.9) -> Column:
    return score * F.pow(F.lit(rate), days)
