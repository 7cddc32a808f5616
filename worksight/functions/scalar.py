"""Column functions: ratios, similarities, geography, text, calendar, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_KM = 6371.0088


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator, denominator) -> Column:
    """numerator / denominator where the denominator is positive, else null; never infinite."""
    den = col(denominator).cast("double")
    out = F.when(den > 0, col(numerator).cast("double") / den)
    return F.when(F.abs(out) < float("inf"), out)


def clipped_excess(a, b) -> Column:
    """max(a - b, 0); null if either is."""
    d = col(a) - col(b)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0)))


def fixed(value, digits: int) -> Column:
    """value rounded half up by plain arithmetic, which gives the same bits in every engine."""
    scale = 10.0**digits
    return F.floor(col(value) * scale + 0.5) / scale


def days_between(later, earlier) -> Column:
    return F.datediff(col(later), col(earlier))


def visible(date, as_of) -> Column:
    """The date if it is not after as_of, else null."""
    return F.when(col(date) <= F.lit(as_of).cast("date"), col(date))


def amount_similarity(a, b) -> Column:
    """1 - |a - b| / max(|a|, |b|), 1 for two zeros, null-propagating."""
    a, b = col(a).cast("double"), col(b).cast("double")
    largest = F.greatest(F.abs(a), F.abs(b))
    out = F.when(largest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / largest))
    return F.when(a.isNotNull() & b.isNotNull(), out)


def ratio_similarity(a, b) -> Column:
    """min / max of two positive amounts, else null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def date_proximity(a, b, span_days: int = 365) -> Column:
    d = F.abs(F.datediff(col(a), col(b))).cast("double")
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), 1 - d / span_days))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the radius's unit; null out of range or if any is null."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    ok = F.abs(lat1).between(0, 90) & F.abs(lat2).between(0, 90) & F.abs(lon1).between(0, 180) & F.abs(lon2).between(0, 180)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(ok, 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def available_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null, weights renormalised; null without any."""
    total = reduce(lambda x, y: x + y, (F.coalesce(v.cast("double") * w, F.lit(0.0)) for v, w in parts))
    weight = reduce(lambda x, y: x + y, (F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in parts))
    return F.when(weight > 0, total / weight)


def same_text(a, b) -> Column:
    """Equal after trimming and lower-casing; null is never equal."""
    return F.coalesce(F.lower(F.trim(col(a))) == F.lower(F.trim(col(b))), F.lit(False))


def normalized_text(text) -> Column:
    """Lower case; letters, digits, spaces and hyphens; single spaces. Plain Unicode forms only."""
    kept = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_\s-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"[_-]+", " "), r"\s+", " "))


def search_text(parts: list[tuple[str, Column]]) -> Column:
    """"label value | label value", empty values left out."""
    return F.concat_ws(" | ", *[F.when(F.length(F.trim(v)) > 0, F.concat_ws(" ", F.lit(name), F.trim(v))) for name, v in parts])


def group_label(columns: list[str]) -> Column:
    """"field=value|field=value", null if any value is null."""
    parts = [x for i, c in enumerate(columns) for x in (F.lit(("|" if i else "") + f"{c}="), col(c).cast("string"))]
    return F.concat(*parts)


def band(score) -> Column:
    """LOW below 25, MEDIUM below 50, HIGH below 75, CRITICAL from there."""
    s = col(score)
    return F.when(s < 25, "LOW").when(s < 50, "MEDIUM").when(s < 75, "HIGH").when(s >= 75, "CRITICAL")


def severity_band(value) -> Column:
    v = col(value)
    return F.when(v <= 0, "NORMAL").when(v <= 5, "MINOR").when(v <= 15, "MODERATE").when(v <= 30, "HIGH").when(v > 30, "SEVERE")


def attention(band_column, actionable) -> Column:
    urgent = col(band_column).isin("HIGH", "CRITICAL")
    return F.when(urgent & col(actionable), "IMMEDIATE").when(urgent, "PRIORITY").when(col(actionable), "WATCH").otherwise("ROUTINE")


def truth(text, also_one: bool = False) -> Column:
    """A boolean from text: "true" in any case, and "1" if `also_one`; all else is false."""
    return F.coalesce(F.lower(F.trim(col(text))).isin(*(["true", "1"] if also_one else ["true"])), F.lit(False))


def working_day(date) -> Column:
    return F.weekday(col(date)) < 5


def first_working_days(month, n: int, holidays: Column | None = None) -> Column:
    """The first n working days of the month that holds the date."""
    first = F.trunc(col(month), "MM")
    days = F.filter(F.sequence(first, F.last_day(first)), lambda d: F.weekday(d) < 5)
    return F.slice(F.array_except(days, holidays) if holidays is not None else days, 1, n)


def add_working_days(date, n: int, holidays: Column | None = None) -> Column:
    """The nth working day after the date."""
    days = F.filter(F.sequence(F.date_add(col(date), 1), F.date_add(col(date), 2 * n + 14)), lambda d: F.weekday(d) < 5)
    return F.element_at(F.array_except(days, holidays) if holidays is not None else days, n)


def monthly_evidence(captured, month, today) -> Column:
    """RECORDED, UPCOMING, DUE or OVERDUE: whether a month's first capture came by its third working day, as of a day."""
    days = first_working_days(month, 3)
    due = F.element_at(days, 3)
    return F.when(col(captured).isNotNull(), F.when(col(captured) <= due, "RECORDED").otherwise("OVERDUE")).when(col(today) < F.element_at(days, 1), "UPCOMING").when(col(today) <= due, "DUE").otherwise("OVERDUE")


def completion_evidence(completed, captured, today, days: int = 3) -> Column:
    """RECORDED, DUE or OVERDUE: whether a completion was captured within so many working days of it, as of a day."""
    due = add_working_days(completed, days)
    return F.when(col(completed).isNull(), "NOT_APPLICABLE").when(col(captured).isNotNull(), F.when(col(captured) <= due, "RECORDED").otherwise("OVERDUE")).when(col(today) <= due, "DUE").otherwise("OVERDUE")


def location_status(metres, limit: float = 500.0) -> Column:
    return F.when(col(metres).isNull(), "LOCATION_UNAVAILABLE").when(col(metres) <= limit, "LOCATION_CONSISTENT").otherwise("LOCATION_REQUIRES_REVIEW")


def money_text(rupees) -> Column:
    """Crore and lakh notation."""
    v = col(rupees).cast("double")
    return F.when(F.abs(v) >= 1e7, F.concat(F.format_string("%.2f", v / 1e7), F.lit(" crore"))).when(F.abs(v) >= 1e5, F.concat(F.format_string("%.2f", v / 1e5), F.lit(" lakh"))).otherwise(F.format_string("%.0f", v))


def json_safe(value) -> Column:
    """NaN as null, so that JSON has neither NaN nor infinity."""
    v = F.nanvl(col(value), F.lit(None).cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def fractional_instant(start, end, fraction) -> Column:
    """start + fraction * (end - start) as a timestamp."""
    seconds = F.unix_seconds(col(start).cast("timestamp")).cast("double") + col(fraction) * 86400 * F.datediff(col(end), col(start))
    return F.timestamp_seconds(seconds)
