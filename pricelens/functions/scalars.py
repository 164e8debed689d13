"""Column-expression helpers (scalar functions).

Every helper returns a ``Column`` built from built-in Spark functions, so it
stays inside whole-stage codegen. Nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SECOND
US_PER_DAY = 86_400 * US_PER_SECOND

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (wall clock) value.

    A difference of two wall-clock values, so the result does not depend on the
    session time zone (a cast to TIMESTAMP would read the wall time in the
    session zone and shift across daylight-saving changes). Used for elapsed
    time and as the integer order key of RANGE frames.
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))


def micros_between(start, end) -> Column:
    """Elapsed microseconds from ``start`` to ``end`` (wall-clock values, zone-free)."""
    return epoch_micros(end) - epoch_micros(start)


# P1 ------------------------------------------------------------------------
def coerce_numeric(c, to: str = "double") -> Column:
    """Number coercion: text or numbers to ``to``; bad values become null. ``"2.0"`` is the whole number 2."""
    text = _c(c).cast("string")
    if to in ("int", "long", "bigint"):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), F.coalesce(text.try_cast(to), number.try_cast(to)))
    return text.try_cast(to) if to != "string" else text


# P2 / P3 -------------------------------------------------------------------
LISTING_TIME_FORMAT = "MM-dd-yy / hh:mm a"  # fixed value: raw listing timestamp pattern


def parse_listing_time(c, fmt: str = LISTING_TIME_FORMAT, strict: bool = True) -> Column:
    """Parse wall-clock text to TIMESTAMP_NTZ; strict raises on bad text (ANSI)."""
    if strict:
        return F.to_timestamp_ntz(_c(c), F.lit(fmt))
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("timestamp_ntz")


def parse_or_null(c, fmt: str | None = None) -> Column:
    """Lenient parse: text that does not parse becomes null."""
    if fmt is None:
        return _c(c).try_cast("timestamp_ntz")
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("timestamp_ntz")


# P4 / P5 -------------------------------------------------------------------
# Zone arithmetic uses ``convert_timezone`` on wall-clock (TIMESTAMP_NTZ) values
# with explicit source and target zones, so no result depends on the session
# time zone.
def _wall_to_utc(wall, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(wall).cast("timestamp_ntz"))


def _utc_to_wall(utc, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(utc).cast("timestamp_ntz"))


def localize(wall, tz: str, nonexistent: str = "raise") -> Column:
    """Wall time in zone ``tz`` to the UTC instant (as TIMESTAMP_NTZ in UTC).

    Ambiguous wall times (the repeated autumn hour) give null. Nonexistent
    wall times (the skipped spring hour) raise, or give null with
    ``nonexistent="null"``; ``localize_status`` names them for a reject table.
    """
    status = localize_status(wall, tz)
    out = F.when(status == F.lit("ok"), _wall_to_utc(wall, tz))
    if nonexistent == "null":
        return out
    gap = F.raise_error(F.concat(F.lit(f"wall time that {tz} skips: "), _c(wall).cast("string")))
    return F.when(status == F.lit("nonexistent"), gap.cast("timestamp_ntz")).otherwise(out)


def localize_status(wall, tz: str) -> Column:
    """'ok', 'ambiguous' or 'nonexistent' for a wall time in zone ``tz``."""
    t = _c(wall).cast("timestamp_ntz")
    u = _wall_to_utc(t, tz)
    one_h = F.expr("INTERVAL 1 HOUR")
    amb = (_utc_to_wall(u - one_h, tz) == t) | (_utc_to_wall(u + one_h, tz) == t)
    return (F.when(t.isNull(), F.lit(None))
            .when(_utc_to_wall(u, tz) != t, F.lit("nonexistent"))
            .when(amb, F.lit("ambiguous"))
            .otherwise(F.lit("ok")))


def to_zone(utc_ntz, tz: str) -> Column:
    """UTC instant (TIMESTAMP_NTZ in UTC) to wall time in ``tz``."""
    return _utc_to_wall(utc_ntz, tz)


# P6 / P7 -------------------------------------------------------------------
def days_until(event_date, ts) -> Column:
    """Whole days from ``ts`` to ``event_date``, truncated toward zero."""
    return (micros_between(ts, event_date) / F.lit(float(US_PER_DAY))).cast("int")


def hours_until(event_date, ts) -> Column:
    return micros_between(ts, event_date) / F.lit(float(US_PER_HOUR))


# F1-F3 ---------------------------------------------------------------------
# Standardisation rules (substring -> replacement), applied in order.
SECTION_RULES = [(("ga", "general"), "General Admission"), (("nmres",), "General Admission")]
ZONE_RULES = [(("ga",), "general admission"), (("floor general admission",), "general admission")]


def standardize(c, rules: Sequence[tuple[Sequence[str], str]] = SECTION_RULES, lower: bool = True) -> Column:
    """Lower-case, then replace the whole value when it contains any substring of a rule.

    Rules apply one after the other, as successive passes over the column.
    """
    out = F.lower(_c(c)) if lower else _c(c)
    for needles, repl in rules:
        cond = None
        for n in needles:
            t = out.contains(n)
            cond = t if cond is None else (cond | t)
        out = F.when(cond, F.lit(repl)).otherwise(out)
    return out


# F4 ------------------------------------------------------------------------
def file_date(name) -> Column:
    """Event date from a file stem: last six characters ``yyMMdd``."""
    return F.try_to_timestamp(F.right(_c(name), F.lit(6)), F.lit("yyMMdd")).cast("timestamp_ntz")


def file_event(name) -> Column:
    """Event name from a file stem: everything before the last six characters."""
    n = _c(name)
    return n.substr(F.lit(1), F.length(n) - 6)


# F5 / F6 -------------------------------------------------------------------
WEEKEND_DAYS = (4, 5, 6)  # fixed values: Friday, Saturday, Sunday with Monday = 0


def day_of_week(c) -> Column:
    return F.weekday(_c(c))


def is_weekend(c) -> Column:
    return F.weekday(_c(c)).isin(*WEEKEND_DAYS).cast("int")


# F7 / F8 -------------------------------------------------------------------
def log1p(c) -> Column:
    return F.log1p(_c(c))


def safe_div(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def zero_to(c, value: float) -> Column:
    c = _c(c)
    return F.when(c == 0, F.lit(value)).otherwise(c)


# F9 ------------------------------------------------------------------------
def edge(lo: Column, width: Column, k: Column) -> Column:
    """k-th edge of an equal-width partition (same formula as a linspace)."""
    return k.cast("double") * width + lo


def cut_right_closed(v, lo, hi, bins: int) -> Column:
    """1-based bin of ``v`` in ``bins`` equal-width, right-closed intervals.

    The first interval also holds ``lo`` (its left edge is widened by 0.1 %
    of the range). Null outside [lo, hi] and for null input.
    """
    v, lo, hi = _c(v), _c(lo), _c(hi)
    w = (hi - lo) / F.lit(float(bins))
    guess = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.try_divide(v - lo, w)).cast("int")))
    guess = F.coalesce(guess, F.lit(1))
    # correct a guess that float rounding put one bin off
    down = F.when((guess > 1) & (v <= edge(lo, w, guess - 1)), guess - 1).otherwise(guess)
    fixed = F.when((down < bins) & (v > edge(lo, w, down)), down + 1).otherwise(down)
    return F.when(v.isNotNull() & (v >= lo) & (v <= hi), fixed)


def hist_bin(v, lo, hi, bins: int) -> Column:
    """1-based bin of ``v`` in ``bins`` equal-width, left-closed intervals; the last is closed."""
    v, lo, hi = _c(v), _c(lo), _c(hi)
    w = (hi - lo) / F.lit(float(bins))
    guess = F.floor(F.try_divide(v - lo, w)).cast("int") + 1
    guess = F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(guess, F.lit(1))))
    down = F.when((guess > 1) & (v < edge(lo, w, guess - 1)), guess - 1).otherwise(guess)
    fixed = F.when((down < bins) & (v >= edge(lo, w, down)), down + 1).otherwise(down)
    return F.when(v.isNotNull() & (v >= lo) & (v <= hi), fixed)


# F11 / F12 -----------------------------------------------------------------
def band(mean, std, k: float = 1.0) -> tuple[Column, Column]:
    return _c(mean) - F.lit(k) * _c(std), _c(mean) + F.lit(k) * _c(std)


def fmt_money(c, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(c), decimals))


def fmt_percent(c, decimals: int = 1) -> Column:
    return F.concat(F.format_number(_c(c) * 100, decimals), F.lit("%"))


def fmt_thousands(c) -> Column:
    return F.format_number(_c(c), 0)
