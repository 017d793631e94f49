"""Instants as epoch seconds (long or double), readings as intervals, decay functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark pattern, granularity in seconds; the first that fits wins.
FORMATS = [
    ("d MMM yyyy, hh:mm a", 1), ("d MMM yyyy, hh:mm:ss a", 1), ("d/M/yyyy HH:mm", 60), ("d/M/yyyy HH:mm:ss", 1),
    ("d-M-yyyy HH:mm", 60), ("d-M-yyyy HH:mm:ss", 1), ("yyyy-M-d HH:mm:ss", 1), ("d MMM yyyy hh:mm a", 1),
    ("d MMM yyyy", 86_400), ("d/M/yyyy", 86_400), ("d-M-yyyy", 86_400),
]
PKT_OFFSET_S = 5 * 3600
MAX_HOUR_ARTIFACT = 14


def parse_timestamp(raw: Column) -> Column:
    """struct(resolved_s, granularity_s, tz_stated, date_inferred) of a printed local time in Pakistan; null if none fits."""
    text = F.regexp_replace(F.trim(raw), "  ", " ")
    text = F.regexp_replace(text, r"(?i)\s*(AM|PM)\s*$", " $1")
    text = F.regexp_replace(text, r"(?<=[ ,])(\d):", "0$1:")
    out = None
    for pattern, granularity in reversed(FORMATS):
        at = F.try_to_timestamp(text, F.lit(pattern))
        made = F.struct(
            (F.unix_timestamp(at) - PKT_OFFSET_S).alias("resolved_s"), F.lit(granularity).alias("granularity_s"),
            F.lit(False).alias("tz_stated"), F.lit(granularity >= 86_400).alias("date_inferred"),
        )
        out = F.when(at.isNotNull(), made) if out is None else F.when(at.isNotNull(), made).otherwise(out)
    return out


def is_precise(granularity_s: Column, date_inferred: Column) -> Column:
    return ~date_inferred & (granularity_s <= 60)


def window_gap_s(start_s: Column, granularity_s: Column, txn_s: Column) -> Column:
    """0 inside [start, start + granularity); else the distance to the nearer edge."""
    end = start_s + granularity_s
    return F.when((txn_s >= start_s) & (txn_s < end), F.lit(0.0)).otherwise(F.least(F.abs(txn_s - start_s), F.abs(txn_s - end)).cast("double"))


def hour_offset(delta_s: Column, tolerance_s: float) -> Column:
    """Whole hours (half-even) that explain the difference within the tolerance: not 0, at most 14; else null."""
    h = F.bround(delta_s / 3600.0, 0)
    ok = (h != 0) & (F.abs(delta_s - h * 3600.0) <= tolerance_s) & (F.abs(h) <= MAX_HOUR_ARTIFACT)
    return F.when(ok, h.cast("int"))


def gauss(distance: Column, offset: Column, scale: Column) -> Column:
    """2^-(((|d| - offset)+ / scale)^2)."""
    z = F.greatest(F.lit(0.0), F.abs(distance) - offset) / scale
    return F.pow(F.lit(2.0), -(z * z))


def exponential(distance: Column, offset: Column, scale: Column) -> Column:
    return F.pow(F.lit(2.0), -(F.greatest(F.lit(0.0), F.abs(distance) - offset) / scale))


def format_instant(epoch_s: Column, granularity_s: Column | None = None) -> Column:
    """Local time in Pakistan, to the minute; day readings print the date alone; null: a dash."""
    local = F.timestamp_seconds(epoch_s + PKT_OFFSET_S)
    minute, day = F.date_format(local, "yyyy-MM-dd HH:mm"), F.date_format(local, "yyyy-MM-dd")
    text = minute if granularity_s is None else F.when(granularity_s >= 86_400, day).otherwise(minute)
    return F.coalesce(text, F.lit("—"))


def search_window(anchor_s: Column, minutes: int = 30) -> Column:
    return F.concat(format_instant(anchor_s - 60 * minutes), F.lit(" to "), format_instant(anchor_s + 60 * minutes))
