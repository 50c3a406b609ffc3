"""Scalar expressions: times, sessions, encodings and small formulas. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
#: Divisors of a nanosecond epoch, by name of the truncated column. Fixed values.
EPOCH_UNITS = {
    "epoch_micro": 1_000,
    "epoch_ms": 1_000_000,
    "epoch_cs": 10_000_000,
    "epoch_ds": 100_000_000,
    "epoch_sec": 1_000_000_000,
    "epoch_sec3": 3_000_000_000,
    "epoch_min": 60_000_000_000,
    "epoch_min5": 300_000_000_000,
    "epoch_hour": 3_600_000_000_000,
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_time(ts: str | Column, zone: str = MARKET_ZONE) -> Column:
    """Wall-clock time in a zone of a UTC timestamp without zone; daylight saving follows the zone's rules."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts))


def minute_of_day(ts: str | Column) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def session(local_ts: str | Column) -> Column:
    """pre-market before 09:30, after-hours from 16:00 on, else market-open; of a wall-clock time."""
    m = minute_of_day(local_ts)
    return F.when(m < 570, "pre-market").when(m >= 960, "after-hours").otherwise("market-open")


def epoch_nanos(ts: str | Column) -> Column:
    """Nanoseconds since the epoch of a UTC timestamp without zone (microsecond precision)."""
    return F.unix_micros(_c(ts).cast("timestamp")) * 1000


def epoch_truncated(nanos: str | Column, unit: str) -> Column:
    size = F.lit(EPOCH_UNITS[unit])
    return F.call_function("div", _c(nanos) - F.pmod(_c(nanos), size), size)  # in whole numbers: a double is too short


def vwap_repaired(vwap: Column, low: Column, high: Column, midprice: Column) -> Column:
    """vwap where it lies in [low, high]; null and others become the midprice."""
    return F.when(vwap.between(low, high), vwap).otherwise(midprice)


def squeezed(x: str | Column, t: float = 4.0) -> Column:
    """Values within t as they are; what lies beyond is bent by tanh, so that nothing exceeds t + 1."""
    clipped = F.greatest(F.least(_c(x), F.lit(t)), F.lit(-t))
    return clipped + F.tanh(_c(x) - clipped)


def cyclic(x: str | Column, period: str | Column | float) -> tuple[Column, Column]:
    """(sine, cosine) of a value on a circle of the given period."""
    p = F.lit(float(period)) if isinstance(period, (int, float)) else _c(period)
    angle = 2 * F.pi() * _c(x) / p
    return F.sin(angle), F.cos(angle)


def linspace(a: Column, b: Column, n: Column) -> Column:
    """n evenly spaced values from a to b, both included; one value is a, none is an empty array."""
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: a + (b - a) * i / F.greatest(n - 1, F.lit(1)))
    return F.when(n >= 1, many).otherwise(F.array().cast("array<double>"))


def compound(principal: Column, rate: Column, periods: Column) -> Column:
    return principal * F.pow(1 + rate, periods)


def curve_drop(distance_km: Column, radius_km: float = 6371.0) -> Column:
    """How far a sphere's surface falls below the tangent, in metres."""
    return (F.sqrt(distance_km * distance_km + radius_km * radius_km) - radius_km) * 1000


def human_size(n: Column) -> Column:
    """Bytes as text: whole bytes, KB and MB to one decimal, GB to two."""
    return (
        F.when(n < 1000, F.format_string("%d Bytes", n))
        .when(n < 1_000_000, F.format_string("%.1f KB", n / 1e3))
        .when(n < 1_000_000_000, F.format_string("%.1f MB", n / 1e6))
        .otherwise(F.format_string("%.2f GB", n / 1e9))
    )


def fracdiff_weights(d: float, size: int) -> list[float]:
    """Weights of the fractional difference operator: 1, then each the last times (k - 1 - d) / k."""
    out = [1.0]
    for k in range(1, size):
        out.append(-out[-1] * (d - k + 1) / k)
    return out
