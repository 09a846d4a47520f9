"""Amounts, confidences and distances in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b) * 0.005)


def clamp4(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def boosted(confidence: Column, by: float = 0.08, cap: float = 0.99) -> Column:
    return F.round(F.least(F.lit(cap), confidence + by), 4)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_apart(a: Column, b: Column) -> Column:
    """Fractional days."""
    return F.abs(micros(a) - micros(b)) / 86_400e6


def time_points(days: Column) -> Column:
    return F.when(days <= 2, 15).when(days <= 7, 10).when(days <= 30, 4).otherwise(0)


def score_band(score: Column) -> Column:
    return F.when(score <= 0, "none").when(score < 80, "weak").when(score < 170, "review").otherwise("strict")


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.greatest(attempts, F.lit(1)), F.lit(10))
