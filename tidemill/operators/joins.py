"""Joins of evidence within a span of time, and guards on how many rows match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import micros


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, hours: float, symmetric: bool = False) -> DataFrame:
    """Rows of ``right`` at most ``hours`` after a row of ``left``, or before it as well if symmetric; both ends count.

    Columns but the keys must differ.  Time is cut into spans of that length
    and the span joins the equi-keys, so a user with many rows is spread over
    as many tasks as spans, and no pair further apart than two spans is made.
    """
    span = int(hours * 3_600_000_000)
    slot = lambda c: F.floor(micros(F.col(c)) / span)
    offsets = [-1, 0, 1] if symmetric else [0, 1]
    near = left.withColumn("__slot", F.explode(F.array(*[slot(left_time) + k for k in offsets])))
    lag = micros(F.col(right_time)) - micros(F.col(left_time))
    within = (F.abs(lag) <= span) if symmetric else ((lag >= 0) & (lag <= span))
    return near.join(right.withColumn("__slot", slot(right_time)), [*keys, "__slot"]).where(within).drop("__slot")


def guarded(pairs: DataFrame, probe: list[str], candidate: str) -> DataFrame:
    """Of each probe: n, the number of different candidates, the candidate if there is one, and the decision."""
    counted = pairs.groupBy(*probe).agg(F.count_distinct(candidate).alias("n"), F.min(candidate).alias("only"))
    return counted.withColumn("only", F.when(F.col("n") == 1, F.col("only"))).withColumn("decision", decision(F.col("n")))


def decision(n: Column) -> Column:
    return F.when(n == 0, "unmatched").when(n == 1, "linkable").otherwise("review")
