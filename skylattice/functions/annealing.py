"""Cooling schedules, the acceptance rule and the tutorial objective of simulated annealing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the acceptance rule finite at temperature zero.
TINY = 1e-8


def linear_cooling(start: Column, rate: Column, step: Column) -> Column:
    return start - rate * step


def exponential_cooling(start: Column, rate: Column, step: Column) -> Column:
    return start * F.pow(rate, step)


def logarithmic_cooling(start: Column, step: Column) -> Column:
    return start / (F.log1p(step) + TINY)


def acceptance(current: Column, new: Column, temperature: Column) -> Column:
    return F.when(new < current, F.lit(1.0)).otherwise(F.exp(-(new - current) / (temperature + TINY)))


def objective(x: Column) -> Column:
    return F.sin(x) + F.sin(10 * x / 3)
