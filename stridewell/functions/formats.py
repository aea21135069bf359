"""Formats of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_sd(mean: Column, sd: Column) -> Column:
    return F.format_string("%.4f +/- %.4f", mean, sd)
