"""Target transform used by the log models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_target(y: Column, offset: float = 1.0) -> Column:
    shifted = y + F.lit(float(offset))
    return F.log(F.when(shifted < 1e-6, F.lit(1e-6)).otherwise(shifted))


def exp_target(z: Column, offset: float = 1.0) -> Column:
    back = F.exp(z) - F.lit(float(offset))
    return F.when(back < 0, F.lit(0.0)).otherwise(back)
