"""Repeatable pseudo-random order and spatial folds from integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier of the spatial fold hash.
FOLD_MULTIPLIER = 2654435761

MODULUS = 2147483647


def draw_order(*keys: Column, seed: int) -> Column:
    """A number in [0, 2^31 - 1) per key; every product stays below 2^62."""
    state = F.lit(seed % MODULUS).cast("long")
    for key in keys:
        mixed = (F.pmod(key.cast("long"), F.lit(MODULUS).cast("long")) + state) % F.lit(MODULUS).cast("long")
        state = (mixed * F.lit(1103515245).cast("long") + F.lit(12345).cast("long")) % F.lit(MODULUS).cast("long")
    return state


def spatial_fold(pixel: Column, k: int) -> Column:
    """(pixel * multiplier) mod k; both factors are reduced first, so no bigint overflows."""
    folds = F.lit(k).cast("long")
    return F.pmod(F.pmod(pixel.cast("long"), folds) * F.lit(FOLD_MULTIPLIER % k).cast("long"), folds)
