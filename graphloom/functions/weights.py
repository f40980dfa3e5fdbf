"""Weights of relations, strengths of memories."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query-time decay.
NO_HISTORY, LEAST, MOST = 0.8, 0.1, 1.0
DEFAULT_RELATION_WEIGHT = 0.5
#: Strengths at or under this do not decay further.
DEAD = 0.001


def clamp(w: Column) -> Column:
    """From 0 to 1; null stays null."""
    return F.when(w.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))


def combine(a: Column, b: Column) -> Column:
    """Probability that one of two independent observations holds."""
    return 1 - (1 - clamp(a)) * (1 - clamp(b))


def combine_all(w: Column) -> Column:
    """combine() as an aggregate: 0 for no rows; nulls are left out.

    The product is a sum of logarithms as exact decimals, so it is the same in whatever order rows come, and tasks add up
    their own rows first. A weight of 1 has no logarithm and decides alone.
    """
    rest = 1 - clamp(w)
    logs = F.sum(F.when(rest > 0, F.ln(rest)).cast("decimal(20,18)")).cast("double")
    return F.when(F.max(rest == 0), F.lit(1.0)).otherwise(F.coalesce(1 - F.exp(logs), F.lit(0.0)))


def default_weight(w: Column) -> Column:
    return F.when(F.coalesce(w, F.lit(0.0)) == 0, DEFAULT_RELATION_WEIGHT).otherwise(w)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def decayed(strength: Column, hours: Column, half_life_hours: float) -> Column:
    """One run of batch decay: halves per half life; next to nothing stays as it is."""
    return F.when(strength > DEAD, strength * F.exp(F.lit(-math.log(2) / half_life_hours) * hours)).otherwise(strength)


def decay_multiplier(strength: Column, access_count: Column, hours: Column, half_life_hours: float) -> Column:
    """What a search multiplies a score with: frequent access slows the decay; items without history have a fixed one."""
    stability = 1 + F.log1p(access_count.cast("double"))
    kept = strength * F.exp(F.lit(-math.log(2) / half_life_hours) * F.greatest(hours, F.lit(0.0)) / stability)
    return F.when(strength.isNull(), F.lit(NO_HISTORY)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), kept)))
