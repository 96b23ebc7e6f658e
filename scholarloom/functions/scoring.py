"""Fixed, inspectable score arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarloom import settings


def age_days(as_of: Column, moment: Column) -> Column:
    """Days between two timestamps, never negative."""
    micros = F.unix_micros(as_of) - F.unix_micros(moment)
    return F.greatest(F.lit(0.0), micros / 86_400_000_000)


def half_life_freshness(as_of: Column, moment: Column) -> Column:
    """Halves every 30 days; an unknown date counts as a year old."""
    age = F.coalesce(age_days(as_of, moment), F.lit(settings.MISSING_AGE_DAYS))
    return F.exp(F.lit(-math.log(2)) * age / F.lit(settings.HALF_LIFE_DAYS))


def linear_freshness(as_of: Column, *moments: Column) -> Column:
    """Falls to zero over 30 days, on the first known moment."""
    return F.greatest(F.lit(0.0), 1 - age_days(as_of, F.coalesce(*moments)) / 30)


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def rounded(value: Column, places: int) -> Column:
    """Rounded as the double it is: half away from zero of the scaled value. ``F.round`` rounds the shortest decimal text of the double instead."""
    scale = F.lit(10.0 ** places)
    return F.round(value * scale) / scale


def tier_quality(tier: Column, publication_status: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in settings.TIER_QUALITY.items() for x in pair])
    base = F.coalesce(F.try_element_at(lookup, tier), F.lit(settings.UNKNOWN_TIER_QUALITY))
    return F.when(publication_status == "preprint", base * settings.PREPRINT_FACTOR).otherwise(base)


def corroboration(sources: Column) -> Column:
    """0, 0.5 or 1 for one, two, or three and more distinct sources."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0), F.coalesce(sources, F.lit(0)) - 1) / 2)


def shrink_to_middle(value: Column, confidence: Column) -> Column:
    """Pull a low-confidence (< .55) feature towards the neutral value."""
    return F.when(confidence < 0.55, 0.5 + confidence * (value - 0.5)).otherwise(value)
