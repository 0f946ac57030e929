"""Band / level labels computed from pay and experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COMPENSATION_RANGES, EXPERIENCE_BRACKETS, EXPERIENCE_LEVELS
from .money import total_compensation


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bands(value: Column, bands) -> Column:
    out = None
    for bound, label in bands:
        if bound is None:
            return out.otherwise(F.lit(label)) if out is not None else F.lit(label)
        cond = value < F.lit(bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def compensation_range(total_cents) -> Column:
    """total compensation (cents) -> band by dollars."""
    return _bands(_c(total_cents) / F.lit(100.0), COMPENSATION_RANGES)


def experience_level(years) -> Column:
    """NULL counted as 0 years."""
    return _bands(F.coalesce(_c(years).cast("double"), F.lit(0.0)), EXPERIENCE_LEVELS)


def experience_bracket(years) -> Column:
    """NULL falls into the last bracket (comparisons with NULL are false)."""
    y = _c(years).cast("double")
    out = None
    for bound, label in EXPERIENCE_BRACKETS:
        if bound is None:
            return out.otherwise(F.lit(label))
        cond = y < F.lit(float(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def enrich_document(df):
    """search document = row + total_compensation + range + level."""
    total = total_compensation()
    return df.withColumns({
        "total_compensation": total,
        "compensation_range": compensation_range(total),
        "experience_level": experience_level("years_experience_industry"),
    })


def touch_updated_at(df):
    """stamp ``updated_at`` on changed rows."""
    return df.withColumn("updated_at", F.current_timestamp())
