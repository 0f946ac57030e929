"""Predicates over the pay table.

A :class:`PayFilter` holds the optional filter fields of the API; every set
field becomes one predicate and all are ANDed.  ``None`` means "not set".
The same condition list renders to a Spark ``Column`` (the real path) and to
SQL text (for the DuckDB oracle of the tests).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import datetime
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    min: float | int | None = None
    max: float | int | None = None


@dataclass(frozen=True)
class PayFilter:
    # text "contains" filters (case-insensitive)
    employer: str | None = None                 # P01
    employer_contains: str | None = None        # P15
    job_title_contains: str | None = None       # P02 / P13
    location_contains: str | None = None        # P03
    # exact matches
    location: str | None = None                 # P16
    job_title: str | None = None                # P16
    industry: str | None = None                 # P04
    company_size: str | None = None             # P17
    education_level: str | None = None          # P17
    public_private: str | None = None           # P17
    # enum matches: ILIKE without wildcards around the value
    gender: str | Enum | None = None            # P05
    employment_type: str | Enum | None = None   # P18
    # inclusive ranges
    annual_base_pay: Range | None = None        # P06 (cents)
    annual_bonus: Range | None = None           # P19 (cents)
    years_experience_industry: Range | None = None  # P07
    years_experience_company: Range | None = None   # P20
    actual_hours_per_week: Range | None = None  # P21
    salary_range: Range | None = None           # P24 -> annual_base_pay
    experience_range: Range | None = None       # P24 -> years_experience_industry
    # booleans
    health_insurance_offered: bool | None = None  # P09
    is_happy_at_position: bool | None = None      # P22
    plans_to_resign: bool | None = None           # P22
    is_validated: bool | None = None              # P22
    # dates (inclusive)
    timestamp_after: str | datetime | None = None   # P08
    timestamp_before: str | datetime | None = None  # P08
    created_after: str | datetime | None = None     # P23
    created_before: str | datetime | None = None    # P23
    # quality
    data_quality_score_min: float | None = None   # P10
    #: escape LIKE wildcards in contains-filters; False reproduces raw ILIKE
    escape: bool = field(default=True, compare=False)

    def replace(self, **kw) -> "PayFilter":
        vals = {f.name: getattr(self, f.name) for f in fields(self)}
        vals.update(kw)
        return PayFilter(**vals)

    # -- neutral condition list ------------------------------------------
    def conditions(self) -> list[tuple[str, str, object]]:
        out: list[tuple[str, str, object]] = []
        for attr, col in (("employer", "employer"), ("employer_contains", "employer"),
                          ("job_title_contains", "job_title"),
                          ("location_contains", "location")):
            v = getattr(self, attr)
            if v:
                out.append(("contains", col, v))
        for col in ("location", "job_title", "industry", "company_size", "education_level",
                    "public_private"):
            v = getattr(self, col)
            if v:
                out.append(("eq", col, v))
        for col in ("gender", "employment_type"):
            v = getattr(self, col)
            if v:
                out.append(("ilike", col, v.value if isinstance(v, Enum) else v))
        for attr, col in (("annual_base_pay", "annual_base_pay"),
                          ("salary_range", "annual_base_pay"),
                          ("annual_bonus", "annual_bonus"),
                          ("years_experience_industry", "years_experience_industry"),
                          ("experience_range", "years_experience_industry"),
                          ("years_experience_company", "years_experience_company"),
                          ("actual_hours_per_week", "actual_hours_per_week")):
            r = getattr(self, attr)
            if r is not None:
                if r.min is not None:
                    out.append(("ge", col, r.min))
                if r.max is not None:
                    out.append(("le", col, r.max))
        for col in ("health_insurance_offered", "is_happy_at_position", "plans_to_resign",
                    "is_validated"):
            v = getattr(self, col)
            if v is not None:
                out.append(("eq", col, bool(v)))
        for attr, col, op in (("timestamp_after", "timestamp", "ge_ts"),
                              ("timestamp_before", "timestamp", "le_ts"),
                              ("created_after", "created_at", "ge_ts"),
                              ("created_before", "created_at", "le_ts")):
            v = getattr(self, attr)
            if v:
                out.append((op, col, v))
        if self.data_quality_score_min is not None:
            out.append(("ge", "data_quality_score", self.data_quality_score_min))
        return out

    # -- Spark -----------------------------------------------------------
    def to_column(self) -> Column | None:
        preds = [_spark_pred(kind, col, v, self.escape) for kind, col, v in self.conditions()]
        return reduce(lambda a, b: a & b, preds) if preds else None

    # -- SQL text (oracle) -----------------------------------------------
    def to_sql(self) -> str:
        preds = [_sql_pred(kind, col, v, self.escape) for kind, col, v in self.conditions()]
        return " AND ".join(preds) if preds else "TRUE"


def _ts_lit(v) -> Column:
    s = v.isoformat(sep=" ") if isinstance(v, datetime) else str(v)
    return F.lit(s).cast("timestamp")


def _spark_pred(kind: str, col: str, v, escape: bool) -> Column:
    c = F.col(col)
    if kind == "contains":
        if escape:
            return F.lower(c).contains(F.lit(str(v).lower()))
        return c.ilike(f"%{v}%")
    if kind == "ilike":
        return c.ilike(str(v))
    if kind == "eq":
        return c == F.lit(v)
    if kind == "ge":
        return c >= F.lit(v)
    if kind == "le":
        return c <= F.lit(v)
    if kind == "ge_ts":
        return c >= _ts_lit(v)
    if kind == "le_ts":
        return c <= _ts_lit(v)
    raise ValueError(kind)


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _sql_pred(kind: str, col: str, v, escape: bool) -> str:
    c = f'"{col}"'
    if kind == "contains":
        if escape:
            return f"contains(lower({c}), {_q(str(v).lower())})"
        return f"{c} ILIKE {_q('%' + str(v) + '%')}"
    if kind == "ilike":
        return f"{c} ILIKE {_q(v)}"
    if kind == "eq":
        if isinstance(v, bool):
            return f"{c} = {'TRUE' if v else 'FALSE'}"
        return f"{c} = {_q(v) if isinstance(v, str) else v}"
    if kind == "ge":
        return f"{c} >= {v}"
    if kind == "le":
        return f"{c} <= {v}"
    if kind in ("ge_ts", "le_ts"):
        s = v.isoformat(sep=" ") if isinstance(v, datetime) else str(v)
        return f"{c} {'>=' if kind == 'ge_ts' else '<='} TIMESTAMP {_q(s)}"
    raise ValueError(kind)


def apply_filter(df: DataFrame, flt: PayFilter | None) -> DataFrame:
    """AND of every set field (pushed to the scan where possible)."""
    if flt is None:
        return df
    cond = flt.to_column()
    return df if cond is None else df.where(cond)


def stat_guard(df: DataFrame, value: str = "annual_base_pay", *not_null: str) -> DataFrame:
    """Value IS NOT NULL AND value > 0 (+ group keys IS NOT NULL)."""
    cond = F.col(value).isNotNull() & (F.col(value) > 0)
    for k in not_null:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def stat_guard_sql(value: str = "annual_base_pay", *not_null: str) -> str:
    parts = [f"{value} IS NOT NULL", f"{value} > 0"] + [f"{k} IS NOT NULL" for k in not_null]
    return " AND ".join(parts)


def engineer_filter(flt: PayFilter | None, keyword: str) -> PayFilter:
    """Force the title keyword (overwrites a caller's value, D12)."""
    return (flt or PayFilter()).replace(job_title_contains=keyword)


def high_pay(df: DataFrame, threshold_cents: int = 10_000_000) -> DataFrame:
    """Records paying more than $100,000."""
    return df.where(F.col("annual_base_pay") > threshold_cents)


def recent(df: DataFrame, since: str = "2020-01-01") -> DataFrame:
    """Records after a date."""
    return df.where(F.col("timestamp") > _ts_lit(since))
