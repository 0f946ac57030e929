"""Projection, lookup, sort and paging.

Paging is a ``TakeOrderedAndProject`` (ORDER BY + OFFSET + LIMIT): each task
keeps only ``offset + limit`` rows, so shallow pages never sort the table.
Deep pages should use the keyset form (:func:`page_after`), which turns the
cursor into a filter that Parquet statistics can prune with.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents_to_dollars, format_currency, total_compensation
from ..schema import DEFAULT_PAGE_LIMIT, MAX_PAGE_LIMIT, SortDirection, SortField
from ..session import reuse
from .filters import PayFilter, apply_filter

SortSpec = Sequence[tuple[str | SortField, str | SortDirection]]


# ---------------------------------------------------------------------------
# J: lookup and projection
# ---------------------------------------------------------------------------

def get_by_id(df: DataFrame, record_id: str) -> DataFrame:
    """The record with this id, or no row."""
    return df.where(F.col("id") == F.lit(str(record_id))).limit(1)


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def api_fields(df: DataFrame) -> dict[str, Column]:
    """camelCase API field -> Column (absent table columns are NULL)."""
    total = total_compensation()
    plain = {
        "id": "id", "sourceFile": "source_file", "rowNumber": "row_number",
        "timestamp": "timestamp", "createdAt": "created_at", "updatedAt": "updated_at",
        "employer": "employer", "companySize": "company_size", "industry": "industry",
        "publicPrivate": "public_private", "location": "location", "city": "city",
        "stateProvince": "state_province", "country": "country", "jobTitle": "job_title",
        "jobLadder": "job_ladder", "jobLevel": "job_level", "employmentType": "employment_type",
        "yearsExperienceIndustry": "years_experience_industry",
        "yearsExperienceCompany": "years_experience_company",
        "yearsAtEmployer": "years_at_employer",
        "requiredHoursPerWeek": "required_hours_per_week",
        "actualHoursPerWeek": "actual_hours_per_week",
        "annualVacationWeeks": "annual_vacation_weeks", "gender": "gender",
        "educationLevel": "education_level", "isHappyAtPosition": "is_happy_at_position",
        "plansToResign": "plans_to_resign", "healthInsuranceOffered": "health_insurance_offered",
        "additionalComments": "additional_comments", "dataQualityScore": "data_quality_score",
        "isValidated": "is_validated",
    }
    out: dict[str, Column] = {k: _opt(df, v) for k, v in plain.items()}
    for k in ("yearsExperienceIndustry", "yearsExperienceCompany", "yearsAtEmployer",
              "dataQualityScore"):
        out[k] = out[k].cast("double")
    pay = _opt(df, "annual_base_pay", "long")
    out.update({
        "annualBasePay": cents_to_dollars(pay),
        "annualBasePayCents": pay,
        "annualBonus": cents_to_dollars(_opt(df, "annual_bonus", "long")),
        "signingBonus": cents_to_dollars(_opt(df, "signing_bonus", "long")),
        "stockValue": cents_to_dollars(_opt(df, "stock_value", "long")),
        "annualBasePayFormatted": format_currency(pay),
        "totalCompensation": cents_to_dollars(total),
        "totalCompensationFormatted": format_currency(total),
    })
    return out


def select_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sparse fieldset by API name (only those columns are read)."""
    fields = api_fields(df)
    unknown = [n for n in names if n not in fields]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return df.select(*[fields[n].alias(n) for n in names])


def api_view(df: DataFrame) -> DataFrame:
    """Every API field."""
    return df.select(*[c.alias(n) for n, c in api_fields(df).items()])


# ---------------------------------------------------------------------------
# O: sort and page
# ---------------------------------------------------------------------------

def _field(df: DataFrame, f: str | SortField) -> str:
    try:
        name = SortField[f].value if isinstance(f, str) else f.value
    except KeyError:
        name = SortField.CREATED_AT.value
    if name == SortField.CREATED_AT.value and name not in df.columns:
        # tables without load metadata fall back to the record time
        name = SortField.TIMESTAMP.value
    return name


def _dir(d: str | SortDirection) -> str:
    d = d.value if isinstance(d, SortDirection) else str(d).upper()
    return "DESC" if d == "DESC" else "ASC"


def sort_keys(df: DataFrame, sort: SortSpec | None) -> list[tuple[str, str]]:
    """Resolved (column, direction) list; default ``created_at DESC``."""
    if not sort:
        return [(_field(df, SortField.CREATED_AT), "DESC")]
    return [(_field(df, f), _dir(d)) for f, d in sort]


def _order(keys: list[tuple[str, str]]) -> list[Column]:
    cols = [F.col(c).desc_nulls_first() if d == "DESC" else F.col(c).asc_nulls_last()
            for c, d in keys]
    return cols + [F.col("id").asc_nulls_last()]


def sort_pay(df: DataFrame, sort: SortSpec | None = None) -> DataFrame:
    """Multi-key sort with PostgreSQL null placement and an id tie-break."""
    return df.orderBy(*_order(sort_keys(df, sort)))


def clamp_limit(limit: int | None) -> int:
    return min(limit or DEFAULT_PAGE_LIMIT, MAX_PAGE_LIMIT)


def page(df: DataFrame, sort: SortSpec | None = None, limit: int | None = None,
         offset: int | None = None) -> DataFrame:
    """One page (limit defaults to 20, capped at 100); a deep offset sorts its own range of the keys only."""
    if offset and int(offset) > DEEP_OFFSET:
        return deep_page(df, sort, limit, offset)
    out = sort_pay(df, sort)
    if offset:
        out = out.offset(int(offset))
    return out.limit(clamp_limit(limit))


#: offsets up to which a page is taken from the head of the order
DEEP_OFFSET = 10_000


def deep_page(df: DataFrame, sort: SortSpec | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """O02 far from the head, for rows with a unique, non-null id.

    The sort keys and ids alone are dealt into ranges of the order and counted
    by range; only the ranges that hold the page are sorted, so no task holds
    offset + limit rows and no full row moves.  The page's ids then filter the
    scan.  Equal keys are told apart by id, so they fill no single range.
    """
    keys = sort_keys(df, sort)
    first, size = int(offset or 0), clamp_limit(limit)
    order = _order(keys)
    placed = reuse(df.select(*dict.fromkeys([c for c, _ in keys] + ["id"])).repartitionByRange(*order)
                   .withColumn("_range", F.spark_partition_id()))
    before, skipped, wanted = 0, 0, []
    for part, n in sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + n <= first:
            skipped = before + n
        elif before < first + size:
            wanted.append(part)
        before += n
    near = placed.where(F.col("_range").isin(wanted)).orderBy(*order).offset(first - skipped).limit(size)
    return df.where(F.col("id").isin([r["id"] for r in near.select("id").collect()])).orderBy(*order)


def page_info(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """total_count, has_next_page, has_previous_page (one row)."""
    lim, off = clamp_limit(limit), int(offset or 0)
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count",
        (F.lit(off + lim) < F.col("total_count")).alias("has_next_page"),
        F.lit(off > 0).alias("has_previous_page"))


def list_pay(df: DataFrame, flt: PayFilter | None = None, sort: SortSpec | None = None,
             limit: int | None = None, offset: int | None = None,
             fields: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Filter + sort + page, plus the page info."""
    filtered = apply_filter(df, flt)
    rows = page(filtered, sort, limit, offset)
    if fields:
        rows = select_fields(rows, fields)
    return rows, page_info(filtered, limit, offset)


def top_groups(agg_df: DataFrame, by: str = "average_salary", n: int = 10,
               keys: Sequence[str] = ()) -> DataFrame:
    """Best ``n`` groups by a measure, group key as tie-break."""
    return agg_df.orderBy(F.col(by).desc_nulls_last(),
                          *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


# ---------------------------------------------------------------------------
# Keyset (cursor) paging
# ---------------------------------------------------------------------------

def cursor_column(keys: list[tuple[str, str]]) -> Column:
    """Opaque cursor of a row: base64 of the JSON array of its sort values + id."""
    vals = [F.col(c).cast("string") for c, _ in keys] + [F.col("id").cast("string")]
    return F.base64(F.to_json(F.array(*vals)).cast("binary"))


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.b64decode(cursor).decode("utf-8"))


def _after(df: DataFrame, keys: list[tuple[str, str]], values: list) -> Column:
    """Rows strictly after ``values`` in the (keys, id) order."""
    types = dict(df.dtypes)
    spec = keys + [("id", "ASC")]
    disjuncts, prefix_eq = [], None
    for (c, d), v in zip(spec, values):
        x = F.col(c)
        lit = F.lit(v).cast(types[c]) if v is not None else None
        if d == "DESC":  # nulls first
            gt = x.isNotNull() if v is None else (x < lit)
        else:            # nulls last
            gt = F.lit(False) if v is None else ((x > lit) | x.isNull())
        eq = x.isNull() if v is None else (x == lit)
        term = gt if prefix_eq is None else (prefix_eq & gt)
        disjuncts.append(term)
        prefix_eq = eq if prefix_eq is None else (prefix_eq & eq)
    out = disjuncts[0]
    for t in disjuncts[1:]:
        out = out | t
    return out


def page_after(df: DataFrame, sort: SortSpec | None = None, cursor: str | None = None,
               limit: int | None = None) -> DataFrame:
    """The page after ``cursor`` (None: first page); rows carry ``cursor``."""
    keys = sort_keys(df, sort)
    if cursor:
        df = df.where(_after(df, keys, decode_cursor(cursor)))
    return (df.orderBy(*_order(keys)).limit(clamp_limit(limit))
              .withColumn("cursor", cursor_column(keys)))
