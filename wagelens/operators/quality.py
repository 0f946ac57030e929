"""Data quality and dimension tables.

Dimension builders pick one attribute value per name with ``min_by`` over
pre-aggregated counts (partial aggregation, skew-safe) instead of a window
per name.  Surrogate keys are deterministic hashes of the natural key, so
reruns and task retries produce the same ids.  Dimensions grow with the
data, so the star join leaves the broadcast decision to AQE's runtime size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TITLE_CATEGORIES, TITLE_SENIORITY, VARCHAR_LIMITS
from ..session import scratch_path
from .search import normalize_title

#: validation rules beyond the table constraints
PAY_MIN_CENTS = 100_000          # $1,000
PAY_MAX_CENTS = 1_000_000_000    # $10,000,000
EXPERIENCE_MAX = 60
ALERT_RATE = 0.05


def validation_rules(df: DataFrame) -> dict[str, Column]:
    """Named failure predicates (NULL-safe: a NULL value does not fail)."""
    c = F.col
    rules = {
        "pay_negative": c("annual_base_pay") < 0,
        "pay_out_of_bounds": (c("annual_base_pay") < PAY_MIN_CENTS) | (c("annual_base_pay") > PAY_MAX_CENTS),
        "experience_negative": c("years_experience_industry") < 0,
        "experience_above_60": c("years_experience_industry") > EXPERIENCE_MAX,
    }
    if "actual_hours_per_week" in df.columns:
        rules["hours_out_of_range"] = (c("actual_hours_per_week") < 0) | (c("actual_hours_per_week") > 168)
    for name, n in VARCHAR_LIMITS.items():
        if name in df.columns:
            rules[f"{name}_too_long"] = F.length(c(name)) > n
    return rules


def validation_report(df: DataFrame, alert_rate: float = ALERT_RATE) -> DataFrame:
    """Per-rule failures, rate and alert flag (one pass, then unpivot)."""
    rules = validation_rules(df)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"f_{n}") for n, p in rules.items()])
    stacked = agg.select("_total", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failures")) for n in rules
    ])).alias("r"))
    rate = F.when(F.col("_total") > 0, F.col("r.failures") / F.col("_total"))
    return stacked.select(F.col("r.rule").alias("rule"), F.col("r.failures").alias("failures"),
                          F.col("_total").alias("total"), (F.floor(rate * 1000000 + 0.5) / 1000000).alias("failure_rate"),
                          (F.coalesce(rate, F.lit(0.0)) > alert_rate).alias("alert"))


def _pick(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Most frequent non-null ``attr`` per ``key`` (ties: smallest value)."""
    counts = (df.where(F.col(key).isNotNull() & F.col(attr).isNotNull())
                .groupBy(key, attr).agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(key).agg(
        F.min_by(F.col(attr), F.struct((-F.col("_n")).alias("n"), F.col(attr).alias("v"))).alias(attr))


def surrogate_key(col: str) -> Column:
    """Key of a dimension row from its natural key; 256 bits, since 64 collide among billions of names."""
    return F.sha2(F.col(col).cast("binary"), 256)


def build_companies(df: DataFrame) -> DataFrame:
    """One row per employer with its most frequent industry / size / sector."""
    names = df.where(F.col("employer").isNotNull()).select(F.col("employer").alias("name")).distinct()
    out = names
    for attr, out_name in (("industry", "industry"), ("company_size", "size_category"),
                           ("public_private", "public_private")):
        if attr in df.columns:
            picked = _pick(df, "employer", attr).withColumnRenamed("employer", "name") \
                                                 .withColumnRenamed(attr, out_name)
            out = out.join(picked, "name", "left")
        else:
            out = out.withColumn(out_name, F.lit(None).cast("string"))
    return out.select(surrogate_key("name").alias("company_id"), "name", "industry", "size_category",
                      (F.lower("public_private") == "public").alias("is_public"))


def split_location(col) -> dict[str, Column]:
    parts = F.split(F.col(col) if isinstance(col, str) else col, ",")
    def part(i):
        return F.when(F.size(parts) > i, F.nullif(F.trim(parts.getItem(i)), F.lit("")))
    return {"city": part(0), "state_province": part(1), "country": part(2)}


def build_locations(df: DataFrame) -> DataFrame:
    """Distinct locations split on commas into city / state / country."""
    loc = df.where(F.col("location").isNotNull()).select(F.col("location").alias("full_location")).distinct()
    p = split_location("full_location")
    return loc.select(surrogate_key("full_location").alias("location_id"),
                      p["city"].alias("city"), p["state_province"].alias("state_province"),
                      p["country"].alias("country"), "full_location",
                      F.lit(None).cast("decimal(10,8)").alias("latitude"),
                      F.lit(None).cast("decimal(11,8)").alias("longitude"))


def _rule_label(text: Column, rules, default: str) -> Column:
    out = None
    for label, pattern in rules:
        cond = text.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def title_category(col) -> Column:
    return _rule_label(F.lower(F.col(col) if isinstance(col, str) else col), TITLE_CATEGORIES, "Other")


def title_seniority(col) -> Column:
    return _rule_label(F.lower(F.col(col) if isinstance(col, str) else col), TITLE_SENIORITY, "Mid")


def build_job_titles(df: DataFrame) -> DataFrame:
    """Distinct titles with normalised form, category and seniority."""
    t = df.where(F.col("job_title").isNotNull()).select(F.col("job_title").alias("title")).distinct()
    return t.select(surrogate_key("title").alias("job_title_id"), "title",
                    normalize_title("title").alias("normalized_title"),
                    title_category("title").alias("category"),
                    title_seniority("title").alias("seniority_level"))


def load_dimension(dim: DataFrame) -> DataFrame:
    """A dimension written once to the shared folder and read back.

    Every join that follows reads it instead of building it again, and knows
    its size from its files: the facts are not shuffled for a small one.
    """
    path = scratch_path(dim.sparkSession, f"dimension-{uuid.uuid4().hex}")
    dim.write.parquet(path)
    return dim.sparkSession.read.schema(dim.schema).parquet(path)


def normalize_employer(col) -> Column:
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    c = F.regexp_replace(c, r"[.,]", "")
    c = F.regexp_replace(c, r"\s+(inc|llc|ltd|corp|corporation|co|company)$", "")
    return F.regexp_replace(c, r"\s+", " ")


def normalize_location(col) -> Column:
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    c = F.regexp_replace(c, r"\s*,\s*", ", ")
    return F.initcap(F.regexp_replace(c, r"\s+", " "))


def normalize_record(df: DataFrame) -> DataFrame:
    """Bounded pay, normalised location / title / employer columns."""
    pay = F.col("annual_base_pay")
    return df.withColumns({
        "annual_base_pay_bounded": F.when((pay >= PAY_MIN_CENTS) & (pay <= PAY_MAX_CENTS), pay),
        "location_normalized": normalize_location("location"),
        "job_title_normalized": normalize_title("job_title"),
        "employer_normalized": normalize_employer("employer"),
    })


def deduplicate(df: DataFrame, keys: Sequence[str] | None = None,
                order: Sequence[str] = ("source_file", "row_number", "id")) -> DataFrame:
    """One row per group of equal normalised keys; the lowest ``order`` wins.

    Uses ``min_by`` in a grouped aggregation (partial aggregation), so a group
    with a huge number of copies is combined map-side, not in one task.
    """
    if keys is None:
        df = normalize_record(df)
        keys = ["employer_normalized", "job_title_normalized", "location_normalized",
                "annual_base_pay", "timestamp"]
    order = [o for o in order if o in df.columns]
    payload = F.struct(*[F.col(c) for c in df.columns])
    ordering = F.struct(*[F.col(o) for o in order])
    return (df.groupBy(*[F.col(k) for k in keys])
              .agg(F.min_by(payload, ordering).alias("_row"))
              .select("_row.*"))


def star_join(pay: DataFrame, companies: DataFrame, locations: DataFrame,
              titles: DataFrame) -> DataFrame:
    """Attach dimension keys to the facts (left joins on natural keys)."""
    # dimensions grow with the data: one is broadcast only when its size, from
    # its files (``load_dimension``) or AQE, is under the threshold, otherwise the join shuffles
    comp = companies.select(F.col("name").alias("employer"), "company_id")
    locs = locations.select(F.col("full_location").alias("location"), "location_id")
    tits = titles.select(F.col("title").alias("job_title"), "job_title_id")
    return (pay.join(comp, "employer", "left").join(locs, "location", "left")
               .join(tits, "job_title", "left"))
