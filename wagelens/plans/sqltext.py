"""SQL text for the DuckDB oracle of the named queries.

Only test tooling: the Spark side never goes through SQL text.  The pieces
mirror the conventions of ``operators/stats.py`` (round half up to 4 places
written as IEEE arithmetic, money averages from exact integer sums).
"""

from __future__ import annotations

from ..functions.money import round4_sql as r4
from ..sources.tables import with_pay

PAY_D = "CAST(annual_base_pay AS DOUBLE) / 100"


def pct(p: float, expr: str = PAY_D) -> str:
    return f"percentile_cont({p}) WITHIN GROUP (ORDER BY {expr})"


def m5_select(keys: list[str], *, count_name="count", avg_name="average_salary",
              min_name="min_salary_cents", max_name="max_salary_cents",
              min_max_dollars=False, pcts=((0.5, "median_salary"),), extra: str = "") -> str:
    lo, hi = "min(annual_base_pay)", "max(annual_base_pay)"
    if min_max_dollars:
        lo, hi = r4(f"{lo} / 100.0"), r4(f"{hi} / 100.0")
    cols = [*keys, f"count(*) AS {count_name}", f"{r4('avg(annual_base_pay) / 100')} AS {avg_name}"]
    cols += [f"{r4(pct(p))} AS {n}" for p, n in pcts]
    cols += [f"{lo} AS {min_name}", f"{hi} AS {max_name}"]
    if extra:
        cols.append(extra)
    return "SELECT " + ", ".join(cols)


def m5_query(keys: list[str], where: str, *, having: str | None = None, top: int | None = None,
             **kw) -> str:
    sel = m5_select(keys, **kw)
    sql = f"{sel}\nFROM pay WHERE {where}"
    if keys:
        sql += "\nGROUP BY " + ", ".join(keys)
    if having:
        sql += f"\nHAVING {having}"
    if keys:
        order = ", ".join(["avg(annual_base_pay) DESC"] + [f"{k} ASC NULLS LAST" for k in keys])
        sql += f"\nORDER BY {order}"
    if top is not None:
        sql += f"\nLIMIT {top}"
    return with_pay(sql)


__all__ = ["m5_query", "m5_select", "pct", "r4", "with_pay", "PAY_D"]
