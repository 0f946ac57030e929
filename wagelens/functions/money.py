"""Money helpers (values are stored as BIGINT cents)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round4(c) -> Column:
    """Round half up to 4 places with plain IEEE arithmetic.

    Written as ``floor(x * 10000 + 0.5) / 10000`` so that the DuckDB oracle
    can spell the very same operations (see ``ROUND4_SQL``).
    """
    return F.floor(_c(c) * 10000 + 0.5) / 10000


def round4_sql(expr: str) -> str:
    return f"(floor(({expr}) * 10000 + 0.5) / 10000)"


def scale_cents(c) -> Column:
    """cents -> dollars as double (``annual_base_pay / 100``)."""
    return _c(c).cast("double") / F.lit(100.0)


def cents_to_dollars(c) -> Column:
    """NULL or 0 -> NULL, else dollars rounded half up."""
    c = _c(c)
    return F.when(c != 0, F.floor(c / F.lit(100.0) + 0.5).cast("long"))


def format_currency(c) -> Column:
    """NULL or 0 -> NULL, else ``$1,234`` (whole dollars, half up)."""
    c = _c(c)
    dollars = F.floor(F.abs(c) / F.lit(100.0) + 0.5).cast("long")  # half away from zero
    # format_number alone rounds half-even; the value is already whole
    body = F.concat(F.lit("$"), F.format_number(dollars, 0))
    return F.when(c > 0, body).when(c < 0, F.concat(F.lit("-"), body))


def total_compensation(base="annual_base_pay", bonus="annual_bonus", stock="stock_value") -> Column:
    """base + bonus + stock, NULL counted as 0 (signing bonus excluded)."""
    return (F.coalesce(_c(base), F.lit(0)) + F.coalesce(_c(bonus), F.lit(0))
            + F.coalesce(_c(stock), F.lit(0))).cast("long")
