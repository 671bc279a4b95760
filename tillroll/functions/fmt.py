"""Text formats used by the reports.

Only the three PostgreSQL masks the scripts use are covered:
``TO_CHAR(d, 'YYYY-MM')``, ``TO_CHAR(x, 'FM$999,999,999,990.00')`` and
``TO_CHAR(d, 'IYYY-"W"IW')``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_month_label(c) -> Column:
    """'YYYY-MM' of a date or timestamp."""
    return F.date_format(_col(c), "yyyy-MM")


def currency_text(c) -> Column:
    """'$1,234.50' style text; negative as '$-5.50'; NULL stays NULL.

    The value is rounded half-up to cents first (numeric rounding), since
    format_number alone rounds half-even. The 12-digit overflow of the
    original mask is not emulated.
    """
    return F.concat(F.lit("$"), F.format_number(F.round(_col(c), 2), 2))


def iso_week_label(c) -> Column:
    """ISO week label 'YYYY-Www' (ISO week-numbering year, zero padded)."""
    d = _col(c)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def hour_window_label(start, end) -> Column:
    """'HH:00-HH:00' label of an hour window."""
    return F.concat(
        F.lpad(_col(start).cast("string"), 2, "0"), F.lit(":00-"),
        F.lpad(_col(end).cast("string"), 2, "0"), F.lit(":00"),
    )
