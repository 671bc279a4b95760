"""Column helpers shared by the reports."""

from tillroll.functions.clock import date_plus_time, hour_of
from tillroll.functions.fmt import (
    currency_text,
    hour_window_label,
    iso_week_label,
    year_month_label,
)
from tillroll.functions.order import pg_asc, pg_desc, total_order

__all__ = [
    "currency_text", "date_plus_time", "hour_of", "hour_window_label",
    "iso_week_label", "pg_asc", "pg_desc", "total_order", "year_month_label",
]
