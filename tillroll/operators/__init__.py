"""The reports, one function per job of the original scripts."""

from tillroll.operators.grain import first_week_mismatch, grain_violations, orphan_rows
from tillroll.operators.lifetime import (
    SINK_COLUMNS,
    SINK_DDL,
    conversion_base,
    conversion_order,
    customer_weekly_lifetime,
    reconcile,
    weekly_orders,
    weekly_spine,
)
from tillroll.operators.numbering import group_row_number
from tillroll.operators.pricing import price_changes, price_effective_months
from tillroll.operators.quality import (
    datetime_mismatch_count,
    drill_down,
    duplicate_groups,
    null_profile,
    rows_sharing_key,
)
from tillroll.operators.ranking import (
    best_adjacent_hours,
    peak_hour,
    revenue_by_month,
    tickets_with_min_items,
    top_items,
    top_items_by_month,
    top_items_price_breakdown,
    top_ticket_lines,
)
from tillroll.operators.stats import (
    equi_width_histogram,
    exact_percentiles,
    summary_stats,
    value_counts,
)

__all__ = [
    "SINK_COLUMNS", "SINK_DDL", "best_adjacent_hours", "conversion_base",
    "conversion_order", "customer_weekly_lifetime", "datetime_mismatch_count",
    "drill_down", "duplicate_groups", "equi_width_histogram", "exact_percentiles",
    "first_week_mismatch", "grain_violations", "group_row_number", "null_profile",
    "orphan_rows", "peak_hour", "price_changes", "price_effective_months",
    "reconcile", "revenue_by_month", "rows_sharing_key", "summary_stats",
    "tickets_with_min_items", "top_items", "top_items_by_month",
    "top_items_price_breakdown", "top_ticket_lines", "value_counts",
    "weekly_orders", "weekly_spine",
]
