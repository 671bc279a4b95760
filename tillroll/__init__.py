"""tillroll: retail and customer analytics reports as Spark DataFrame jobs.

Every report is a function from DataFrames to a DataFrame, built from
Spark's own operators so Catalyst can prune, push down and plan it.
Literals of the original scripts (thresholds, dates, item names) are
arguments.

Modules:
    sources    -- reading tables, fixture views over the synthetic tables, calendar
    functions  -- column helpers: PostgreSQL-style null ordering, text formats, time parts
    operators  -- the reports: ranking, quality, stats, pricing, grain, lifetime
    plans      -- multi-step jobs (session pipelines, the full-refresh lifetime table)
    sinks      -- typed result tables, staged refresh, snapshots
"""

__version__ = "0.1.0"
