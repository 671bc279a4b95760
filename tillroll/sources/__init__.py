"""Inputs: table reads, fixture views and the calendar."""

from tillroll.sources import views
from tillroll.sources.calendar import date_dimension, date_key, day_weeks, week_list, week_tables
from tillroll.sources.tables import TABLES, materialize, read_table

__all__ = ["TABLES", "date_dimension", "date_key", "day_weeks", "materialize", "read_table",
           "views", "week_list", "week_tables"]
