"""Time-of-day helpers.

A sale time may be a TIME column (``spark.sql.timeType.enabled``) or text
'HH:mm:ss'. Which expression is built depends on the column's type, read
from the DataFrame schema at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type_name(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.typeName()


def hour_of(df: DataFrame, col: str) -> Column:
    """Hour of day (int) of a time, timestamp or 'HH:mm:ss' text column."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return F.substring_index(F.col(col), ":", 1).cast("int")
    return F.hour(F.col(col))


def date_plus_time(df: DataFrame, date_col: str, time_col: str) -> Column:
    """DATE + TIME as TIMESTAMP_NTZ (PostgreSQL ``date::timestamp + time``)."""
    if isinstance(df.schema[time_col].dataType, T.StringType):
        # concat (not concat_ws): a NULL date or time gives a NULL timestamp.
        text = F.concat(F.col(date_col).cast("string"), F.lit(" "), F.col(time_col))
        return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    if _type_name(df, time_col) == "time":
        return F.make_timestamp_ntz(date=F.col(date_col), time=F.col(time_col))
    raise TypeError(f"{time_col}: expected TIME or 'HH:mm:ss' text")
