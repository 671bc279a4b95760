import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import local_session

    warehouse = tempfile.mkdtemp(prefix="tillroll-wh-")
    s = local_session(cores=4, partitions=4, app="tillroll-tests",
                      extra={"spark.sql.warehouse.dir": warehouse,
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


def D(x):
    return Decimal(str(x))


def d(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


SALES_SCHEMA = ("ticket_number long, sale_date date, sale_time string, sale_datetime timestamp_ntz, "
                "article string, quantity int, unit_price decimal(12,2)")


def sales(spark, rows):
    """rows: (ticket, date, time, article, qty, price); datetime derived."""
    full = []
    for t, day, tm, art, q, p in rows:
        day_v = d(day) if isinstance(day, str) else day
        stamp = ts(f"{day} {tm}") if (day and tm) else None
        full.append((t, day_v, tm, stamp, art, q, None if p is None else D(p)))
    return spark.createDataFrame(full, SALES_SCHEMA)
