"""Times and panes as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's time zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * DAY + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds


def floored(x: Column, by: int) -> Column:
    """floor(x / by) of integers, exact: Spark's / would go through doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def pane(t: Column, window: int, panes: int) -> Column:
    """The pane of an integer time on the grid of window / panes, which need not be an integer."""
    return floored(t.cast("long") * panes, window)
