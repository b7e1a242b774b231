"""Time arithmetic on microseconds since 1970-01-01 UTC; independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
#: Stands for "still open" in computed bounds; larger than any timestamp.
OPEN_US = (1 << 63) - 1


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds of a timestamp; integers pass through. A timestamp without a zone counts as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp"))
    return column.cast("bigint")


def month_of(us: Column) -> Column:
    """Months since year 0 (12 * year + month - 1) of a number of microseconds."""
    day = F.date_from_unix_date(F.floor(us / F.lit(DAY_US)).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_start(month: Column) -> Column:
    """Microseconds at the start of a month numbered as in `month_of`."""
    year = F.floor(month / 12).cast("int")
    return F.unix_date(F.make_date(year, (month - year * 12 + 1).cast("int"), F.lit(1))).cast("bigint") * F.lit(DAY_US)


def month_label(month: Column) -> Column:
    """`YYYY-MM` of a month numbered as in `month_of`."""
    year = F.floor(month / 12).cast("int")
    return F.format_string("%04d-%02d", year, (month - year * 12 + 1).cast("int"))
