"""Sizes, times, speeds and dates as text for people, and sizes back from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in rising order, each 1024 of the one before; a fixed list of the format.
UNITS = ("", "k", "M", "G", "T", "E")
MORE_THAN_ALL = "more"


def human_size(size: Column, item: str = "B") -> Column:
    """The size divided down by 1024 (floor) to below 1024, its unit and the item; no number beyond the last unit."""
    out = F.lit(MORE_THAN_ALL)
    for power in reversed(range(len(UNITS))):
        part = F.concat(F.shiftright(size, 10 * power).cast("string"), F.lit(UNITS[power]))
        out = F.when(size < (1 << 10 * (power + 1)), part).otherwise(out)
    return F.concat(out, F.lit(item))


def human_size_strict(size: Column, item: str = "B") -> Column:
    """As ``human_size``, but divided only as long as 1024 divides the size."""
    out = F.concat(F.shiftright(size, 50).cast("string"), F.lit(UNITS[5]))
    for power in reversed(range(5)):
        part = F.shiftright(size, 10 * power)
        out = F.when((part < 1024) | (part % 1024 != 0), F.concat(part.cast("string"), F.lit(UNITS[power]))).otherwise(out)
    return F.concat(out, F.lit(item))


def parsed_size(text: Column, item: str = "B") -> Column:
    """A number, an optional unit and the item as a size; null if it is no such text."""
    pattern = rf"^([0-9]{{1,18}})([kMGTE]?){item}$"
    value, unit = F.regexp_extract(text, pattern, 1).try_cast("bigint"), F.regexp_extract(text, pattern, 2)
    out = value
    for power, name in enumerate(UNITS[1:], 1):
        out = F.when(unit == name, F.shiftleft(value, 10 * power)).otherwise(out)
    return out


def _rounded(value: Column, digits: int) -> Column:
    """Rounded half to even, without trailing zeros."""
    text = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return F.regexp_replace(text, r"\.?0+$", "")


def human_time(msec: Column) -> Column:
    """Milliseconds below a second, else seconds (2 digits), minutes, hours or days (1 digit); a week or more as days and a clock."""
    value = msec.cast("double")
    days = F.floor(value / 86_400_000).cast("string")
    clock = F.date_format(F.timestamp_millis((msec % 86_400_000).cast("bigint")), "HH:mm:ss")
    return (
        F.when(value < 1000, F.concat(F.floor(value).cast("string"), F.lit("msec")))
        .when(value < 60_000, F.concat(_rounded(value / 1000, 2), F.lit("sec")))
        .when(value < 3_600_000, F.concat(_rounded(value / 60_000, 1), F.lit("min")))
        .when(value < 86_400_000, F.concat(_rounded(value / 3_600_000, 1), F.lit("hrs")))
        .when(value < 604_800_000, F.concat(_rounded(value / 86_400_000, 1), F.lit("days")))
        .otherwise(F.concat(days, F.lit("."), clock))
    )


def human_speed(count: Column, seconds: Column, item: str = "B") -> Column:
    """Items a second with two digits, in thousandths (of 1024) below 0.1 and in rising units from 1024 on."""
    rate = count.cast("double") / seconds
    text = lambda v, unit: F.concat(F.format_string("%.2f", F.bround(v, 2)), F.lit(f"{unit}{item}/s"))
    out = text(rate / 1024.0**4, "T")
    for power, unit in ((3, "G"), (2, "M"), (1, "k"), (0, "")):
        out = F.when(rate < 1024.0 ** (power + 1), text(rate / 1024.0**power, unit)).otherwise(out)
    return F.when(rate < 0.1, text(rate * 1024.0, "m")).otherwise(out)


def _joined(ts: Column, formats: list[str], separator: str) -> Column:
    return F.concat_ws(separator, *[F.date_format(ts, f) for f in formats])


def date_name(ts: Column, separator: str = "") -> Column:
    return _joined(ts, ["yyyy", "MM", "dd"], separator)


def time_name(ts: Column, separator: str = "") -> Column:
    return _joined(ts, ["HH", "mm", "ss", "SSS"], separator)
