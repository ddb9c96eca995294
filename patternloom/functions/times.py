"""Times as arguments and as text, and fields of query strings. Nothing here depends on the session's time zone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"^(\d{4})-(\d\d)-(\d\d)[ T](\d\d):(\d\d):(\d\d)(?:\.(\d{6}))?([+-]\d\d:\d\d)?"
_DATE = r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2})\s*$"
_LOCAL = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used: else each use repeats its whole expression."""
    return F.transform(F.array(value), use)[0]


def _instant(text: Column, pattern: str, zone: Column, seconds: Column) -> Column:
    """Microseconds of the first five fields and the seconds of a text; null where it doesn't match or no such time exists."""
    part = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, 6)]
    return F.unix_micros(F.try_make_timestamp(*part, seconds.try_cast("decimal(8,6)"), zone))


def parse_time(text: Column, zone: str = "UTC") -> Column:
    """Microseconds of ``YYYY-MM-DD HH:MM:SS[.ffffff][+HH:MM]`` (or with ``T``), in ``zone`` where no offset is given.

    A fraction counts with six digits only; what follows the time is ignored. Null for other texts.
    """

    def instant(text: Column) -> Column:
        offset = F.regexp_extract(text, _TIME, 8)
        seconds = F.concat(F.regexp_extract(text, _TIME, 6), F.lit("."), F.rpad(F.regexp_extract(text, _TIME, 7), 6, "0"))
        return _instant(text, _TIME, F.when(offset != "", offset).otherwise(F.lit(zone)), seconds)

    return _once(text, instant)


def format_time(epoch_us: Column, zone: str = "UTC") -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff+HH:MM`` of microseconds in a zone; null for null."""
    utc = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch_us / F.lit(86_400_000_000)).cast("int")).cast("timestamp_ntz")
    utc = utc + F.make_dt_interval(secs=(F.pmod(epoch_us, F.lit(86_400_000_000)) / F.lit(1_000_000)).cast("decimal(18,6)"))

    def shown(local: Column) -> Column:
        seconds = F.unix_date(local.cast("date")).cast("long") * 86_400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
        minutes = F.round((seconds - F.floor(epoch_us / F.lit(1_000_000))) / 60).cast("int")
        return F.concat(_once(local.cast("string"), clock), _once(minutes, offset))

    def clock(text: Column) -> Column:
        return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))

    def offset(minutes: Column) -> Column:
        size = F.abs(minutes)
        return F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), size % 60)

    return F.when(epoch_us.isNotNull(), _once(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), shown))


def parse_date(text: Column, zone: str = "UTC") -> Column:
    """Seconds of ``YYYY/MM/DD HH:MM`` in a zone; null for other texts."""
    return _once(text, lambda t: F.floor(_instant(t, _DATE, F.lit(zone), F.lit("0")) / 1_000_000))


def parse_loose(text: Column, zone: str = "UTC") -> Column:
    """Seconds of ``YYYY-MM-DD HH:MM:SS`` in a zone, or of a whole number (decimal, ``0x`` or with a leading 0 octal); -1 for other texts."""
    number = r"^\s*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9]\d*)$"

    def seconds(text: Column) -> Column:
        digits = F.regexp_extract(text, r"^\s*[+-]?(?:0[xX])?(\w+)$", 1)
        base10 = F.when(text.rlike("0[xX]"), F.conv(digits, 16, 10)).when(digits.startswith("0"), F.conv(digits, 8, 10)).otherwise(digits).try_cast("long")
        signed = F.when(F.regexp_extract(text, number, 1) == "-", -base10).otherwise(base10)
        time = F.floor(_instant(text, _LOCAL, F.lit(zone), F.regexp_extract(text, _LOCAL, 6)) / 1_000_000)
        return F.when(text.isNotNull(), F.coalesce(time, F.when(text.rlike(number), signed), F.lit(-1).cast("long")))

    return _once(text, seconds)


def query_fields(text: Column) -> Column:
    """``array<struct<name, value>>`` of ``a=1&b=x%20y`` in order: names and values decoded, a value null where there is no ``=`` or where it can't be decoded."""

    def one(pair: Column) -> Column:
        cut = F.locate("=", pair)
        name = F.when(cut > 0, F.substr(pair, F.lit(1), cut - 1)).otherwise(pair)
        value = F.when(cut > 0, F.substr(pair, cut + 1))
        return F.struct(F.try_url_decode(name).alias("name"), F.try_url_decode(value).alias("value"))

    return F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), one)
