"""Timestamp parsing and calendar expressions.

All results are ``TIMESTAMP_NTZ`` wall clocks; arithmetic on them does not
depend on the session time zone. Texts are checked by shape first and parsed with
``try_*`` forms, so dirty input gives null instead of failing the job under
ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework import constants as K

# Shapes of the accepted texts. Anything else is null, whatever a lenient
# cast would make of it.
_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?"
_OFFSET = r"([+-]\d{2}(:?\d{2}(:?\d{2})?)?)"
_NAIVE = rf"^{_DATE}([T ]\d{{2}}(:\d{{2}}(:\d{{2}})?)?)?$"
_WITH_OFFSET = rf"^{_DATE}([T ]{_CLOCK}(Z|{_OFFSET})?)?$"
_INSTANT = rf"^{_DATE}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}(:?\d{{2}})?)?)?$"
_ZONE_AT_END = r"T.*(Z|[+-]\d{2}(:?\d{2})?)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clock(day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Wall clock from text parts, null when there is no such day or time."""
    text = F.concat(day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second)
    return text.try_cast("timestamp_ntz")


def _part(c: Column, at: int) -> Column:
    """Two digits at ``at``, ``00`` past the end of the text."""
    return F.when(F.length(c) >= at + 1, F.substring(c, at, 2)).otherwise(F.lit("00"))


def parse_compact(c) -> Column:
    """``yyyyMMddHHmmss`` text -> timestamp_ntz, null when it does not parse."""
    c = _col(c)
    day = F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-"), F.substring(c, 7, 2))
    return F.when(c.rlike(r"^\d{14}$"), _clock(day, F.substring(c, 9, 2), F.substring(c, 11, 2), F.substring(c, 13, 2)))


def parse_iso_naive(c) -> Column:
    """ISO text with every ``Z`` removed and cut at the first ``.``; a
    leftover UTC offset is a failure (null), as a naive/aware mix is."""
    x = F.substring_index(F.replace(_col(c), F.lit("Z"), F.lit("")), ".", 1)
    return F.when(x.rlike(_NAIVE), _clock(F.left(x, F.lit(10)), _part(x, 12), _part(x, 15), _part(x, 18)))


def parse_instant_utc(c) -> Column:
    """ISO text with zone (``Z`` or offset; none means UTC) -> UTC wall clock
    (ntz). The instant is counted from the epoch, so the session time zone
    plays no part."""
    c = _col(c)
    zoned = F.when(c.rlike(_ZONE_AT_END), c).when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z")))
    micros = F.unix_micros(F.when(c.rlike(_INSTANT), F.try_to_timestamp(zoned)))
    # Whole days apart from the rest of the day: no number grows large.
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    rest = micros - day.cast("long") * F.lit(86_400_000_000)
    seconds = (rest.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=day, secs=seconds)


def parse_filing_utc(c) -> Column:
    """Filing date in either of its two formats (compact or ISO) -> UTC wall clock."""
    return F.coalesce(parse_compact(c), parse_instant_utc(c))


def to_local(ts_utc) -> Column:
    """UTC wall clock -> America/Sao_Paulo wall clock (DST-aware)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(K.LOCAL_TIME_ZONE), _col(ts_utc))


def local_offset_text(ts_utc) -> Column:
    """Zone offset of the local time at that instant, as ``-03:00``."""
    local = to_local(ts_utc)
    minutes = F.timestamp_diff("MINUTE", _col(ts_utc), local)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(minutes)
    return F.concat(sign, F.lpad((a / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((a % 60).cast("string"), 2, "0"))


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored (a 12 h negative gap is -1)."""
    secs = F.timestamp_diff("SECOND", _col(start), _col(end))
    return F.floor(secs / F.lit(86400)).cast("int")


def iso_hour(c) -> Column:
    """Hour as written in an ISO text (its own offset), 0 for a date alone,
    null when the text is not a valid timestamp. One test of the shape, which
    also bounds hour, minute and second, and one of the day; the hour then stands
    at a fixed place."""
    c = _col(c)
    hour = F.when(F.length(c) == 10, F.lit(0)).otherwise(F.substring(c, 12, 2).try_cast("int"))
    return F.when(c.rlike(_WITH_OFFSET) & F.left(c, F.lit(10)).try_cast("date").isNotNull(), hour)


def format_ts(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(c), fmt)
