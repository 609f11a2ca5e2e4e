"""Mixed timestamps to UTC instants; durations; time windows."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import as_col, bind_sql, let, text_sql
from pagesift.functions.text import u_strip, u_strip_sql

# The fields of a record that hold its time, in the order in which they are asked.
TIME_FIELDS = [
    "published_at",
    "published_at_utc",
    "publish_time",
    "publishTimestamp",
    "timestamp",
    "time",
    "fetched_at",
]

# ISO 8601, extended or compact, with any one character before the clock.
# Groups: 1 year, 3 month, 4 day, 5 hour, 7 minute, 8 second, 9 fraction, 10 zone.
_ISO = (
    r"^(?!0000)(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\6([0-5]\d)(?:[.,](\d+))?)?)?"
    r"(Z|[+-](?:0\d|1[0-7])(?::?[0-5]\d)?)?|Z)?$"
)
_ISO_WEEK = r"^(?!0000)(\d{4})(-?)W(\d{2})(?:\2([1-7]))?$"
# One or two digits per part, dashes or slashes; the year may be missing.
_LOOSE = r"^(?:(?!0000)(\d{4})([-/]))?(\d{1,2})([-/])(\d{1,2})(?:\s+([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d))?)?$"


def _parts_sql(text: str, pattern: str, groups: list[int]) -> str:
    """The wanted groups of a matching text as one array, in one regex pass."""
    wanted = text_sql("|".join(f"${g}" for g in groups))
    return f"split(regexp_replace({text}, {text_sql(pattern)}, {wanted}), {text_sql('[|]')}, -1)"


def _int_sql(part: int, default: int = 0) -> str:
    return f"coalesce(cast(nullif(p[{part}], '') as int), {default})"


def _if_matches_sql(text: str, pattern: str, groups: list[int], body: str) -> str:
    parts = bind_sql("p", _parts_sql(text, pattern, groups), body)
    return f"if(rlike({text}, {text_sql(pattern)}), {parts}, null)"


def _iso_sql(text: str, tz: str) -> str:
    seconds = "cast(concat(lpad(p[5], 2, '0'), '.', rpad(substring(p[6], 1, 6), 6, '0')) as decimal(16,6))"
    zone = f"""case when p[7] = '' then {tz} when p[7] = 'Z' then 'UTC'
      when length(p[7]) = 3 then concat(p[7], ':00')
      else concat(left(p[7], 3), ':', right(p[7], 2)) end"""
    return _if_matches_sql(
        text,
        _ISO,
        [1, 3, 4, 5, 7, 8, 9, 10],
        f"try_make_timestamp({', '.join(_int_sql(i) for i in range(5))}, {seconds}, {zone})",
    )


def _iso_week_sql(text: str, tz: str) -> str:
    # The first ISO week of a year is the one that holds 4 January.
    day = (
        f"date_add(cast(date_trunc('WEEK', make_date({_int_sql(0)}, 1, 4)) as date), "
        f"({_int_sql(1)} - 1) * 7 + {_int_sql(2, 1)} - 1)"
    )
    stamp = (
        f"if({_int_sql(1)} between 1 and 53 and weekofyear(d) = {_int_sql(1)}, "
        f"try_make_timestamp(year(d), month(d), day(d), 0, 0, cast(0 as decimal(16,6)), {tz}), null)"
    )
    return _if_matches_sql(text, _ISO_WEEK, [1, 3, 4], bind_sql("d", day, stamp))


def _loose_sql(text: str, tz: str, fallback_year: str) -> str:
    # Both marks agree; without a year a clock without seconds is required.
    known = "if(p[0] <> '', p[1] = p[3], p[5] <> '' and p[7] = '')"
    stamp = (
        f"try_make_timestamp(if(p[0] <> '', {_int_sql(0)}, {fallback_year}), "
        f"{', '.join(_int_sql(i) for i in (2, 4, 5, 6))}, cast({_int_sql(7)} as decimal(16,6)), {tz})"
    )
    return _if_matches_sql(text, _LOOSE, list(range(1, 9)), f"if({known}, {stamp}, null)")


def coerce_ts_sql(text: str, tz: str = "UTC", fallback_year: int | str | None = None) -> str:
    zone = text_sql(tz)
    year = "year(current_timestamp())" if fallback_year is None else str(fallback_year)
    tries = [_iso_sql("s", zone), _loose_sql("s", zone, year), _iso_week_sql("s", zone)]
    return bind_sql("s", u_strip_sql(text), f"coalesce({', '.join(tries)})")


def coerce_ts(text: str, tz: str = "UTC", fallback_year: int | str | None = None) -> Column:
    """String (a SQL expression) to instant; null if no known layout fits.

    ``tz`` is the zone of strings without one; ``fallback_year``, a year or a
    SQL expression, completes layouts without one (default: the current year).
    """
    return F.expr(coerce_ts_sql(text, tz, fallback_year))


def epoch_ts(col: Column | str) -> Column:
    """Epoch number to instant: above 1e12 it counts milliseconds."""
    number = as_col(col).cast("double")
    micros = F.round(F.when(number > 1e12, number * 1e3).otherwise(number * 1e6))
    return F.timestamp_micros(micros.try_cast("bigint"))


def record_ts(df: DataFrame, tz: str = "UTC", fallback_year: int | str | None = None) -> Column:
    """First usable time of a record over the time fields it has.

    Looks at columns first, then at keys of a ``fields`` map if there is one.
    """
    types = dict(df.dtypes)
    tries = []
    for name in TIME_FIELDS:
        kind = types.get(name)
        if kind == "timestamp":
            tries.append(F.col(name))
        elif kind == "timestamp_ntz":
            tries.append(ntz_instant(name, tz))
        elif kind in ("int", "bigint", "double", "float") or (kind or "").startswith("decimal"):
            tries.append(epoch_ts(name))
        elif kind == "string":
            tries.append(coerce_ts(name, tz, fallback_year))
        elif "fields" in types:
            tries.append(coerce_ts(f"fields['{name}']", tz, fallback_year))
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp")


def ntz_instant(col: Column | str, tz: str = "UTC") -> Column:
    """Zone-less timestamp read in ``tz``, independent of the session zone."""
    return F.convert_timezone(F.lit(tz), F.current_timezone(), as_col(col)).cast("timestamp")


def ntz_literal(value: datetime, tz: str = "UTC") -> Column:
    """An aware time as a zone-less literal in ``tz``, whatever the session's zone.

    Bounds in this form compare with a stored zone-less column as it is, so the
    comparison reaches the scan.
    """
    local = value.astimezone(ZoneInfo(tz)).replace(tzinfo=None)
    return F.lit(local.isoformat(sep=" ")).cast("timestamp_ntz")


def iso_utc(col: Column | str) -> Column:
    """ISO 8601 text in UTC with offset, microseconds only if there are any."""
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), as_col(col).cast("timestamp_ntz"))
    plain = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(local, "SSSSSS")
    return F.concat(
        plain,
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def epoch_ms_iso(col: Column | str) -> Column:
    millis = as_col(col).cast("double")
    return iso_utc(F.timestamp_micros(F.round(millis * 1e3).try_cast("bigint")))


# --- durations -------------------------------------------------------------

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration_spec(col: Column | str) -> Column:
    """'1d6h' or bare hours to seconds; null if malformed, not positive, or beyond 64 bits."""
    spec = F.lower(u_strip(col))

    def total(s: Column) -> Column:
        numbers = F.regexp_extract_all(s, F.lit(r"(\d+)([smhd])"), F.lit(1))
        units = F.regexp_extract_all(s, F.lit(r"(\d+)([smhd])"), F.lit(2))
        weight = F.create_map(*[F.lit(x) for pair in _UNIT_SECONDS.items() for x in pair])
        seconds = F.zip_with(numbers, units, lambda n, u: F.try_multiply(n.try_cast("bigint"), weight[u]))
        whole = F.aggregate(seconds, F.lit(0).cast("bigint"), lambda a, b: F.try_add(a, b))
        each_positive = F.forall(seconds, lambda x: x > 0)
        return (
            F.when(s.rlike(r"^\d+$"), F.nullif(F.try_multiply(s.try_cast("bigint"), F.lit(3600)), F.lit(0)))
            .when(s.rlike(r"^(\d+[smhd])+$"), F.when(each_positive, whole))
        )

    return let(spec, total)


def parse_duration(spec: str | None) -> timedelta:
    """Job parameter form of ``duration_spec``; no value means 24 hours."""
    if spec is None:
        return timedelta(hours=24)
    text = spec.strip().lower()
    if re.fullmatch(r"\d+", text):
        seconds = int(text) * 3600
    elif re.fullmatch(r"(\d+[smhd])+", text):
        pieces = re.findall(r"(\d+)([smhd])", text)
        if any(int(n) <= 0 for n, _ in pieces):
            raise ValueError(f"duration parts must be positive: {spec!r}")
        seconds = sum(int(n) * _UNIT_SECONDS[u] for n, u in pieces)
    else:
        raise ValueError(f"not a duration: {spec!r}")
    if seconds <= 0:
        raise ValueError(f"duration must be positive: {spec!r}")
    return timedelta(seconds=seconds)


# --- windows: plain literals, so the predicate reaches the scan -------------


def _utc(value: datetime | str) -> datetime:
    """An instant in UTC, of ISO text too; what has no zone is in UTC already."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip())
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def window_bounds(
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    duration: str | None = None,
    now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Both ends of a window of which at least one is given.

    A missing end lies a duration away from the other one. Only a window that
    is open towards the present ends there instead.
    """
    given = {-1: since, 1: until}
    ends = {side: _utc(value) for side, value in given.items() if value is not None}
    if not ends:
        raise ValueError("give since or until")
    if 1 not in ends and duration is None:
        ends[1] = _utc(now or datetime.now(timezone.utc))
    for side in given.keys() - ends.keys():
        ends[side] = ends[-side] + side * parse_duration(duration)
    if ends[-1] >= ends[1]:
        raise ValueError("window end must be after its start")
    return ends[-1], ends[1]


def daily_window(
    start_hhmm: str, duration: str | None = None, now: datetime | None = None, tz: str = "UTC"
) -> tuple[datetime, datetime]:
    """Today's local start time, yesterday's if it is still ahead."""
    match = re.fullmatch(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", start_hhmm.strip())
    if not match:
        raise ValueError(f"not a time of day: {start_hhmm!r}")
    hour, minute, second = (int(x or 0) for x in match.groups())
    local = _utc(now or datetime.now(timezone.utc)).astimezone(ZoneInfo(tz))
    anchor = local.replace(hour=hour, minute=minute, second=second, microsecond=0)
    if anchor > local:
        anchor -= timedelta(days=1)
    return anchor.astimezone(timezone.utc), (anchor + parse_duration(duration)).astimezone(
        timezone.utc
    )


# Relative ranges and how many days they reach back.
RELATIVE_DAYS = {"last_24_hours": 1, "last_7_days": 7, "last_30_days": 30}


def date_bounds(
    start: date | None = None,
    end: date | None = None,
    relative: str | None = None,
    reference: date | datetime | None = None,
) -> tuple[date, date]:
    """Inclusive dates from a fixed pair or from a relative expression."""
    fixed = start is not None and end is not None
    if fixed == (relative is not None):
        raise ValueError("give either start and end, or a relative range")
    if fixed:
        if end < start:
            raise ValueError("range end is before its start")
        return start, end
    if relative not in RELATIVE_DAYS:
        raise ValueError(f"unknown relative range: {relative}")
    day = reference or date.today()
    if isinstance(day, datetime):
        day = day.date()
    return day - timedelta(days=RELATIVE_DAYS[relative]), day
