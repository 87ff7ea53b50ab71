"""ISO-8601 dates, times and milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varidoc.functions.binding import bind

_TIME = r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?"
_ZONE = r"([Zz]|[+-]\d\d:?\d\d)"
ISO = rf"^\s*(-?\d{{4}})-(\d\d)-(\d\d)(?:(\s*[Tt]\s*|\s+){_TIME}\s*{_ZONE}?)?\s*$"
TIME_ONLY = rf"^\s*{_TIME}\s*$"
#: Names of date components, as given, and the units that Spark knows them by.
COMPONENTS = {n: n.upper() for n in ("millennium", "century", "decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")}
#: What a zone may be away from UTC at most, in minutes.
_FARTHEST = 14 * 60 + 59


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def parts(s: Column) -> Column:
    """A struct of what s says, NULL if it is neither a date, with or without a time, nor a time alone: year,
    month, day, hour, minute, second, millis (rounded, so that 1000 is possible), zone (minutes east of UTC, NULL
    if not given), separator (T or a space, NULL without a date and a time), has_date, has_time."""
    # a text that matches becomes its groups between bars, in one pass each; another one stays as it is
    def groups(pattern: str, shown: list[str], otherwise: Column) -> Column:
        return bind(F.regexp_replace(s, pattern, "|".join([*shown, ""])), lambda found: F.when(found != s, F.split(found, r"\|")).otherwise(otherwise))

    time = groups(TIME_ONLY, ["t", "", "", "", "", "$1", "$2", "$3", "$4", ""], F.lit(None).cast("array<string>"))
    return bind(groups(ISO, ["d", *(f"${i}" for i in range(1, 10))], time), _parts)


def _parts(groups: Column) -> Column:
    """parts, from the array of the kind, d or t, and the groups of ISO."""
    group = [F.get(groups, F.lit(i)) for i in range(10)]
    dated = group[0] == "d"
    date, clock = [_number(x) for x in group[1:4]], group[5:9]
    h, mi, sec = map(_number, clock[:3])
    millis = F.when(clock[3] == "", 0).otherwise(F.coalesce(F.round(F.concat(F.lit("0."), clock[3]).try_cast("double") * 1000).cast("int"), F.lit(0)))
    return bind(F.struct(*[x.alias(n) for n, x in zip(("y", "mo", "d", "h", "mi", "sec"), (*date, h, mi, sec))], millis.alias("millis"), _zone(group[9]).alias("zone")), lambda n: _checked(n, dated, group[4], clock[0]))


def _zone(zone: Column) -> Column:
    """Minutes east of UTC, NULL for an empty text."""
    minutes = F.concat(F.substring(zone, 1, 1), F.substring(zone, 2, 2)).try_cast("int") * 60 + F.concat(F.substring(zone, 1, 1), F.substring(zone, -2, 2)).try_cast("int")
    return F.when(zone.isin("Z", "z"), 0).when(zone != "", minutes)


def _checked(n: Column, dated: Column, gap: Column, hours: Column) -> Column:
    """The struct of parts, NULL if one of the numbers is out of its range."""
    y, mo, d, h, mi, sec, millis, zone = (n[c] for c in ("y", "mo", "d", "h", "mi", "sec", "millis", "zone"))
    leap = (y > 0) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    fine = mo.between(1, 12) & d.between(1, 31) & (d <= last) & (F.coalesce(F.abs(zone), F.lit(0)) <= _FARTHEST)
    fine = (fine | ~dated) & (h <= 24) & (mi <= 59) & (sec <= 59)
    return F.when(fine, F.struct(
        y.alias("year"), mo.alias("month"), d.alias("day"), h.alias("hour"), mi.alias("minute"), sec.alias("second"), millis.alias("millis"), zone.alias("zone"),
        F.when(gap != "", F.when(F.upper(gap).contains("T"), "T").otherwise(" ")).alias("separator"), dated.alias("has_date"), (hours != "").alias("has_time")))


def parts_of_millis(ms: Column) -> Column:
    """The same struct for milliseconds since 1970, in UTC."""
    # Spark's own components are of the session's time, so these are made from days and the rest
    days, rest = F.floor(ms / 86400000), F.pmod(ms, F.lit(86400000))
    date = F.date_from_unix_date(days.cast("int"))
    number = lambda x: x.cast("int")
    return F.when(ms.isNotNull(), F.struct(
        F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"), number(F.floor(rest / 3600000)).alias("hour"), number(F.floor(rest / 60000) % 60).alias("minute"),
        number(F.floor(rest / 1000) % 60).alias("second"), number(rest % 1000).alias("millis"), F.lit(0).alias("zone"), F.lit("T").alias("separator"), F.lit(True).alias("has_date"), F.lit(True).alias("has_time")))


def millis_of(p: Column) -> Column:
    """Milliseconds since 1970 of a parts struct; without a zone in the session's time; NULL without a date."""
    date = F.make_date(p["year"], p["month"], p["day"])
    local = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000 + p["hour"] * 3600000 + p["minute"] * 60000 + p["second"] * 1000 + p["millis"]
    wall = F.timestamp_millis(local)  # read as UTC, then as the session's wall clock
    return F.when(p["has_date"], F.when(p["zone"].isNotNull(), local - p["zone"] * 60000).otherwise(F.unix_millis(F.to_utc_timestamp(wall, F.current_timezone()))))


def parse_iso8601(s: Column) -> Column:
    """Milliseconds since 1970; without a zone in the session's time; NULL if s is no date."""
    return bind(parts(s), millis_of)


def zone_offset(ms: Column) -> Column:
    """Minutes that the session's time zone is east of UTC at a time."""
    at = F.timestamp_millis(ms)
    return ((F.unix_millis(F.from_utc_timestamp(at, F.current_timezone())) - ms) / 60000).cast("int")


def now() -> Column:
    """Milliseconds since 1970 at the query's start."""
    return F.unix_millis(F.current_timestamp())


def format_iso8601(ms: Column, utc: bool = True, *, offset: Column | int | None = None, date: bool = True, time: bool = True, zone: bool = True, separator: str = "T") -> Column:
    """`YYYY-MM-DDThh:mm:ss[.mmm]` and the zone: Z, the session's offset unless utc, or the given one in minutes
    east. Milliseconds only if there are any. Date, time and zone (which needs a time) may be left out."""
    shift = F.lit(0) if utc else zone_offset(ms)
    if offset is not None:
        shift = F.lit(offset) if isinstance(offset, int) else offset
    local = ms + shift.cast("bigint") * 60000
    named = F.when(shift == 0, "Z").otherwise(F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(shift) / 60).cast("string"), 2, "0"), F.lpad((F.abs(shift) % 60).cast("string"), 2, "0")))
    rest = F.pmod(ms, F.lit(1000))
    fraction = F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise("")
    days, seconds = F.floor(local / 86400000), F.pmod(F.floor(local / 1000), F.lit(86400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), fraction)
    shown = [F.date_from_unix_date(days.cast("int")).cast("string")] if date else []
    if time:
        shown += [F.lit(separator)] * date + [clock] + [named] * zone
    return F.concat(*shown) if shown else F.when(ms.isNotNull(), "")


def truncate(ms: Column, component: str) -> Column:
    """ms cut to the start of a named component, in UTC."""
    unit = COMPONENTS[component.lower()]
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(ms)))
