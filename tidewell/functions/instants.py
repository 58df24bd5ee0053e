"""Reading dates and times in many notations with Column expressions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC of the usual zone abbreviations.
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}
#: English names of the months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?([A-Za-z]{1,5}|(?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2})?))?(?: ?\[([^\]]+)\])?"
_NAME, _DAY = r"([A-Za-z]{3,9})\.?", r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|mon|tue|wed|thu|fri|sat|sun|MON|TUE|WED|THU|FRI|SAT|SUN)[A-Za-z]*\.?,? )?"


def _rest(n: int, separator: str = ",? (?:at )?") -> tuple[str, str]:
    """The optional time and zone of a notation, and their places in the replacement."""
    return f"(?:{separator}{_TIME}{_ZONE})?", "|".join(f"${n + k}" for k in range(7))


def _notations() -> list[tuple[str, str, str]]:
    """Name, pattern, and the replacement kind|year|month|day|hour|minute|second|fraction|a/p|zone|bracket."""
    out = []
    tail, places = _rest(5, "[Tt ]")
    out.append(("year_first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){tail}$", f"ymd|$1|$3|$4|{places}"))
    tail, places = _rest(4)
    out.append(("day_name_year", rf"^{_WEEKDAY}{_DAY}[ -]{_NAME},?[ -](\d{{4}}){tail}$", f"ymd|$3|$2|$1|{places}"))
    out.append(("name_day_year", rf"^{_WEEKDAY}{_NAME} {_DAY},? (\d{{4}}){tail}$", f"ymd|$3|$1|$2|{places}"))
    out.append(("c_time", rf"^{_WEEKDAY}{_NAME} (\d{{1,2}}) {_TIME}(?: ([A-Za-z]{{1,5}}))? (\d{{4}})$", "ymd|$9|$1|$2|$3|$4|$5|$6|$7|$8|"))
    out.append(("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"))
    tail, places = _rest(3, "[Tt ]")
    out.append(("ordinal", rf"^(\d{{4}})-(\d{{3}}){tail}$", f"ord|$1||$2|{places}"))
    tail, places = _rest(4, "[Tt ]")
    out.append(("week", rf"^(\d{{4}})-?[Ww](\d{{2}})-?([1-7]){tail}$", f"week|$1|$2|$3|{places}"))
    tail, places = _rest(5)
    out.append(("digits_year_last", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){tail}$", f"num|$4|$1|$3|{places}"))
    return out


NOTATIONS = _notations()


def tidy(text: Column) -> Column:
    """White space of any kind collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def notation(text: Column) -> Column:
    """The name of the notation a tidied text is written in, or null."""
    out = F.when(text.rlike(r"^(\d{10}|\d{13}|\d{16}|\d{10}\.\d+)$"), F.lit("epoch"))
    for name, pattern, _ in NOTATIONS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out


def fields(text: Column, kind: Column) -> Column:
    """The parts of a text in the given notation, as an array: kind, year, month, day, hour, minute, second, fraction, a/p, zone, bracket."""
    out = F.when(kind == "epoch", F.concat(F.lit("epoch|"), text))
    for name, pattern, to in NOTATIONS:
        out = out.when(kind == name, F.regexp_replace(text, pattern, to))
    return F.split(out, r"\|")


def _month(text: Column) -> Column:
    """A month's number from digits or from its English name or abbreviation."""
    names = {k: n for n, m in enumerate(MONTHS, 1) for k in (m, m[:3])} | {"sept": 9}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(F.try_element_at(lookup, F.lower(text)))


def known_zone(zone: Column) -> Column:
    """The zone's name if it is an IANA name, else null."""
    return F.when(zone.isin(*sorted(available_timezones())), zone)


def _settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column behind a generator, so that what is built on it reads the value and does not repeat its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_instant(rows: DataFrame, value: str, zone: Column, month_first: Column, out: str = "utc_us") -> DataFrame:
    """Adds ``<out>_notation``, ``<out>_parts`` and ``out``: microseconds since 1970-01-01 UTC, null for what denotes no instant.

    ``value`` names the text column; ``zone`` is the IANA zone of values that name none: a local time that occurs
    twice is the earlier instant, one that is skipped is read with the offset before the change. ``month_first``
    orders all-digit dates that end in the year; it may use ``<out>_parts``. A zone, offset or bracketed zone in the
    value counts first. Digits finer than a microsecond are cut off. An unknown zone name makes the value null.
    """
    kind_name, parts_name = f"{out}_notation", f"{out}_parts"
    rows = rows.withColumn("_text", tidy(F.col(value)))
    rows = _settled(rows, kind_name, notation(F.col("_text")))
    rows = _settled(rows, parts_name, fields(F.col("_text"), F.col(kind_name)))
    at = [F.try_element_at(parts_name, F.lit(n + 1)) for n in range(11)]
    number = lambda n: at[n].try_cast("int")
    swap = (at[0] == "num") & ~F.coalesce(month_first, F.lit(True))
    half = F.lower(at[8])
    hour = F.coalesce(number(4), F.lit(0))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    away = F.regexp_replace(at[9], r"^[A-Za-z]+|:", "")
    sign = F.when(away.startswith("+"), 1).otherwise(-1)
    minutes = F.substring(away, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(away, 4, 2).try_cast("int"), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.when(away == "", F.try_element_at(lookup, F.upper(at[9]))).otherwise(F.when(minutes <= 18 * 60, sign * minutes))
    read = F.struct(
        at[0].alias("kind"),
        number(1).alias("year"),
        F.when(at[0] != "ymd", F.when(swap, number(3)).otherwise(number(2))).otherwise(_month(at[2])).alias("month"),
        F.when(swap, number(2)).otherwise(number(3)).alias("day"),
        hour.alias("hour"),
        F.coalesce(number(5), F.lit(0)).alias("minute"),
        F.coalesce(number(6), F.lit(0)).alias("second"),
        F.rpad(at[7], 6, "0").try_cast("int").alias("micros"),
        (at[9] != "").alias("has_offset"),
        offset.alias("offset"),
        known_zone(F.when(at[10] == "", zone).otherwise(at[10])).alias("zone"),
    )
    rows = _settled(rows, "_read", read)
    r = {n: F.col(f"_read.{n}") for n in ("kind", "year", "month", "day", "hour", "minute", "second", "micros", "has_offset", "offset", "zone")}
    day_us = F.lit(86_400_000_000).cast("bigint")
    midnight = lambda year, month, day: F.unix_micros(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    one, four = F.lit(1), F.lit(4)
    fourth = lambda year: F.floor(midnight(year, one, four) / day_us)
    monday = lambda year: fourth(year) - F.pmod(fourth(year) + 3, F.lit(7))  # noqa: E731  # of ISO week 1, the week of January 4th
    by_week = monday(r["year"]) + (r["month"] - 1) * 7 + r["day"] - 1
    by_day = midnight(r["year"], one, one) + (r["day"] - 1) * day_us
    start = (
        F.when(r["kind"] == "ord", F.when((r["day"] >= 1) & (by_day < midnight(r["year"] + 1, one, one)), by_day))
        .when(r["kind"] == "week", F.when((r["month"] >= 1) & (by_week < monday(r["year"] + 1)), by_week * day_us))
        .otherwise(midnight(r["year"], r["month"], r["day"]))
    )
    rows = _settled(rows, "_start", start)
    clock = F.when(r["hour"].between(0, 23) & r["minute"].between(0, 59) & r["second"].between(0, 59), ((r["hour"] * 60 + r["minute"]) * 60 + r["second"]).cast("bigint"))
    local = F.col("_start") + clock * F.lit(1_000_000).cast("bigint") + r["micros"]
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), r["zone"]))
    whole = F.substring_index(at[1], ".", 1)
    digits = F.substring(F.rpad(F.when(at[1].contains("."), F.substring_index(at[1], ".", -1)).otherwise(""), 6, "0"), 1, 6)
    epoch = whole.try_cast("bigint") * F.when(F.length(whole) == 10, 1_000_000).when(F.length(whole) == 13, 1_000).otherwise(1) + digits.try_cast("bigint")
    result = F.when(r["kind"] == "epoch", epoch).when(r["has_offset"], local - r["offset"].cast("bigint") * 60_000_000).otherwise(F.when(r["zone"].isNotNull(), by_zone))
    return _settled(rows, out, result).drop("_text", "_read", "_start")
