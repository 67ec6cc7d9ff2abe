"""Mixed timestamp notations to one unambiguous form.

An ordered cascade of anchored patterns rewrites each text into one canonical list of fields in a single regular
expression pass; the first pattern that matches the whole text wins. Fields are then checked strictly against the
calendar and the clock. Everything is a Catalyst expression: no Python, no shuffle; the zone of the source comes by a
join with a small lookup.

Policies
--------
* A zone in the text (offset, Z, UTC+8, EST, 北京时间) holds; otherwise the source's zone; otherwise ``default_zone``.
* An ambiguous local time (clock set back) is read as the earlier of the two instants.
* A nonexistent local time (clock set forward) is moved forward by the length of the gap.
* Day and month of ``1/2/2020`` follow the source's order; without one, a part above 12 decides, else day comes first.
* Null, empty, placeholder and impossible values give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import narrow, strip

#: Zone abbreviations with their offsets from UTC.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "jst": "+09:00", "hkt": "+08:00", "sgt": "+08:00",
    "est": "-05:00", "edt": "-04:00", "pst": "-08:00", "pdt": "-07:00", "bst": "+01:00",
    "cet": "+01:00", "cest": "+02:00", "aest": "+10:00", "aedt": "+11:00",
}
#: English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Words that may stand before a time.
LABELS = r"(?:[^0-9:,]{1,24}: *|首发 *|更新于 *|更新 *|上架 *|发表于 *|updated +|first published +|published +|posted +|on +)"
BEIJING = r"北京时间[: ]*"

_ZONE = r" *(z|[+-]\d{2}:?\d{2}|(?:utc|gmt)(?:[+-]\d{1,2}(?::?\d{2})?)?|[a-z]{3,4})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Pattern, then the groups of year, month, day, hour, minute, second, fraction, half of the day, zone (0: none) and the kind.
#: Kinds: t local or zoned time, d date, s seconds and m milliseconds since 1970, x date whose day and month follow the source.
CASCADE = [
    (r"(\d{10})", (1, 0, 0, 0, 0, 0, 0, 0, 0), "s"),
    (r"(\d{13})", (1, 0, 0, 0, 0, 0, 0, 0, 0), "m"),
    (r"(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?:\.(\d{1,9}))?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8), "t"),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[ t]+" + _CLOCK + r" *(am|pm)?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 8, 9), "t"),
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{4})[-/.](\d{1,2})", (1, 2, 0, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{4})年?", (1, 0, 0, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{4}) *年 *(\d{1,2}) *月 *(\d{1,2}) *[日号] *(上午|下午|中午|凌晨|早上|晚上)? *" + _CLOCK + _ZONE, (1, 2, 3, 5, 6, 7, 8, 4, 9), "t"),
    (r"(\d{4}) *年 *(\d{1,2}) *月 *(\d{1,2}) *[日号] *(上午|下午|中午|凌晨|早上|晚上)? *(\d{1,2}) *[时点] *(?:(\d{1,2}) *分 *)?(?:(\d{1,2}) *秒)?" + _ZONE, (1, 2, 3, 5, 6, 7, 0, 4, 8), "t"),
    (r"(\d{4}) *年 *(\d{1,2}) *月 *(\d{1,2}) *[日号]?", (1, 2, 3, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{4}) *年 *(\d{1,2}) *月", (1, 2, 0, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})[ t]+" + _CLOCK + r" *(am|pm)?" + _ZONE, (3, 2, 1, 4, 5, 6, 7, 8, 9), "t"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1, 0, 0, 0, 0, 0, 0), "d"),
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})[ ,t]+" + _CLOCK + r" *(am|pm)?" + _ZONE, (3, 2, 1, 4, 5, 6, 7, 8, 9), "x"),
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (3, 2, 1, 0, 0, 0, 0, 0, 0), "x"),
    (r"(?:[a-z]{3,9}\.?,? +)?(\d{1,2})[- ]+" + _MONTH + r"[- ,]+(\d{4})[ ,t]+" + _CLOCK + r" *(am|pm)?" + _ZONE, (3, 2, 1, 4, 5, 6, 7, 8, 9), "t"),
    (r"(?:[a-z]{3,9}\.?,? +)?(\d{1,2})[- ]+" + _MONTH + r"[- ,]+(\d{4})", (3, 2, 1, 0, 0, 0, 0, 0, 0), "d"),
    (r"(?:[a-z]{3,9}\.?, +)?" + _MONTH + r" +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})[ ,t]+" + _CLOCK + r" *(am|pm)?" + _ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9), "t"),
    (r"(?:[a-z]{3,9}\.?, +)?" + _MONTH + r" +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})", (3, 1, 2, 0, 0, 0, 0, 0, 0), "d"),
    (_MONTH + r",? +(\d{4})", (2, 1, 0, 0, 0, 0, 0, 0, 0), "d"),
]


def _fields(text: Column) -> Column:
    """The canonical list of fields of a cleaned text, kind last; null if no pattern matches the whole text."""
    found = F.lit(None).cast("string")
    for pattern, groups, kind in reversed(CASCADE):
        whole = f"^{pattern}$"
        form = "|".join(f"${g}" if g else "" for g in groups) + f"|{kind}"
        found = F.when(text.rlike(whole), F.regexp_replace(text, whole, form)).otherwise(found)
    return F.split(found, r"\|")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: as a lambda variable, so the optimizer can't paste it in at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _resolve(fields: Column, beijing: Column, zone: Column, month_first: Column) -> Column:
    at = lambda i: F.nullif(F.get(fields, F.lit(i)), F.lit(""))
    number = lambda i: at(i).try_cast("int")
    first, second = number(2), number(1)
    day_second = F.when(first > 12, False).when(second > 12, True).otherwise(F.coalesce(month_first, F.lit(False)))
    swap = (at(9) == "x") & day_second
    month = F.coalesce(second, F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), at(1)).cast("int"), F.lit(0)))
    half = F.coalesce(at(7), F.lit(""))
    late, early = half.isin("pm", "下午", "晚上"), half.isin("am", "上午", "凌晨", "早上")
    hour = F.when(late & (number(3) < 12), number(3) + 12).when(early & (number(3) == 12), 0).otherwise(number(3))
    second_text = F.concat(F.coalesce(at(5), F.lit("0")), F.lit("."), F.coalesce(F.substring(at(6), 1, 6), F.lit("0")))
    word = F.regexp_replace(at(8), r"^(?:utc|gmt)(?=[+-])", "")
    sign, digits = F.substring(word, 1, 1), F.regexp_replace(F.substring(word, 2, 9), ":", "")
    hours = F.when(F.length(digits) > 2, F.substring(F.lpad(digits, 4, "0"), 1, 2)).otherwise(F.lpad(digits, 2, "0"))
    offset = F.concat(sign, hours, F.lit(":"), F.when(F.length(digits) > 2, F.substring(F.lpad(digits, 4, "0"), 3, 2)).otherwise("00"))
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    stated = F.when(at(8).isNull(), F.when(beijing, F.lit("Asia/Shanghai")).otherwise(zone)).when(sign.isin("+", "-"), offset).otherwise(F.try_element_at(named, at(8)))
    parts = F.struct(
        at(9).alias("kind"), at(0).alias("head"), number(0).alias("y"), F.when(swap, first).otherwise(month).alias("m"), F.when(swap, second).otherwise(first).alias("d"),
        hour.alias("h"), F.coalesce(number(4), F.lit(0)).alias("mi"), second_text.try_cast("decimal(8,6)").alias("s"), stated.alias("zone"),
    )
    return _let(parts, _write)


def _write(p: Column) -> Column:
    utc = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")  # noqa: E731  the session's zone is UTC
    month, day = F.coalesce(p.m, F.lit(1)), F.coalesce(p.d, F.lit(1))
    long_month = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when((p.y % 4 == 0) & ((p.y % 100 != 0) | (p.y % 400 == 0)), 29).otherwise(28)
    real = (p.y >= 1) & month.between(1, 12) & (day >= 1) & (day <= long_month)
    clock = p.h.between(0, 23) & p.mi.between(0, 59) & (p.s < 60)
    precise = F.format_string("%04d-%02d-%02d", p.y, month, day)
    length = F.when(p.m.isNull(), 4).when(p.d.isNull(), 7).otherwise(10)
    return (
        F.when(p.kind == "s", utc(F.timestamp_seconds(p["head"].try_cast("bigint"))))
        .when(p.kind == "m", utc(F.timestamp_millis(p["head"].try_cast("bigint"))))
        .when(~F.coalesce(real, F.lit(False)), None)
        .when(p.h.isNull(), F.substr(precise, F.lit(1), length))
        .when(clock & p.zone.isNotNull(), utc(F.try_make_timestamp(p.y, p.m, p.d, p.h, p.mi, p.s, p.zone)))
    )


def normalise(frame: DataFrame, text: str, zone: str, month_first: str, out: str = "normal_time") -> DataFrame:
    """``frame`` with ``out``: UTC ``YYYY-MM-DDTHH:MM:SS.ffffffZ`` for times, else the date as precise as written.

    ``zone`` and ``month_first`` name columns with the source's zone and its order of day and month (null: unknown; a
    time without any zone is then null). The session's time zone must be UTC. Other columns pass through unchanged; an
    existing column ``out`` is replaced. Null, empty and long texts that are no time give null; padding of any length is
    stripped first.
    """
    if frame.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError("spark.sql.session.timeZone must be UTC")
    clean = F.lower(strip(narrow(F.col(text))))
    bare = F.regexp_replace(clean, rf"^{LABELS}(?=[0-9a-z北])", "")
    value = _let(
        bare,
        lambda t: _let(_fields(F.regexp_replace(t, f"^{BEIJING}", "")), lambda f: _resolve(f, t.startswith("北京时间"), F.col(zone), F.col(month_first))),
    )
    return frame.withColumn(out, value)
