"""Dates of records: 14-digit stamps, partial years, coded ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _time(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def epoch_time(value: Column) -> Column:
    """Seconds up to 2 147 483 647, milliseconds above, as a timestamp."""
    return F.when(value <= 2_147_483_647, F.timestamp_seconds(value)).otherwise(F.timestamp_millis(value))


def parse_range(text: Column) -> Column:
    """Struct (lower, upper) of ``[a,b)``; a missing bound is null, that is open."""
    part = lambda k: F.trim(F.get(F.split(text, ","), F.lit(k)), F.lit(" \"[]()"))
    bound = lambda k: F.try_to_timestamp(F.when(part(k) != "", part(k))).cast("timestamp_ntz")
    return F.struct(bound(0).alias("lower"), bound(1).alias("upper"))


def in_range(moment: Column, bounds: Column) -> Column:
    """Whether a half-open range holds a moment; null bounds are open."""
    return (bounds["lower"].isNull() | (moment >= bounds["lower"])) & (bounds["upper"].isNull() | (moment < bounds["upper"]))


def parse_date(raw: Column, lower: bool = False) -> Column:
    """A record's date string as a timestamp, null if it can't be read.

    ``yyyymmddhhmmss[.f]``; eight digits yyyymmdd, whose unknown last digits (blank, u, 0, |, #) count
    as 01; six digits yymmdd, with years up to 70 in this century; else the first four signs that are
    digits, '-' or '?', the latter two standing for 0 and January 1st if ``lower``, for 9 and December
    31st if not. Zeros only are null.
    """
    return let(raw.cast("string"), lambda r: _parsed(r, lower))


#: Signs that stand for an unknown digit.
UNKNOWN = " u0|#"


def _unknown(c: Column) -> Column:
    return F.translate(c, UNKNOWN, "") == ""


def _eight(raw: Column) -> Column:
    """A field of eight signs as digits: an unknown day is the 1st, an unknown month January, an unknown decade or year zeros."""
    year, month, day = F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)
    known = F.rtrim(year, F.lit(UNKNOWN))
    first_of_year = F.when(F.length(known) > 1, F.concat(F.rpad(known, 4, "0"), F.lit("0101")))
    return F.when(_unknown(F.concat(month, day)), first_of_year).when(_unknown(day), F.concat(year, month, F.lit("01"))).otherwise(raw)


def _six(digits: Column) -> Column:
    """yymmdd with its century."""
    return F.concat(F.when(F.substring(digits, 1, 2) > "70", "19").otherwise("20"), digits)


def _parsed(raw: Column, lower: bool) -> Column:
    size = F.length(raw)

    def read(s: Column) -> Column:
        day = F.when(F.length(s) == 6, _six(s)).when(F.length(s) == 8, s)
        stamp = F.when(size > 8, F.substring(s, 1, 14))
        signs = F.regexp_extract(raw, "[0-9?-]{4}", 0)
        bound = F.concat(F.translate(signs, "-?", "00"), F.lit("0101")) if lower else F.concat(F.translate(signs, "-?", "99"), F.lit("1231"))
        found = F.coalesce(_time(stamp, "yyyyMMddHHmmss"), _time(day, "yyyyMMdd"), _time(F.when(signs != "", bound), "yyyyMMdd"))
        nothing = F.startswith(s, F.lit("0000")) & ~F.rlike(raw, F.lit("^[0-9]{14}([.]|$)"))
        return F.when(~nothing, found)

    whole = F.when(size == 8, F.coalesce(_eight(raw), raw)).otherwise(raw)
    return let(F.translate(whole, "u#|[] ", ""), read)


DATE_FIELDS = (
    "date_start", "date_end", "date2_start", "date2_end", "reissue_start", "reissue_end", "copyright_start", "copyright_end", "date_production",
    "date_distribution", "other_field",
)
#: A RUSMARC code of the kind of date, and the MARC 21 code of the same meaning.
RUSMARC_TYPES = {"a": "c", "b": "d", "c": "u", "d": "s", "e": "r", "f": "q", "g": "m", "h": "t", "i": "p", "j": "e", "k": "p", "l": "i", "u": "n"}


def coded_dates(code: Column, digits: Column) -> Column:
    """Struct of ``DATE_FIELDS`` for a MARC 21 type of date and its eight signs of two dates."""
    def read(v: Column) -> Column:
        one, two = F.substring(v["digits"], 1, 4), F.substring(v["digits"], 5, 4)
        return let(F.struct(
            v["code"].alias("code"), v["digits"].alias("digits"), parse_date(one, True).alias("lo1"), parse_date(one).alias("up1"), parse_date(two, True).alias("lo2"), parse_date(two).alias("up2"),
        ), _coded)

    return let(F.struct(F.lower(code).alias("code"), digits.alias("digits")), read)


def _coded(v: Column) -> Column:
    code, digits, lo1, up1, lo2, up2 = (v[c] for c in ("code", "digits", "lo1", "up1", "lo2", "up2"))
    rising = lo1 < lo2
    both = lo1.isNotNull() & lo2.isNotNull()
    released = F.when(both, F.when(rising, lo1).otherwise(lo2)).otherwise(F.coalesce(lo1, lo2))
    made = F.when(both, F.when(rising, up2).otherwise(up1))
    known = lambda *codes: code.isin(*codes)
    values = {
        "date_start": F.when(known("e"), parse_date(F.regexp_replace(digits, "##", "01"), True)).when(known("p"), released).when(known(*"cdikmqrs1tua"), lo1),
        "date_end": F.when(known("d", "i", "k"), up2).when(known("p"), made).when(known("m", "q", "r", "1", "t"), up1),
        "date2_start": F.when(known("m"), lo2), "date2_end": F.when(known("m"), up2),
        "reissue_start": F.when(known("r"), lo2), "reissue_end": F.when(known("r"), up2),
        "copyright_start": F.when(known("t"), lo2), "copyright_end": F.when(known("t"), up2),
        "date_production": F.when(known("p"), released), "date_distribution": F.when(known("p"), made),
        "other_field": F.when(known("b"), F.lit("046")),
    }
    return F.struct(*[values[f].alias(f) for f in DATE_FIELDS])


def minutes_text(milliseconds: Column) -> Column:
    """``m:ss`` of a duration."""
    s = F.floor(milliseconds / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


#: How the months' names begin in Russian, January first.
MONTHS = ("янв", "фев", "мар", "апр", "ма", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def issued_date(text: Column) -> Column:
    """A date in free text, such as ``12 мая 1961 г.`` or ``05.1961``; without a day or month the first counts, null without a year."""
    low = F.lower(text)
    year = F.regexp_extract(low, "(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])", 1)
    name = F.regexp_extract(low, "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")[а-я]*", 1)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    number = F.regexp_extract(low, "(?<![0-9])([0-9]{1,2})[./][0-9]{4}(?![0-9])", 1).try_cast("int")
    month = F.when(named > 0, named).when(number.between(1, 12), number).otherwise(1)
    before = F.regexp_extract(low, "(?<![0-9])([0-9]{1,2})(?:[./][0-9]{1,2}[./]| +[а-я]+ )", 1).try_cast("int")
    day = F.when(before.between(1, 31), before).otherwise(1)
    at = lambda d: F.try_make_timestamp_ntz(year.try_cast("int"), month, d, F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(at(day), at(F.lit(1)))
