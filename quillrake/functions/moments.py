"""Texts that denote moments: their parts, as JVM expressions.

``parts`` turns a text into a struct; ``operators.moments`` gives local times their offset.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utrim

#: Month names and abbreviations, lower case, in en, de, fr, es, pt, nl, ru, hi.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene janeiro januari января янв январь जनवरी",
    2: "february feb februar février févr febrero fevereiro fev februari февраля фев февраль फ़रवरी फरवरी",
    3: "march mar märz mär mrz mars marzo março maart mrt марта мар март मार्च",
    4: "april apr avril avr abril abr апреля апр апрель अप्रैल",
    5: "may mai mayo maio mei мая май मई",
    6: "june jun juni juin junio junho июня июн июнь जून",
    7: "july jul juli juillet juil julio julho июля июл июль जुलाई",
    8: "august aug août aout agosto ago augustus августа авг август अगस्त",
    9: "september sep sept septembre septiembre setiembre setembro set сентября сен сент сентябрь सितंबर सितम्बर",
    10: "october oct oktober okt octobre octubre outubro out октября окт октябрь अक्टूबर अक्तूबर",
    11: "november nov novembre noviembre novembro ноября ноя нояб ноябрь नवंबर नवम्बर",
    12: "december dec dezember dez décembre déc diciembre dic dezembro декабря дек декабрь दिसंबर दिसम्बर",
}

#: Already one unambiguous form: nothing is left to normalise.
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"

_TIME = r"(\d{1,2})[:.hH](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_CLOCK = r"(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*(?:Uhr|uur|h|часов))?"
_ZONE = r"\s*(?:\(?([Zz]|[+\-\u2212]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+\-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)\)?)?(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_WEEKDAY = r"(?:[\p{L}\p{M}\-]{2,12}\.?,?\s+)?"
_MONTH = r"([\p{L}\p{M}]{3,12})\.?"
_LINK = r"(?:,?\s+|,)(?:(?:à|a las|às|às|um|om|at|в|को)\s+)?"

#: (tag, pattern, order of the pattern's groups as year, month, day, hour, minute, second, fraction, half, zone, bracket)
_FORMS = (
    ("ymd", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|,?\s+){_TIME}{_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    ("ymd", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]|\s)?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    ("num", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:[Tt]|,?\s+){_TIME}{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("named", rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|st|nd|rd|th|er)?[\s\-]+(?:de\s+|of\s+)?{_MONTH},?[\s\-]+(?:de\s+)?(\d{{4}}){_LINK}{_TIME}{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("named", rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_LINK}{_TIME}{_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
)


#: Begins texts whose parts were found: a character of private use, which no moment is written with.
_FOUND = "\ue000"


def _split(t: Column) -> Column:
    made = t
    for tag, pattern, order in _FORMS:  # what one pattern has rewritten no later one matches, so each text is read once by each
        made = F.regexp_replace(made, "(?U)" + pattern, _FOUND + tag + "|" + "|".join(f"${i}" for i in order))
    return F.when(~t.contains(_FOUND), F.transform(F.array(made), lambda m: F.when(m.startswith(_FOUND), F.split(F.substr(m, F.lit(2)), r"\|", -1)))[0])


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def split_parts(raw: Column) -> Column:
    """Array (form, year, month, day, hour, minute, second, fraction, half, zone, bracket) of texts; NULL if no form fits.

    Texts of digits only become ('epoch', number): seconds, milliseconds, microseconds or nanoseconds by their length.
    """
    t = utrim(raw)
    return F.when(t.rlike(r"^-?(\d{9,10}(\.\d{1,9})?|\d{12,13}|\d{15,16}|\d{18,19})$"), F.array(F.lit("epoch"), t)).otherwise(_split(t))


def epoch_ms(number: Column) -> Column:
    """Milliseconds of a count since 1970 whose unit its length tells, rounded down."""
    whole = F.regexp_extract(number, r"^-?(\d+)", 1)
    n, v = F.length(whole), number.try_cast("decimal(38,9)")
    per = F.when(n <= 10, F.lit(1000)).when(n <= 13, F.lit(1)).when(n <= 16, F.lit(0.001)).otherwise(F.lit(0.000001))
    return F.floor(v * per.cast("decimal(10,6)")).cast("long")


def local_ms(p: Column, date_order: Column) -> Column:
    """Milliseconds of the written wall-clock time, as if it were UTC; NULL where no such date or time exists."""
    month_of = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for name in names.split() for x in (name, m)])
    form = F.get(p, F.lit(0))
    second, third = F.get(p, F.lit(2)), F.get(p, F.lit(3))
    mdy = (form == "num") & (F.lower(F.coalesce(date_order, F.lit("dmy"))) == "mdy")
    month = F.when(form == "named", F.try_element_at(month_of, F.lower(second))).when(mdy, _int(third)).otherwise(_int(second))
    day = F.when(mdy, _int(second)).otherwise(_int(third))
    hour, half = _int(F.get(p, F.lit(4))), F.lower(F.get(p, F.lit(8)))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute, sec = _int(F.get(p, F.lit(5))), F.coalesce(_int(F.get(p, F.lit(6))), F.lit(0))
    frac = F.substring(F.rpad(F.get(p, F.lit(7)), 3, "0"), 1, 3).try_cast("int")
    days = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", _int(F.get(p, F.lit(1))), month, day), "yyyy-MM-dd"))
    ok = hour.between(0, 23) & minute.between(0, 59) & sec.between(0, 59) & month.isNotNull() & day.isNotNull()
    return F.when(ok, days.cast("long") * 86400000 + (hour * 3600 + minute * 60 + sec) * F.lit(1000).cast("long") + frac)


def zone_text(p: Column) -> Column:
    """The zone as written: after the time, else in brackets; '' if there is none."""
    z, b = F.get(p, F.lit(9)), F.get(p, F.lit(10))
    return F.when(z != "", z).otherwise(F.coalesce(b, F.lit("")))


def fixed_offset_ms(zone: Column) -> Column:
    """Offset that the zone text itself states: Z, UTC, GMT or a number; NULL for names of zones and their abbreviations."""
    num = F.regexp_replace(F.regexp_replace(zone, r"^(?i)(UTC|GMT)(?=[+\-])", ""), "\u2212", "-")
    sign = F.when(num.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(num, r"[^0-9]", "")
    digits = F.when(F.length(digits) == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    stated = F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes) * F.lit(60000).cast("long"))
    return F.when(F.upper(zone).isin("Z", "UTC", "GMT", "UT"), F.lit(0).cast("long")).when(num.rlike(r"^[+\-]\d"), stated)
