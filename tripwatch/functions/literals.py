"""Datatype inference and casts of literals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import CONTINUOUS, FAMILIES, XSD

_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_FLOAT = r"^\s*[+-]?(([0-9]+(_[0-9]+)*)\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"


def sniffed(value: Column) -> Column:
    """xsd:integer, xsd:float or xsd:string by how a value looks."""
    return F.when(value.rlike(_INTEGER), XSD + "integer").when(value.rlike(_FLOAT), XSD + "float").otherwise(XSD + "string")


def inferred(value: Column, dtype: Column, lang: Column) -> Column:
    """A language means xsd:string; else the declared datatype; else how the value looks."""
    return F.when(lang.isNotNull(), XSD + "string").otherwise(F.coalesce(dtype, sniffed(value)))


def epoch_seconds(value: Column, dtype: Column) -> Column:
    """Unix seconds (UTC) of date, dateTime, dateTimeStamp, gYear and gYearMonth; years and months begin at 01:00."""
    year = F.try_to_timestamp(F.concat(value, F.lit("-01-01T01:00:00")))
    month = F.try_to_timestamp(F.concat(value, F.lit("-01T01:00:00")))
    at = F.when(dtype == XSD + "gYear", year).when(dtype == XSD + "gYearMonth", month).otherwise(F.try_to_timestamp(value))
    return F.unix_micros(at) / 1e6


def fragment_days(value: Column, dtype: Column) -> Column:
    """Days from 1 January 1970 of gMonth (`M`) and gMonthDay (`M-D`), the day of gDay (`D`); other forms are null."""
    part = F.split(value, "-")
    month, day = F.expr("0"), F.expr("0")
    whole = value.rlike(r"^[0-9]{1,2}$")
    both = value.rlike(r"^[0-9]{1,2}-[0-9]{1,2}$")
    month = F.try_to_date(F.concat(F.lit("1970-"), F.lpad(value, 2, "0"), F.lit("-01")))
    day = F.try_to_date(F.concat(F.lit("1970-"), F.lpad(F.get(part, F.lit(0)), 2, "0"), F.lit("-"), F.lpad(F.get(part, F.lit(1)), 2, "0")))
    start = F.lit("1970-01-01").cast("date")
    return F.when((dtype == XSD + "gMonth") & whole, F.date_diff(month, start)).when((dtype == XSD + "gMonthDay") & both, F.date_diff(day, start)).when((dtype == XSD + "gDay") & whole, value.try_cast("int"))


def numeric(value: Column, dtype: Column) -> Column:
    """The double that a literal stands for, by its datatype; null if it has none or doesn't parse."""
    text = F.trim(value)
    within = lambda names: dtype.isin([XSD + n for n in names])
    plain = F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))
    integers = [n for n in FAMILIES["numeric"] if n not in CONTINUOUS]
    whole = F.when(text.rlike(_INTEGER), F.regexp_replace(text, "_", "").try_cast("double"))
    return F.when(within(FAMILIES["datetime"]), epoch_seconds(text, dtype)).when(within(FAMILIES["datefrag"]), fragment_days(text, dtype).cast("double")).when(within(integers), whole).when(within(FAMILIES["numeric"]), plain)


def kept_value(value: Column, dtype: Column) -> Column:
    """(num, text) of a literal as a distribution keeps it: the number it stands for or, if it has none, its stripped text."""
    num = numeric(value, dtype)
    return F.struct(num.alias("num"), F.when(num.isNull(), F.trim(value)).alias("text"))


def span_seconds(text: Column) -> Column:
    """Seconds of a time span of whole hours, days or weeks, as 12H, 3D or 2W; null for other texts."""
    form = r"^([0-9]+)([HDW])$"
    unit = F.regexp_extract(text, form, 2)
    each = F.when(unit == "H", 3600).when(unit == "D", 86400).when(unit == "W", 7 * 86400)
    return F.nullif(F.regexp_extract(text, form, 1), F.lit("")).try_cast("long") * each


def significant(value: Column, figures: int) -> Column:
    """value rounded to significant figures, ties to even; 0 figures or fewer leave it, and so do more than a double has.

    Null, NaN and infinite values stay as they are; what rounds up beyond the largest double becomes infinite.
    """
    if figures <= 0 or figures > 16:
        return value
    finite = (F.abs(value) != float("inf")) & ~F.isnan(value)
    last = F.when(value == 0, 0).when(finite, F.floor(F.log10(F.abs(value)))).otherwise(0) - (figures - 1)
    near = F.when(last < -200, value * 1e200).otherwise(value)  # powers of ten beyond 308 are no doubles
    up = F.pow(F.lit(10.0), F.when(last < -200, -last - 200).otherwise(-last).cast("double"))
    scaled = F.when(last > 0, near / F.pow(F.lit(10.0), last.cast("double"))).otherwise(near * up)
    return F.when(finite, F.concat(F.bround(scaled).try_cast("long").cast("string"), F.lit("e"), last.cast("string")).try_cast("double")).otherwise(value)


def date_text(seconds: Column, dtype: str) -> Column:
    """The lexical form of Unix seconds in a date datatype."""
    form = {"gYear": "yyyy", "gYearMonth": "yyyy-MM", "date": "yyyy-MM-dd"}.get(dtype, "yyyy-MM-dd'T'HH:mm:ss")
    return F.date_format(F.timestamp_seconds(seconds), form)


def fragment_text(days: Column, dtype: str) -> Column:
    """The lexical form of a day number in a date fragment datatype."""
    return days.cast("string") if dtype == "gDay" else F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "MM-dd" if dtype == "gMonthDay" else "MM")


def literal_text(value: Column, dtype: str | None) -> Column:
    """The lexical form of the number that stands for a literal of dtype: dates and date fragments as such, others as they are."""
    name = (dtype or "").removeprefix(XSD)
    if name in FAMILIES["datetime"]:
        return date_text(value, name)
    if name in FAMILIES["datefrag"]:
        return fragment_text(value.cast("int"), name)
    whole = name in FAMILIES["numeric"] and name not in CONTINUOUS
    return (value.cast("long") if whole else value).cast("string")


def duration_days(days: Column) -> Column:
    """Whole days as an ISO 8601 duration."""
    return F.concat(F.lit("P"), days.cast("long").cast("string"), F.lit("D"))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as an ISO 8601 duration of days, hours, minutes and seconds."""
    s = seconds.cast("long")
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.concat(F.lit("P"), part(F.floor(s / 86400), "DT"), part(F.floor(s % 86400 / 3600), "H"), part(F.floor(s % 3600 / 60), "M"), part(s % 60, "S"))
