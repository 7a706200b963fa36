"""Printed date labels, German and English, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the order in which beginnings are looked up.
MONTHS = (
    ("januar", 1), ("jänner", 1), ("februar", 2), ("märz", 3), ("maerz", 3), ("april", 4), ("mai", 5), ("juni", 6), ("juli", 7), ("august", 8), (
        "september", 9
    ), ("oktober", 10), ("november", 11), ("dezember", 12),
    ("january", 1), ("february", 2), ("march", 3), ("may", 5), ("june", 6), ("july", 7), ("october", 10), ("december", 12),
)
# The forms of labels.
_NAME = "[A-Za-zäöüÄÖÜ]+\\.?"
ISO, MONTH_YEAR, DAY_MONTH = "^(\\d{4})-(\\d{2})-(\\d{2})$", f"^({_NAME})\\s+(\\d{{4}})$", f"^(\\d{{1,2}})\\.?\\s*({_NAME})\\s*(\\d{{4}})?$"
#: Every name, and every beginning of three letters at least with the first name that has it.
_BEGINNINGS = {name[:n]: number for name, number in reversed(MONTHS) for n in range(3, len(name))} | dict(MONTHS)


def month_number(name: Column) -> Column:
    """1 to 12 of a full name, or of the first name that begins so (three letters at least): one look-up in a constant map."""
    key = F.lower(F.regexp_replace(F.trim(name), "\\.+$", ""))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _BEGINNINGS.items() for x in pair)), key)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def parse_label(label: Column, default_year: Column | None = None) -> Column:
    """A date of 1849-07-03, Juli 1849 (its first day), or 3. Juli [1849] with the default year; else null."""
    text = F.trim(label)
    default_year = F.lit(None).cast("int") if default_year is None else default_year
    iso = F.when(text.rlike(ISO), F.try_to_date(text, "yyyy-MM-dd"))
    month = month_number(F.regexp_extract(text, MONTH_YEAR, 1))
    by_month = F.when(
        text.rlike(MONTH_YEAR) & month.isNotNull(), _date(F.regexp_extract(text, MONTH_YEAR, 2).try_cast("int"), month, F.lit(1))
    )
    own_month = month_number(F.regexp_extract(text, DAY_MONTH, 2))
    year = F.coalesce(F.regexp_extract(text, DAY_MONTH, 3).try_cast("int"), default_year)
    by_day = F.when(
        text.rlike(DAY_MONTH) & own_month.isNotNull() & year.isNotNull(),
        _date(year, own_month, F.regexp_extract(text, DAY_MONTH, 1).try_cast("int"))
    )
    return F.when(text.rlike(ISO), iso).otherwise(F.coalesce(by_month, by_day))


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def label_month(label: Column) -> Column:
    """The month of the first line that names one."""
    return F.get(F.filter(F.transform(F.split(label, "\n"), lambda x: month_number(F.trim(x))), lambda m: m.isNotNull()), F.lit(0))
