"""Length units of historical axes, as Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.config import BAVARIAN_FOOT_MM, BAVARIAN_ZOLL_MM, UNIT_SWITCH

# Patterns in their order, then exact names; names and their millimetres.
PATTERNS = (
    ("(?i)^m(illi)?m(eter)?s?\\.?$", "mm"),
    ("(?i)^c(enti)?m(eter)?s?\\.?$", "cm"),
    ("(?i)^m(eter)?s?\\.?$", "m"),
    ("(?i)fu(ß|ss)", "bavarian_foot"),
    ("(?i)schuh", "bavarian_foot"),
    ("(?i)zoll", "bavarian_zoll"),
)
FACTORS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "bavarian_foot": BAVARIAN_FOOT_MM, "bavarian_zoll": BAVARIAN_ZOLL_MM}


def canonical(raw: Column) -> Column:
    """The unit's name; a label that no rule knows stays as it is, an empty one is 'unknown'."""
    text = F.trim(raw)
    out = F.when(raw.isNull() | (raw == ""), F.lit("unknown"))
    for pattern, name in PATTERNS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.when(F.lower(text).isin(*FACTORS), F.lower(text)).otherwise(text)


def factor(name: Column) -> Column:
    """Millimetres of one unit, null for what is no known length."""
    out = F.when(F.lit(False), F.lit(0.0))
    for unit, mm in FACTORS.items():
        out = out.when(name == unit, F.lit(mm))
    return out


def to_mm(value: Column, name: Column) -> Column:
    return value * factor(name)


def by_date(day: Column, switch: date = UNIT_SWITCH) -> Column:
    """Feet before the switch, millimetres from then on."""
    return F.when(day < F.lit(switch), "bavarian_foot").when(day.isNotNull(), "mm")


def in_force(raw: Column, x_key: Column, dated: bool = True, switch: date = UNIT_SWITCH) -> Column:
    """The declared unit if it is a length, else by the key's date, where the profile has dated units."""
    declared = canonical(raw)
    if not dated:
        return declared
    return F.when(factor(declared).isNotNull(), declared).otherwise(
        F.coalesce(by_date(F.try_to_date(x_key, "yyyy-MM-dd"), switch), declared)
    )
