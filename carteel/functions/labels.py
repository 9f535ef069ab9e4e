"""Values of printed grid labels: misread digits, zone prefixes, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed table: digits that recognition takes for each other.
CONFUSED = {
    "3": ["8"],
    "8": ["3", "0"],
    "5": ["6"],
    "6": ["5", "0"],
    "1": ["7"],
    "7": ["1"],
    "0": ["6", "8"],
    "9": ["4"],
    "4": ["9"],
}


def digit_variants(value: Column) -> Column:
    """All values with one digit exchanged, by position, then in the table's order; may repeat."""
    text = value.cast("string")
    others = F.create_map(*[x for k, v in CONFUSED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def at(i: Column) -> Column:
        subs = F.coalesce(F.try_element_at(others, F.substr(text, i, F.lit(1))), F.array().cast("array<string>"))
        return F.transform(subs, lambda s: F.concat(F.substr(text, F.lit(1), i - 1), s, F.substr(text, i + 1)).cast("long"))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), at))


def rescued(value: Column, lo: Column, hi: Column) -> Column:
    """The only distinct variant within [lo, hi]; null if there is none or several."""
    fits = F.array_distinct(F.filter(digit_variants(value), lambda v: (v >= lo) & (v <= hi)))
    return F.when(F.size(fits) == 1, F.get(fits, F.lit(0)))


def without_zone(value: Column, lo: Column, hi: Column) -> Column:
    """1130 printed for 130 km: the last three digits, where the whole is too large and they aren't too small."""
    return F.when((value > hi) & (value % 1000 >= lo), value % 1000).otherwise(value)


def accepted(value: Column, confidence: Column, lo: Column, hi: Column) -> Column:
    """(value, confidence) of a reading after prefix and digit repair; a repaired digit costs a tenth of the confidence; null if it can't be in range."""
    plain = without_zone(value, lo, hi)
    fixed = rescued(plain, lo, hi)
    return F.when(plain.between(lo, hi), F.struct(plain.alias("value"), confidence.alias("confidence"))).when(fixed.isNotNull(), F.struct(fixed.alias("value"), (confidence * 0.9).alias("confidence")))


def box_position(xs: Column, ys: Column, orientation: Column, origin_x: Column, origin_y: Column) -> Column:
    """Centre of a reading's box along the strip, in the whole image."""
    mid = [(F.array_min(v) + F.array_max(v)) / 2.0 for v in (xs, ys)]
    return F.when(orientation == "horizontal", mid[0] + origin_x).otherwise(mid[1] + origin_y)
