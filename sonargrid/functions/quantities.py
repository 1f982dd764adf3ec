"""Numbers with units in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit prefixes and units with a factor of their own.
PREFIXES = {"deka": 1e1, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15,
            "hecto": 1e2, "kilo": 1e3, "Mega": 1e6, "mega": 1e6, "Giga": 1e9, "giga": 1e9, "Tera": 1e12, "tera": 1e12, "Peta": 1e15, "peta": 1e15,
            "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "mu": 1e-6, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15,
            "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15}
FACTORS = {"%": 0.01, "hour": 3600.0, "h": 3600.0, "min": 60.0}
BASES = ["Hz", "hertz", "Hertz", "V", "volt", "Volt", "A", "s", "sec", "g", "m", "meter", "Pa", "W", "F", "B", "b", "l", "J", "N", "K", "Ohm", "°", "rad"]
_NUMBER = r"^([0-9+-]*\.?[0-9+-]*)"


def parse_number(c: Column) -> Column:
    """STRUCT<value DOUBLE, is_int BOOLEAN, unit STRING, digits INT> of a text such as "4.2 mV".

    The number is the longest start of digits, signs and one point; the unit is the rest, without outer spaces. Without a valid number
    the value is null, the unit the whole text and digits 0; null stays null.
    """
    head = F.regexp_extract(c, _NUMBER, 1)
    value = head.try_cast("double")
    point = F.instr(head, ".")
    digits = F.when(point > 0, F.length(head) - point).otherwise(0)
    unit = F.when(value.isNotNull(), F.trim(F.regexp_replace(c, _NUMBER, ""))).otherwise(c)
    return F.when(c.isNotNull(), F.struct(value.alias("value"), (value.isNotNull() & (point == 0)).alias("is_int"), unit.alias("unit"), F.when(value.isNotNull(), digits).otherwise(0).cast("int").alias("digits")))


def unit_factor(unit: Column) -> Column:
    """The factor of a unit: its own, that of the longest prefix before a known base unit, that of the longest prefix, or 1."""
    longest = "|".join(sorted(PREFIXES, key=len, reverse=True))
    known = F.regexp_extract(unit, f"^({longest})(?:{'|'.join(BASES)})$", 1)
    prefix = F.when(known != "", known).otherwise(F.regexp_extract(unit, f"^({longest}).", 1))
    entry = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    own = F.try_element_at(entry(FACTORS | dict.fromkeys(BASES, 1.0) | {"h": FACTORS["h"]}), unit)
    return F.coalesce(own, F.try_element_at(entry(PREFIXES), prefix), F.lit(1.0))


def change_unit(value: Column, old: Column, new: Column) -> Column:
    """value * factor(old) / factor(new); unchanged if a unit is missing, except that "%" counts on its own."""
    o, n = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    missing = ((o == "") & (n == "")) | ((o == "") & (n != "%")) | ((n == "") & (o != "%"))
    return F.when(missing, value).otherwise(value * unit_factor(o) / unit_factor(n))


def scaled_text(c: Column, factor: float) -> Column:
    """A quantity text over ``factor``, with one digit more and without "/V" at its end; null without a number."""
    q = parse_number(c)
    unit = F.regexp_replace(q["unit"], "/V$", "")
    return F.when(q["value"].isNotNull(), F.concat(_fixed(q["value"] / F.lit(float(factor)), q["digits"] + 1), unit))


def _fixed(value: Column, digits: Column) -> Column:
    """A number with so many digits, of 0 to 12."""
    out = F.format_string("%.12f", value)
    for n in range(12):
        out = F.when(digits == n, F.format_string(f"%.{n}f", value)).otherwise(out)
    return out
