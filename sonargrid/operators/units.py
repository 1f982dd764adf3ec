"""Quantities in different units, converted to one unit per quantity.

Conversions are the edges of a graph, each an affine function with rational coefficients. The shortest composition
from every unit to the canonical unit of its quantity is worked out once, every further edge is checked to agree
with it, and the result is a table of fixed size that rows reach by an equi-join on unit and quantity.
"""

from __future__ import annotations

import re
from collections import deque
from fractions import Fraction as Q

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (from, to, factor, offset), to = from * factor + offset.
EDGES = [
    ("kHz", "Hz", Q(1000), Q(0)), ("MHz", "kHz", Q(1000), Q(0)), ("Hz", "mHz", Q(1000), Q(0)), ("kHz", "mHz", Q(10**6), Q(0)),
    ("1/s", "Hz", Q(1), Q(0)), ("1/min", "1/s", Q(1, 60), Q(0)), ("1/min", "mHz", Q(1000, 60), Q(0)), ("1/h", "1/min", Q(1, 60), Q(0)),
    ("kV", "V", Q(1000), Q(0)), ("V", "mV", Q(1000), Q(0)), ("mV", "µV", Q(1000), Q(0)), ("V", "µV", Q(10**6), Q(0)), ("nV", "µV", Q(1, 1000), Q(0)),
    ("h", "min", Q(60), Q(0)), ("min", "s", Q(60), Q(0)), ("h", "s", Q(3600), Q(0)), ("s", "ms", Q(1000), Q(0)), ("ms", "µs", Q(1000), Q(0)),
    ("°F", "°C", Q(5, 9), Q(-160, 9)), ("°C", "K", Q(1), Q(27315, 100)), ("°F", "K", Q(5, 9), Q(45967, 180)),
]
# The canonical unit of each quantity.
CANONICAL = {"frequency": "mHz", "voltage": "µV", "time": "µs", "temperature": "K"}
# Spellings of a unit. A spelling that holds a capital M is compared as it stands, others in lower case.
SPELLINGS = {
    "mHz": ["mhz", "millihertz"], "Hz": ["hz", "hertz"], "kHz": ["khz", "kilohertz"], "MHz": ["MHz", "megahertz"],
    "1/s": ["1/s", "/s", "cps"], "1/min": ["1/min", "/min", "cpm"], "1/h": ["1/h", "/h"],
    "nV": ["nv", "nanovolt", "nanovolts"], "µV": ["µv", "μv", "uv", "muv", "microvolt", "microvolts"], "mV": ["mv", "millivolt", "millivolts"],
    "V": ["v", "volt", "volts"], "kV": ["kv", "kilovolt", "kilovolts"],
    "µs": ["µs", "μs", "us", "microseconds"], "ms": ["ms", "milliseconds"], "s": ["s", "sec", "seconds"], "min": ["min", "minutes"], "h": ["h", "hours"],
    "K": ["kelvin"], "°C": ["°c", "celsius"], "°F": ["°f", "fahrenheit"],
}
_NUMBER = r"(?<![\d.,/])([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)"


def compositions(edges=EDGES, canonical=CANONICAL) -> dict[str, tuple[str, Q, Q]]:
    """{unit: (quantity, factor, offset)} to the canonical unit by the fewest edges; ValueError if a cycle disagrees."""
    near: dict[str, list[tuple[str, Q, Q]]] = {}
    for a, b, f, o in edges:
        if f == 0:
            raise ValueError(f"conversion {a} to {b} can't be inverted")
        near.setdefault(b, []).append((a, f, o))
        near.setdefault(a, []).append((b, 1 / f, -o / f))
    found: dict[str, tuple[str, Q, Q]] = {}
    for quantity, target in canonical.items():
        if target in found:
            raise ValueError(f"{target} is reached from two canonical units")
        found[target] = (quantity, Q(1), Q(0))
        queue = deque([target])
        while queue:
            at = queue.popleft()
            _, f, o = found[at]
            for unit, g, p in near.get(at, []):  # at = unit * g + p
                if unit not in found:
                    found[unit] = (quantity, f * g, f * p + o)
                    queue.append(unit)
    for a, b, f, o in edges:
        if a in found:
            (qa, fa, oa), (qb, fb, ob) = found[a], found[b]
            if (qa, fa, oa) != (qb, fb * f, fb * o + ob):
                raise ValueError(f"conversion {a} to {b} disagrees with the other conversions")
    return found


def conversion_table(spark: SparkSession) -> DataFrame:
    """(spelling, quantity, mul, div, add): canonical = value * mul / div + add. Its size is that of the fixed lists above."""
    rows = []
    for unit, (quantity, f, o) in compositions().items():
        rows += [(s, quantity, float(f.numerator), float(f.denominator), float(o)) for s in SPELLINGS.get(unit, [])]
    return spark.createDataFrame(rows, "spelling string, quantity string, mul double, div double, add double")


def _spelled(quantity: str) -> str:
    found = compositions()
    words = sorted((s for u, ss in SPELLINGS.items() if found[u][0] == quantity for s in ss), key=lambda s: (-len(s), s))
    return "|".join(f"(?-i:{re.escape(w)})" if w == "MHz" else re.escape(w) for w in words).replace("\\/", "/")


def _unit(c: Column) -> Column:
    return F.when(c == "MHz", c).otherwise(F.lower(c))


def number(c: Column) -> Column:
    """Text of a number with a decimal point or comma as double."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def quantity_columns(value: Column, quantity: str) -> tuple[Column, Column, Column]:
    """(number, unit spelling, bare number): the first number that a unit of the quantity follows directly, and the number of a text that is nothing else."""
    with_unit = rf"{_NUMBER}\s*((?i:{_spelled(quantity)}))(?:/[vV])?(?![A-Za-zµμ])"
    bare = r"^\s*([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)\s*(?:/[vV])?\s*$"
    both = F.regexp_extract_all(value, F.lit(with_unit), 0)
    first = F.try_element_at(both, F.lit(1))
    take = lambda p, k: F.regexp_extract(first, p, k)
    return number(take(with_unit.replace(r"(?<![\d.,/])", ""), 1)), _unit(take(with_unit.replace(r"(?<![\d.,/])", ""), 2)), number(F.regexp_extract(value, bare, 1))


def unit_in(text: Column, quantity: str) -> Column:
    """The first unit of the quantity that stands as a word in a text, or the empty text."""
    return _unit(F.regexp_extract(text, rf"(?<![A-Za-zµμ/\d])((?i:{_spelled(quantity)}))(?![A-Za-zµμ])", 1))


def to_base(metadata: DataFrame, settings: dict[str, str]) -> DataFrame:
    """(rec_id, ord, base_value) of the metadata rows whose key is in ``settings`` ({lower-case key: quantity}), distinct.

    A unit in the value counts before one in the row Units of the same section; "/V" after a unit is dropped. Rows give
    nothing if key or value is null, or without a number or a unit of the right quantity; decibels, words and bare factors
    have neither. base_value is rounded half up to a whole canonical unit. Of several Units rows in a section the first by
    ord counts. Repeated rows give one row; columns other than rec_id, ord, path, key, value are ignored.
    """
    m = metadata.where("coalesce(is_section, false) = false AND value IS NOT NULL AND key IS NOT NULL")
    m = m.select("rec_id", "ord", F.concat_ws("\u0001", "path").alias("at"), F.lower(F.trim("key")).alias("k"), "value")
    units = m.where("k = 'units'").groupBy("rec_id", "at").agg(F.min_by("value", "ord").alias("units"))
    parts = []
    for key, quantity in settings.items():
        n, unit, bare = quantity_columns(F.col("value"), quantity)
        parts.append(m.where(F.col("k") == key).select("rec_id", "ord", "at", F.lit(quantity).alias("quantity"), n.alias("n"), unit.alias("u"), bare.alias("bare")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("n IS NOT NULL OR bare IS NOT NULL").distinct()
    chosen = F.lit(None).cast("string")
    for quantity in dict.fromkeys(settings.values()):
        chosen = F.when(F.col("quantity") == quantity, unit_in(F.col("units"), quantity)).otherwise(chosen)
    rows = rows.join(units, ["rec_id", "at"], "left").select(
        "rec_id", "ord", "quantity",
        F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("bare")).alias("n"),
        F.when(F.col("n").isNotNull(), F.col("u")).otherwise(chosen).alias("spelling"),
    )
    table = conversion_table(metadata.sparkSession)  # fixed size, so it may be sent to all
    base = F.col("n") * F.col("mul") / F.col("div") + F.col("add")
    return rows.join(F.broadcast(table), ["spelling", "quantity"]).select("rec_id", "ord", F.round(base).try_cast("bigint").alias("base_value")).where("base_value IS NOT NULL").distinct()
