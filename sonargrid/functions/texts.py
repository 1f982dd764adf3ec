"""Dates in file names, notes, lists and names as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of dates and times within a text.
DATE, DATE_PLAIN = r"[123]\d{3}-[01]\d-[0123]\d", r"[123]\d{3}[01]\d[0123]\d"
TIME, TIME_PLAIN = r"[012]\d:[0-5]\d:[0-5]\d", r"[012]\d[0-5]\d[0-5]\d"


def _first(c: Column, pattern: str) -> Column:
    got = F.regexp_extract(c, f"({pattern})", 1)
    return F.when(got != "", got)


def _after_date(c: Column) -> tuple[Column, Column]:
    """(text up to the end of the first date, the rest)."""
    p = F.when(c.rlike(DATE), F.regexp_extract(c, f"^(.*?{DATE})", 1)).when(c.rlike(DATE_PLAIN), F.regexp_extract(c, f"^(.*?{DATE_PLAIN})", 1)).otherwise(F.lit(""))
    return p, F.substring(c, F.length(p) + 1, F.length(c))


def parse_datetime(c: Column) -> Column:
    """TIMESTAMP_NTZ of the first date in a text and the first time after it; 0001-01-01 or 00:00:00 where one is missing, null where both are or the date doesn't exist."""
    _, rest = _after_date(c)
    date = F.coalesce(_first(c, DATE), F.regexp_replace(_first(c, DATE_PLAIN), r"(\d{4})(\d\d)(\d\d)", "$1-$2-$3"))
    time = F.coalesce(_first(rest, TIME), F.regexp_replace(_first(rest, TIME_PLAIN), r"(\d\d)(\d\d)(\d\d)", "$1:$2:$3"))
    text = F.concat_ws(" ", F.coalesce(date, F.lit("0001-01-01")), F.coalesce(time, F.lit("00:00:00")))
    return F.when(date.isNotNull() | time.isNotNull(), text.try_cast("timestamp_ntz"))


def replace_datetime(c: Column, when: Column) -> Column:
    """The text with its dates, and the times after the first date, set to ``when`` in the style they had; unchanged where ``when`` is null."""
    head, rest = _after_date(c)
    day, clock = F.date_format(when, "yyyy-MM-dd"), F.date_format(when, "HH:mm:ss")
    dashed = c.rlike(DATE)
    put = lambda t: F.when(dashed, F.regexp_replace(t, F.lit(DATE), day)).otherwise(F.regexp_replace(t, F.lit(DATE_PLAIN), F.replace(day, F.lit("-"), F.lit(""))))
    r = put(rest)
    r = F.when(r.rlike(TIME), F.regexp_replace(r, F.lit(TIME), clock)).otherwise(F.regexp_replace(r, F.lit(TIME_PLAIN), F.replace(clock, F.lit(":"), F.lit(""))))
    return F.when(when.isNull(), c).otherwise(F.concat(put(head), r))


def note2freq(c: Column, a4: float = 440.0) -> Column:
    """Frequency of a note such as "a4", "f#3" or "eb5", without a number in octave 4; null if it is no note."""
    ok = c.rlike(r"^[a-g][b#]?[0-9]{0,3}$")
    letter, sign, octave = (F.regexp_extract(c, r"^([a-g])([b#]?)([0-9]{0,3})$", i) for i in (1, 2, 3))
    base = F.element_at(F.array(*[F.lit(t) for t in (9, 11, 0, 2, 4, 5, 7)]), F.ascii(letter) - 96)  # half tones above c
    tone = base + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0) + 12 * (F.coalesce(octave.try_cast("int"), F.lit(4)) - 4) - 9
    return F.when(ok, F.lit(float(a4)) * F.pow(F.lit(2.0), F.when(ok, tone).otherwise(0) / F.lit(12.0)))


def parse_channels(c: Column) -> Column:
    """ARRAY<INT> of a list such as "0-2,5"; parts that are neither number nor range are left out."""
    def span(p: Column) -> Column:
        low, high = (F.regexp_extract(p, r"^\s*(\d+)(?:\s*-\s*(\d+))?\s*$", i).try_cast("int") for i in (1, 2))
        return F.when(low.isNull() | (F.coalesce(high, low) < low), F.array().cast("array<int>")).otherwise(F.sequence(low, F.coalesce(high, low)))

    return F.flatten(F.transform(F.split(c, ","), span))


def key_values(c: Column, pair: str = ",", key: str = "=") -> Column:
    """MAP of a list such as "a=1, b=2", keys and values without outer spaces; of a repeated key the last value counts, parts without ``key`` are left out."""
    parts = F.filter(F.split(c, pair), lambda p: F.instr(p, key) > 0)
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, key, 1)).alias("k"), F.trim(F.substring(p, F.instr(p, key) + 1, F.length(p))).alias("v")))
    return F.map_from_entries(F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), F.when(~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]), e["v"]).alias("v"))), lambda e: e["v"].isNotNull()))


def history(encoding: Column, rate: Column, channels: Column, text: Column | None = None) -> Column:
    """A line of coding history such as "A=PCM,F=44100,W=16,M=stereo,T=text"; unknown parts are left out."""
    kind = F.regexp_extract(encoding, r"^([A-Z]+)(?:_|$)", 1)
    bits = F.regexp_extract(encoding, r"_[A-Z]?(\d+)$", 1)
    mode = F.when(channels == 1, "mono").when(channels == 2, "stereo").when(channels > 2, "multi")
    parts = [F.concat(F.lit("A="), F.when(kind == "PCM", "PCM").otherwise(F.coalesce(encoding, F.lit("")))), F.concat(F.lit("F="), F.format_string("%.0f", rate)),
             F.when(bits != "", F.concat(F.lit("W="), bits)), F.concat(F.lit("M="), mode)]
    return F.concat_ws(",", *parts, *([F.concat(F.lit("T="), text)] if text is not None else []))


def format_from_extension(path: Column) -> Column:
    """Audio format of a path's suffix in upper case, WAVE as WAV and MPEG as MP; null without a suffix."""
    s = F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(s != "", F.when(s == "WAVE", "WAV").when(s.startswith("MPEG"), F.concat(F.lit("MP"), F.substring(s, 5, 9))).otherwise(s))


def fill_name(pattern: Column, values: Column, keys: list[str]) -> Column:
    """A name with "{Key}" replaced by the value of the map ``values``, spaces as underscores; unknown keys stay."""
    out = pattern
    for k in keys:
        v = F.replace(F.try_element_at(values, F.lit(k)), F.lit(" "), F.lit("_"))
        out = F.when(v.isNotNull(), F.replace(out, F.lit("{" + k + "}"), v)).otherwise(out)
    return out
