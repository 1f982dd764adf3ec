"""Timestamps in mixed notations and time zones, normalised to microseconds since 1970-01-01 UTC.

Every notation is a branch of one regular expression with named groups. One replacement turns a matching text
into a delimited list of components, so a text is matched once and stays inside the JVM. The calendar is
checked and the instant put together by integer arithmetic on days and microseconds.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Minutes east of UTC of common zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120, "WAT": 60, "CAT": 120, "EAT": 180, "IST": 330, "NPT": 345,
    "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "ART": -180,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*"
_MONTH = "[A-Z][a-z]{2}"
_MARK = "\u0001"
_FIELDS = ("y", "m", "d", "h", "i", "x", "f", "p", "o", "z", "e")


def _clock(n: int, separator: str = "[:.-]") -> str:
    return rf"(?<h{n}>\d{{1,2}})(?<t{n}>{separator})(?<i{n}>\d{{2}})(?:\k<t{n}>(?<x{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?)?(?:\s*(?<p{n}>[AaPp][Mm])(?![A-Za-z]))?"


def _zone(n: int) -> str:
    return rf"(?:\s*(?<o{n}>[+-]\d{{2}}(?::?\d{{2}})?)|\s*\[?(?<z{n}>[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+){{0,2}})\]?)?"


def _branches() -> list[str]:
    return [
        rf"(?<y1>\d{{4}})(?<s1>[-:/._])(?<m1>\d{{1,2}})\k<s1>(?<d1>\d{{1,2}})(?:[Tt]|[\s_,]+){_clock(1)}{_zone(1)}",
        rf"(?<y2>\d{{4}})(?<m2>\d{{2}})(?<d2>\d{{2}})(?:[Tt _-])?(?<h2>\d{{2}})(?<i2>\d{{2}})(?<x2>\d{{2}})(?:[.,](?<f2>\d{{1,9}}))?{_zone(2)}",
        rf"(?<y3>\d{{4}})(?<m3>\d{{2}})(?<d3>\d{{2}})(?:[Tt]|[\s_,]+){_clock(3)}{_zone(3)}",
        rf"(?<y4>\d{{4}})(?<s4>[-:/._])(?<m4>\d{{1,2}})\k<s4>(?<d4>\d{{1,2}})(?:[Tt]|[\s_,]+)(?<h4>\d{{2}})(?<i4>\d{{2}})(?<x4>\d{{2}})(?:[.,](?<f4>\d{{1,9}}))?{_zone(4)}",
        rf"(?<d5>\d{{1,2}})\.(?<m5>\d{{1,2}})\.(?<y5>\d{{4}})[,\s]\s*{_clock(5, ':')}{_zone(5)}",
        rf"(?<m6>\d{{1,2}})/(?<d6>\d{{1,2}})/(?<y6>\d{{4}})[,\s]\s*{_clock(6, ':')}{_zone(6)}",
        rf"(?:{_DAY},?\s+)?(?<d7>\d{{1,2}})\s+(?<m7>{_MONTH})[a-z]*\s+(?<y7>\d{{4}})\s+{_clock(7, ':')}{_zone(7)}",
        rf"(?:{_DAY}\s+)?(?<m8>{_MONTH})\s+(?<d8>\d{{1,2}})\s+{_clock(8, ':')}{_zone(8)}\s+(?<y8>\d{{4}})",
        r"(?<e9>\d{9,10}|\d{12,13})",
    ]


def pattern() -> str:
    """The alternation of all notations, anchored at both ends."""
    return rf"^\s*(?:{'|'.join(_branches())})\s*$"


def _replacement() -> str:
    groups = [[f"${{{f}{n}}}" for n, b in enumerate(_branches(), 1) if f"(?<{f}{n}>" in b] for f in _FIELDS]
    return _MARK + _MARK.join("".join(g) for g in groups)


@cache
def _zones() -> list[str]:
    """Every zone name that the JVM, whose rules apply, knows: with and without slash, Etc/* and legacy names too."""
    known = set(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted({z for z in known if not z.startswith("SystemV/")} | {"EST", "MST", "HST"})  # Spark knows these three besides


def utc_micros(text: Column | str, zone: Column | str | None = None) -> Column:
    """Microseconds since 1970-01-01 UTC of a text, or null.

    Null comes of: null or empty text, no full date with time of day, a date or time that doesn't exist, an unknown
    zone name, or a time without zone where ``zone`` (an IANA name) is null or unknown. Zone names, legacy ones such as Japan or
    Etc/GMT+5 included, are those of the JVM; what is an abbreviation as well, such as EST, counts as one. Dotted dates are day first,
    slashed ones month first unless the year leads; missing seconds are 0; digits beyond microseconds are cut.
    A local time that occurs twice is the earlier instant, one that is skipped moves on by the skip.
    Nine or ten digits are an epoch in seconds, twelve or thirteen in milliseconds.
    """
    c = F.col(text) if isinstance(text, str) else text
    home = F.lit(None).cast("string") if zone is None else F.col(zone) if isinstance(zone, str) else zone
    parts = F.split(F.regexp_replace(c, pattern(), _replacement()), _MARK)

    def read(got: Column) -> Column:
        word = lambda i: F.try_element_at(got, F.lit(i + 2))
        number = lambda i: word(i).try_cast("bigint")
        at = F.instr(F.lit(MONTHS), F.lower(word(1)))
        month = F.coalesce(number(1), F.when((F.length(word(1)) == 3) & (at % 3 == 1), F.floor((at + 2) / 3)))
        return F.struct(
            number(0).alias("y"), month.alias("m"), number(2).alias("d"), number(3).alias("h"), number(4).alias("i"),
            F.coalesce(number(5), F.lit(0)).alias("x"), F.coalesce(F.rpad(F.substring(word(6), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)).alias("f"),
            F.lower(word(7)).alias("p"), word(8).alias("o"), word(9).alias("z"), word(10).alias("e"),
        )

    def assemble(r: Column) -> Column:
        g = lambda k: r.getField(k)
        return F.struct(g("e").alias("e"), g("o").alias("o"), g("z").alias("z"), _local(g).alias("local"))

    def _local(g) -> Column:
        leap = ((g("y") % 4 == 0) & (g("y") % 100 != 0)) | (g("y") % 400 == 0)
        longest = F.when(g("m") == 2, F.when(leap, 29).otherwise(28)).when(g("m").isin(4, 6, 9, 11), 30).otherwise(31)
        half = g("p").isin("am", "pm")
        hour = F.when(half, g("h") % 12 + F.when(g("p") == "pm", 12).otherwise(0)).otherwise(g("h"))
        valid = g("y").between(1, 9999) & g("m").between(1, 12) & g("d").between(1, longest) & g("i").between(0, 59) & g("x").between(0, 59)
        valid = valid & F.when(half, g("h").between(1, 12)).otherwise(g("h").between(0, 23))
        yy, mm = g("y") - (g("m") <= 2).cast("bigint"), (g("m") + 9) % 12
        div = lambda a, n: F.floor(a / F.lit(n))
        days = yy * 365 + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(mm * 153 + 2, 5) + g("d") - 1 - 719468
        return F.when(valid, (((days * 24 + hour) * 60 + g("i")) * 60 + g("x")) * 1_000_000 + g("f"))

    def instant(r: Column) -> Column:
        e, o, z, local = (r.getField(k) for k in ("e", "o", "z", "local"))
        digits = F.regexp_replace(F.substring(o, 2, 5), ":", "")
        minutes = F.substring(digits, 1, 2).try_cast("bigint") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("bigint"), F.lit(0))
        east = F.when(minutes <= 18 * 60, F.when(o.startswith("-"), -minutes).otherwise(minutes))
        table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
        fixed = F.when(o != "", east).otherwise(F.try_element_at(table, F.upper(z)).cast("bigint"))
        name = F.when(z == "", home).otherwise(z)
        at = F.to_utc_timestamp(F.timestamp_micros(local), F.when(name.isin(*_zones()), name))
        epoch = e.try_cast("bigint") * F.when(F.length(e) <= 10, 1_000_000).otherwise(1_000)
        return F.when(e != "", epoch).when(fixed.isNotNull(), local - fixed * 60_000_000).when(o == "", F.unix_micros(at))

    # Each step is bound once by a transform of at most one element, so that no expression is computed twice.
    matched = F.filter(F.array(parts), lambda p: F.size(p) == len(_FIELDS) + 1)
    steps = F.transform(F.transform(F.transform(matched, read), assemble), instant)
    return F.try_element_at(steps, F.lit(1))


def start_times(metadata: DataFrame, files: DataFrame, sites: DataFrame) -> DataFrame:
    """Start times of recordings: (rec_id, ord, utc_us), distinct, for every metadata row that gives one.

    Rows with key DateTimeOriginal or DateCreated, and OriginationDate of a section BEXT joined with OriginationTime
    of the same section. Keys and section names match in any case. Rows with null keys or values give nothing; repeated
    rows give one row; where a recording has several sites, the least id counts; a recording without files has no zone.
    Only rec_id, ord, path, key, value, is_section of metadata, rec_id and site_id of files, and site_id and tz_name of
    sites are read, so further columns do no harm.
    """
    m = metadata.select("rec_id", "ord", "path", F.lower(F.trim("key")).alias("k"), "value").where("coalesce(is_section, false) = false AND value IS NOT NULL")
    whole = m.where(F.col("k").isin("datetimeoriginal", "datecreated")).select("rec_id", "ord", F.col("value").alias("said"))
    bext = m.where(F.col("k").isin("originationdate", "originationtime") & (F.upper(F.try_element_at("path", F.lit(-1))) == "BEXT"))
    section = F.concat_ws("\u0001", "path")
    date = bext.where("k = 'originationdate'").select("rec_id", "ord", section.alias("at"), "value").distinct()
    time = bext.where("k = 'originationtime'").groupBy("rec_id", section.alias("at")).agg(F.min_by("value", "ord").alias("time"))
    both = date.join(time, ["rec_id", "at"]).select("rec_id", "ord", F.concat_ws(" ", F.trim("value"), F.trim("time")).alias("said"))
    zone = (
        files.where("site_id IS NOT NULL").groupBy("rec_id").agg(F.min("site_id").alias("site_id"))
        .join(sites.where("tz_name IS NOT NULL").groupBy("site_id").agg(F.min("tz_name").alias("tz_name")), "site_id")
        .select("rec_id", "tz_name")
    )
    found = whole.unionByName(both).distinct().join(zone, "rec_id", "left")
    return found.select("rec_id", "ord", utc_micros("said", "tz_name").alias("utc_us")).where("utc_us IS NOT NULL").distinct()
