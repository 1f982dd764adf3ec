"""Queries of the training-data problems that concern any recording: time stamps, intervals, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonargrid.operators import intervals, timestamps, units
from sonargrid.session import table

SETTINGS = {"highpass": "frequency", "gain": "voltage"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.start_times(table(spark, d, "metadata"), table(spark, d, "files"), table(spark, d, "sites"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(intervals.marker_intervals(table(spark, d, "markers")), ["rec_id", "label"])


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(intervals.marker_intervals(table(spark, d, "markers")), ["rec_id", "label"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.to_base(table(spark, d, "metadata"), SETTINGS)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_periods, p5_found)}

_INTERVALS = """i AS (
  SELECT DISTINCT rec_id, lower(trim(label)) AS label, pos AS s, pos + span AS e FROM markers WHERE span > 0 AND trim(label) <> ''
), o AS (
  SELECT *, max(e) OVER (PARTITION BY rec_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i
)"""
_NUM = "[-+]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"
# spelling, quantity, factor to the base unit; the two that differ in case only come first
_UNITS = """u(name, quantity, f) AS (VALUES ('hz','highpass',1e3),('hertz','highpass',1e3),('khz','highpass',1e6),('kilohertz','highpass',1e6),('mhz','highpass',1),('millihertz','highpass',1),
 ('1/s','highpass',1e3),('/s','highpass',1e3),('cps','highpass',1e3),('1/min','highpass',1e3/60),('/min','highpass',1e3/60),('cpm','highpass',1e3/60),
 ('v','gain',1e6),('volt','gain',1e6),('volts','gain',1e6),('mv','gain',1e3),('millivolt','gain',1e3),('millivolts','gain',1e3),('uv','gain',1),('muv','gain',1),('µv','gain',1),('μv','gain',1),('microvolt','gain',1),('microvolts','gain',1),('kv','gain',1e9))"""
_FREQ = "millihertz|kilohertz|hertz|khz|mhz|hz|1/min|/min|1/s|/s|cps|cpm"
_VOLT = "microvolts?|millivolts?|volts?|muv|uv|µv|μv|mv|kv|v"


def _units_sql() -> str:
    parts = []
    for key, names in (("highpass", _FREQ), ("gain", _VOLT)):
        parts.append(f"""SELECT m.rec_id, m.ord, '{key}' AS quantity, regexp_extract(value, '(?:^|[^0-9.,/])({_NUM})\\s*(?i:{names})(?:/[vV])?(?:[^A-Za-zµμ]|$)', 1) AS n,
  lower(regexp_extract(value, '(?:^|[^0-9.,/]){_NUM}\\s*((?i:{names}))(?:/[vV])?(?:[^A-Za-zµμ]|$)', 1)) AS name, regexp_extract(value, '^\\s*({_NUM})\\s*(?:/[vV])?\\s*$', 1) AS bare,
  lower(regexp_extract(t.units, '(?:^|[^A-Za-zµμ/0-9])((?i:{names}))(?:[^A-Za-zµμ]|$)', 1)) AS given FROM m LEFT JOIN t USING (rec_id, place) WHERE k = '{key}'""")
    return f"""WITH {_UNITS}, m AS (SELECT DISTINCT rec_id, ord, array_to_string(path, '/') AS place, lower(trim(key)) AS k, value FROM metadata WHERE value IS NOT NULL AND NOT coalesce(is_section, false)),
t AS (SELECT rec_id, place, arg_min(value, ord) AS units FROM m WHERE k = 'units' GROUP BY 1, 2), p AS ({" UNION ALL ".join(parts)}),
c AS (SELECT rec_id, ord, quantity, replace(CASE WHEN n <> '' THEN n ELSE bare END, ',', '.')::DOUBLE AS v, CASE WHEN n <> '' THEN name ELSE given END AS name FROM p WHERE n <> '' OR bare <> '')
SELECT DISTINCT rec_id, ord, round(v * f)::BIGINT AS base_value FROM c JOIN u USING (name, quantity)"""


# Hours east of UTC of zone abbreviations, written down for this check alone
_EAST = """Z +0|UTC +0|GMT +0|UT +0|WET +0|WEST +1|BST +1|CET +1|CEST +2|MEZ +1|MESZ +2|EET +2|EEST +3|MSK +3|SAST +2|WAT +1|CAT +2|EAT +3|IST +5.5|NPT +5.75|SGT +8|HKT +8|AWST +8|JST +9|KST +9
|ACST +9.5|ACDT +10.5|AEST +10|AEDT +11|NZST +12|NZDT +13|NST -3.5|NDT -2.5|AST -4|ADT -3|EST -5|EDT -4|CST -6|CDT -5|MST -7|MDT -6|PST -8|PDT -7|AKST -9|AKDT -8|HST -10|BRT -3|BRST -2|ART -3"""
# each notation is rewritten to "year-month-day clock rest" first
_REWRITES = [
    (r"^(\d{4})(\d{2})(\d{2})[T _-]?(\d{2})(\d{2})(\d{2})$", r"\1-\2-\3 \4:\5:\6"), (r"^(\d{4})(\d{2})(\d{2})[T ]+(\d{1,2}[:.-])", r"\1-\2-\3 \4"),
    (r"^(\d{4})[-:/._](\d{1,2})[-:/._](\d{1,2})[T ]+(\d{2})(\d{2})(\d{2})$", r"\1-\2-\3 \4:\5:\6"), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s*(\d{1,2}:\d{2})", r"\3-\2-\1 \4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+", r"\3-\1-\2 "), (r"^[A-Z][a-z]{2}, (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) ", r"\3-\2-\1 "),
    (r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\S+) (\d{4})$", r"\4-\1-\2 \3"),
]
_PARTS = r"^(\d{4})[-:/._](\d{1,2}|[A-Z][a-z]{2})[-:/._](\d{1,2})[T ]+(\d{1,2})[:.-](\d{2})(?:[:.-](\d{2})(?:[.,](\d{1,9}))?)?\s*(.*)$"


def _times_sql() -> str:
    text = "said"
    for old, new in _REWRITES:
        text = f"regexp_replace({text}, '{old}', '{new}')"
    return f"""WITH m AS (SELECT DISTINCT rec_id, ord, array_to_string(path, '/') AS place, path, lower(trim(key)) AS k, trim(value) AS value FROM metadata WHERE value IS NOT NULL AND NOT coalesce(is_section, false)),
b AS (SELECT * FROM m WHERE upper(path[-1]) = 'BEXT'), said AS (SELECT rec_id, ord, value AS said FROM m WHERE k IN ('datetimeoriginal', 'datecreated')
  UNION SELECT d.rec_id, d.ord, d.value || ' ' || t.value FROM b d JOIN (SELECT rec_id, place, arg_min(value, ord) AS value FROM b WHERE k = 'originationtime' GROUP BY 1, 2) t USING (rec_id, place) WHERE d.k = 'originationdate'),
z AS (SELECT rec_id, min(tz_name) AS home FROM (SELECT rec_id, min(site_id) AS site_id FROM files GROUP BY 1) JOIN sites USING (site_id) GROUP BY 1),
p AS (SELECT *, regexp_extract({text}, '{_PARTS}', ['y', 'm', 'd', 'h', 'i', 'x', 'f', 'rest']) AS g FROM said LEFT JOIN z USING (rec_id)),
n AS (SELECT rec_id, ord, said, home, g.y AS y, lpad(CASE WHEN regexp_matches(g.m, '^[A-Z]') THEN list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(g.m))::VARCHAR ELSE g.m END, 2, '0') AS m, lpad(g.d, 2, '0') AS d, g.h AS hh, g.i AS i, coalesce(nullif(g.x, ''), '00') AS x, rpad(left(g.f, 6), 6, '0') AS f,
  lower(regexp_extract(g.rest, '^([AaPp][Mm])$', 1)) AS half, trim(regexp_replace(g.rest, '^[AaPp][Mm]$', ''), '[] ') AS zone FROM p),
h AS (SELECT *, CASE WHEN half = '' THEN hh::INT WHEN hh::INT BETWEEN 1 AND 12 THEN hh::INT % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END ELSE 99 END AS hour FROM n WHERE y <> ''),
l AS (SELECT *, try_cast(y || '-' || m || '-' || d || ' ' || lpad(hour::VARCHAR, 2, '0') || ':' || i || ':' || x || '.' || f AS TIMESTAMP) AS local FROM h WHERE hour < 24),
ab AS (SELECT split_part(trim(e), ' ', 1) AS zone, (split_part(trim(e), ' ', 2)::DOUBLE * 60)::INT AS east FROM (SELECT unnest(string_split(replace('{_EAST}', chr(10), ''), '|')) AS e)),
o AS (SELECT l.*, CASE WHEN regexp_matches(l.zone, '^[+-]') THEN (CASE l.zone[1] WHEN '-' THEN -1 ELSE 1 END) * (l.zone[2:3]::INT * 60 + coalesce(nullif(replace(l.zone[4:], ':', ''), ''), '0')::INT) ELSE ab.east END AS minutes, CASE WHEN l.zone = '' THEN home WHEN l.zone IN (SELECT name FROM pg_timezone_names()) THEN l.zone END AS name FROM l LEFT JOIN ab ON ab.zone = upper(l.zone) WHERE local IS NOT NULL),
w AS (SELECT *, CASE WHEN minutes IS NULL AND name IS NOT NULL THEN timezone(name, local) END AS moment FROM o)
SELECT DISTINCT rec_id, ord, CASE WHEN minutes IS NOT NULL THEN epoch_us(local) - minutes::BIGINT * 60000000 WHEN timezone(name, moment - INTERVAL 1 HOUR) = local THEN epoch_us(moment) - 3600000000 ELSE epoch_us(moment) END AS utc_us FROM w WHERE minutes IS NOT NULL OR name IS NOT NULL
UNION SELECT rec_id, ord, CASE WHEN length(said) <= 10 THEN said::BIGINT * 1000000 ELSE said::BIGINT * 1000 END FROM said WHERE regexp_matches(said, '^(\\d{{9,10}}|\\d{{12,13}})$')"""


ORACLES = {
    "p1_found": _times_sql(),
    "p5_found": _units_sql(),
    "p4_found": f"WITH {_INTERVALS} SELECT rec_id, label, reach AS gap_start, s AS gap_end FROM o WHERE s > reach",
    "p4_periods": f"""WITH {_INTERVALS}, g AS (
  SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o
) SELECT rec_id, label, min(s) AS period_start, max(e) AS period_end FROM g GROUP BY rec_id, label, k""",
}
