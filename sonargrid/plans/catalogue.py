"""Queries that apply the library's operators to whole tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonargrid.functions import quantities, texts
from sonargrid.operators import metadata as meta
from sonargrid.operators import recordings as rec
from sonargrid.operators import signal as sig
from sonargrid.session import is_small, shared_folder, table
from sonargrid.sources import riff_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SIG = """sig AS (SELECT rec_id, channel, frame, max(x) AS x FROM samples
  WHERE rec_id IS NOT NULL AND channel IS NOT NULL AND frame IS NOT NULL GROUP BY rec_id, channel, frame)"""
_MD = "md AS (SELECT DISTINCT rec_id, ord, dict_ord, path, key, value, vtype, is_section FROM metadata WHERE key IS NOT NULL AND ord IS NOT NULL)"
_LEAF = "leaf AS (SELECT * FROM md WHERE NOT coalesce(is_section, false))"
_FILES = """fs AS (SELECT * EXCLUDE (rn) REPLACE (CASE WHEN upper(trim(format)) = 'WAVE' THEN 'WAV' ELSE upper(trim(format)) END AS format, coalesce(end_index - start_index, frames) AS frames)
  FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, file_idx ORDER BY coalesce(loaded_at, TIMESTAMP '0001-01-01') DESC, path DESC) AS rn FROM files) WHERE rn = 1)"""
_MARKERS = "mk AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, marker_id ORDER BY coalesce(loaded_at, TIMESTAMP '0001-01-01') DESC, pos DESC) AS rn FROM markers) WHERE rn = 1)"


def query(sql: str | None = None):
    """Register a query by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return sig.signal(table(spark, d, "samples"))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return meta.distinct_rows(table(spark, d, "metadata"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return rec.distinct_files(table(spark, d, "files"))


def _markers(spark: SparkSession, d: str) -> DataFrame:
    return rec.distinct_markers(table(spark, d, "markers"))


def _nano(x: str) -> Column:
    """Results of sines and powers in whole 10**-9, as libraries differ in the last bit."""
    return F.rint(F.col(x) * 1e9).cast("bigint").alias("x_nano")


# samples

@query(f"WITH {_SIG} SELECT * FROM sig WHERE frame >= 100 AND frame < 900")
def slice_range(spark, d):
    return sig.slice_frames(_signal(spark, d), 100, 900)


@query(f"WITH {_SIG}, n AS (SELECT rec_id, max(frame) + 1 AS n FROM sig GROUP BY rec_id) SELECT s.* FROM sig s JOIN n USING (rec_id) WHERE frame >= greatest(n - 50, 0) AND (frame - greatest(n - 50, 0)) % 3 = 0")
def slice_step(spark, d):
    return sig.slice_frames(_signal(spark, d), -50, None, 3)


@query(f"WITH {_SIG}, want AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 59)) t(position, frame)) SELECT position, rec_id, channel, frame, x FROM sig JOIN want USING (frame)")
def index_list(spark, d):
    return sig.take_frames(_signal(spark, d), [7, 3, 7, 59])


@query(f"WITH {_SIG}, n AS (SELECT rec_id, max(frame) + 1 AS n FROM sig GROUP BY rec_id), want AS (SELECT * FROM (VALUES (0, -1), (1, 0), (2, -10), (3, -1)) t(position, f)) SELECT position, s.rec_id, channel, frame, x FROM n, want JOIN sig s ON s.rec_id = n.rec_id AND s.frame = f + CASE WHEN f < 0 THEN n ELSE 0 END")
def index_list_from_end(spark, d):
    return sig.take_frames(_signal(spark, d), [-1, 0, -10, -1])


@query(f"WITH {_SIG}, r AS (SELECT rec_id, max(rate) AS rate FROM files GROUP BY rec_id) SELECT s.* FROM sig s JOIN r USING (rec_id) WHERE frame >= trunc(0.002::DOUBLE * rate)::BIGINT AND frame < trunc(0.01::DOUBLE * rate)::BIGINT + 1")
def time_range(spark, d):
    return sig.time_range(_signal(spark, d), table(spark, d, "files"), 0.002, 0.01)


@query(f"WITH {_SIG} SELECT rec_id, CASE channel WHEN 1 THEN 0 ELSE 1 END AS channel, frame, x FROM sig WHERE channel IN (0, 1)")
def channel_select(spark, d):
    return sig.select_channels(_signal(spark, d), [1, 0])


@query(f"WITH {_SIG} SELECT rec_id, channel, frame, CASE WHEN x IS NOT NULL THEN least(greatest(x * 2.5::DOUBLE, -1.0::DOUBLE), 1.0::DOUBLE) END AS x FROM sig")
def scale_clip(spark, d):
    return sig.clip(sig.scale(_signal(spark, d), 2.5), 1.0)


_SUM = "sum(round_even(x / power(2.0, -30), 0)::BIGINT)::DOUBLE * power(2.0, -30)"


@query(f"WITH {_SIG}, m AS (SELECT rec_id, channel, {_SUM} / count(x) AS mean FROM sig GROUP BY rec_id, channel) SELECT rec_id, channel, frame, x - mean AS x FROM sig JOIN m USING (rec_id, channel)")
def dc_remove(spark, d):
    return sig.remove_mean(_signal(spark, d))


@query(f"WITH {_SIG}, m AS (SELECT rec_id, max(abs(x)) AS top FROM sig GROUP BY rec_id) SELECT rec_id, channel, frame, CASE WHEN top > 0 THEN x / top ELSE x END AS x FROM sig JOIN m USING (rec_id)")
def autoscale(spark, d):
    return sig.autoscale(_signal(spark, d))


@query(f"WITH {_SIG} SELECT rec_id, channel, frame, least(greatest(floor(x * 32768)::BIGINT, -32768), 32767) AS q FROM sig")
def quantize_pcm16(spark, d):
    return sig.quantize(_signal(spark, d)).withColumn("q", F.col("q").cast("bigint"))


@query(f"WITH {_SIG} SELECT rec_id, channel, count(x) AS n, min(x) AS low, max(x) AS high, {_SUM} / count(x) AS mean, sqrt(sum(round_even(x * x / power(2.0, -30), 0)::BIGINT)::DOUBLE * power(2.0, -30) / count(x)) AS rms FROM sig GROUP BY rec_id, channel")
def channel_stats(spark, d):
    return sig.channel_stats(_signal(spark, d))


@query(f"WITH {_SIG} SELECT rec_id, max(abs(x - least(greatest(floor(x * 32768)::BIGINT, -32768), 32767) / 32768.0::DOUBLE)) AS worst FROM sig GROUP BY rec_id")
def quantization_error(spark, d):
    return sig.quantization_error(_signal(spark, d))


@query(f"""WITH {_SIG}, e AS (SELECT rec_id, channel, x - least(greatest(floor(x * 32768)::BIGINT, -32768), 32767) / 32768.0::DOUBLE AS d FROM sig),
g AS (SELECT rec_id, channel, count(d) AS n, max(abs(d)) AS worst, {_SUM.replace('x /', 'd /')} / count(d) AS mean, {_SUM.replace('x /', '(d * d) /')} / count(d) AS square FROM e GROUP BY 1, 2)
SELECT rec_id, channel, n, worst, mean, sqrt(greatest(square - mean * mean, 0)) AS std FROM g""")
def difference_std(spark, d):
    """The samples against themselves as 16-bit numbers."""
    s = _signal(spark, d)
    return sig.difference_stats(s, sig.quantize(s).select("rec_id", "channel", "frame", (F.col("q") / 32768.0).alias("x")))


def _despike_sql(n: int, thresh: float) -> str:
    ctes, src = [_SIG], "sig"
    w = "OVER (PARTITION BY rec_id, channel ORDER BY frame)"
    for k in range(n, 0, -1):
        up, back = f"lead(x) {w} - x", f"lead(x, {k + 1}) {w} - lead(x, {k}) {w}"
        ctes.append(f"s{k} AS (SELECT *, coalesce(({up} > {thresh} AND {back} < -{thresh}) OR ({up} < -{thresh} AND {back} > {thresh}), false) AS sel FROM {src})")
        src = f"s{k}"
        for j in range(1, k + 1):
            ctes.append(f"r{k}{j} AS (SELECT rec_id, channel, frame, sel, CASE WHEN lag(sel, {j}) {w} THEN (lag(x, {j}) {w} * {k + 1 - j} + lead(x, {k + 1 - j}) {w} * {j}) / {k + 1} ELSE x END AS x FROM {src})")
            src = f"r{k}{j}"
        ctes.append(f"d{k} AS (SELECT rec_id, channel, frame, x FROM {src})")
        src = f"d{k}"
    return f"WITH {', '.join(ctes)} SELECT * FROM {src}"


@query(_despike_sql(1, 0.5))
def despike_1(spark, d):
    return sig.despike(table(spark, d, "samples"), 0.5, 1)


@query(_despike_sql(2, 0.3))
def despike_2(spark, d):
    return sig.despike(table(spark, d, "samples"), 0.3, 2)


def _unwrap_sql(wrapped: str, out: str, levels: int = 20) -> str:
    """Each sample maps the three steps before it (places 1 to 3) to the step after it; up to 2**levels samples a channel are composed by doubling."""
    ctes = [_SIG, f"w AS (SELECT rec_id, channel, frame, {wrapped} AS x FROM sig)", "b AS (SELECT *, lag(x) OVER (PARTITION BY rec_id, channel ORDER BY frame) AS p FROM w)",
            "d AS (SELECT rec_id, channel, frame, x, list_transform([-2.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE], lambda s: x - (p + s)) AS dd FROM b)",
            "c AS (SELECT *, list_transform(dd, lambda d: CASE WHEN x >= 0 AND abs(d - 2) < abs(d) THEN -2 ELSE 0 END) AS c1 FROM d)",
            "e AS (SELECT *, list_transform([1, 2, 3], lambda i: CASE WHEN x <= 0 AND abs(dd[i] + 2) < abs(dd[i] + c1[i]) THEN 2 ELSE c1[i] END) AS c2 FROM c)",
            "m0 AS (SELECT rec_id, channel, frame, x, list_transform([1, 2, 3], lambda i: CASE WHEN dd[i] IS NOT NULL AND (c2[i] = 0 OR abs(dd[i]) > 1.5::DOUBLE) THEN c2[i] // 2 + 2 ELSE i END) AS m FROM e)"]
    for k in range(levels):
        ctes += [f"l{k} AS (SELECT *, lag(m, {1 << k}) OVER (PARTITION BY rec_id, channel ORDER BY frame) AS q FROM m{k})",
                 f"m{k + 1} AS (SELECT rec_id, channel, frame, x, CASE WHEN q IS NULL THEN m ELSE [m[q[1]], m[q[2]], m[q[3]]] END AS m FROM l{k})"]
    return f"WITH {', '.join(ctes)}, u AS (SELECT rec_id, channel, frame, x + (m[2] - 2) * 2.0::DOUBLE AS x FROM m{levels}) SELECT rec_id, channel, frame, {out} AS x FROM u"


@query(_unwrap_sql("x * 2.0::DOUBLE - 2.0::DOUBLE * floor((x * 2.0::DOUBLE + 1.0::DOUBLE) / 2.0::DOUBLE)", "x"))
def unwrap(spark, d):
    """Twice the samples, wrapped into the range, are unwrapped again."""
    doubled = sig.scale(_signal(spark, d), 2.0)
    wrapped = doubled.withColumn("x", F.col("x") - 2.0 * F.floor((F.col("x") + 1.0) / 2.0))
    return sig.unwrap(wrapped)


@query(_unwrap_sql("x", "CASE WHEN x IS NOT NULL THEN least(greatest(x, -1.0::DOUBLE), 1.0::DOUBLE) END"))
def unwrap_clip(spark, d):
    return sig.unwrap(table(spark, d, "samples"), mode="clip")


@query(f"""WITH {_SIG}, n AS (SELECT rec_id, channel, max(frame) + 1 AS n FROM sig GROUP BY rec_id, channel),
r AS (SELECT s.*, n, CASE WHEN n < 4 THEN 0 ELSE least(200, n // 2) END AS nr FROM sig s JOIN n USING (rec_id, channel)),
i AS (SELECT *, CASE WHEN frame < nr THEN x * pow(sin(0.5::DOUBLE * pi() * (frame::DOUBLE / nr)), 2) ELSE x END AS y FROM r)
SELECT rec_id, channel, frame, round_even((CASE WHEN nr > 0 AND frame >= n - nr THEN y * pow(sin(0.5::DOUBLE * pi() * ((frame - (n - nr))::DOUBLE / nr + 1)), 2) ELSE y END) * 1e9, 0)::BIGINT AS x_nano FROM i""")
def fade_in_out(spark, d):
    return sig.fade(_signal(spark, d), 200).select("rec_id", "channel", "frame", _nano("x"))


@query(f"WITH {_SIG} SELECT rec_id, channel, frame // 4 AS frame, x FROM sig WHERE frame % 4 = 0")
def decimate_nofilter(spark, d):
    return sig.decimate_plain(_signal(spark, d), 4)


def _decimate_sql(q: int, taps: int) -> str:
    """Four sections by recursion over their impulse response; then two passes of plain convolution, from the steady state of the first value, over samples with odd ends."""
    pole = "sqrt(power(10, 0.005::DOUBLE) - 1)"
    sections = []
    for i in range(4):
        th = f"(pi() * {2 * i + 1} / 16)"
        re, im = f"(-2 * tan(pi() * 0.4::DOUBLE / {q}) * sinh(mu) * sin{th})", f"(2 * tan(pi() * 0.4::DOUBLE / {q}) * cosh(mu) * cos{th})"
        # z = (2 + p) / (2 - p)
        sections.append(f"-2 * (4 - {re} * {re} - {im} * {im}) / ((2 - {re}) * (2 - {re}) + {im} * {im}) AS a{i}, ((2 + {re}) * (2 + {re}) + {im} * {im}) / ((2 - {re}) * (2 - {re}) + {im} * {im}) AS b{i}")
    gain = " * ".join(f"(1 + a{i} + b{i}) / 4" for i in range(4))
    state = ", ".join(f"0.0::DOUBLE AS u{i}, 0.0::DOUBLE AS v{i}" for i in range(4))
    # w is a section's inner value; its output w + 2 u + v is the next section's input
    inner, x = [], "(CASE WHEN n + 1 = 0 THEN g ELSE 0.0::DOUBLE END)"
    for i in range(4):
        w = f"({x} - a{i} * u{i} - b{i} * v{i})"
        inner.append(w)
        x = f"({w} + 2 * u{i} + v{i})"
    step = ", ".join(f"{w}, u{i}" for i, w in enumerate(inner))
    one = lambda src, dst, order: f"""{dst} AS (SELECT s.k, s.place, sum(h.h * p.x) + first(f.x) * first(r.rest) AS x FROM {src} s JOIN h ON h.n <= s.{order} JOIN {src} p ON p.k = s.k AND p.{order} = s.{order} - h.n JOIN (SELECT k, x FROM {src} WHERE {order} = 0) f ON f.k = s.k JOIN tail r ON r.n = least(s.{order}, {taps}) {{}} GROUP BY s.k, s.place)"""
    return f"""WITH RECURSIVE {_SIG}, c AS (SELECT *, ({gain}) / sqrt(1 + eps * eps) AS g FROM (SELECT *, {', '.join(sections)} FROM (SELECT {pole} AS eps, asinh(1 / {pole}) / 8 AS mu))),
imp(n, h, u0, v0, u1, v1, u2, v2, u3, v3) AS (SELECT -1, 0.0::DOUBLE, {state} UNION ALL SELECT n + 1, {x}, {step} FROM imp, c WHERE n < {taps}),
h AS (SELECT n, h FROM imp WHERE n >= 0), tail AS (SELECT n, 1 / any_value(sqrt(1 + eps * eps)) - sum(any_value(h)) OVER (ORDER BY n) AS rest FROM h, c GROUP BY n),
z AS (SELECT rec_id, channel, rec_id * 1000 + channel AS k, (row_number() OVER w - 1)::BIGINT AS i, coalesce(x, 0) AS x, count(*) OVER (PARTITION BY rec_id, channel) AS n FROM sig WINDOW w AS (PARTITION BY rec_id, channel ORDER BY frame)),
pads AS (SELECT z.k, -z.i AS place, 2 * f.x - z.x AS x FROM z JOIN (SELECT k, x FROM z WHERE i = 0) f USING (k) JOIN (SELECT k, least(27, any_value(n) - 1) AS p FROM z GROUP BY k) e USING (k) WHERE z.i BETWEEN 1 AND e.p
  UNION ALL SELECT z.k, 2 * (z.n - 1) - z.i, 2 * f.x - z.x FROM z JOIN (SELECT k, x FROM z WHERE i = n - 1) f USING (k) WHERE z.i BETWEEN z.n - 1 - least(27, z.n - 1) AND z.n - 2),
ext AS (SELECT k, place, x, (row_number() OVER (PARTITION BY k ORDER BY place) - 1)::BIGINT AS i FROM (SELECT k, i AS place, x FROM z UNION ALL SELECT * FROM pads)),
{one("ext", "fwd", "i").format("")},
rev AS (SELECT k, place, x, (row_number() OVER (PARTITION BY k ORDER BY place DESC) - 1)::BIGINT AS i FROM fwd),
{one("rev", "bwd", "i").format(f"WHERE s.place % {q} = 0")}
SELECT z.rec_id, z.channel, z.i // {q} AS frame, round_even(bwd.x * 1e6, 0)::BIGINT AS x_micro FROM z JOIN bwd ON bwd.k = z.k AND bwd.place = z.i"""


@query(_decimate_sql(4, 900))
def decimate_filtered(spark, d):
    return sig.decimate(table(spark, d, "samples"), 4).select("rec_id", "channel", "frame", F.rint(F.col("x") * 1e6).cast("bigint").alias("x_micro"))


@query(f"""WITH {_SIG}, n AS (SELECT rec_id, channel, max(frame) AS last FROM sig GROUP BY rec_id, channel),
k AS (SELECT rec_id, channel, last, unnest(range(0, ceil((last + 0.5::DOUBLE) / 1.6::DOUBLE)::BIGINT)) AS k FROM n),
g AS (SELECT *, least(floor(k * 1.6::DOUBLE)::BIGINT, last) AS f FROM k)
SELECT g.rec_id, g.channel, g.k AS frame, round_even((CASE WHEN f < last AND k * 1.6::DOUBLE > f THEN a.x + (b.x - a.x) * (k * 1.6::DOUBLE - f) ELSE a.x END) * 1e9, 0)::BIGINT AS x_nano
FROM g JOIN sig a ON a.rec_id = g.rec_id AND a.channel = g.channel AND a.frame = g.f LEFT JOIN sig b ON b.rec_id = g.rec_id AND b.channel = g.channel AND b.frame = g.f + 1""")
def resample_linear(spark, d):
    return sig.resample_linear(table(spark, d, "samples"), 1.6).select("rec_id", "channel", "frame", _nano("x"))


@query("SELECT i AS frame, round_even(0.5::DOUBLE * sin(2 * pi() * 880 * (i / 44100.0::DOUBLE)) * 1e9, 0)::BIGINT AS x_nano FROM range(0, 4410) t(i)")
def tone_synthesis(spark, d):
    return sig.tone(spark, 0.1, 880.0, 0.5).select("frame", _nano("x"))


@query("""SELECT note, round_even(440 * pow(2, (list_extract([9, 11, 0, 2, 4, 5, 7], ascii(note[1]) - 96) + CASE note[2] WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END
  + 12 * (CASE WHEN regexp_matches(note, '[0-9]$') THEN regexp_extract(note, '[0-9]+$')::INT ELSE 4 END - 4) - 9) / 12.0) * 1e6, 0)::BIGINT AS micro_hz
FROM (SELECT l || s || o AS note FROM unnest(['a','b','c','d','e','f','g']) a(l), unnest(['','#','b']) b(s), unnest(['','0','4','9']) c(o))""")
def note_frequency(spark, d):
    notes = [(a + s + o,) for a in "abcdefg" for s in ("", "#", "b") for o in ("", "0", "4", "9")]
    return spark.createDataFrame(notes, "note string").select("note", F.rint(texts.note2freq(F.col("note")) * 1e6).cast("bigint").alias("micro_hz"))


@query(f"""WITH {_SIG}, n AS (SELECT rec_id, max(frame) + 1 AS n FROM sig GROUP BY rec_id),
c AS (SELECT rec_id, n, greatest(1, ceil((n - 100) / 400.0)::BIGINT) AS blocks FROM n)
SELECT s.rec_id, channel, b AS block, count(*) AS n, count(x) AS known, max(x) AS high FROM sig s JOIN c USING (rec_id), unnest(range(0, blocks)) t(b) WHERE frame >= b * 400 AND frame < b * 400 + 500 GROUP BY ALL""")
def blocks_overlap(spark, d):
    return sig_blocks(_signal(spark, d), 500, 100)


def sig_blocks(s: DataFrame, size: int, overlap: int) -> DataFrame:
    """(rec_id, channel, block, n, known, high) of overlapping blocks."""
    return rec.into_blocks(s, size, overlap).groupBy("rec_id", "channel", "block").agg(F.count("*").alias("n"), F.count("x").alias("known"), F.max("x").alias("high"))


# files and markers

@query(f"WITH {_FILES}, o AS (SELECT rec_id, file_idx, frames, coalesce(sum(frames) OVER (PARTITION BY rec_id ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM fs) SELECT rec_id, file_idx, frames, off AS \"offset\", off + coalesce(frames, 0) AS until FROM o")
def file_offsets(spark, d):
    return rec.file_offsets(_files(spark, d))


@query(f"WITH {_FILES} SELECT rec_id, file_idx, start_index / rate AS start_s FROM fs")
def file_start_times(spark, d):
    return rec.file_start_times(_files(spark, d))


@query(f"""WITH {_FILES} SELECT rec_id, file_idx, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS name, format, encoding, printf('%.0fHz', rate) AS samplingrate, channels, frames, printf('%.3fs', round_even(frames / rate * 1000, 0) / 1000) AS duration FROM fs""")
def file_info(spark, d):
    return rec.file_info(_files(spark, d))


_CONTINUITY = """, w AS (SELECT *, coalesce(round_even(frames / rate * 1e6, 0)::BIGINT, 0) AS len, epoch_us(start_time) AS us FROM fs),
r AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY rec_id ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run, row_number() OVER f AS i, first_value(rate) OVER f AS rate0, first_value(channels) OVER f AS channels0 FROM w WINDOW f AS (PARTITION BY rec_id ORDER BY file_idx)),
e AS (SELECT *, {expected} AS expected FROM r),
b AS (SELECT *, us - expected AS gap, CASE WHEN i = 1 THEN false ELSE coalesce(rate <> rate0 OR channels <> channels0 OR coalesce(abs(us - expected) > 1000000, false) {strict}, true) END AS bad FROM e)
SELECT rec_id, file_idx, max(bad::INT) OVER (PARTITION BY rec_id ORDER BY file_idx) = 0 AS ok, gap / 1e6::DOUBLE AS gap_s FROM b"""


@query(f"WITH {_FILES}" + _CONTINUITY.format(expected="lag(us) OVER (PARTITION BY rec_id ORDER BY file_idx) + lag(len) OVER (PARTITION BY rec_id ORDER BY file_idx)", strict="OR us IS NULL"))
def continuity_prefix(spark, d):
    return rec.continuity(_files(spark, d))


@query(f"WITH {_FILES}" + _CONTINUITY.format(expected="last_value(us - run IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + run", strict=""))
def continuity_relaxed(spark, d):
    return rec.continuity(_files(spark, d), mode="relaxed")


@query(f"WITH {_FILES}, {_MARKERS} SELECT m.rec_id, marker_id, pos, file_idx, path, pos - start_index AS local_frame FROM mk m JOIN fs f ON f.rec_id = m.rec_id AND pos >= start_index AND pos < end_index")
def frame_to_file(spark, d):
    return rec.frame_to_file(_markers(spark, d).select("rec_id", "marker_id", "pos"), _files(spark, d))


@query(f"WITH {_MARKERS} SELECT rec_id, marker_id, pos - 1000 AS pos, span FROM mk WHERE pos >= 1000 AND pos < 50000")
def markers_in_range(spark, d):
    return rec.markers_in_range(_markers(spark, d), 1000, 50000).select("rec_id", "marker_id", "pos", "span")


@query(f"WITH {_FILES}, {_MARKERS}, o AS (SELECT rec_id, file_idx, coalesce(sum(frames) OVER (PARTITION BY rec_id ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM fs), p AS (SELECT m.rec_id, marker_id, file_idx, pos - start_index AS pos FROM mk m JOIN fs f ON f.rec_id = m.rec_id AND pos >= start_index AND pos < end_index) SELECT p.rec_id, marker_id, file_idx, pos + off AS pos FROM p JOIN o USING (rec_id, file_idx)")
def concat_markers(spark, d):
    files = _files(spark, d)
    local = rec.frame_to_file(_markers(spark, d).select("rec_id", "marker_id", "pos"), files).select("rec_id", "marker_id", "file_idx", F.col("local_frame").alias("pos"))
    return rec.concat_markers(local, files).select("rec_id", "marker_id", "file_idx", "pos")


@query(f"WITH {_MARKERS} SELECT rec_id, marker_id, pos, pos // 44100 AS block, pos % 44100 AS local_pos FROM mk WHERE pos >= 0")
def markers_in_block(spark, d):
    return rec.markers_in_blocks(_markers(spark, d), 44100).select("rec_id", "marker_id", "pos", F.col("block").cast("bigint"), "local_pos")


@query(f"WITH {_MARKERS} SELECT rec_id, pos // 44100 AS block, coalesce(string_agg(CASE WHEN label <> '' THEN label END, '|' ORDER BY marker_id, label), '') AS label, coalesce(string_agg(CASE WHEN text <> '' THEN text END, '|' ORDER BY marker_id, text), '') AS text FROM mk WHERE pos >= 0 GROUP BY 1, 2")
def labels_concat(spark, d):
    return rec.join_labels(rec.markers_in_blocks(_markers(spark, d), 44100).withColumn("block", F.col("block").cast("bigint")), ["rec_id", "block"])


@query(f"WITH {_MARKERS} SELECT rec_id, count(*) AS n, count(*) FILTER (span > 0) AS with_span, min(pos) AS first_pos, max(pos) AS last_pos FROM mk GROUP BY rec_id")
def marker_counts(spark, d):
    return _markers(spark, d).groupBy("rec_id").agg(F.count("*").alias("n"), F.count_if(F.col("span") > 0).alias("with_span"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"WITH {_MARKERS} SELECT rec_id, marker_id, rtrim(printf('%10d', coalesce(pos, 0)) || ' ' || printf('%8d', coalesce(span, 0)) || ' ' || rpad(coalesce(label, ''), 10, ' ') || ' ' || coalesce(text, '')) AS line FROM mk")
def marker_table(spark, d):
    return rec.marker_table(_markers(spark, d))


@query("SELECT rec_id, upper(tag) AS tag, arg_max({'v': pos}, ord).v AS pos, arg_max({'v': size + size % 2}, ord).v AS size FROM (SELECT DISTINCT * FROM chunks WHERE tag IS NOT NULL AND ord IS NOT NULL) GROUP BY 1, 2")
def chunks_last_wins(spark, d):
    return rec.last_chunks(table(spark, d, "chunks"))


@query("SELECT rec_id, count(*) AS chunks, sum(size + size % 2 + 8)::BIGINT AS bytes, max(size) AS largest FROM (SELECT DISTINCT * FROM chunks WHERE ord IS NOT NULL) GROUP BY rec_id")
def chunk_sizes(spark, d):
    return rec.chunk_sizes(table(spark, d, "chunks"))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events), n AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY event_type ORDER BY us) > 3600000000)::BIGINT, 0) AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY us)::BIGINT AS session FROM n) SELECT event_type, session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY 1, 2""")
def sessionize(spark, d):
    e = table(spark, d, "events").select("event_type", rec.wall_micros("ts").alias("us"))
    return rec.sessions(e, ["event_type"], "us", 3_600_000_000)


# metadata

def _find_sql(key: str) -> str:
    return f"(SELECT rec_id, ord, key, value FROM leaf WHERE lower(key) = '{key}' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY dict_ord, ord) = 1)"


@query(f"WITH {_MD}, {_LEAF} SELECT rec_id, array_to_string(list_append(path, key), '.') AS key, nullif(arg_max(coalesce(value, chr(1)), ord), chr(1)) AS value FROM leaf GROUP BY 1, 2")
def metadata_flatten(spark, d):
    return meta.flatten(_meta(spark, d), keep_sections=True)


@query(f"WITH {_MD}, {_LEAF} SELECT rec_id, key, nullif(arg_max(coalesce(value, chr(1)), ord), chr(1)) AS value FROM leaf GROUP BY 1, 2")
def metadata_flatten_bare(spark, d):
    return meta.flatten(_meta(spark, d))


@query(f"WITH {_MD}, {_LEAF} SELECT rec_id, array_to_string(path, '/') AS section, key, nullif(arg_max(coalesce(value, chr(1)), ord), chr(1)) AS value FROM leaf GROUP BY 1, 2, 3")
def metadata_unflatten(spark, d):
    u = meta.unflatten(meta.flatten(_meta(spark, d), keep_sections=True))
    return u.select("rec_id", F.concat_ws("/", "path").alias("section"), "key", "value")


@query(f"WITH {_MD}, {_LEAF} SELECT lower(array_to_string(path, '.')) AS section, lower(key) AS key, rec_id % 100 AS site, nullif(arg_max(coalesce(value, chr(1)), {{'r': rec_id, 'o': ord}}), chr(1)) AS value FROM leaf GROUP BY 1, 2, 3")
def metadata_last_wins(spark, d):
    m = _meta(spark, d).withColumns({"site": F.col("rec_id") % 100, "at": F.struct("rec_id", "ord")})
    return meta.merge(m, ["site"], "at")


@query(f"WITH {_MD}, {_LEAF} SELECT * FROM {_find_sql('highpass')}")
def metadata_find(spark, d):
    return meta.find(_meta(spark, d), "Highpass").drop("path")


@query(f"""WITH {_MD}, sec AS (SELECT rec_id, lower(key) AS under FROM md WHERE is_section AND lower(key) = 'info' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY dict_ord, ord) = 1),
leaf AS (SELECT md.* FROM md JOIN sec USING (rec_id) WHERE NOT coalesce(is_section, false) AND lower(path[1]) = 'info') SELECT * FROM {_find_sql('gain')}""")
def metadata_find_section(spark, d):
    return meta.find(_meta(spark, d), "INFO.Gain").drop("path")


_PARSED = """p AS (SELECT *, try_cast(regexp_extract(value, '^([0-9+-]*\\.?[0-9+-]*)', 1) AS DOUBLE) AS num, regexp_extract(value, '^([0-9+-]*\\.?[0-9+-]*)', 1) AS head FROM leaf)"""


@query(f"""WITH {_MD}, {_LEAF}, {_PARSED} SELECT rec_id, ord, num AS value, num IS NOT NULL AND instr(head, '.') = 0 AS is_int, CASE WHEN num IS NOT NULL THEN trim(substr(value, length(head) + 1)) ELSE value END AS unit,
  CASE WHEN num IS NOT NULL AND instr(head, '.') > 0 THEN length(head) - instr(head, '.') ELSE 0 END AS digits FROM p WHERE value IS NOT NULL""")
def parse_number(spark, d):
    m = _meta(spark, d).where("NOT coalesce(is_section, false) AND value IS NOT NULL")
    return m.select("rec_id", "ord", quantities.parse_number(F.col("value")).alias("q")).select("rec_id", "ord", "q.*").withColumn("digits", F.col("digits").cast("bigint"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity * 0.001::DOUBLE) / 1.0::DOUBLE AS seconds, (l_quantity * 60.0::DOUBLE) / 3600.0::DOUBLE AS hours, (l_quantity * 1000.0::DOUBLE) / 0.001::DOUBLE AS millihertz, l_quantity AS same, (l_quantity * 0.01::DOUBLE) / 1.0::DOUBLE AS share FROM lineitem""")
def change_unit(spark, d):
    c = lambda a, b: quantities.change_unit(F.col("l_quantity"), F.lit(a), F.lit(b))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("ms", "s").alias("seconds"), c("min", "h").alias("hours"), c("kHz", "mHz").alias("millihertz"), c("", "V").alias("same"), c("%", "").alias("share"))


@query(f"WITH {_MD}, {_LEAF}, {_PARSED}, c AS (SELECT rec_id, ord, dict_ord, num, 0 AS pr, trim(substr(value, length(head) + 1)) AS unit FROM p WHERE lower(key) = 'gain' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY dict_ord, ord) = 1) SELECT rec_id, num AS value, unit FROM c WHERE num IS NOT NULL")
def get_number_unit(spark, d):
    return meta.get_number_unit(_meta(spark, d), ["Gain"])


@query(f"WITH {_MD}, {_LEAF}, a AS (SELECT rec_id, value, 0 AS pr FROM {_find_sql('title')} UNION ALL SELECT rec_id, value, 1 FROM {_find_sql('comment')}) SELECT rec_id, arg_min(value, pr) AS value FROM a WHERE value IS NOT NULL GROUP BY rec_id")
def get_str(spark, d):
    return meta.get_str(_meta(spark, d), ["Title", "Comment"])


@query(f"WITH {_MD}, {_LEAF} SELECT rec_id, try_cast(value AS BIGINT) AS value FROM {_find_sql('timereference')} WHERE regexp_full_match(value, '[0-9+-]+.*') AND try_cast(regexp_extract(value, '^([0-9+-]*)', 1) AS BIGINT) IS NOT NULL AND instr(regexp_extract(value, '^([0-9+-]*\\.?[0-9+-]*)', 1), '.') = 0")
def get_int(spark, d):
    return meta.get_int(_meta(spark, d), ["TimeReference"])


_ISO = r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*$"


@query(f"""WITH {_MD}, {_LEAF}, a AS (SELECT rec_id, value AS said, 0 AS pr FROM {_find_sql('datetimeoriginal')}
UNION ALL SELECT d.rec_id, trim(d.value) || 'T' || trim(t.value), 1 FROM {_find_sql('originationdate')} d JOIN {_find_sql('originationtime')} t USING (rec_id)),
v AS (SELECT rec_id, pr, try_cast(trim(said) AS TIMESTAMP) AS value FROM a WHERE regexp_matches(said, '{_ISO}')) SELECT rec_id, arg_min(value, pr) AS value FROM v WHERE value IS NOT NULL GROUP BY rec_id""")
def get_datetime(spark, d):
    return meta.get_datetime(_meta(spark, d))


@query(f"WITH {_MD}, {_LEAF}, f AS (SELECT rec_id, ord, true AS hit FROM {_find_sql('software')}) SELECT md.rec_id, md.ord, md.key, CASE WHEN hit THEN 'sonargrid' ELSE value END AS value FROM md LEFT JOIN f USING (rec_id, ord)")
def metadata_set(spark, d):
    return meta.set_values(_meta(spark, d), {"Software": "sonargrid"}).select("rec_id", "ord", "key", "value")


@query(f"""WITH {_MD}, {_LEAF}, f AS (SELECT rec_id, ord, true AS hit FROM {_find_sql('project')}), n AS (SELECT rec_id, max(ord) + 1 AS ord FROM md WHERE rec_id NOT IN (SELECT rec_id FROM f) GROUP BY rec_id)
SELECT md.rec_id, md.ord, md.key, CASE WHEN hit THEN 'survey' ELSE value END AS value FROM md LEFT JOIN f USING (rec_id, ord) UNION ALL SELECT rec_id, ord, 'Project', 'survey' FROM n""")
def metadata_add(spark, d):
    return meta.add_values(_meta(spark, d), {"Project": "survey"}).select("rec_id", "ord", "key", "value")


@query(f"WITH {_MD}, r AS (SELECT rec_id, ord, array_to_string(list_append(path, key), '/') AS place, is_section AS s FROM md WHERE lower(key) = 'bext' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY dict_ord, ord) = 1) SELECT md.rec_id, md.ord, md.key FROM md LEFT JOIN r USING (rec_id) WHERE place IS NULL OR NOT (md.ord = r.ord OR (s AND starts_with(array_to_string(path, '/') || '/', place || '/')))")
def metadata_remove(spark, d):
    return meta.remove(_meta(spark, d), ["BEXT"]).select("rec_id", "ord", "key")


@query(f"WITH {_MD}, {_LEAF}, f AS (SELECT rec_id, ord, true AS hit FROM {_find_sql('comment')}) SELECT md.rec_id, md.ord, CASE WHEN hit THEN 'Notes' ELSE array_to_string(path, '/') END AS section, CASE WHEN hit THEN 'Remark' ELSE key END AS key FROM md LEFT JOIN f USING (rec_id, ord)")
def metadata_move(spark, d):
    return meta.move(_meta(spark, d), "Comment", "Notes", "Remark").select("rec_id", "ord", F.concat_ws("/", "path").alias("section"), "key")


@query(f"WITH {_MD}, u AS (SELECT DISTINCT rec_id, lower(array_to_string(path, '/')) AS at FROM md) SELECT md.rec_id, md.ord, md.key FROM md LEFT JOIN u ON u.rec_id = md.rec_id AND u.at = lower(array_to_string(list_append(path, key), '/')) WHERE NOT coalesce(is_section, false) OR u.at IS NOT NULL")
def metadata_cleanup(spark, d):
    return meta.cleanup(_meta(spark, d)).select("rec_id", "ord", "key")


@query(f"""WITH {_MD}, {_LEAF}, w AS (SELECT *, max(CASE WHEN NOT coalesce(is_section, false) THEN length(key) END) OVER (PARTITION BY rec_id, array_to_string(path, '/')) AS wide FROM md)
SELECT rec_id, ord, repeat(' ', (len(path) * 4)::BIGINT) || CASE WHEN coalesce(is_section, false) THEN key || ':' ELSE rpad(key, coalesce(wide, 0)::INT, ' ') || ': ' || replace(replace(coalesce(value, ''), chr(13), ''), chr(10), '\\n') END AS line FROM w""")
def metadata_text(spark, d):
    return meta.as_text(_meta(spark, d))


@query(f"""WITH {_MD}, {_LEAF}, {_PARSED}, f AS (SELECT rec_id, ord FROM {_find_sql('gain')}), g AS (SELECT p.rec_id, p.ord, num / 2 AS v, CASE WHEN instr(head, '.') > 0 THEN length(head) - instr(head, '.') ELSE 0 END + 1 AS digits,
  regexp_replace(trim(substr(value, length(head) + 1)), '/V$', '') AS unit FROM p JOIN f USING (rec_id, ord) WHERE num IS NOT NULL),
n AS (SELECT rec_id, ord, CASE digits {' '.join(f"WHEN {i} THEN printf('%.{i}f', v)" for i in range(1, 13))} END || unit AS new FROM g)
SELECT md.rec_id, md.ord, md.key, coalesce(new, value) AS value FROM md LEFT JOIN n USING (rec_id, ord)""")
def update_gain(spark, d):
    return meta.update_gain(_meta(spark, d), 2.0).select("rec_id", "ord", "key", "value")


@query(f"""WITH {_MD}, {_LEAF}, said AS (SELECT rec_id, ord, value FROM {_find_sql('datetimeoriginal')} UNION ALL SELECT rec_id, ord, value FROM {_find_sql('location_time')} UNION ALL SELECT rec_id, ord, value FROM {_find_sql('timestamp')}),
one AS (SELECT rec_id, ord, try_cast(trim(value) AS TIMESTAMP) + INTERVAL 90 SECOND AS t FROM said WHERE regexp_matches(value, '{_ISO}')),
pair AS (SELECT d.rec_id, d.ord AS o0, t.ord AS o1, trim(d.value) || 'T' || trim(t.value) AS value FROM {_find_sql('originationdate')} d JOIN {_find_sql('originationtime')} t USING (rec_id)),
two AS (SELECT rec_id, o0, o1, try_cast(value AS TIMESTAMP) + INTERVAL 90 SECOND AS t FROM pair WHERE regexp_matches(value, '{_ISO}')),
n AS (SELECT rec_id, ord, strftime(t, '%Y-%m-%dT%H:%M:%S') AS new FROM one UNION ALL SELECT rec_id, o0, strftime(t, '%Y-%m-%d') FROM two UNION ALL SELECT rec_id, o1, strftime(t, '%H:%M:%S') FROM two
UNION ALL SELECT rec_id, ord, (try_cast(trim(value) AS BIGINT) + 3969000)::VARCHAR FROM {_find_sql('timereference')} WHERE regexp_matches(trim(value), '^[+-]?[0-9]+$'))
SELECT md.rec_id, md.ord, md.key, coalesce(new, value) AS value FROM md LEFT JOIN (SELECT * FROM n WHERE new IS NOT NULL) USING (rec_id, ord)""")
def starttime_shift(spark, d):
    return meta.update_starttime(_meta(spark, d), 90.0, 44100.0).select("rec_id", "ord", "key", "value")


@query(f"""WITH {_MD}, {_LEAF}, k AS (SELECT rec_id, value, 0 AS pr FROM {_find_sql('filtered')} UNION ALL SELECT rec_id, value, 1 FROM {_find_sql('gain')}),
w AS (SELECT rec_id, arg_min(CASE WHEN lower(trim(value)) IN ('true', 'yes', 'on') THEN true ELSE false END, pr) AS w FROM k WHERE lower(trim(value)) IN ('true', 'yes', 'on', 'false', 'no', 'off') GROUP BY 1),
n AS (SELECT rec_id, arg_min(try_cast(regexp_extract(value, '^([0-9+-]*\\.?[0-9+-]*)', 1) AS DOUBLE) <> 0, pr) AS n FROM k WHERE try_cast(regexp_extract(value, '^([0-9+-]*\\.?[0-9+-]*)', 1) AS DOUBLE) IS NOT NULL GROUP BY 1)
SELECT rec_id, coalesce(w, n) AS value FROM w FULL JOIN n USING (rec_id)""")
def get_bool(spark, d):
    return meta.get_bool(_meta(spark, d), ["Filtered", "Gain"])


@query(f"""WITH {_MD}, {_LEAF}, {_PARSED}, c AS (SELECT num, trim(substr(value, length(head) + 1)) AS unit, rec_id FROM p JOIN (SELECT rec_id, ord FROM {_find_sql('highpass')}) USING (rec_id, ord) WHERE num IS NOT NULL)
SELECT rec_id, num AS value FROM c WHERE unit IN ('', 'Hz') UNION ALL SELECT rec_id, num * 1000.0::DOUBLE / 1.0::DOUBLE FROM c WHERE unit = 'kHz' UNION ALL SELECT rec_id, num * 0.001::DOUBLE / 1.0::DOUBLE FROM c WHERE unit = 'mHz'""")
def get_number(spark, d):
    """Highpass in Hertz, of values written in Hz, kHz, mHz or without a unit."""
    m = _meta(spark, d)
    plain = meta.get_number_unit(m, ["Highpass"]).where(F.col("unit").isin("", "Hz", "kHz", "mHz")).select("rec_id")
    return meta.get_number(m, "Hz", ["Highpass"]).join(plain, "rec_id")


@query(f"""WITH {_MD}, {_LEAF}, h AS (SELECT rec_id, ord, lower(key) AS k, value FROM leaf WHERE lower(key) IN ('history', 'codinghistory', 'bwf_coding_history') QUALIFY row_number() OVER (PARTITION BY rec_id, lower(key) ORDER BY dict_ord, ord) = 1),
r AS (SELECT rec_id, max(ord) + 1 AS ord, max(CASE WHEN is_section AND len(path) = 0 AND upper(key) = 'BEXT' THEN key END) AS bext FROM md GROUP BY rec_id HAVING rec_id NOT IN (SELECT rec_id FROM h))
SELECT md.rec_id, md.ord, array_to_string(path, '/') AS section, md.key, CASE WHEN h.ord IS NULL THEN md.value ELSE CASE WHEN h.value <> '' THEN h.value || chr(13) || chr(10) ELSE '' END || 'A=PCM,W=16' END AS value FROM md LEFT JOIN h USING (rec_id, ord)
UNION ALL SELECT rec_id, ord, coalesce(bext, ''), 'CodingHistory', 'A=FLOAT' || chr(13) || chr(10) || 'A=PCM,W=16' FROM r""")
def metadata_history(spark, d):
    m = _meta(spark, d)
    lines = m.select("rec_id").distinct().select("rec_id", F.lit("A=PCM,W=16").alias("line"), F.lit("A=FLOAT").alias("before"))
    return meta.add_histories(m, lines).select("rec_id", "ord", F.concat_ws("/", "path").alias("section"), "key", "value")


@query(f"""WITH {_MD}, {_LEAF}, g AS (SELECT rec_id, max(ord) + 1 AS ord FROM md GROUP BY rec_id HAVING count(*) FILTER (lower(key) = 'gain' AND NOT coalesce(is_section, false)) = 0)
SELECT rec_id, ord, key, value FROM md UNION ALL SELECT rec_id, ord, 'gain', '0.5' FROM g""")
def metadata_add_missing(spark, d):
    return meta.add_missing(_meta(spark, d), "gain", "0.5").select("rec_id", "ord", "key", "value")


@query(f"""WITH {_MD}, a AS (SELECT rec_id, max(ord) + 1 AS ord, bool_or(coalesce(is_section, false) AND len(path) = 0 AND lower(key) = 'info') AS has FROM md GROUP BY rec_id), b AS (SELECT rec_id, ord + CASE WHEN has THEN 0 ELSE 1 END AS ord FROM a)
SELECT rec_id, ord, array_to_string(path, '/') AS section, key FROM md UNION ALL SELECT rec_id, ord, '', 'INFO' FROM a WHERE NOT has UNION ALL SELECT rec_id, ord, 'INFO', 'Survey' FROM b""")
def metadata_add_sections(spark, d):
    return meta.add_sections(_meta(spark, d), "INFO.Survey").select("rec_id", "ord", F.concat_ws("/", "path").alias("section"), "key")


@query(f"WITH {_MD}, {_LEAF}, s AS (SELECT rec_id, ord, '2024-05-06T07:08:09' AS new FROM {_find_sql('datetimeoriginal')} UNION ALL SELECT rec_id, ord, '2024-05-06' FROM {_find_sql('originationdate')} UNION ALL SELECT rec_id, ord, '07:08:09' FROM {_find_sql('originationtime')}) SELECT md.rec_id, md.ord, md.key, coalesce(new, value) AS value FROM md LEFT JOIN s USING (rec_id, ord)")
def starttime_set(spark, d):
    return meta.set_starttime(_meta(spark, d), "2024-05-06T07:08:09").select("rec_id", "ord", "key", "value")


# texts

@query(f"""WITH {_FILES}, n AS (SELECT rec_id, file_idx, regexp_extract(path, '[^/]*$') AS name FROM fs),
d AS (SELECT *, regexp_extract(name, '[123][0-9]{{3}}-[01][0-9]-[0123][0-9]') AS dashed, regexp_extract(name, '[123][0-9]{{3}}[01][0-9][0123][0-9]') AS plain FROM n),
r AS (SELECT *, CASE WHEN dashed <> '' THEN substr(name, instr(name, dashed) + 10) WHEN plain <> '' THEN substr(name, instr(name, plain) + 8) ELSE name END AS rest FROM d),
t AS (SELECT *, regexp_extract(rest, '[012][0-9]:[0-5][0-9]:[0-5][0-9]') AS colon, regexp_extract(rest, '[012][0-9][0-5][0-9][0-5][0-9]') AS run FROM r)
SELECT rec_id, file_idx, try_cast(CASE WHEN dashed = '' AND plain = '' AND colon = '' AND run = '' THEN NULL ELSE
  CASE WHEN dashed <> '' THEN dashed WHEN plain <> '' THEN plain[1:4] || '-' || plain[5:6] || '-' || plain[7:8] ELSE '0001-01-01' END || ' ' ||
  CASE WHEN colon <> '' THEN colon WHEN run <> '' THEN run[1:2] || ':' || run[3:4] || ':' || run[5:6] ELSE '00:00:00' END END AS TIMESTAMP)::VARCHAR AS starts FROM t""")
def parse_datetime(spark, d):
    return _files(spark, d).select("rec_id", "file_idx", texts.parse_datetime(F.regexp_extract("path", r"[^/]*$", 0)).cast("string").alias("starts"))


@query("""SELECT o_orderkey, 'rec-' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T' || strftime(o_orderdate + INTERVAL 1 DAY, '%H:%M:%S') || '.wav' AS dashed, 'rec' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') || '-' || strftime(o_orderdate + INTERVAL 1 DAY, '%H%M%S') || '.wav' AS plain FROM orders""")
def replace_datetime(spark, d):
    o = table(spark, d, "orders")
    moved = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    dashed, plain = F.concat(F.lit("rec-"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".wav")), F.concat(F.lit("rec"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit(".wav"))
    return o.select("o_orderkey", texts.replace_datetime(dashed, moved).alias("dashed"), texts.replace_datetime(plain, moved).alias("plain"))


@query(f"""WITH {_FILES} SELECT rec_id, file_idx, concat_ws(',', 'A=' || CASE WHEN regexp_extract(encoding, '^([A-Z]+)(?:_|$)', 1) = 'PCM' THEN 'PCM' ELSE coalesce(encoding, '') END, 'F=' || printf('%.0f', rate),
  CASE WHEN regexp_extract(encoding, '_[A-Z]?([0-9]+)$', 1) <> '' THEN 'W=' || regexp_extract(encoding, '_[A-Z]?([0-9]+)$', 1) END, 'M=' || CASE WHEN channels = 1 THEN 'mono' WHEN channels = 2 THEN 'stereo' ELSE 'multi' END, 'T=cut') AS line FROM fs""")
def history_str(spark, d):
    return _files(spark, d).select("rec_id", "file_idx", texts.history(F.col("encoding"), F.col("rate"), F.col("channels"), F.lit("cut")).alias("line"))


@query(f"WITH {_FILES}, e AS (SELECT rec_id, file_idx, upper(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM fs) SELECT rec_id, file_idx, CASE WHEN e = '' THEN NULL WHEN e = 'WAVE' THEN 'WAV' WHEN starts_with(e, 'MPEG') THEN 'MP' || substr(e, 5) ELSE e END AS format FROM e")
def extension_format(spark, d):
    return _files(spark, d).select("rec_id", "file_idx", texts.format_from_extension(F.col("path")).alias("format"))


@query(f"WITH {_FILES} SELECT format, encoding, count(*) AS files, count(DISTINCT rec_id) AS recordings FROM fs GROUP BY 1, 2")
def formats_used(spark, d):
    return _files(spark, d).groupBy("format", "encoding").agg(F.count("*").alias("files"), F.count_distinct("rec_id").alias("recordings"))


@query("""WITH t AS (SELECT DISTINCT rec_id, channels FROM files WHERE channels IS NOT NULL) SELECT rec_id, channels, range(0, channels) || [channels + 2, channels + 3, channels + 4] AS list FROM t""")
def parse_channels(spark, d):
    f = table(spark, d, "files").where("channels IS NOT NULL").select("rec_id", "channels").distinct()
    said = F.concat(F.lit("0-"), F.col("channels") - 1, F.lit(", x, "), F.col("channels") + 2, F.lit(" - "), F.col("channels") + 4)
    return f.select("rec_id", "channels", texts.parse_channels(said).cast("array<bigint>").alias("list"))


@query(f"WITH {_MD}, {_LEAF} SELECT rec_id, ord, coalesce(value, '') AS v, vtype AS t FROM leaf WHERE NOT regexp_matches(coalesce(value, ''), '[,=]') AND trim(coalesce(value, '')) = coalesce(value, '') AND vtype IS NOT NULL")
def key_values(spark, d):
    m = _meta(spark, d).where("NOT coalesce(is_section, false) AND vtype IS NOT NULL").withColumn("v", F.coalesce("value", F.lit(""))).where("NOT v RLIKE '[,=]' AND trim(v) = v")
    said = texts.key_values(F.concat(F.lit("v=old, t = "), "vtype", F.lit(",x , v="), "v"))
    return m.select("rec_id", "ord", said["v"].alias("v"), said["t"].alias("t"))


@query(f"WITH {_FILES} SELECT rec_id, file_idx, format || '-' || replace(coalesce(encoding, '{{encoding}}'), ' ', '_') || '-{{none}}.wav' AS name FROM fs WHERE format IS NOT NULL")
def fill_name(spark, d):
    f = _files(spark, d).where("format IS NOT NULL")
    values = F.map_from_entries(F.filter(F.array(F.struct(F.lit("format").alias("k"), F.col("format").alias("v")), F.struct(F.lit("encoding").alias("k"), F.col("encoding").alias("v"))), lambda e: e["v"].isNotNull()))
    return f.select("rec_id", "file_idx", texts.fill_name(F.lit("{format}-{encoding}-{none}.wav"), values, ["format", "encoding", "none"]).alias("name"))


# files, written and read again


def _written(spark: SparkSession, d: str, view: str) -> DataFrame:
    """A view of the recordings of the samples table as 16-bit files, with the metadata of section INFO and the markers that files can hold."""
    s = table(spark, d, "samples").where("frame >= 0")
    rates = _files(spark, d).groupBy("rec_id").agg(F.max("rate").alias("rate"))
    info = _meta(spark, d).where("NOT coalesce(is_section, false) AND size(path) = 1 AND path[0] = 'INFO' AND value <> ''").groupBy("rec_id", "key").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
    info = info.select("rec_id", "ord", F.array(F.lit("INFO")).alias("path"), "key", "value", F.lit(False).alias("is_section"))
    marks = _markers(spark, d).where("pos >= 0 AND pos < 4294967296 AND coalesce(span, 0) >= 0").select("rec_id", "pos", "span", "label", "text")
    target = f"{shared_folder(spark)}/riff-{uuid.uuid4().hex}"
    riff_source.write_recordings(riff_source.to_files(s, rates, info, marks), target)
    f = spark.read.format("riff").option("view", view).load(target)
    names = spark.read.format("riff").option("view", "files").load(target).select("rec_id", F.regexp_extract("path", r"rec(\d+)\.wav$", 1).cast("bigint").alias("own"))
    return f.join(F.broadcast(names) if is_small(names) else names, "rec_id").drop("rec_id").withColumnRenamed("own", "rec_id")


_SIZE = "size AS (SELECT rec_id, max(frame) + 1 AS frames, max(channel) + 1 AS channels FROM sig WHERE rec_id IN (SELECT rec_id FROM files) GROUP BY rec_id)"


@query(f"WITH {_SIG}, {_SIZE}, r AS (SELECT rec_id, max(rate) AS rate FROM files GROUP BY rec_id) SELECT rec_id, 'WAV' AS format, 'PCM_16' AS encoding, trunc(rate) AS rate, channels, frames FROM size JOIN r USING (rec_id)")
def riff_files(spark, d):
    return _written(spark, d, "files").select("rec_id", "format", "encoding", "rate", "channels", "frames")


@query(f"""WITH {_SIG}, {_SIZE}, g AS (SELECT rec_id, c AS channel, unnest(range(0, frames)) AS frame FROM size, unnest(range(0, channels)) t(c))
SELECT g.rec_id, g.channel::INT AS channel, g.frame, least(greatest(floor(coalesce(x, 0) * 32768)::BIGINT, -32768), 32767) / 32768.0::DOUBLE AS x FROM g LEFT JOIN sig s USING (rec_id, channel, frame)""")
def riff_samples(spark, d):
    return _written(spark, d, "samples").select("rec_id", "channel", "frame", "x")


@query(f"""WITH {_SIG}, {_SIZE}, {_MARKERS}, m AS (SELECT rec_id, pos, coalesce(span, 0) AS span, nullif(rtrim(label, ' '), '') AS label, nullif(rtrim(text, ' '), '') AS text FROM mk JOIN size USING (rec_id) WHERE pos >= 0 AND pos < 4294967296 AND coalesce(span, 0) >= 0)
SELECT rec_id, pos, span, label, text, count(*) AS n FROM m GROUP BY ALL""")
def riff_markers(spark, d):
    return _written(spark, d, "markers").groupBy("rec_id", "pos", "span", "label", "text").agg(F.count("*").alias("n"))


@query(f"""WITH {_SIG}, {_SIZE}, {_MD}, {_LEAF} SELECT rec_id, key, trim(rtrim(arg_max(value, ord), ' ' || chr(0))) AS value FROM leaf JOIN size USING (rec_id) WHERE len(path) = 1 AND path[1] = 'INFO' AND value <> '' GROUP BY rec_id, key""")
def riff_metadata(spark, d):
    return _written(spark, d, "metadata").where("path[0] = 'INFO' AND NOT is_section").select("rec_id", "key", F.regexp_replace("value", r"^ +|[ \x00]+$", "").alias("value"))  # files don't keep outer spaces


@query(f"""WITH {_SIG}, {_SIZE} SELECT rec_id, frames * channels * 2 AS size FROM size""")
def riff_chunks(spark, d):
    return _written(spark, d, "chunks").where("tag = 'DATA'").select("rec_id", "size")
