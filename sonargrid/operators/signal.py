"""Operators on samples (rec_id, channel, frame, x): slicing, scaling, repair, resampling, synthesis.

A sample is found by its frame number. Operators that look at neighbours or carry state work on blocks of 2**16 frames,
so that a long recording is spread over many tasks; rows near a block's edge are also given to the neighbour. These take
samples as they are stored: repeated ones are joined within the blocks, so that everything costs one shuffle.
Rows with a null x stay and count as no number; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonargrid.operators import blocks

BITS = 16
KEYS = ["rec_id", "channel"]
#: Doubles are added up as integers of this unit, so that sums don't depend on the order of rows.
UNIT = 2.0**-30


def signal(samples: DataFrame) -> DataFrame:
    """Distinct samples: rows with a null key are dropped, of repeated ones the greatest non-null x counts."""
    return _keyed(samples).groupBy("rec_id", "channel", "frame").agg(F.max("x").alias("x"))


def _keyed(samples: DataFrame) -> DataFrame:
    return samples.where("rec_id IS NOT NULL AND channel IS NOT NULL AND frame IS NOT NULL").select(*KEYS, "frame", "x")


def slice_frames(s: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames start, start + step, .. before stop; a negative bound counts from the end of each recording."""
    if step < 1:
        raise ValueError("step must be positive")
    if start >= 0 and (stop is None or stop >= 0):
        kept = s.where((F.col("frame") >= start) & (F.lit(True) if stop is None else F.col("frame") < stop))
        return kept.where((F.col("frame") - start) % step == 0) if step > 1 else kept
    ends = s.groupBy("rec_id").agg((F.max("frame") + 1).alias("n"))
    at = lambda v: F.greatest(F.col("n") + v, F.lit(0)) if v < 0 else F.lit(v)
    upto = F.col("n") if stop is None else at(stop)
    return s.join(ends, "rec_id").where((F.col("frame") >= at(start)) & (F.col("frame") < upto) & ((F.col("frame") - at(start)) % step == 0)).select(*s.columns)


def take_frames(s: DataFrame, frames: list[int]) -> DataFrame:
    """(position, .. columns of s): the listed frames in the listed order, repeated where the list repeats them.

    A negative frame counts from the end of each recording; a frame outside of a recording gives no row.
    """
    wanted = s.sparkSession.createDataFrame([(i, f) for i, f in enumerate(frames)], "position int, frame bigint")  # as long as the list given
    if min(frames, default=0) >= 0:
        return s.join(F.broadcast(wanted), "frame").select("position", *s.columns)
    ends = s.groupBy("rec_id").agg((F.max("frame") + 1).alias("n"))
    at = F.col("frame") + F.when(F.col("frame") < 0, F.col("n")).otherwise(0)
    places = ends.crossJoin(F.broadcast(wanted)).select("rec_id", "position", at.alias("frame"))  # a row for each recording and entry of the list
    return s.join(places, ["rec_id", "frame"]).select("position", *s.columns)


def in_order(s: DataFrame) -> Iterator[tuple[int, int, list]]:
    """(rec_id, frame, xs by channel) frame by frame, a partition at a time on the driver; an absent channel is None."""
    frames = s.groupBy("rec_id", "frame").agg(F.collect_list(F.struct("channel", "x")).alias("v")).orderBy("rec_id", "frame")
    for r in frames.toLocalIterator(prefetchPartitions=True):
        xs: list = [None] * (1 + max(v.channel for v in r.v))
        for v in r.v:
            xs[v.channel] = v.x
        yield r.rec_id, r.frame, xs


def time_range(s: DataFrame, rates: DataFrame, start: float, stop: float) -> DataFrame:
    """Frames from int(start * rate) up to and including int(stop * rate), by the rate of each recording."""
    rate = rates.groupBy("rec_id").agg(F.max("rate").alias("rate"))
    low, high = ((F.lit(float(t)) * F.col("rate")).cast("bigint") for t in (start, stop))
    return s.join(rate, "rec_id").where((F.col("frame") >= low) & (F.col("frame") < high + 1)).select(*s.columns)


def select_channels(s: DataFrame, channels: list[int]) -> DataFrame:
    """Samples of the listed channels, renumbered in the order of the list."""
    number = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")) - 1
    return s.where(F.col("channel").isin(channels)).withColumn("channel", number.cast("int"))


def scale(s: DataFrame, factor: float) -> DataFrame:
    return s.withColumn("x", F.col("x") * F.lit(float(factor)))


def clip(s: DataFrame, limit: float) -> DataFrame:
    return s.withColumn("x", F.when(F.col("x").isNotNull(), F.least(F.greatest("x", F.lit(-float(limit))), F.lit(float(limit)))))


def _sum(x: str) -> Column:
    return F.sum(F.rint(F.col(x) / UNIT).cast("bigint")) * F.lit(UNIT)


def remove_mean(s: DataFrame) -> DataFrame:
    """x less its mean over the channel."""
    mean = s.groupBy(*KEYS).agg((_sum("x") / F.count("x")).alias("mean"))
    return s.join(mean, KEYS).select(*KEYS, "frame", (F.col("x") - F.col("mean")).alias("x"))


def autoscale(s: DataFrame) -> DataFrame:
    """x over the greatest absolute x of the recording; recordings without sound stay as they are."""
    top = s.groupBy("rec_id").agg(F.max(F.abs("x")).alias("top"))
    return s.join(top, "rec_id").select(*KEYS, "frame", F.when(F.col("top") > 0, F.col("x") / F.col("top")).otherwise(F.col("x")).alias("x"))


def quantize(s: DataFrame, bits: int = 16, rounding: str = "floor") -> DataFrame:
    """x as integers of ``bits``; both ends saturate. ``rounding`` is "floor" or "trunc"."""
    top = 1 << (bits - 1)
    v = F.col("x") * float(top)
    v = F.floor(v) if rounding == "floor" else F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return s.select(*KEYS, "frame", F.least(F.greatest(v.cast("bigint"), F.lit(-top)), F.lit(top - 1)).alias("q"))


def channel_stats(s: DataFrame) -> DataFrame:
    """(rec_id, channel, n, low, high, mean, rms) of each channel; nulls don't count."""
    square = F.sum(F.rint(F.col("x") * F.col("x") / UNIT).cast("bigint")) * F.lit(UNIT)
    return s.groupBy(*KEYS).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), (_sum("x") / F.count("x")).alias("mean"), F.sqrt(square / F.count("x")).alias("rms"))


def quantization_error(s: DataFrame, bits: int = 16) -> DataFrame:
    """(rec_id, worst): the greatest error of writing and reading x in ``bits``."""
    q = quantize(s, bits).join(s, [*KEYS, "frame"])
    return q.groupBy("rec_id").agg(F.max(F.abs(F.col("x") - F.col("q") / float(1 << (bits - 1)))).alias("worst"))


def difference_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rec_id, channel, n, worst, mean, std) of a - b over the frames that both have: greatest absolute value, mean, population standard deviation."""
    d = a.join(b.withColumnRenamed("x", "y"), [*KEYS, "frame"]).select(*KEYS, (F.col("x") - F.col("y")).alias("d"), ((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("dd"))
    n = F.count("d")
    mean = _sum("d") / n
    return d.groupBy(*KEYS).agg(n.alias("n"), F.max(F.abs("d")).alias("worst"), mean.alias("mean"), F.sqrt(F.greatest(_sum("dd") / n - mean * mean, F.lit(0.0))).alias("std"))


def _by_block(rows: DataFrame, *more: str) -> DataFrame:
    """Distinct samples of rows with a ``block``, partitioned by channel and block: what groups or orders by these needs no further shuffle."""
    return rows.repartition(*KEYS, "block").groupBy(*KEYS, "block", "frame", *more).agg(F.max("x").alias("x"))


def with_halo(s: DataFrame, before: int, after: int) -> DataFrame:
    """Every sample in its block, and again in the blocks that need it as one of ``before`` frames before or ``after`` after their own; ``own`` tells."""
    here = F.shiftright("frame", BITS)
    low, high = F.shiftright(F.col("frame") - after, BITS), F.shiftright(F.col("frame") + before, BITS)
    blocks = F.when(low == high, F.array(here)).otherwise(F.sequence(low, high))
    return _by_block(_keyed(s).withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == here), "own")


def despike(s: DataFrame, thresh: float = 1.0, n: int = 1) -> DataFrame:
    """Runs of up to ``n`` samples that jump by more than ``thresh`` and back become a line between their neighbours; longer runs go first."""
    reach = n * (n + 1) // 2 + n + 1
    rows = with_halo(s, reach, reach)
    w = Window.partitionBy(*KEYS, "block").orderBy("frame")
    for k in range(n, 0, -1):
        up, back = F.lead("x").over(w) - F.col("x"), F.lead("x", k + 1).over(w) - F.lead("x", k).over(w)
        rows = rows.withColumn("sel", F.coalesce(((up > thresh) & (back < -thresh)) | ((up < -thresh) & (back > thresh)), F.lit(False)))
        for j in range(1, k + 1):
            line = (F.lag("x", j).over(w) * (k + 1 - j) + F.lead("x", k + 1 - j).over(w) * j) / (k + 1)
            rows = rows.withColumn("x", F.when(F.lag("sel", j).over(w), line).otherwise(F.col("x")))
    return rows.where("own").select(*KEYS, "frame", "x")


def fade(s: DataFrame, fade_frames: int, fade_in: bool = True, fade_out: bool = True) -> DataFrame:
    """First and last samples times a squared sine ramp of ``fade_frames``, at most half of the channel; channels of fewer than 4 frames stay."""
    n = s.groupBy(*KEYS).agg((F.max("frame") + 1).alias("n"))
    nr = F.least(F.lit(fade_frames).cast("bigint"), F.floor(F.col("n") / 2))
    rows = s.join(n, KEYS).withColumn("nr", F.when(F.col("n") < 4, 0).otherwise(nr))
    ramp = lambda i: F.pow(F.sin(F.lit(0.5 * math.pi) * i), F.lit(2.0))
    x = F.col("x")
    if fade_in:
        x = F.when(F.col("frame") < F.col("nr"), x * ramp(F.col("frame") / F.col("nr"))).otherwise(x)
    if fade_out:
        i = F.col("frame") - (F.col("n") - F.col("nr"))
        x = F.when((F.col("nr") > 0) & (i >= 0), x * ramp(i / F.col("nr") + 1.0)).otherwise(x)
    return rows.select(*KEYS, "frame", x.alias("x"))


def decimate_plain(s: DataFrame, q: int) -> DataFrame:
    """Every q-th frame, without a filter."""
    return s.where(F.col("frame") % q == 0).select(*KEYS, (F.col("frame") / q).cast("bigint").alias("frame"), "x")


def resample_linear(s: DataFrame, factor: float) -> DataFrame:
    """Samples at 0, factor, 2 * factor, .. frames, at most half a frame beyond the last, by linear interpolation.

    Each pair of neighbours gives the new samples between them, so the new grid is never joined to the old one.
    """
    rows = with_halo(s, 0, 1)
    w = Window.partitionBy(*KEYS, "block").orderBy("frame")
    ends = s.groupBy(*KEYS).agg(F.max("frame").alias("last"))
    rows = rows.withColumn("nx", F.lead("x").over(w)).where("own").join(ends, KEYS)
    f = F.lit(float(factor))
    first = F.ceil(F.col("frame") / f)
    stop = F.when(F.col("frame") < F.col("last"), F.ceil((F.col("frame") + 1) / f)).otherwise(F.ceil((F.col("last") + 0.5) / f))
    rows = rows.withColumn("k", F.explode(F.when(stop > first, F.sequence(first, stop - 1))))
    t = F.col("k") * f - F.col("frame")
    x = F.when((F.col("frame") < F.col("last")) & (t > 0), F.col("x") + (F.col("nx") - F.col("x")) * t).otherwise(F.col("x"))
    return rows.select(*KEYS, F.col("k").alias("frame"), x.alias("x"))


def tone(spark: SparkSession, duration: float, frequency: float, amplitude: float = 1.0, rate: float = 44100.0, rec_id: int = 0, channel: int = 0) -> DataFrame:
    """A sine of ceil(duration * rate) frames."""
    x = F.lit(float(amplitude)) * F.sin(F.lit(2.0 * math.pi * frequency) * (F.col("id") / F.lit(float(rate))))
    return spark.range(math.ceil(duration * rate)).select(F.lit(rec_id).cast("bigint").alias("rec_id"), F.lit(channel).alias("channel"), F.col("id").alias("frame"), x.alias("x"))


def next_steps(x: np.ndarray, before: float, thresh: float, a: float) -> np.ndarray:
    """(n, 3): for each sample and each of the steps -2a, 0, 2a before it, the index of the step after it. A null here or before keeps the step."""
    steps = np.array([-2.0 * a, 0.0, 2.0 * a])
    dd = x[:, None] - (np.concatenate([[before], x[:-1]])[:, None] + steps)
    c = np.where((x[:, None] >= 0) & (np.abs(dd - 2 * a) < np.abs(dd)), -2 * a, 0.0)
    c = np.where((x[:, None] <= 0) & (np.abs(dd + 2 * a) < np.abs(dd + c)), 2 * a, c)
    change = (c == 0.0) | (np.abs(dd) > thresh * a)
    index = np.where(change, np.searchsorted(steps, c), np.arange(3))
    index[np.isnan(dd)] = np.broadcast_to(np.arange(3), dd.shape)[np.isnan(dd)]
    return index


def prefix_maps(m: np.ndarray) -> np.ndarray:
    """Compositions of the maps up to each place, by doubling."""
    m, d, rows = m.copy(), 1, np.arange(len(m))
    while d < len(m):
        m[d:] = m[rows[d:, None], m[:-d]]
        d *= 2
    return m


def _map_kernel(thresh: float, a: float):
    """(rec_id, channel, block, parts) -> the block's first and last sample and its map from the step after the first to the step after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last, rest = [], [], []
            for i in range(b.num_rows):
                _, x = blocks.merged(b.column(3)[i].values)
                first.append(x[0])
                last.append(x[-1])
                m = next_steps(x, np.nan, thresh, a)[1:]
                while len(m) > 1:  # halves by composing neighbours
                    odd, m = m[len(m) // 2 * 2 :], m[: len(m) // 2 * 2]
                    m = np.concatenate([np.take_along_axis(m[1::2], m[::2], 1), odd])
                rest.append((m[0] if len(m) else np.arange(3)).tolist())
            cols = [*b.columns[:3], pa.array(first, pa.float64()), pa.array(last, pa.float64()), pa.array(rest, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["rec_id", "channel", "block", "first", "last", "rest"])

    return run


def _chain_kernel(thresh: float, a: float):
    """Rows of ``_map_kernel`` in order of channel and block -> (rec_id, channel, block, before, entry): what every block starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, step = None, float("nan"), 1
        for b in batches:
            befores, entries = [], []
            for rec, channel, first, last, rest in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5))):
                if key != (rec, channel):
                    key, before, step = (rec, channel), float("nan"), 1
                befores.append(before)
                entries.append(step)
                step = rest[next_steps(np.array([first], float), before, thresh, a)[0, step]]
                before = float("nan") if last is None else last
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(befores, pa.float64()), pa.array(entries, pa.int32())], names=["rec_id", "channel", "block", "before", "entry"])

    return run


def _columns(rec: int, channel: int, frame: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(x), rec, np.int64)), pa.array(np.full(len(x), channel, np.int32)), pa.array(frame.astype(np.int64)), pa.array(x, pa.float64(), mask=np.isnan(x))]
    return pa.RecordBatch.from_arrays(cols, names=["rec_id", "channel", "frame", "x"])


def _unwrap_kernel(thresh: float, a: float, bits: int):
    """(rec_id, channel, block, parts, before, entry) -> samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rec, channel, block, before, entry = (b.column(c)[i].as_py() for c in (0, 1, 2, 4, 5))
                frame, x = blocks.merged(b.column(3)[i].values)
                prefix = prefix_maps(next_steps(x, before, thresh, a))
                yield _columns(rec, channel, (block << bits) + frame, x + (prefix[:, entry] - 1) * 2.0 * a)

    return run


def unwrap(s: DataFrame, thresh: float = 1.5, ampl_max: float = 1.0, mode: str = "keep") -> DataFrame:
    """Undo the wrap-around of a range of +-ampl_max. ``mode`` keeps the result, clips it to the range, or halves it.

    Each block is a map of the three possible steps before it to the step after it. Maps compose, so only one small row per block is
    read in order, one after the other, and every block is then computed with its first step known. Blocks without samples
    are passed over: a sample follows the one before it, however far. A null keeps the step.
    """
    if mode not in ("keep", "clip", "halve"):
        raise ValueError("mode must be keep, clip or halve")
    held = blocks.gathered(s, BITS)
    maps = held.mapInArrow(_map_kernel(thresh, ampl_max), "rec_id bigint, channel int, block bigint, first double, last double, rest array<int>")
    chained = maps.repartition(*KEYS).sortWithinPartitions(*KEYS, "block").mapInArrow(_chain_kernel(thresh, ampl_max), "rec_id bigint, channel int, block bigint, before double, entry int")
    # every block is in the chain; a left join keeps both uses of ``held`` alike, so that its shuffle is done once; the hashed side has a row for 2**16 samples
    rows = held.join(chained.hint("shuffle_hash"), [*KEYS, "block"], "left").select(*KEYS, "block", "parts", "before", "entry")
    rows = rows.mapInArrow(_unwrap_kernel(thresh, ampl_max, BITS), "rec_id bigint, channel int, frame bigint, x double")
    return clip(rows, ampl_max) if mode == "clip" else scale(rows, 0.5) if mode == "halve" else rows


def chebyshev_sections(order: int, ripple_db: float, cutoff: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Chebyshev type I low-pass; ``cutoff`` is a share of half the rate."""
    eps = math.sqrt(10 ** (0.1 * ripple_db) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(order // 2) + 1) / (2 * order)
    warped = 2 * math.tan(math.pi * cutoff / 2)
    poles = warped * (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
    z = (2 + poles) / (2 - poles)
    sections = np.array([[1, 2, 1, 1, -2 * p.real, abs(p) ** 2] for p in z])
    gain = np.prod(sections[:, 3:].sum(1) / sections[:, :3].sum(1)) / (math.sqrt(1 + eps**2) if order % 2 == 0 else 1)
    sections[0, :3] *= gain
    return sections


def _filtfilt(x: np.ndarray, sections: np.ndarray, pad: int) -> np.ndarray:
    """The sections forward and backward over x with odd extension at both ends, each pass started in the steady state of its first value."""
    pad = min(pad, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    settle = decimation_halo(sections)
    n = 1 << (len(y) + 2 * settle).bit_length()
    w = np.exp(-1j * np.linspace(0, np.pi, n // 2 + 1))
    h = np.ones(len(w), complex)
    for b0, b1, b2, a0, a1, a2 in sections:
        h *= (b0 + b1 * w + b2 * w * w) / (a0 + a1 * w + a2 * w * w)
    for _ in range(2):
        held = np.concatenate([np.full(settle, y[0]), y])
        y = np.fft.irfft(np.fft.rfft(held, n) * h, n)[settle : settle + len(y)][::-1]
    return y[pad : pad + len(x)]


def decimation_halo(sections: np.ndarray) -> int:
    """Frames in which what a cut does to the filter's result fades to 1e-12 by the slowest pole; at least 4096."""
    slowest = max(abs(np.roots(a)).max() for a in sections[:, 3:])
    return max(4096, math.ceil(math.log(1e-12) / math.log(slowest)))


def decimate(s: DataFrame, q: int, halo: int | None = None) -> DataFrame:
    """Every q-th frame after a zero-phase order-8 Chebyshev filter (0.05 dB ripple, cutoff 0.8 / q), block by block with ``halo`` frames around.

    If none is given the halo is what the filter's memory needs for q, see ``decimation_halo``. Nulls count as 0.
    """
    sections = chebyshev_sections(8, 0.05, 0.8 / q)
    halo = decimation_halo(sections) if halo is None else halo
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rec, channel, block = (b.column(c)[i].as_py() for c in range(3))
                offset, x = blocks.merged(b.column(3)[i].values)
                if not ((offset >= 0) & (offset < 1 << bits)).any():
                    continue
                y = _filtfilt(np.nan_to_num(x), sections, 27)
                frame = (block << bits) + offset
                keep = (offset >= 0) & (offset < 1 << bits) & (frame % q == 0)
                yield _columns(rec, channel, frame[keep] // q, y[keep])

    return blocks.gathered(s, bits, halo, halo).mapInArrow(run, "rec_id bigint, channel int, frame bigint, x double")
