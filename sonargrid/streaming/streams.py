"""Streams of samples and files.

Samples carry an event time; late rows are taken up to the watermark. State per key is a few numbers, whatever the length
of a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonargrid.operators import signal


def block_stats(stream: DataFrame, time: str, size: str, step: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("rec_id", "channel")) -> DataFrame:
    """(keys.., start, n, low, high) of windows of ``size``, every ``step`` for overlapping ones."""
    window = F.window(time, size, step) if step else F.window(time, size)
    stats = stream.withWatermark(time, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return stats.select(*keys, F.col("w.start").alias("start"), "n", "low", "high")


def sessions(stream: DataFrame, time: str, gap: str = "1 second", late: str = "10 minutes", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """(keys.., start, stop, n): runs of rows with no gap longer than ``gap``."""
    found = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def continuity(stream: DataFrame, max_gap_s: float = 1.0) -> DataFrame:
    """(rec_id, file_idx, ok, gap_s) of files (rec_id, file_idx, start_us, length_us, and optionally rate and channels) as they arrive, in order of file_idx within a batch.

    A file continues its recording if it starts within ``max_gap_s`` of the end of the one before, and with the rate and channels of the first; after a
    break nothing does. A file that comes after one with a greater file_idx is late: it is not ok, and changes nothing for others.
    """
    limit = max_gap_s * 1e6
    more = [c for c in ("rate", "channels") if c in stream.columns]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, good, last, kind = state.get if state.exists else (None, True, None, None)
        rows = pd.concat(batches).sort_values("file_idx", kind="stable")
        out = []
        for r in rows.itertuples():
            known = not pd.isna(r.start_us)
            gap = (r.start_us - expected) / 1e6 if known and expected is not None else None
            if last is not None and r.file_idx <= last:
                out.append((key[0], r.file_idx, False, gap))
                continue
            here = "|".join(str(getattr(r, c)) for c in more)
            if expected is not None:
                good = good and known and abs(r.start_us - expected) <= limit and here == kind
            kind = here if kind is None else kind
            expected, last = int((r.start_us if known else expected or 0) + (0 if pd.isna(r.length_us) else r.length_us)), int(r.file_idx)
            out.append((key[0], r.file_idx, good, gap))
        state.update((expected, good, last, kind))
        yield pd.DataFrame(out, columns=["rec_id", "file_idx", "ok", "gap_s"])

    grouped = stream.select("rec_id", "file_idx", "start_us", "length_us", *more).groupBy("rec_id")
    return grouped.applyInPandasWithState(run, "rec_id bigint, file_idx int, ok boolean, gap_s double", "expected bigint, good boolean, last int, kind string", "append", GroupStateTimeout.NoTimeout)


def unwrap(stream: DataFrame, thresh: float = 1.5, ampl_max: float = 1.0) -> DataFrame:
    """(rec_id, channel, frame, x) unwrapped as ``signal.unwrap`` does, with the step and the last sample carried from batch to batch.

    A null keeps the step. Frames must arrive in order from batch to batch, as a step depends on all samples before: one that isn't after those of earlier batches,
    or comes twice, stops the stream with an error.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, step, upto = state.get if state.exists else (None, 1, None)
        rows = pd.concat(batches).sort_values("frame")
        frame, x = rows.frame.to_numpy(np.int64), rows.x.to_numpy(np.float64)
        if (upto is not None and frame[0] <= upto) or (np.diff(frame) <= 0).any():
            raise ValueError(f"frames of recording {key[0]}, channel {key[1]} don't arrive in order")
        steps = signal.prefix_maps(signal.next_steps(x, np.nan if last is None else last, thresh, float(ampl_max)))[:, step]
        state.update((None if np.isnan(x[-1]) else float(x[-1]), int(steps[-1]), int(frame[-1])))
        yield pd.DataFrame({"rec_id": key[0], "channel": key[1], "frame": frame, "x": x + (steps - 1) * 2.0 * ampl_max})

    grouped = stream.select("rec_id", "channel", "frame", "x").groupBy("rec_id", "channel")
    return grouped.applyInPandasWithState(run, "rec_id bigint, channel int, frame bigint, x double", "last double, step int, upto bigint", "append", GroupStateTimeout.NoTimeout)
