"""Samples gathered in blocks of 2**16 frames, and functions over blocks.

Rows become arrays before they are shuffled, one for each run of samples of a channel and block, so a shuffle moves 12 bytes
a sample. A task holds one block of one channel at a time, whatever the length of a recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
FRAMES = 1 << BITS


def lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Arrow lists of the given lengths from one array of values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _compact_kernel(bits: int, before: int, after: int):
    """(rec_id, channel, frame, x) -> (rec_id, channel, block, frames, xs), frames counted from the block's first; samples near an edge also go to the blocks that see them."""

    def runs(rec, channel, block, frame, x) -> pa.RecordBatch:
        cut = lambda: np.flatnonzero(np.concatenate([[True], (np.diff(rec) != 0) | (np.diff(channel) != 0) | (np.diff(block) != 0)]))
        at = cut()
        if len(at) > len(rec) // 4:
            order = np.lexsort((frame, block, channel, rec))
            rec, channel, block, frame, x = (a[order] for a in (rec, channel, block, frame, x))
            at = cut()
        lengths = np.diff(np.append(at, len(rec)))
        cols = [pa.array(rec[at]), pa.array(channel[at].astype(np.int32)), pa.array(block[at]), lists(lengths, (frame - (block << bits)).astype(np.int32)), lists(lengths, x)]
        return pa.RecordBatch.from_arrays(cols, names=["rec_id", "channel", "block", "frames", "xs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rec, channel, frame = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            x = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            low, high = (frame - after) >> bits, (frame + before) >> bits
            for d in range(int((high - low).max()) + 1):
                of = low + d
                keep = of <= high
                yield runs(*(a if keep.all() else a[keep] for a in (rec, channel, of, frame, x)))

    return run


def gathered(samples: DataFrame, bits: int = BITS, before: int = 0, after: int = 0) -> DataFrame:
    """(rec_id, channel, block, parts): the samples of each block and of ``before`` frames before and ``after`` after it, in parts to be put together by ``merged``.

    Rows with a null key are left out; columns other than rec_id, channel, frame, x are dropped.
    """
    rows = samples.where("rec_id IS NOT NULL AND channel IS NOT NULL AND frame IS NOT NULL")
    rows = rows.select(F.col("rec_id").cast("bigint"), F.col("channel").cast("int"), F.col("frame").cast("bigint"), F.col("x").cast("double"))
    parts = rows.mapInArrow(_compact_kernel(bits, before, after), "rec_id bigint, channel int, block bigint, frames array<int>, xs array<double>")
    return parts.groupBy("rec_id", "channel", "block").agg(F.collect_list(F.struct("frames", "xs")).alias("parts"))


def merged(parts: pa.StructArray, greatest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(frames, x) in order of frames, nulls as NaN; of repeated frames the greatest, or the least, number counts."""
    frame = parts.field("frames").flatten().to_numpy(zero_copy_only=False)
    x = parts.field("xs").flatten().to_numpy(zero_copy_only=False)
    if (np.diff(frame) <= 0).any():
        order = np.lexsort((-x if greatest else x, frame))  # NaN last
        frame, x = frame[order], x[order]
        first = np.concatenate([[True], frame[1:] != frame[:-1]])
        frame, x = frame[first], x[first]
    return frame, x


def map_blocks(samples: DataFrame, f: Callable, schema: str, size: int, overlap: int = 0) -> DataFrame:
    """What ``f(rec_id, start, x)`` makes of every block of every recording, as rows of ``schema``.

    A block has ``size`` frames, consecutive ones share ``overlap``; ``x`` is an array (frames, channels) of at most ``size`` frames, NaN where a
    sample is null or missing, ``start`` its first frame. ``f`` returns a list of tuples. Blocks without any sample are passed over,
    and so is a last block that lies within the one before it. One block of all channels is held at a time. Repeated samples count once.
    """
    from sonargrid.operators import recordings

    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the block")
    rows = recordings.into_blocks(samples.where("rec_id IS NOT NULL AND channel IS NOT NULL AND frame >= 0").select("rec_id", "channel", "frame", "x"), size, overlap)
    whole = rows.groupBy("rec_id", "block").agg(F.collect_list(F.struct("channel", "frame", "x")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rec, block, v = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].values
                channel, frame, x = (v.field(k).to_numpy(zero_copy_only=False) for k in ("channel", "frame", "x"))
                start = block * (size - overlap)
                data = np.full((int(frame.max()) + 1 - start, int(channel.max()) + 1), np.nan)
                order = np.lexsort((x, np.isnan(x)))[::-1]  # of repeated samples the least number is put last
                data[frame[order] - start, channel[order]] = x[order]
                rows = f(rec, start, data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    empty = samples.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)
    names, types = list(arrow.names), list(arrow.types)
    return whole.select("rec_id", "block", "v").mapInArrow(run, schema)
