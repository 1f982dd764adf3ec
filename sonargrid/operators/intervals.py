"""Union of integer intervals per entity: continuous periods and the gaps between them.

Intervals are cut at tiles of 2**16 units. Within a tile they are decomposed into canonical dyadic blocks; blocks
covered by an ancestor are removed, sibling pairs are merged upward and adjacent blocks are joined. A run of whole tiles
is itself an interval, of tiles, and goes through the same steps one tier up, so an interval of any length gives at most
two rows per tier. A tile holds at most 2**16 different starts, of which only the furthest end matters, so no group is
unbounded; only one row per tile, with the gaps inside, meets its neighbours in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
TIERS = 4


def dyadic_periods(start: np.ndarray, end: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted periods covered by intervals, none of which crosses a multiple of 2**bits; periods don't cross one either."""
    levels: list[np.ndarray] = []
    left, right = start.astype(np.int64), end.astype(np.int64)
    for _ in range(bits + 1):  # canonical blocks: an odd left edge or odd right edge can't grow any further
        odd_left, odd_right = (left & 1) == 1, (right & 1) == 1
        levels.append(np.unique(np.concatenate([left[odd_left & (left < right)], right[odd_right & (left < right)] - 1])))
        left, right = (left + odd_left) >> 1, right >> 1
        keep = left < right
        left, right = left[keep], right[keep]
        if len(levels) == bits:
            levels.append(np.unique(left))  # whole tiles
            break
    for low in range(bits + 1):  # blocks covered by an ancestor
        covered = np.zeros(len(levels[low]), bool)
        for high in range(low + 1, bits + 1):
            if len(levels[high]):
                covered |= np.isin(levels[low] >> (high - low), levels[high])
        levels[low] = levels[low][~covered]
    for low in range(bits):  # sibling pairs
        k = levels[low]
        first = np.flatnonzero((k[:-1] & 1 == 0) & (k[1:] == k[:-1] + 1)) if len(k) > 1 else np.zeros(0, np.int64)
        if len(first):
            levels[low + 1] = np.union1d(levels[low + 1], k[first] >> 1)
            levels[low] = np.delete(k, np.concatenate([first, first + 1]))
    s = np.concatenate([k << j for j, k in enumerate(levels)])
    e = np.concatenate([(k + 1) << j for j, k in enumerate(levels)])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != e[:-1]) | (s[1:] >> bits != s[:-1] >> bits)
    last = np.append(new[1:], True) if len(s) else new
    return s[new], e[last]


def _tile_kernel(n_keys: int):
    """Rows (keys.., tile, starts, ends) with offsets within the tile -> (keys.., tile, starts, ends) of its periods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_keys + 1)
            counts = np.diff(lists.offsets.to_numpy())
            base = np.repeat(np.arange(b.num_rows, dtype=np.int64) << BITS, counts)
            start, end = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (lists, b.column(n_keys + 2)))
            s, e = dyadic_periods(base + start, base + end)
            of = s >> BITS
            offsets = pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32))
            s, e = (s - (of << BITS)).astype(np.int32), (e - (of << BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: n_keys + 1], pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(e))],
                names=[*b.schema.names[: n_keys + 1], "s", "e"],
            )

    return run


def _tiled(intervals: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces within tiles, runs of whole tiles) of distinct intervals (keys.., a, b)."""
    d = intervals.withColumns({"ta": F.shiftright("a", BITS), "tb": F.shiftright(F.col("b") - 1, BITS)})
    first = F.shiftleft("ta", BITS)
    last = F.shiftleft("tb", BITS)
    piece = lambda t, s, e: F.struct(t.alias("tile"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    one = F.array(piece(F.col("ta"), F.col("a") - first, F.col("b") - first))
    two = F.array(piece(F.col("ta"), F.col("a") - first, F.lit(1 << BITS)), piece(F.col("tb"), F.lit(0), F.col("b") - last))
    pieces = d.select(*keys, F.explode(F.when(F.col("ta") == F.col("tb"), one).otherwise(two)).alias("p")).select(*keys, "p.*")
    runs = d.where("tb - ta > 1").select(*keys, (F.col("ta") + 1).alias("a"), F.col("tb").alias("b"))
    return pieces, runs


def _tile_periods(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., tile, s, e): the periods of each tile as two lists of offsets."""
    furthest = pieces.groupBy(*keys, "tile", "s").agg(F.max("e").alias("e"))
    grouped = furthest.groupBy(*keys, "tile").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "tile bigint", "s array<int>", "e array<int>"])
    return grouped.select(*keys, "tile", "starts", "ends").mapInArrow(_tile_kernel(len(keys)), schema)


def _stretches(intervals: DataFrame, keys: list[str], tiers: int) -> DataFrame:
    """(keys.., start, stop, gaps): one row per touched tile and per run of whole tiles; gaps are those within the row."""
    pieces, runs = _tiled(intervals, keys)
    tile = F.shiftleft("tile", BITS)
    inner = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct((tile + F.element_at("e", i)).alias("gap_start"), (tile + F.element_at("s", i + 1)).alias("gap_end")))
    none = F.array().cast("array<struct<gap_start:bigint,gap_end:bigint>>")
    rows = _tile_periods(pieces, keys).select(
        *keys, (tile + F.element_at("s", 1)).alias("start"), (tile + F.element_at("e", -1)).alias("stop"),
        F.when(F.size("s") > 1, inner).otherwise(none).alias("gaps"),
    )
    if tiers > 1:
        upper = _stretches(runs.distinct(), keys, tiers - 1)
        # a run of whole tiles one tier up: its periods in units of this tier, without gaps of its own
        solid = F.flatten(F.array(F.array(F.struct(F.col("start").alias("x"), F.coalesce(F.element_at("gaps.gap_start", 1), F.col("stop")).alias("y")))))
        rest = F.transform(F.sequence(F.lit(1), F.size("gaps")), lambda i: F.struct(
            F.element_at(F.col("gaps"), i).getField("gap_end").alias("x"), F.coalesce(F.try_element_at(F.col("gaps"), i + 1).getField("gap_start"), F.col("stop")).alias("y")))
        solid = F.when(F.size("gaps") == 0, F.array(F.struct(F.col("start").alias("x"), F.col("stop").alias("y")))).otherwise(F.concat(solid, rest))
        upper = upper.select(*keys, F.explode(solid).alias("p")).select(*keys, F.shiftleft("p.x", BITS).alias("start"), F.shiftleft("p.y", BITS).alias("stop"), none.alias("gaps"))
        rows = rows.unionByName(upper)
    return rows


def _ordered(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys.., start, stop, gaps, reach): stretches that nothing covers, with the furthest end before each."""
    d = intervals.where(F.col(start).isNotNull() & (F.col(end) > F.col(start))).select(*keys, F.col(start).cast("bigint").alias("a"), F.col(end).cast("bigint").alias("b"))
    rows = _stretches(d, keys, TIERS)
    before = Window.partitionBy(*keys).orderBy(F.col("start"), F.col("stop").desc(), F.size("gaps")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("stop").over(before)).where("reach IS NULL OR stop > reach")


def gaps(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys.., gap_start, gap_end): maximal stretches that no interval covers, between the first start and last end of an entity.

    Intervals are half open; rows with a null bound or no length count for nothing, touching intervals leave no gap,
    repeated rows change nothing, null keys are an entity of their own. Other columns are dropped.
    """
    rows = _ordered(intervals, keys, start, end)
    outer = F.when(F.col("start") > F.col("reach"), F.array(F.struct(F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))))
    none = F.array().cast("array<struct<gap_start:bigint,gap_end:bigint>>")
    return rows.select(*keys, F.explode(F.concat(F.coalesce(outer, none), "gaps")).alias("g")).select(*keys, "g.gap_start", "g.gap_end")


def periods(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys.., period_start, period_end): maximal covered stretches per entity; same rules as ``gaps``."""
    rows = _ordered(intervals, keys, start, end)
    whole = Window.partitionBy(*keys).orderBy("start", "stop")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))
    rows = rows.withColumn("opened", opened).withColumn("last_open", F.coalesce(F.try_element_at("gaps.gap_end", F.lit(-1)), "opened"))
    rows = rows.withColumns({"open_before": F.last("last_open", True).over(before), "is_last": F.lead("start").over(whole).isNull()})
    pair = lambda a, b: F.struct(a.alias("period_start"), b.alias("period_end"))
    here = F.coalesce("opened", "open_before")
    none = F.array().cast("array<struct<period_start:bigint,period_end:bigint>>")
    closed = F.when(F.col("opened").isNotNull() & F.col("reach").isNotNull(), F.array(pair(F.col("open_before"), F.col("reach")))).otherwise(none)
    head = F.when(F.size("gaps") > 0, F.array(pair(here, F.element_at("gaps", 1).getField("gap_start")))).otherwise(none)
    inner = F.when(
        F.size("gaps") > 1,
        F.transform(F.sequence(F.lit(1), F.size("gaps") - 1), lambda i: pair(F.element_at(F.col("gaps"), i).getField("gap_end"), F.element_at(F.col("gaps"), i + 1).getField("gap_start"))),
    ).otherwise(none)
    tail = F.when(F.col("is_last"), F.array(pair(F.coalesce("last_open", "open_before"), F.col("stop")))).otherwise(none)
    return rows.select(*keys, F.explode(F.concat(closed, head, inner, tail)).alias("p")).select(*keys, "p.*")


def marker_intervals(markers: DataFrame) -> DataFrame:
    """(rec_id, label, start, end): markers with a span and a label, the label without outer spaces in lower case.

    Markers with null pos, span of null or less than 1, and null or blank labels are left out; an end beyond BIGINT is its largest value.
    """
    label: Column = F.lower(F.trim("label"))
    end = F.coalesce(F.try_add("pos", "span"), F.lit(2**63 - 1))
    return markers.where("span > 0 AND pos IS NOT NULL").select("rec_id", label.alias("label"), F.col("pos").alias("start"), end.alias("end")).where("label <> ''")
