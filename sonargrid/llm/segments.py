"""Recordings cut into pieces at natural boundaries.

Every frame of a recording is classed by the strength of a cut there, one character each: ``q`` quiet in all channels,
``x`` not, ``_`` null, ``-`` missing. Regular expressions with bounded quantifiers consume the classes: one gives the quiet stretches,
one the pieces, both as lists of tokens whose lengths SQL array functions add up. A recording is held in blocks of 2**16 frames,
the only unit that a task ever holds. A block sees the start of the next one, and the first cut in it follows from the last cut
before it: each block is a map of the places where the first cut may lie to the place of the first cut in the next block, and
these small maps are followed in order. So the pieces don't depend on where blocks begin.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonargrid.operators.blocks import BITS, FRAMES, gathered, lists, merged
from sonargrid.session import checkpoint, is_small, join_checked

_ROWS = "rec_id bigint, channel int, block bigint, frames array<int>, xs array<double>"
_FLAGS = "rec_id bigint, block bigint, low int, size int, flags binary"
_CLASSED = "rec_id bigint, block bigint, first_frame bigint, n_frames bigint, classes string"


def _median(x: np.ndarray) -> float:
    x = x[~np.isnan(x)]
    return float(np.median(x)) if len(x) else float("nan")


def _flagged(frames: np.ndarray, x: np.ndarray, median: float, most: float) -> tuple[int, int, bytes]:
    """(first frame, number of frames, three bits a frame): whether a channel has the frame, has no number there, and is calm."""
    low, size = int(frames[0]), int(frames[-1] - frames[0]) + 1
    planes = np.zeros((3, size), bool)
    planes[0, frames - low] = True
    planes[1, frames - low] = np.isnan(x)
    planes[2, frames - low] = np.abs(x - median) <= most
    return low, size, np.packbits(planes, axis=1).tobytes()


def _flag_kernel(most: float, known: bool):
    """(rec_id, channel, block, parts), or (rec_id, channel, block, frames, xs, median) if the median is known -> flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                if known:
                    frames, x = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                    median = b.column(5)[i].as_py()
                else:
                    frames, x = merged(b.column(3)[i].values, greatest=False)
                    median = _median(x)
                out.append(_flagged(frames, x, float("nan") if median is None else median, most))
            low, size, flags = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(low, pa.int32()), pa.array(size, pa.int32()), pa.array(flags, pa.binary())], names=["rec_id", "block", "low", "size", "flags"])

    return run


def _class_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, block, channels of the recording, flags of the block's channels) -> classes."""
    for b in batches:
        out = []
        for i in range(b.num_rows):
            rec, block, channels = (b.column(c)[i].as_py() for c in range(3))
            held = b.column(3)[i].values
            lows, sizes = (held.field(k).to_numpy() for k in ("low", "size"))
            low, high = int(lows.min()), int((lows + sizes).max())
            present, null, calm = np.zeros(high - low, bool), np.zeros(high - low, bool), np.zeros(high - low, np.int32)
            for a, n, flags in zip(lows - low, sizes, held.field("flags")):
                planes = np.unpackbits(np.frombuffer(flags.as_buffer(), np.uint8).reshape(3, -1), axis=1, count=int(n)).astype(bool)
                for whole, part in zip((present, null), planes):
                    whole[a : a + n] |= part
                calm[a : a + n] += planes[2]
            n = len(held) if channels is None else channels
            codes = np.select([~present, null, calm == n], [ord("-"), ord("_"), ord("q")], ord("x")).astype(np.uint8)
            out.append((rec, block, (block << BITS) + low, int(present.sum()), codes.tobytes().decode("ascii")))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["rec_id", "block", "first_frame", "n_frames", "classes"])


def _distinct_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, channel, block, parts) -> the same with distinct samples."""
    for b in batches:
        rows = [merged(b.column(3)[i].values, greatest=False) for i in range(b.num_rows)]
        if rows:
            frames, xs = zip(*rows)
            lengths = np.array([len(f) for f in frames])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(lengths, np.concatenate(frames).astype(np.int32)), lists(lengths, np.concatenate(xs))], names=["rec_id", "channel", "block", "frames", "xs"])


def _digit_kernel(level: int):
    """(rec_id, channel, xs[, targets]) -> (rec_id, channel, which, digit, n, x): counts of the next 16 bits of values with a known prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                x = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)] + 0.0  # no negative zero
                u = x.view(np.uint64)
                u = np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))
                targets = b.column(3)[i].as_py() if level else [{"which": 0, "prefix": 0}]
                for t in targets:
                    v, xv = u, x
                    if level:
                        mine = u >> np.uint64(64 - 16 * level) == np.uint64(t["prefix"])
                        v, xv = u[mine], x[mine]
                    digit = (v >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF) if level < 2 else v & np.uint64(0xFFFFFFFF)
                    d, first, n = np.unique(digit, return_index=True, return_counts=True)
                    for o, a in zip(out, (np.full(len(d), b.column(0)[i].as_py()), np.full(len(d), b.column(1)[i].as_py()), np.full(len(d), t["which"]), d.astype(np.int64), n, xv[first])):
                        o.append(a)
            if out[0]:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)).cast(t) for o, t in zip(out, types)], names=["rec_id", "channel", "which", "digit", "n", "x"])

    return run


def _medians(blocks: DataFrame) -> DataFrame:
    """(rec_id, channel, median) of recordings of many blocks, exact: the middle ranks are found 16 bits of the value at a time.

    Each pass counts at most 2**16 digits per channel, whatever the number of samples.
    """
    schema = "rec_id bigint, channel int, which int, digit bigint, n bigint, x double"
    targets = None
    for level in range(3):
        rows = blocks.select("rec_id", "channel", "xs")
        if targets is not None:
            held = targets.groupBy("rec_id", "channel").agg(F.collect_list(F.struct("which", "prefix")).alias("targets"))  # two a channel
            rows = join_checked(rows, held, ["rec_id", "channel"]).select("rec_id", "channel", "xs", "targets")
        counts = rows.mapInArrow(_digit_kernel(level), schema).groupBy("rec_id", "channel", "which", "digit").agg(F.sum("n").alias("n"), F.max("x").alias("x"))
        w = Window.partitionBy("rec_id", "channel", "which")
        counts = counts.withColumns({"upto": F.sum("n").over(w.orderBy("digit")), "total": F.sum("n").over(w)})
        if targets is None:
            ranks = F.array(*[F.struct(F.lit(i).alias("which"), r.cast("bigint").alias("rank")) for i, r in enumerate((F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))])
            counts = counts.drop("which").withColumn("t", F.explode(ranks)).select("rec_id", "channel", "t.*", F.lit(0).cast("bigint").alias("prefix"), "digit", "n", "x", "upto")
        else:
            counts = counts.drop("total").join(targets.drop("x"), ["rec_id", "channel", "which"])
        chosen = counts.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        targets = checkpoint(chosen.select(
            "rec_id", "channel", "which", (F.col("prefix") * FRAMES + F.col("digit")).alias("prefix") if level < 2 else F.lit(0).cast("bigint").alias("prefix"),
            (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "x"))
    every = blocks.select("rec_id", "channel").distinct()  # a channel of nulls only has no median
    return every.join(targets.groupBy("rec_id", "channel").agg((F.sum("x") / 2).alias("median")), ["rec_id", "channel"], "left")


def classes(samples: DataFrame, most: float = 0.02) -> DataFrame:
    """(rec_id, block, first_frame, n_frames, classes): the class of every frame, in rows of at most 2**16 frames, with the distinct frames of the recording.

    A frame is quiet (``q``) if every channel of the recording is there and within ``most`` of its median over the recording;
    a frame with a null or NaN is ``_``, and a frame without samples within a row ``-``. Rows with a null key count for nothing;
    of repeated samples with different values the least counts. Columns other than the four of ``samples`` are ignored.
    A task holds a block of one channel, then three bits a frame of all channels. Medians are exact: of a recording of one block they are
    taken in the task that holds it, of others by counting.
    """
    own = samples.where("rec_id IS NOT NULL AND channel IS NOT NULL AND frame IS NOT NULL")
    extent = own.groupBy("rec_id").agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    many = checkpoint(extent.where(F.shiftright("low", BITS) < F.shiftright("high", BITS)).select("rec_id"))
    listed = F.broadcast(many) if is_small(many) else many.hint("shuffle_merge")
    flags = gathered(own.join(listed, "rec_id", "left_anti")).mapInArrow(_flag_kernel(most, known=False), _FLAGS)
    row = lambda f: f.groupBy("rec_id", "block").agg(F.collect_list(F.struct("low", "size", "flags")).alias("held"))
    result = row(flags).select("rec_id", "block", F.lit(None).cast("int").alias("channels"), "held").mapInArrow(_class_kernel, _CLASSED)
    if not many.isEmpty():
        blocks = checkpoint(gathered(own.join(listed, "rec_id", "left_semi")).mapInArrow(_distinct_kernel, _ROWS))
        medians = checkpoint(_medians(blocks))
        known = join_checked(blocks, medians, ["rec_id", "channel"]).select("rec_id", "channel", "block", "frames", "xs", "median")
        held = row(known.mapInArrow(_flag_kernel(most, known=True), _FLAGS))
        held = join_checked(held, medians.groupBy("rec_id").agg(F.count("*").cast("int").alias("channels")), ["rec_id"])
        found = checkpoint(held.select("rec_id", "block", "channels", "held").mapInArrow(_class_kernel, _CLASSED))
        total = found.groupBy("rec_id").agg(F.sum("n_frames").alias("n_frames"))
        result = result.unionByName(join_checked(found.drop("n_frames"), total, ["rec_id"]).select(*result.columns))
    return result


def _ends(tokens: str) -> Column:
    """Where each token ends, from their lengths."""
    return F.aggregate(tokens, F.array().cast("array<int>"), lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(t))))


def quiet_stretches(samples: DataFrame, limit: int = 1000, least: int = 50, most: float = 0.02) -> DataFrame:
    """(rec_id, start_frame, end_frame): maximal runs of at least ``least`` quiet frames in recordings of more than ``limit`` frames.

    These are the natural boundaries that ``pieces`` cuts at. The classes are consumed in tokens of at most ``limit`` frames: quiet stretches first,
    also short ones at the edges of a block, then all that comes before the next one. A stretch longer than a token goes on in
    the next token, and one across blocks in the next block, so tokens that touch are joined. See ``classes`` for what quiet is and how nulls and repeats count.
    """
    if not 0 < least <= limit:
        raise ValueError("a stretch must not be longer than the limit")
    other = rf"(?:(?!q{{{least}}}|q{{1,{least}}}$).){{1,{limit}}}"
    c = classes(samples, most).where(F.col("n_frames") > limit)
    tokens = F.regexp_extract_all("classes", F.lit(rf"^q{{1,{limit}}}|q{{{least},{limit}}}|(?<=q)q{{1,{limit}}}|q{{1,{limit}}}$|{other}"), 0)
    c = c.select("rec_id", "first_frame", F.length("classes").alias("n"), tokens.alias("tokens")).withColumn("ends", _ends("tokens"))
    quiet = lambda i: F.coalesce(F.try_element_at("tokens", i).rlike("^q+$"), F.lit(False))
    kept = F.filter(
        F.transform("tokens", lambda t, i: F.when(t.startswith("q"), F.struct(F.element_at("ends", i + 1).alias("end"), F.length(t).alias("size"), quiet(i + 1).alias("quiet"), F.when(i > 0, quiet(F.when(i > 0, i).otherwise(1))).otherwise(False).alias("goes_on")))),
        lambda t: t["quiet"] & ((t["size"] >= least) | (t["end"] == t["size"]) | (t["end"] == F.col("n")) | t["goes_on"]),
    )
    runs = c.select("rec_id", "first_frame", "n", F.explode(kept).alias("t"))
    runs = runs.select("rec_id", (F.col("first_frame") + F.col("t.end") - F.col("t.size")).alias("start_frame"), (F.col("first_frame") + F.col("t.end")).alias("end_frame"), ((F.col("t.end") == F.col("t.size")) | (F.col("t.end") == F.col("n")) | (F.col("t.size") == limit) | F.col("t.goes_on")).alias("open"))
    # only tokens at the edges of blocks and in stretches longer than a token meet others, in order
    w = Window.partitionBy("rec_id").orderBy("start_frame")
    joined = runs.where("open").withColumn("new", (F.coalesce(F.lag("end_frame").over(w), F.lit(-1)) != F.col("start_frame")).cast("int"))
    joined = joined.withColumn("k", F.sum("new").over(w)).groupBy("rec_id", "k").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    joined = joined.where(F.col("end_frame") - F.col("start_frame") >= least).drop("k")
    return runs.where("NOT open").select("rec_id", "start_frame", "end_frame").unionByName(joined)


def _stretch_kernel(limit: int):
    """(rec_id, block, first_frame, n_frames, classes) -> a row for each part of a block without a hole longer than ``limit`` frames."""
    hole = re.compile(f"-{{{limit + 1},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rec, block, first, _, codes in zip(*(c.to_pylist() for c in b.columns)):
                holes = [(m.start(), m.end()) for m in hole.finditer(codes)]
                parts = list(zip([0, *(e for _, e in holes)], [*(a for a, _ in holes), len(codes)]))
                out += [(rec, block, first + a, i == 0, i == len(parts) - 1, codes[a:e]) for i, (a, e) in enumerate(parts)]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rec_id", "block", "first", "is_first", "is_last", "classes"])

    return run


def _map_kernel(pattern: str, reach: int):
    """(rec_id, first, follows, more, classes, ahead) -> (rec_id, first, follows, exits): for a first cut at each of ``reach`` places, the place of the first cut in what follows."""
    token = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for more, codes, ahead in zip(*(c.to_pylist() for c in b.columns[3:])):
                if not more:
                    out.append(None)
                    continue
                text, n = codes + ahead, len(codes)
                known: dict[int, int] = {}
                exits = np.empty(reach, np.int32)
                for e in range(reach):
                    way, at = [], e
                    while at < n and at not in known:
                        way.append(at)
                        at = token.match(text, at).end()
                    at = known.get(at, at)
                    known.update(dict.fromkeys(way, at))
                    exits[e] = at - n
                out.append(zlib.compress(np.diff(exits, prepend=0).astype(np.int32).tobytes()))  # mostly zeros: cuts soon coincide
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["rec_id", "first", "follows", "exits"])

    return run


def _entry_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_map_kernel`` in order of recording and frame -> (rec_id, first, entry): the place of the first cut in each, 0 where nothing goes before."""
    at = 0
    for b in batches:
        entries = []
        for follows, exits in zip(*(c.to_pylist() for c in b.columns[2:])):
            at = at if follows else 0
            entries.append(at)
            if exits is not None:
                at = int(np.cumsum(np.frombuffer(zlib.decompress(exits), np.int32))[at])
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(entries, pa.int32())], names=["rec_id", "first", "entry"])


def pieces(samples: DataFrame, limit: int = 1000, overlap: int = 50, least: int = 50, most: float = 0.02) -> DataFrame:
    """(rec_id, start_frame, end_frame, boundary): pieces of at most ``limit`` frames that cover every recording.

    Consecutive pieces share ``overlap`` frames. A piece ends, in this order, at the end of the recording (``end``), in the midst
    of the last quiet stretch within reach (``quiet``), between two quiet frames of its latter half (``lull``), or at the limit (``limit``).
    A recording that is no longer than the limit is one piece. A hole of more than ``limit`` missing frames ends a recording and starts another;
    shorter ones lie within pieces. Pieces depend on the recording only: moved by any number of frames, it has the same pieces.
    """
    if not (0 <= 2 * overlap + least < limit <= FRAMES // 4 and least >= 2):
        raise ValueError(f"the limit must exceed twice the overlap and a quiet stretch, and not {FRAMES // 4} frames")
    reach, half = limit - overlap, least // 2
    quiet = rf".{{{min(overlap, reach - half)},{reach - half}}}q{{{half}}}(?=q{{{half}}})"
    natural = rf".{{1,{reach}}}$|{quiet}|.{{{reach // 2},{reach - 1}}}q(?=q)|.{{1,{reach}}}"
    c = checkpoint(classes(samples, most).mapInArrow(_stretch_kernel(limit), "rec_id bigint, block bigint, first bigint, is_first boolean, is_last boolean, classes string"))
    end = F.col("first") + F.length("classes")
    # parts of neighbouring blocks with no more than ``limit`` missing frames between them: a row a block on either side
    before = c.where("is_last").select("rec_id", (F.col("block") + 1).alias("block"), end.alias("end_before"))
    after = c.where("is_first").select("rec_id", (F.col("block") - 1).alias("block"), F.col("first").alias("first_after"), F.substring("classes", 1, limit + half).alias("head"))
    c = c.join(before, ["rec_id", "block"], "left").join(after, ["rec_id", "block"], "left")
    follows = F.col("is_first") & F.coalesce(F.col("first") - F.col("end_before") <= limit, F.lit(False))
    more = F.col("is_last") & F.coalesce(F.col("first_after") - end <= limit, F.lit(False))
    filled = F.when(more, F.rpad("classes", (F.col("first_after") - F.col("first")).cast("int"), "-")).otherwise(F.col("classes"))
    c = c.select("rec_id", "first", follows.alias("follows"), more.alias("more"), filled.alias("classes"), F.when(more, F.col("head")).otherwise("").alias("ahead"))
    maps = c.where("follows OR more").mapInArrow(_map_kernel(natural, reach), "rec_id bigint, first bigint, follows boolean, exits binary")
    entries = maps.repartition("rec_id").sortWithinPartitions("rec_id", "first").mapInArrow(_entry_kernel, "rec_id bigint, first bigint, entry int")
    c = join_checked(c, checkpoint(entries), ["rec_id", "first"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    size = F.length("classes") - F.col("entry")
    c = c.select("rec_id", (F.col("first") + F.col("entry")).alias("start"), "follows", "more", size.alias("size"), F.concat(F.substring("classes", F.col("entry") + 1, F.length("classes")), "ahead").alias("text"))
    whole = (F.length("text") <= limit) & ~F.col("follows") & ~F.col("more")
    tokens = F.when(whole, F.array("text")).when(F.col("size") > 0, F.regexp_extract_all("text", F.lit(natural), 0))
    c = c.withColumn("tokens", tokens).withColumn("ends", _ends("tokens"))

    def piece(e, i):
        begin = F.when(i > 0, F.element_at("ends", F.when(i > 0, i).otherwise(1))).otherwise(0)
        first = (i == 0) & ~F.col("follows")
        around = F.substring("text", e - half + 1, F.lit(2 * half))
        last = (e == F.length("text")) & ~F.col("more")
        boundary = F.when(last, "end").when(around == "q" * (2 * half), "quiet").when(F.substring("text", e, F.lit(2)) == "qq", "lull").otherwise("limit")
        return F.struct(begin.alias("begin"), (begin - F.when(first, 0).otherwise(overlap)).alias("a"), e.alias("e"), boundary.alias("boundary"))

    made = F.filter(F.transform("ends", piece), lambda p: p["begin"] < F.col("size"))  # what begins in the next block is the next block's
    c = c.select("rec_id", "start", F.explode(made).alias("p"))
    return c.select("rec_id", (F.col("start") + F.col("p.a")).alias("start_frame"), (F.col("start") + F.col("p.e")).alias("end_frame"), F.col("p.boundary").alias("boundary"))
