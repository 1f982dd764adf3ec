"""Long exact spans shared between records.

A window of text is shared if it stands, code point by code point, in a record with another id. Sharding suffix automata
by record would stream every record past every shard, which is quadratic. Here the shards are made by content: every
window has one anchor, the k-gram of least hash in it, and equal windows have equal anchors at equal offsets. So only the
stretches around an anchor that several texts hold meet in a shard, where a generalised suffix automaton of the
distinct stretches is built and every stretch streamed past it for its matching statistics. Stretches are aligned at their anchor,
so they are cut into symbols where any two of them part: the automaton is that of the code points with its unbranched paths
drawn together, and has a few states a stretch. Equal texts are taken together first. A shard with very many distinct stretches is split by
the position of the window around the anchor, as often as needed, by ever longer common text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonargrid.llm.automaton import SuffixAutomaton
from sonargrid.operators.blocks import lists
from sonargrid.session import checkpoint, join_checked

GRAM = 32
#: Distinct stretches up to which a shard goes into one automaton; one with more is split.
CROWD = 400
#: Code points hashed at once; a longer text is cut into parts that overlap by a window less one.
PART = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POSITION = np.uint64(23)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all k-grams, from prefix sums of code * base**i modulo 2**64."""
    n = len(points)
    power = np.full(n, _BASE)
    power[:1] = 1
    back = np.full(n, _BASE_INVERSE)
    back[:1] = 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(points.astype(np.uint64) + _MIX) * np.multiply.accumulate(power), out=prefix[1:])
    return _mixed((prefix[gram:] - prefix[:-gram]) * np.multiply.accumulate(back)[: n - gram + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(points: np.ndarray, of: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last): the anchors of concatenated texts and the starts first..last of the windows they stand for.

    ``of`` numbers the text of each code point; windows across texts don't count.
    """
    if len(points) < window:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    h = _gram_hashes(points, gram)
    key = (h >> _POSITION << _POSITION) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    place = (_sliding_min(key, window - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
    place[of[: len(place)] != of[window - 1 :]] = -1
    edge = np.flatnonzero(np.diff(place, prepend=-2))
    stop = np.append(edge[1:], len(place)) - 1
    real = place[edge] >= 0
    at = place[edge][real]
    return h[at], at, edge[real], stop[real]


def _anchor_kernel(window: int):
    """(doc_id, text_key, text) -> (doc_id, text_key, part, anchor, place, first, last), the last four as lists; a row for each part of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[tuple[int, int, str]], b: pa.RecordBatch):
            points = np.frombuffer("".join(t for _, _, t in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = [len(t) for _, _, t in parts]
            begin = np.cumsum([0, *sizes[:-1]])
            of = np.repeat(np.arange(len(parts)), sizes)
            h, place, first, last = anchors(points, of, window)
            k = of[place]
            start = np.array([o for _, o, _ in parts])
            shift = start[k] - begin[k]
            rows = pa.array([r for r, _, _ in parts])
            n = np.bincount(k, minlength=len(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(start.astype(np.int32)), lists(n, h.view(np.int64)), *(lists(n, (x + shift).astype(np.int32)) for x in (place, first, last))],
                names=["doc_id", "text_key", "part", "anchor", "place", "first", "last"],
            )

        for b in batches:
            parts, held = [], 0
            for r, text in enumerate(b.column(2).to_pylist()):
                for o in range(0, len(text) - window + 1, PART - window + 1):
                    part = text[o : o + PART]
                    if held + len(part) > PART and parts:
                        yield from emit(parts, b)
                        parts, held = [], 0
                    parts.append((r, o, part))
                    held += len(part)
            if parts:
                yield from emit(parts, b)

    return run


def _member_kernel(window: int):
    """(text_key, lo, hi, text, at) -> a row for each anchor with the stretch of text around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "text_key", "lo", "hi", "place", "base", "n", "near", "far", "seg"]
        for b in batches:
            lists = b.column(4)
            ends = lists.offsets.to_numpy()
            anchor, n, place, first, last = (lists.values.field(k).to_numpy() for k in ("anchor", "n", "place", "first", "last"))
            texts = b.column(3)
            row, a, e = 0, int(ends[0]), int(ends[-1])
            for at in range(a, e, 50_000):  # bounded batches, whatever the length of a text
                to = min(e, at + 50_000)
                of, segs = np.empty(to - at, np.int64), []
                text = texts[row].as_py()
                for i in range(at, to):
                    while i >= ends[row + 1]:
                        row += 1
                        text = texts[row].as_py()
                    of[i - at] = row
                    segs.append(text[first[i] : last[i] + window])
                part = slice(at, to)
                key, lo, hi = (b.column(c).take(pa.array(of)) for c in range(3))
                cols = [pa.array(anchor[part]), key, lo, hi, pa.array(place[part]), pa.array(first[part]), pa.array(n[part])]
                cols += [pa.array(place[part] - last[part]), pa.array(place[part] - first[part]), pa.array(segs, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _common(a: str, b: str) -> int:
    """Length of the common start of two texts."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _partings(texts: set[str]) -> list[int]:
    """Every length at which two of the texts part, in order; a text that starts another parts from it at its end."""
    held = sorted(texts)
    return sorted({_common(a, b) for a, b in zip(held, held[1:])})


def solve(stretches: dict[tuple[str, int], tuple[int, int]], window: int) -> dict[tuple[str, int], list[tuple[int, int]]]:
    """Runs of starts of shared windows of every stretch (text, offset of its anchor) with its least and greatest owner.

    Stretches are aligned at their anchors. They are cut where any two of them part, to the right and to the left of the anchor, so a
    longest match of symbols is a longest match of code points.
    """
    runs: dict[tuple[str, int], list[tuple[int, int]]] = {}
    single = [s for s, (lo, hi) in stretches.items() if lo == hi]
    for s in stretches.keys() - set(single):
        runs[s] = [(0, len(s[0]) - window + 1)]
    if not single or (len(stretches) == 1):
        return runs
    right = _partings({t[o:] for t, o in stretches})
    left = [-x for x in reversed(_partings({t[:o][::-1] for t, o in stretches}))]
    cuts = [*left, *(x for x in right if x > 0)]
    automaton = SuffixAutomaton()
    coded = {}
    for (text, o), (lo, hi) in stretches.items():
        places = [0, *(o + x for x in cuts if 0 < o + x < len(text)), len(text)]
        symbols = [(a - o, text[a:b]) for a, b in zip(places, places[1:])]
        coded[text, o] = symbols, places
        automaton.add(symbols, lo, hi)
    automaton.settle()
    for s in single:
        runs[s] = automaton.shared(*coded[s], window)
    return runs


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in groups of their first column."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _packed(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)


def _shard_kernel(window: int):
    """Rows sorted by shard: (shard, text_key, lo, hi, base, far, seg) -> (text_key, a, b), runs of starts of shared windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _by_shard(batches):
            held: dict[tuple[str, int], tuple[int, int]] = {}
            for _, _, lo, hi, _, far, seg in rows:
                x = held.get((seg, far))
                held[seg, far] = (lo, hi) if x is None else (min(x[0], lo), max(x[1], hi))
            if min(x[0] for x in held.values()) == max(x[1] for x in held.values()):
                continue
            runs = solve(held, window)
            for _, key, _, _, base, far, seg in rows:
                for a, b in runs[seg, far]:
                    yield key, base + a, base + b

    return lambda batches: _packed(found(batches), ["text_key", "a", "b"], [pa.binary(), pa.int32(), pa.int32()])


def _distinct_kernel(window: int):
    """Distinct stretches sorted by shard: (shard, far, seg, lo, hi) -> (shard, far, seg, a, b)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _by_shard(batches):
            for (seg, far), runs in solve({(seg, far): (lo, hi) for _, far, seg, lo, hi in rows}, window).items():
                for a, b in runs:
                    yield rows[0][0], far, seg, a, b

    return lambda batches: _packed(found(batches), ["shard", "far", "seg", "a", "b"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()])


def _crowds(rows: DataFrame, window: int, crowd: int) -> list[DataFrame]:
    """Runs of shared starts of shards with many members (shard, text_key, lo, hi, place, base, near, far, seg).

    A row stands for the windows whose anchor lies ``near``..``far`` behind their start. Each step halves the range, and
    keys the halves by the text that all of their windows hold. Equal stretches are one before they meet, however many members
    they have, so a shard is done once it has at most ``crowd`` distinct ones. After the last step the windows of a shard are its key,
    and it is done with whatever it holds: equal windows, and others only by a collision of hashes, which the automaton tells apart.
    """
    out = []
    width = 1 << (window - 1).bit_length()
    while width > 1:
        width //= 2
        half = lambda low: F.struct(
            F.greatest("near", low).alias("near"), F.least("far", low + F.lit(width - 1)).alias("far"), low.alias("low"))
        lows = F.transform(F.sequence((F.floor(F.col("near") / width) * width).cast("int"), F.col("far"), F.lit(width)), half)
        parts = rows.withColumn("part", F.explode(lows)).select("shard", "text_key", "lo", "hi", "place", "base", "seg", "part.*")
        first = F.col("place") - F.col("far")  # start of the first window, in the text
        core = F.substring("seg", F.col("place") - F.col("low") - F.col("base") + 1, F.lit(window) - width + 1)
        parts = checkpoint(parts.select(
            F.xxhash64("shard", "low", core).alias("shard"), "text_key", "lo", "hi", "place", "near", "far", first.alias("base"),
            F.substring("seg", first - F.col("base") + 1, F.col("far") - F.col("near") + window).alias("seg"),
        ))
        distinct = parts.groupBy("shard", "far", "seg").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        about = distinct.groupBy("shard").agg(F.count("*").alias("n"), F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("shard", "n")
        about = checkpoint(about)
        done = about.where(f"n <= {crowd}") if width > 1 else about
        ready = distinct.join(done.select("shard"), "shard").select("shard", "far", "seg", "lo", "hi").repartition("shard").sortWithinPartitions("shard")
        runs = checkpoint(ready.mapInArrow(_distinct_kernel(window), "shard bigint, far int, seg string, a int, b int"))
        out.append(join_checked(parts.select("shard", "far", "seg", "text_key", "base"), runs, ["shard", "far", "seg"]).select("text_key", (F.col("base") + F.col("a")).cast("int").alias("a"), (F.col("base") + F.col("b")).cast("int").alias("b")))
        left = about.where(f"n > {crowd}") if width > 1 else about.limit(0)
        if left.isEmpty():
            break
        rows = parts.join(left.select("shard"), "shard")
    return out


def shared_spans(documents: DataFrame, window: int = 250, crowd: int = CROWD) -> DataFrame:
    """(doc_id, start_char, end_char): maximal stretches all of whose windows of ``window`` code points stand in a record with another id.

    Two stretches of a record may overlap by less than a window. Texts that are null or shorter than the window and rows
    with null ids give nothing; a row that comes twice is one record. ``window`` must exceed the anchor's 32 code points.
    Columns other than doc_id and text are ignored.
    """
    if window <= GRAM:
        raise ValueError(f"a window must hold more than {GRAM} code points")
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text").where(F.length("text") >= window)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.unhex(F.md5("text")).alias("text_key"), "text")
    columns = ["anchor", "place", "first", "last"]
    kept = "doc_id bigint, text_key binary, part int, anchor array<bigint>, place array<int>, first array<int>, last array<int>"
    parts = docs.mapInArrow(_anchor_kernel(window), kept).groupBy("text_key", "part")
    found = checkpoint(parts.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *(F.first(c).alias(c) for c in columns)))
    each = found.select("text_key", "lo", "hi", F.explode(F.arrays_zip(*columns)).alias("x")).select("text_key", "lo", "hi", "x.*")
    about = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("anchor", "n")
    placed = each.join(about, "anchor").groupBy("text_key", "lo", "hi").agg(F.collect_list(F.struct("anchor", "n", "place", "first", "last")).alias("at"))
    schema = "shard bigint, text_key binary, lo bigint, hi bigint, place int, base int, n bigint, near int, far int, seg string"
    one = docs.join(placed.withColumn("doc_id", F.col("lo")), ["doc_id", "text_key"])  # of equal texts that of the least record
    members = one.select("text_key", "lo", "hi", "text", "at").mapInArrow(_member_kernel(window), schema)
    rows = members.where(F.col("n") <= crowd).select("shard", "text_key", "lo", "hi", "base", "far", "seg")
    runs = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_kernel(window), "text_key binary, a int, b int")
    if not about.where(F.col("n") > crowd).isEmpty():
        for r in _crowds(members.where(F.col("n") > crowd).drop("n"), window, crowd):
            runs = runs.unionByName(r)
    order = Window.partitionBy("text_key").orderBy("a")
    runs = runs.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    runs = runs.withColumn("k", F.sum("new").over(order)).groupBy("text_key", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = runs.select("text_key", F.col("a").cast("bigint").alias("start_char"), (F.col("b") + (window - 1)).cast("bigint").alias("end_char"))
    return docs.select("doc_id", "text_key").distinct().join(spans, "text_key").select("doc_id", "start_char", "end_char")


def coverage(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) for every record with a shared span: how much of it is shared elsewhere."""
    order = Window.partitionBy("doc_id").orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end_char") - F.greatest("start_char", F.coalesce(F.max("end_char").over(order), F.col("start_char")))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("shared_chars"))
    sizes = documents.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    return covered.join(sizes, "doc_id").select("doc_id", "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_share"))
