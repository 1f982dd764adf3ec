"""Recordings made of many files, their blocks, markers and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def _in_order() -> WindowSpec:
    return Window.partitionBy("rec_id").orderBy("file_idx")


def _before() -> WindowSpec:
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def wall_micros(c: str) -> Column:
    """Microseconds from 1970-01-01 of a wall clock, whatever the session's zone."""
    return F.unix_micros(F.concat(F.col(c).cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per (rec_id, file_idx), the one loaded last; formats in upper case, WAVE as WAV; frames from the indices where these are known."""
    order = F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")), "path")
    rest = [c for c in files.columns if c not in ("rec_id", "file_idx")]
    one = files.where("rec_id IS NOT NULL AND file_idx IS NOT NULL").groupBy("rec_id", "file_idx").agg(F.max_by(F.struct(*rest), order).alias("f")).select("rec_id", "file_idx", "f.*")
    name = F.upper(F.trim("format"))
    return one.withColumns({"format": F.when(name == "WAVE", "WAV").otherwise(name), "frames": F.coalesce(F.col("end_index") - F.col("start_index"), F.col("frames"))})


def file_offsets(files: DataFrame) -> DataFrame:
    """(rec_id, file_idx, frames, offset, until): where each file lies in its recording, by the frames of the files before it."""
    return files.select("rec_id", "file_idx", "frames", F.coalesce(F.sum("frames").over(_before()), F.lit(0)).alias("offset")).withColumn("until", F.col("offset") + F.coalesce("frames", F.lit(0)))


def file_start_times(files: DataFrame) -> DataFrame:
    """(rec_id, file_idx, start_s): seconds from the recording's start to each file's."""
    return files.select("rec_id", "file_idx", (F.col("start_index") / F.col("rate")).alias("start_s"))


def file_info(files: DataFrame) -> DataFrame:
    """(rec_id, file_idx, name, format, encoding, samplingrate, channels, frames, duration) as text and numbers for people."""
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return files.select("rec_id", "file_idx", name.alias("name"), "format", "encoding", F.format_string("%.0fHz", "rate").alias("samplingrate"), "channels", "frames",
                        F.format_string("%.3fs", F.rint(F.col("frames") / F.col("rate") * 1000) / 1000).alias("duration"))


def continuity(files: DataFrame, max_gap_s: float = 1.0, mode: str = "strict") -> DataFrame:
    """(rec_id, file_idx, ok, gap_s): whether a file and all before it continue the recording.

    A file breaks it by another rate or number of channels, by a start more than ``max_gap_s`` off the end of the file before, and in
    mode "strict" by a missing start. In mode "relaxed" the last known start counts, moved on by the frames since.
    """
    if mode not in ("strict", "relaxed"):
        raise ValueError("mode must be strict or relaxed")
    rows = files.withColumn("start_us", wall_micros("start_time"))
    length = F.rint(F.col("frames") / F.col("rate") * 1e6).cast("bigint")
    rows = rows.withColumn("length", F.coalesce(length, F.lit(0)))
    rows = rows.withColumn("run", F.coalesce(F.sum("length").over(_before()), F.lit(0)))
    zero = F.col("start_us") - F.col("run")  # the start of the recording that a file's start stands for
    if mode == "strict":
        expected = F.lag("start_us").over(_in_order()) + F.lag("length").over(_in_order())
    else:
        expected = F.last(zero, ignorenulls=True).over(_before()) + F.col("run")
    rows = rows.withColumns({"expected": expected, "i": F.row_number().over(_in_order()), "rate0": F.first("rate").over(_in_order()), "channels0": F.first("channels").over(_in_order())})
    gap = F.col("start_us") - F.col("expected")
    bad = (F.col("rate") != F.col("rate0")) | (F.col("channels") != F.col("channels0")) | F.coalesce(F.abs(gap) > int(max_gap_s * 1e6), F.lit(False))
    if mode == "strict":
        bad = bad | F.col("start_us").isNull()
    bad = F.when(F.col("i") == 1, False).otherwise(F.coalesce(bad, F.lit(True)))
    rows = rows.withColumns({"bad": bad.cast("int"), "gap_s": gap / 1e6})
    return rows.select("rec_id", "file_idx", (F.max("bad").over(_in_order()) == 0).alias("ok"), "gap_s")


def frame_to_file(positions: DataFrame, files: DataFrame, pos: str = "pos") -> DataFrame:
    """``positions`` (rec_id, pos, ..) with file_idx, path and the frame within the file; positions outside all files are left out.

    Files of a recording are few, so the join is on rec_id with the range as a condition.
    """
    f = files.select("rec_id", "file_idx", "path", "start_index", "end_index")
    inside = (F.col(pos) >= F.col("start_index")) & (F.col(pos) < F.col("end_index"))
    return positions.join(f, "rec_id").where(inside).withColumn("local_frame", F.col(pos) - F.col("start_index")).drop("start_index", "end_index")


def distinct_markers(markers: DataFrame) -> DataFrame:
    """One row per (rec_id, marker_id), the one loaded last."""
    rest = [c for c in markers.columns if c not in ("rec_id", "marker_id")]
    order = F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")), "pos") if "loaded_at" in rest else F.struct("pos")
    return markers.groupBy("rec_id", "marker_id").agg(F.max_by(F.struct(*rest), order).alias("m")).select("rec_id", "marker_id", "m.*")


def markers_in_range(markers: DataFrame, start: int, stop: int) -> DataFrame:
    """Markers with start <= pos < stop, counted from start."""
    return markers.where((F.col("pos") >= start) & (F.col("pos") < stop)).withColumn("pos", F.col("pos") - start)


def concat_markers(markers: DataFrame, files: DataFrame) -> DataFrame:
    """Markers (rec_id, file_idx, pos, ..) of single files moved to their places in the recording."""
    return markers.join(file_offsets(files).select("rec_id", "file_idx", "offset"), ["rec_id", "file_idx"]).withColumn("pos", F.col("pos") + F.col("offset")).drop("offset")


def join_labels(markers: DataFrame, by: list[str], sep: str = "|") -> DataFrame:
    """(by.., label, text): labels and texts of each place, joined in order of marker_id; nulls and empty ones are left out."""
    def joined(c: str) -> Column:
        return F.concat_ws(sep, F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("marker_id", F.col(c).alias("v"))))), lambda s: s["v"]))

    return markers.groupBy(*by).agg(joined("label").alias("label"), joined("text").alias("text"))


def marker_table(markers: DataFrame, sep: str = " ") -> DataFrame:
    """(rec_id, marker_id, line): markers as lines of fixed width."""
    cells = [F.format_string("%10d", F.coalesce("pos", F.lit(0))), F.format_string("%8d", F.coalesce("span", F.lit(0))), F.rpad(F.coalesce("label", F.lit("")), 10, " "), F.coalesce("text", F.lit(""))]
    return markers.select("rec_id", "marker_id", F.rtrim(F.concat_ws(sep, *cells)).alias("line"))


def block_count(frames: Column, size: int, overlap: int) -> Column:
    """Number of blocks of ``size`` frames, consecutive ones sharing ``overlap``; the last may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the block")
    return F.greatest(F.lit(1), F.ceil((frames - overlap) / (size - overlap))).cast("bigint")


def block_plan(lengths: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(keys.., block, start, stop) for rows (keys.., frames)."""
    keys = [c for c in lengths.columns if c != "frames"]
    b = lengths.where("frames > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), block_count(F.col("frames"), size, overlap) - 1)))
    return b.select(*keys, "block", (F.col("block") * (size - overlap)).alias("start"), F.least(F.col("block") * (size - overlap) + size, F.col("frames")).alias("stop"))


def into_blocks(s: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Samples with the number of every block that holds them: one row for each of the at most ceil(size / step) blocks."""
    step = size - overlap
    n = s.groupBy("rec_id").agg((F.max("frame") + 1).alias("n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / step)).cast("bigint")
    high = F.least(F.floor(F.col("frame") / step), block_count(F.col("n"), size, overlap) - 1).cast("bigint")
    return s.join(n, "rec_id").withColumn("block", F.explode(F.when(high >= low, F.sequence(low, high)))).drop("n")


def markers_in_blocks(markers: DataFrame, size: int) -> DataFrame:
    """Markers with the block that their position lies in, and the position within it; a range join by division."""
    return markers.where("pos >= 0").withColumns({"block": F.floor(F.col("pos") / size), "local_pos": F.col("pos") % size})


def last_chunks(chunks: DataFrame) -> DataFrame:
    """(rec_id, tag, pos, size): chunks by upper-case tag, the last of a tag counts; odd sizes are rounded up to even ones."""
    last = F.max_by(F.struct("pos", (F.col("size") + F.col("size") % 2).alias("size")), "ord")
    return chunks.where("tag IS NOT NULL AND ord IS NOT NULL").groupBy("rec_id", F.upper("tag").alias("tag")).agg(last.alias("c")).select("rec_id", "tag", "c.pos", "c.size")


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """(rec_id, chunks, bytes, largest) of distinct chunks: how many, what they take with their 8 bytes of head and padded to even sizes, and the largest; a null size counts for nothing."""
    rows = chunks.where("ord IS NOT NULL").distinct()
    return rows.groupBy("rec_id").agg(F.count("*").alias("chunks"), F.sum(F.col("size") + F.col("size") % 2 + 8).alias("bytes"), F.max("size").alias("largest"))


def sessions(rows: DataFrame, keys: list[str], time: str, gap_us: int) -> DataFrame:
    """(keys.., session, first_us, last_us, n): runs of rows no more than ``gap_us`` microseconds apart; ``time`` is a count of microseconds."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap_us).cast("bigint"), F.lit(0))
    numbered = rows.where(F.col(time).isNotNull()).withColumn("new", new).withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.count("*").alias("n"))
