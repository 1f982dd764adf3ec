"""Conversion of recordings: select, scale, unwrap, decimate, merge or split, edit metadata, write."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonargrid.functions import texts
from sonargrid.operators import metadata as meta
from sonargrid.operators import recordings
from sonargrid.operators import signal as sig
from sonargrid.session import checkpoint
from sonargrid.sources import riff, riff_source


@dataclass
class Conversion:
    """What to do with recordings; the steps run in the order of the fields."""

    channels: list[int] = field(default_factory=list)
    scale: float = 1.0
    unwrap: float = 0.0
    unwrap_mode: str = "keep"
    ampl_max: float = 1.0
    unit: str = ""
    decimate: int = 1
    #: Name of the outputs without suffix, with keys of the metadata in braces; empty for the names of the inputs.
    name: str = ""
    add: dict[str, str] = field(default_factory=dict)
    remove: list[str] = field(default_factory=list)


def modify_samples(s: DataFrame, c: Conversion) -> DataFrame:
    """Samples after channel selection, scaling, unwrapping and decimation."""
    if c.channels:
        s = sig.select_channels(s, c.channels)
    if c.scale != 1.0:
        s = sig.scale(s, c.scale)
    if c.unwrap > 0:
        s = sig.unwrap(s, c.unwrap, c.ampl_max, c.unwrap_mode)
    return sig.decimate(s, c.decimate) if c.decimate > 1 else s


def modify_metadata(m: DataFrame, c: Conversion) -> DataFrame:
    """Metadata in step with ``modify_samples``: gain, unwrap threshold and clip, then removals and additions. Scaling leaves a gain where there was none."""
    factor = c.scale * (0.5 if c.unwrap > 0 and c.unwrap_mode == "halve" else 1.0)
    if factor != 1.0:
        m = meta.update_gain(m, factor)
    if c.scale != 1.0:
        m = meta.add_missing(m, "gain", f"{1 / factor:g}", meta.GAIN_KEYS)
    if c.unwrap > 0:
        m = meta.add_unwrap(m, c.unwrap * c.ampl_max, c.ampl_max if c.unwrap_mode == "clip" else 0.0, c.unit)
    if c.remove:
        m = meta.cleanup(meta.remove(checkpoint(m), c.remove))  # small; every step reads its input several times
    return meta.add_values(checkpoint(m), c.add) if c.add else m


def modify_markers(k: DataFrame, c: Conversion) -> DataFrame:
    """Markers with positions and spans at the decimated rate."""
    q = c.decimate
    return k if q == 1 else k.withColumns({"pos": F.floor(F.col("pos") / q).cast("bigint"), "span": F.floor(F.col("span") / q).cast("bigint")})


def groups(files: DataFrame, merge: int = 0) -> DataFrame:
    """(rec_id, out_id, low, high): ranges of frames that go into one output each; 0 merges all files of a recording.

    Files that don't continue their recording are an error for the caller to raise, see ``check_continuity``.
    """
    part = F.lit(0) if merge < 1 else F.floor(F.col("file_idx") / merge)
    return files.groupBy("rec_id", part.cast("int").alias("part")).agg(F.min("start_index").alias("low"), F.max("end_index").alias("high"))


def start_times(m: DataFrame) -> DataFrame:
    """(rec_id, file_idx, start_time) of the files that have one in their metadata (rec_id, file_idx, ord, ..)."""
    found = meta.get_datetime(m.withColumn("rec_id", F.struct("rec_id", "file_idx")).drop("file_idx"))
    return found.select("rec_id.rec_id", "rec_id.file_idx", F.col("value").alias("start_time"))


def check_continuity(files: DataFrame, starts: DataFrame, max_gap_s: float = 1.0, mode: str = "strict") -> None:
    """ValueError naming the first file that doesn't continue its recording, see ``recordings.continuity``; in mode "strict" nothing continues a file without start."""
    timed = files.join(starts, ["rec_id", "file_idx"], "left")
    broken = recordings.continuity(timed, max_gap_s, mode).where("NOT ok")
    if mode == "strict":
        after = timed.where("start_time IS NULL").select("rec_id", (F.col("file_idx") + 1).alias("file_idx"))
        broken = broken.select("rec_id", "file_idx").union(after)
    first = files.join(broken.select("rec_id", "file_idx").distinct(), ["rec_id", "file_idx"]).agg(F.min_by("path", F.struct("rec_id", "file_idx"))).first()[0]
    if first is not None:
        raise ValueError(f"{first} does not continue its recording")


def convert(spark: SparkSession, source: str, target: str, c: Conversion, encoding: str | None = None, merge: int = 0, folders: bool = False, hint: str = "cue", mode: str = "strict", max_gap_s: float = 1.0) -> None:
    """Read recordings at ``source``, change them and write them to the folder ``target``.

    Outputs lie below ``target`` as their first files lie below ``source``; equal names, as of x.wav and x.WAV, are an error.
    With ``folders`` all files of a folder are one recording, written as one file or, with ``merge``, as one file per so many.
    These must continue each other by their start times, up to ``max_gap_s``; with ``mode`` "relaxed" start times may be missing.
    Outputs have the encoding given, or else that of their recording's first file, or PCM_16 if WAVE hasn't got that.
    Every output has the metadata of all files of its recording, of a repeated key the last value, but the first file's start time, and a line of
    coding history: after those that are there, or in a new history that begins with a line for the source.
    """
    riff_source.register(spark)
    view = lambda v: spark.read.format("riff").option("view", v).option("recording", "folder" if folders else "file").load(source)
    files, said = view("files").cache(), view("metadata").cache()
    kept = [files, said]  # small, and read by many steps
    kinds, last = files.groupBy("rec_id").agg(F.count_distinct("rate", "channels").alias("kinds"), F.max("file_idx").alias("last")).agg(F.max("kinds"), F.max("last")).first()
    if kinds > 1:
        raise ValueError("files of one recording differ in rate or channels")
    if folders:
        starts = start_times(said).cache()
        kept.append(starts)
        check_continuity(files, starts, max_gap_s, mode)
    cut = groups(files, merge)
    most = last // merge if merge > 0 else 0
    up = lambda v: F.ceil(F.col(v) / c.decimate)  # noqa: E731 - both ends alike, so that every frame has one output
    cut = cut.withColumns({"out_id": F.col("rec_id") * (most + 1) + F.col("part"), "low": up("low"), "high": up("high")})
    samples = modify_samples(view("samples"), c)
    placed = samples.join(cut.select("rec_id", "out_id", "low", "high"), "rec_id").where("frame >= low AND frame < high")
    placed = placed.select(F.col("out_id").alias("rec_id"), "channel", (F.col("frame") - F.col("low")).alias("frame"), "x")
    if folders:
        merged = meta.merge_files(said).cache()
        md = meta.set_starttimes(merged, starts.where("file_idx = 0").select("rec_id", F.col("start_time").alias("value"))).cache()
        kept += [merged, md]
    else:
        md = said.drop("file_idx")
    outs = cut.select("rec_id", "out_id")
    md = checkpoint(modify_metadata(md, c).join(outs, "rec_id").drop("rec_id").withColumnRenamed("out_id", "rec_id"))  # small, and a long plan
    offsets = files.select("rec_id", "file_idx", F.col("start_index").alias("offset"))
    marks = view("markers").join(offsets, ["rec_id", "file_idx"]).withColumn("pos", F.col("pos") + F.col("offset"))
    marks = modify_markers(marks, c).join(cut.select("rec_id", "out_id", "low", "high"), "rec_id").where("pos >= low AND pos < high")
    marks = marks.select(F.col("out_id").alias("rec_id"), (F.col("pos") - F.col("low")).alias("pos"), "span", "label", "text")
    head = files.where("file_idx = 0").select("rec_id", "path", "rate", "encoding", "channels")
    channels = F.lit(len(c.channels)) if c.channels else F.col("channels")
    to = F.lit(encoding) if encoding else F.when(F.col("encoding").isin(list(riff.ENCODINGS)), F.col("encoding")).otherwise("PCM_16")
    own = riff_source.below(source, F.col("path"))
    stem = F.regexp_extract(own, r"(?s)^(.*?)(\.[^./]*)?$", 1)
    outs = cut.join(head, "rec_id")
    if c.name:
        keys = list(dict.fromkeys(re.findall(r"\{([^{}]+)\}", c.name)))
        flat = meta.flatten(md).where(F.col("key").isin(keys) & F.col("value").isNotNull()).groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
        outs = outs.join(flat.withColumnRenamed("rec_id", "out_id"), "out_id", "left")
        filled = F.coalesce(texts.fill_name(F.lit(c.name), F.coalesce("values", F.create_map().cast("map<string,string>")), keys), F.lit(c.name))
        stem = F.concat(F.regexp_extract(own, r"^(.*/)?", 0), F.regexp_replace(filled, "/", "_"))
    name = F.concat(stem, F.when(F.lit(merge > 0), F.format_string("-%04d", "part")).otherwise(""), F.lit(".wav"))
    rates = outs.select(
        F.col("out_id").alias("rec_id"), (F.col("rate") / c.decimate).alias("rate"), name.alias("name"), to.alias("encoding"),
        texts.history(F.col("encoding"), F.col("rate"), F.col("channels"), own).alias("before"), texts.history(to, F.col("rate") / c.decimate, channels, name).alias("line"),
    ).cache()
    kept.append(rates)
    riff_source.check_names(rates)
    md = meta.add_histories(md, rates.select("rec_id", "line", "before"))
    riff_source.write_recordings(riff_source.to_files(placed, rates, md, marks, "PCM_16", hint), target)
    for df in kept:
        df.unpersist()
