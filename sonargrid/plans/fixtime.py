"""Start times of consecutive files set anew: in their metadata, their names, or both."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonargrid.functions import texts
from sonargrid.sources import riff, riff_source


def new_starts(files: DataFrame, start: str) -> DataFrame:
    """(path, name, new_start, new_name) of files in order of rec_id and path: each starts where those before it in its recording end.

    Names hold whole seconds, so of equal new names in a recording all but the first are numbered: _1, _2 ..
    """
    w = Window.partitionBy("rec_id").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.rint(F.col("frames") / F.col("rate") * 1e6).cast("bigint")).over(w), F.lit(0).cast("bigint"))
    at = F.timestamp_add("MICROSECOND", before, F.lit(start).cast("timestamp_ntz"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    named = files.select("rec_id", "file_idx", "path", name.alias("name"), at.alias("new_start"), texts.replace_datetime(name, at).alias("new_name"))
    turn = F.row_number().over(Window.partitionBy("rec_id", "new_name").orderBy("file_idx")) - 1
    stem, ending = (F.regexp_extract("new_name", r"(?s)^(.*?)(\.[^.]*)?$", i) for i in (1, 2))
    return named.select("path", "name", "new_start", F.when(turn > 0, F.concat(stem, F.lit("_"), turn, ending)).otherwise(F.col("new_name")).alias("new_name"))


def _set(md: dict, day: str, clock: str) -> dict:
    out = {}
    for k, v in md.items():
        low = k.lower()
        out[k] = _set(v, day, clock) if isinstance(v, dict) else f"{day}T{clock}" if low in ("datetimeoriginal", "timestamp", "location_time") else day if low == "originationdate" else clock if low == "originationtime" else v
    return out


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, data, day, clock) -> (name, data) with the metadata's start times set."""
    for b in batches:
        out = []
        for name, data, day, clock in zip(*(c.to_pylist() for c in b.columns)):
            md = riff.parse(data).metadata
            out.append((name, riff.rebuild(data, _set(md, day, clock)) if md else data))
        names, datas = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(datas, pa.binary())], names=["name", "data"])


def fix_timestamps(spark: SparkSession, source: str, target: str, start: str, dry_run: bool = False) -> DataFrame:
    """The new start and name of every file of a folder; unless it is a dry run the files are written to their folders below ``target``, the old ones stay."""
    riff_source.register(spark)
    files = spark.read.format("riff").option("view", "files").option("recording", "folder").load(source)
    plan = new_starts(files, start)
    if not dry_run:
        raw = spark.read.format("riff").option("view", "raw").load(source).select("path", "data")
        out = F.regexp_replace(riff_source.below(source, F.col("path")), r"[^/]*$", "")
        names = plan.select("path", F.concat(out, "new_name").alias("name"), "new_start")
        riff_source.check_names(names)
        rows = raw.join(names, "path").select("name", "data", F.date_format("new_start", "yyyy-MM-dd").alias("day"), F.date_format("new_start", "HH:mm:ss").alias("clock"))
        riff_source.write_recordings(rows.mapInArrow(_rewrite, "name string, data binary"), target)
    return plan
