"""Recordings as a Spark data source: ``spark.read.format("riff").option("view", ..).load(path)`` and back.

Views: samples, files, chunks, metadata, markers, and raw for whole files. A path is a file, a folder or a pattern, on a local disk or, as a
URI, on any file system that pyarrow knows. Files are those with a suffix of an available codec, see ``registry``; the first codec that can read one is taken.
Files are numbered by their sorted paths: each is a recording of its own, or, with option recording="folder", one file of its folder's
recording. Samples are read in ranges; the options recIds, startFrame and stopFrame decide which are read at all.
Tasks read the headers; only with recording="folder" does the driver, as a file's place depends on the lengths of those before it.
Metadata, markers and chunks are read without the samples.
(Spark 4.1 keeps pushed filters of a Python source for later queries on the same DataFrame, so these are options, not filters.)
"""

from __future__ import annotations

import glob
import os
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sonargrid.operators import blocks
from sonargrid.sources import registry, riff

SCHEMAS = {
    "samples": "rec_id bigint, channel int, frame bigint, x double",
    "files": "rec_id bigint, file_idx int, path string, format string, encoding string, rate double, channels int, frames bigint, start_index bigint, end_index bigint",
    "chunks": "rec_id bigint, file_idx int, ord int, tag string, pos bigint, size bigint",
    "metadata": "rec_id bigint, file_idx int, ord int, dict_ord int, path array<string>, key string, value string, vtype string, is_section boolean",
    "markers": "rec_id bigint, file_idx int, marker_id int, pos bigint, span bigint, label string, text string",
    "raw": "rec_id bigint, file_idx int, path string, data binary",
}
#: Frames read at once, bytes of samples and of small files in one input partition, and files in one.
RANGE, SPLIT, MANY = 1 << 18, 32 << 20, 256


def _file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path on it, what stood before the path)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/"), ""
    if "://" in path:
        system, at = pafs.FileSystem.from_uri(path)
        return system, at, path[: len(path) - len(at)] if path.endswith(at) else ""
    return pafs.LocalFileSystem(), path, ""


class RiffSource(DataSource):
    """The data source "riff"."""

    codecs: list[registry.Codec] = []

    @classmethod
    def name(cls) -> str:
        return "riff"

    def schema(self) -> str:
        view = self.options.get("view", "samples")
        if view not in SCHEMAS:
            raise ValueError(f"view must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[view]

    def reader(self, schema: StructType) -> RiffReader:
        return RiffReader(dict(self.options), self.codecs)

    def writer(self, schema: StructType, overwrite: bool) -> RiffWriter:
        return RiffWriter(dict(self.options), schema)


class Part(InputPartition):
    """Files (rec_id, file_idx, path, size, offset in the recording, start, stop) to read; start and stop are shares of the samples in 2**-30, or None for frames from offset on."""

    def __init__(self, files: list[tuple]) -> None:
        self.files = files


WHOLE = 1 << 30


class RiffReader(DataSourceReader):
    def __init__(self, options: dict, codecs: list[registry.Codec]) -> None:
        self.codecs = codecs
        self.view, self.path, self.folder = options.get("view", "samples"), options.get("path", ""), options.get("recording") == "folder"
        self.keep_empty = options.get("storeempty", "false").lower() == "true"
        self.recs = {int(r) for r in options["recids"].split(",")} if options.get("recids") else None
        self.low, self.high = int(options.get("startframe", 0)), int(options["stopframe"]) if options.get("stopframe") else None

    def _listed(self) -> list[tuple[str, int]]:
        """(path, size) of the files at the path, sorted."""
        system, at, before = _file_system(self.path)
        suffixes = tuple({x for c in self.codecs for x in c.suffixes})
        info = lambda paths: [(i.path, i.size) for i in system.get_file_info(paths) if i.type == pafs.FileType.File]
        if glob.has_magic(at):
            if isinstance(system, pafs.LocalFileSystem):
                found = info(glob.glob(at))
            else:
                root = at
                while glob.has_magic(root):
                    root = posixpath.dirname(root)
                found = [f for f in info(pafs.FileSelector(root, recursive=True)) if fnmatch(f[0], at)]
        elif system.get_file_info(at).type == pafs.FileType.Directory:
            found = [f for f in info(pafs.FileSelector(at, recursive=True)) if f[0].lower().endswith(suffixes)]
        else:
            found = info([at])
        if not found:
            raise FileNotFoundError(f"no file at {self.path!r}")
        return sorted((before + p, n) for p, n in found)

    def _files(self) -> list[tuple[int, int, str, int]]:
        found = self._listed()
        if not self.folder:
            return [(i, 0, p, n) for i, (p, n) in enumerate(found)]
        number = {d: i for i, d in enumerate(sorted({posixpath.dirname(p) for p, _ in found}))}
        count: Counter = Counter()
        out = []
        for p, n in found:
            rec = number[posixpath.dirname(p)]
            out.append((rec, count[rec], p, n))
            count[rec] += 1
        return out

    def _frames(self, path: str, size: int) -> int:
        with self._open(path) as f:
            return registry.opened(self.codecs, f, size, path)[1].frames

    @staticmethod
    def _open(path: str):
        system, at, _ = _file_system(path)
        return system.open_input_file(at)

    def partitions(self) -> list[Part]:
        files = [f for f in self._files() if self.recs is None or f[0] in self.recs]
        placed = []
        if self.folder and self.view in ("samples", "files"):
            with ThreadPoolExecutor(32) as pool:
                frames = list(pool.map(lambda f: self._frames(f[2], f[3]), files))
            offsets: Counter = Counter()
            for (rec, i, path, size), n in zip(files, frames):
                if self.view == "files" or (offsets[rec] + n > self.low and (self.high is None or offsets[rec] < self.high)):
                    placed.append((rec, i, path, size, offsets[rec]))
                offsets[rec] += n
        else:
            placed = [(*f, 0) for f in files]
        splits = {x for c in self.codecs if c.splits for x in c.suffixes} if self.view == "samples" else set()
        out, held, total = [], [], 0
        for f in placed:
            size = f[3] if self.view in ("samples", "raw") else 0
            n = -(-size // SPLIT) if f[2].lower().endswith(tuple(splits)) and size > SPLIT else 1
            if n > 1:
                out += [Part([(*f, WHOLE * k // n, WHOLE * (k + 1) // n)]) for k in range(n)]
                continue
            if held and (total + size > SPLIT or len(held) == MANY):
                out.append(Part(held))
                held, total = [], 0
            held.append((*f, 0, WHOLE))
            total += size
        return [*out, Part(held)] if held or not out else out

    def read(self, part: Part) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        for rec, i, path, size, offset, start, stop in part.files:
            with self._open(path) as f:
                yield from self._rows(f, rec, i, path, size, offset, start, stop)

    def _rows(self, f, rec: int, i: int, path: str, size: int, offset: int, start: int, stop: int) -> Iterator:
        if self.view == "raw":
            yield (rec, i, path, f.read())
            return
        if self.view in ("samples", "files"):
            codec, r, read = registry.opened(self.codecs, f, size, path)
            if self.view == "files":
                yield (rec, i, path, posixpath.splitext(path)[1][1:].upper().replace("WAVE", "WAV") if codec.name != "riff" else "WAV", r.encoding, r.rate, r.channels, r.frames, offset, offset + r.frames)
                return
            low = max(r.frames * start // WHOLE, self.low - offset)
            high = min(r.frames * stop // WHOLE, r.frames if self.high is None else self.high - offset)
            for at in range(low, high, RANGE):
                x = read(at, min(at + RANGE, high))
                frame = np.arange(at, at + len(x), dtype=np.int64) + offset
                for c in range(r.channels):
                    cols = [np.full(len(x), rec, np.int64), np.full(len(x), c, np.int32), frame, np.ascontiguousarray(x[:, c], np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in cols], names=["rec_id", "channel", "frame", "x"])
            return
        try:
            r = riff.parse(riff.FileBytes(f, size), self.keep_empty)
        except ValueError:
            if path.lower().endswith((".wav", ".wave")):
                raise
            return  # other formats have samples only
        if self.view == "chunks":
            yield from ((rec, i, k, *c) for k, c in enumerate(r.chunks))
        elif self.view == "metadata":
            yield from ((rec, i, *row) for row in riff.metadata_rows(r.metadata))
        else:
            yield from ((rec, i, k, *m) for k, m in enumerate(r.markers))


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class RiffWriter(DataSourceWriter):
    """Writes rows (name string, data binary), or (name, seq int, data) in order of name and seq, whose data follow each other in a file.

    Files get another name first and are renamed when all are there. A name may have folders; two files of the same name are an error, and nothing is renamed.
    """

    def __init__(self, options: dict, schema: StructType) -> None:
        if schema.fieldNames() not in (["name", "data"], ["name", "seq", "data"]):
            raise ValueError("rows must be (name, data) or (name, seq, data); use write_recordings")
        self.parts = len(schema.fieldNames()) == 3
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, at, _ = _file_system(self.path)
        system.create_dir(at, recursive=True)
        done, out, before = [], None, (None, -1)
        for row in rows:
            here = (row.name, row.seq if self.parts else 0)
            if out is None or here[0] != before[0] or not self.parts:
                name = posixpath.normpath(row.name)
                if posixpath.isabs(name) or name.split("/")[0] == "..":
                    raise ValueError(f"{row.name!r} is outside of the target")
                if out:
                    out.close()
                new = posixpath.join(at, f".{self.job}-{uuid.uuid4().hex}.part")
                out = system.open_output_stream(new)
                done.append((new, posixpath.join(at, name)))
                before = (row.name, -1)
            if here[1] != before[1] + 1:
                raise ValueError(f"{row.name!r} comes in no order")
            out.write(row.data)
            before = here if self.parts else (None, -1)
        if out:
            out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        if twice := [name for name, n in Counter(final for _, final in files).items() if n > 1]:
            raise ValueError(f"several outputs are named {min(twice)!r}")
        system, _, _ = _file_system(self.path)
        for folder in {posixpath.dirname(final) for _, final in files}:
            system.create_dir(folder, recursive=True)
        for new, final in files:
            system.move(new, final)

    def abort(self, messages: list) -> None:
        system, _, _ = _file_system(self.path)
        for m in messages:
            for new, _ in m.files if m else []:
                if system.get_file_info(new).type == pafs.FileType.File:
                    system.delete_file(new)


def register(spark: SparkSession) -> None:
    """Make the format "riff" known to a session, with the codecs that the registry has now."""
    spark.dataSource.register(type("RiffSource", (RiffSource,), {"codecs": registry.decoders()}))


def below(source: str, path: Column) -> Column:
    """Paths of files that a reader finds at ``source``, from its folder, or from the last folder before a pattern."""
    system, at, before = _file_system(source)
    root = at
    while system.get_file_info(root).type != pafs.FileType.Directory and (root == at or glob.has_magic(root)):
        root = posixpath.dirname(root) or "."
    root = before + root
    return F.udf(lambda p: os.path.relpath(p, root) if "://" not in root else p[len(root) :].lstrip("/"), "string")(path)


def check_names(names: DataFrame) -> None:
    """ValueError if two outputs have the same ``name``."""
    twice = names.groupBy("name").count().where("count > 1").agg(F.min("name")).first()[0]
    if twice is not None:
        raise ValueError(f"several outputs are named {twice!r}")


def _encode_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, encoding, channels, frames, block, held) -> (name, seq, data): a block of all channels, missing samples and nulls 0."""
    for b in batches:
        for i in range(b.num_rows):
            name, encoding, channels, frames, block = (b.column(c)[i].as_py() for c in range(5))
            data = np.zeros((min(blocks.FRAMES, frames - block * blocks.FRAMES), channels))
            held = b.column(5)[i]
            if held.is_valid:
                for k, c in enumerate(held.values.field("channel").to_pylist()):
                    at, x = blocks.merged(held.values.field("parts")[k].values)
                    data[at, c] = np.nan_to_num(x)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block + 1], pa.int32()), pa.array([riff.encode(data, encoding)], pa.binary())], names=["name", "seq", "data"])


def _frame_kernel(hint: str):
    """(name, rate, encoding, channels, frames, last, md, mk) -> (name, seq, data): what comes before and after the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, rate, encoding, channels, frames, last = (b.column(c)[i].as_py() for c in range(6))
                meta = riff.metadata_dict([(m["ord"], m["path"] or [], m["key"], m["value"], bool(m["is_section"])) for m in b.column(6)[i].as_py() or []])
                marks = [(m["pos"], m["span"] or 0, m["label"], m["text"]) for m in b.column(7)[i].as_py() or [] if m["pos"] is not None and m["pos"] >= 0]
                head, tail = riff.frame_of(frames, channels, rate, encoding, meta, marks, hint)
                yield pa.RecordBatch.from_arrays([pa.array([name, name]), pa.array([0, last + 2], pa.int32()), pa.array([head, tail], pa.binary())], names=["name", "seq", "data"])

    return run


def to_files(samples: DataFrame, rates: DataFrame, metadata: DataFrame | None = None, markers: DataFrame | None = None, encoding: str = "PCM_16", hint: str = "cue") -> DataFrame:
    """(name, seq, data): a RIFF file for each recording, in parts that follow each other: a head, blocks of 2**16 frames, a tail.

    ``rates`` has rec_id, rate and optionally name and encoding; missing samples are 0. A task holds one block of all channels, or the metadata and markers of
    one recording; a file is written part after part, and an error if it exceeds 4 GB. Frames before 0 are left out.
    """
    spark = samples.sparkSession
    if encoding not in riff.ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    samples = samples.where("frame >= 0")
    empty = lambda schema: spark.createDataFrame([], schema)
    md = metadata if metadata is not None else empty("rec_id bigint, ord int, path array<string>, key string, value string, is_section boolean")
    mk = markers if markers is not None else empty("rec_id bigint, pos bigint, span bigint, label string, text string")
    md = md.groupBy("rec_id").agg(F.collect_list(F.struct("ord", "path", "key", "value", "is_section")).alias("md"))
    mk = mk.groupBy("rec_id").agg(F.collect_list(F.struct("pos", "span", "label", "text")).alias("mk"))
    name = F.col("name") if "name" in rates.columns else F.format_string("rec%06d.wav", "rec_id")
    kind = F.coalesce("encoding", F.lit(encoding)) if "encoding" in rates.columns else F.lit(encoding)
    about = rates.select("rec_id", F.col("rate").cast("double").alias("rate"), name.alias("name"), kind.alias("encoding")).dropDuplicates(["rec_id"])
    size = samples.groupBy("rec_id").agg((F.max("frame") + 1).alias("frames"), (F.max("channel") + 1).alias("channels"))
    about = about.join(size, "rec_id").withColumn("last", F.shiftright(F.col("frames") - 1, blocks.BITS).cast("int"))
    ends = about.join(md, "rec_id", "left").join(mk, "rec_id", "left").select("name", "rate", "encoding", "channels", "frames", "last", "md", "mk")
    schema = "name string, seq int, data binary"
    grid = about.select("rec_id", "name", "encoding", "channels", "frames", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("block"))
    held = blocks.gathered(samples).groupBy("rec_id", "block").agg(F.collect_list(F.struct("channel", "parts")).alias("held"))
    data = grid.join(held, ["rec_id", "block"], "left").select("name", "encoding", "channels", "frames", "block", "held").mapInArrow(_encode_kernel, schema)
    return ends.mapInArrow(_frame_kernel(hint), schema).unionByName(data)


def write_recordings(files: DataFrame, path: str) -> None:
    """Write rows (name, data), or (name, seq, data) as ``to_files`` makes them, as files; every file by one task, part after part."""
    register(files.sparkSession)
    if "seq" in files.columns:
        files = files.select("name", "seq", "data").repartition("name").sortWithinPartitions("name", "seq")
    files.write.format("riff").mode("append").save(path)
