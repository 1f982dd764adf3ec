"""Command line: ``python -m sonargrid.cli convert|metadata|fixtime|formats ..``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sonargrid.operators import metadata as meta
from sonargrid.operators import recordings as rec
from sonargrid.plans.convert import Conversion, convert
from sonargrid.plans.fixtime import fix_timestamps
from sonargrid.sources import registry, riff, riff_source


def channel_list(text: str) -> list[int]:
    """Channels of a list such as "0-2,5"."""
    out: list[int] = []
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        out += range(int(low), int(high if dash else low) + 1)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sonargrid")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="change and write recordings")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("-c", "--channels", type=channel_list, default=[])
    c.add_argument("-s", "--scale", type=float, default=1.0)
    c.add_argument("-u", "--unwrap", type=float, default=0.0, nargs="?", const=1.5, help="threshold, 1.5 if none is given; halves the result")
    c.add_argument("-U", "--unwrap-clip", type=float, default=0.0, nargs="?", const=1.5, help="threshold; clips the result")
    c.add_argument("-d", "--decimate", type=int, default=1)
    c.add_argument("-a", "--add", action="append", default=[], metavar="KEY=VALUE")
    c.add_argument("-r", "--remove", action="append", default=[], metavar="KEY")
    c.add_argument("-n", "--merge", type=int, default=0, help="files per output, 0 for all of a folder")
    c.add_argument("-f", "--folders", action="store_true", help="the files of a folder are one recording")
    c.add_argument("-m", "--mode", default="strict", choices=["strict", "relaxed"], help="whether files of a recording must have start times")
    c.add_argument("-g", "--max-gap", type=float, default=1.0, help="seconds that a file may start off the end of the one before")
    c.add_argument("-e", "--encoding", choices=registry.encodings("WAV"), help="default: that of the source")
    c.add_argument("-o", "--name", default="", help="name of outputs, with keys of the metadata in braces")
    m = sub.add_parser("metadata", help="print metadata, markers or chunks")
    m.add_argument("source")
    m.add_argument("-v", "--view", default="metadata", choices=["files", "metadata", "markers", "chunks"])
    t = sub.add_parser("fixtime", help="set start times of consecutive files")
    t.add_argument("source")
    t.add_argument("target")
    t.add_argument("-s", "--start", required=True)
    t.add_argument("-n", "--dry-run", action="store_true")
    d = sub.add_parser("demo", help="write a recording with two tones, metadata and markers")
    d.add_argument("target")
    d.add_argument("-c", "--channels", type=int, default=2)
    d.add_argument("-e", "--encoding", default="PCM_16", choices=registry.encodings("WAV"))
    f = sub.add_parser("formats", help="list formats, or the encodings of one")
    f.add_argument("format", nargs="?")
    return p


def demo(spark: SparkSession, target: str, channels: int = 2, encoding: str = "PCM_16") -> None:
    """Write demo.wav: a second of 880 Hz that swells, each channel quieter than the one before, with metadata and two markers."""
    rate, n = 44100.0, 44100
    frames = spark.range(n).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    x = F.sin(F.col("id") * (2 * 3.141592653589793 * 880 / rate)) * F.col("id") / n / (F.col("channel") + 1)
    samples = frames.select(F.lit(0).cast("bigint").alias("rec_id"), "channel", F.col("id").alias("frame"), x.alias("x"))
    md = spark.createDataFrame([(0, *row) for row in riff.metadata_rows({"INFO": {"Title": "demo", "Software": "sonargrid"}})], "rec_id bigint, ord int, dict_ord int, path array<string>, key string, value string, vtype string, is_section boolean")
    marks = spark.createDataFrame([(0, n // 4, 0, "start", None), (0, n // 2, n // 4, "loud", "above half")], "rec_id bigint, pos bigint, span bigint, label string, text string")
    rates = spark.createDataFrame([(0, rate, "demo.wav")], "rec_id bigint, rate double, name string")
    riff_source.write_recordings(riff_source.to_files(samples, rates, md, marks, encoding), target)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "formats":
        print("\n".join(registry.encodings(a.format) if a.format else registry.formats()))
        return
    spark = SparkSession.builder.appName("sonargrid").getOrCreate()
    if a.command == "demo":
        demo(spark, a.target, a.channels, a.encoding)
        return
    if a.command == "convert":
        mode = "clip" if a.unwrap_clip else "halve"
        c = Conversion(a.channels, a.scale, a.unwrap_clip or a.unwrap, mode, decimate=a.decimate, name=a.name, add=dict(x.split("=", 1) for x in a.add), remove=a.remove)
        convert(spark, a.source, a.target, c, a.encoding, a.merge, a.folders, mode=a.mode, max_gap_s=a.max_gap)
    elif a.command == "fixtime":
        for r in fix_timestamps(spark, a.source, a.target, a.start, a.dry_run).orderBy("path").toLocalIterator():
            print(r.name, "->", r.new_name, r.new_start)
    else:
        riff_source.register(spark)
        d = spark.read.format("riff").option("view", a.view).load(a.source)
        if a.view == "metadata":
            d = meta.as_text(d).orderBy("rec_id", "ord").select("line")
        elif a.view == "markers":
            d = rec.marker_table(d).orderBy("rec_id", "marker_id").select("line")
        for r in d.toLocalIterator():
            print(*r)


if __name__ == "__main__":
    main()
