from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sonargrid.functions import quantities, texts
from sonargrid.operators import metadata as meta
from sonargrid.sources import riff

MD = {"Title": "top", "INFO": {"Gain": "1.4mV/V", "Software": "s", "DateTimeOriginal": "2024-01-01T23:59:50"}, "Recording": {"Title": "deep", "Sub": {"Gain": "2 V", "Flag": "yes", "Count": "42"}},
      "BEXT": {"OriginationDate": "2024-01-01", "OriginationTime": "23:59:50", "TimeReference": "100", "CodingHistory": "A=PCM"}, "Empty": {}}
SCHEMA = "rec_id bigint, ord int, dict_ord int, path array<string>, key string, value string, vtype string, is_section boolean"


@pytest.fixture(scope="module")
def m(spark):
    return spark.createDataFrame([(1, *r) for r in riff.metadata_rows(MD)] + [(2, 0, 0, [], "gain", None, "str", False)], SCHEMA).cache()


def values(df):
    return {r.key: r.value for r in df.where("rec_id = 1").collect()}


def test_flatten_and_back(m):
    flat = meta.flatten(m, True)
    assert values(flat)["Recording.Sub.Gain"] == "2 V" and values(meta.flatten(m))["Title"] == "deep"
    back = {("/".join(r.path), r.key): r.value for r in meta.unflatten(flat).where("rec_id = 1").collect()}
    assert back["Recording/Sub", "Flag"] == "yes" and back["", "Title"] == "top"
    assert riff.metadata_dict([(o, p, k, v, s) for o, _, p, k, v, _, s in riff.metadata_rows(MD)]) == MD


def test_find(m):
    one = lambda k: [r[4] for r in rows(meta.find(m, k)) if r[0] == 1]
    assert one("title") == ["top"] and one("gain") == ["1.4mV/V"] and one("Recording.Title") == ["deep"] and one("recording.sub.GAIN") == ["2 V"]
    assert one("nothing") == [] and one("INFO.Flag") == [] and one("sub.count") == ["42"]


def test_typed_lookups(m):
    first = lambda df: [tuple(r)[1:] for r in df.where("rec_id = 1").collect()]
    assert first(meta.get_number_unit(m, ["x", "gain"])) == [(1.4, "mV/V")]
    assert first(meta.get_number(m, "mV", ["Recording.Sub.Gain"])) == [(2000.0,)]
    assert first(meta.get_int(m, ["gain", "count"])) == [(42,)] and first(meta.get_bool(m, ["count", "flag"])) == [(True,)] and first(meta.get_str(m, ["x", "software"])) == [("s",)]
    assert first(meta.get_datetime(m)) == [(datetime(2024, 1, 1, 23, 59, 50),)]


def test_updates(m):
    assert values(meta.set_values(m, {"software": "n", "no": "x"}))["Software"] == "n"
    added = meta.add_values(m, {"INFO.Artist": "a", "Title": "b"})
    assert values(added)["Artist"] == "a" and added.where("rec_id = 2 AND key IN ('Artist', 'Title')").count() == 2
    assert not {"BEXT", "TimeReference"} & set(values(meta.remove(m, ["bext"])))
    assert "Empty" not in values(meta.cleanup(m)) and "INFO" in values(meta.cleanup(m))
    moved = meta.move(m, "Software", "Soft", "Name").where("key = 'Name'").collect()
    assert [(r.path, r.value) for r in moved] == [(["Soft"], "s")]
    assert values(meta.update_gain(m.where("dict_ord < 2"), 2.0))["Gain"] == "0.70mV"
    assert values(meta.add_unwrap(m, 1.5, 1.0, "V"))["UnwrapThreshold"] == "1.50V"
    assert values(meta.add_history(m, "A=X"))["CodingHistory"] == "A=PCM\r\nA=X"


def test_start_times_move_together(m):
    v = values(meta.update_starttime(m, 20.5, 100.0))
    assert (v["DateTimeOriginal"], v["OriginationDate"], v["OriginationTime"], v["TimeReference"]) == ("2024-01-02T00:00:10", "2024-01-02", "00:00:10", "2150")
    v = values(meta.set_starttime(m, "2025-02-03T04:05:06"))
    assert (v["DateTimeOriginal"], v["OriginationDate"], v["OriginationTime"]) == ("2025-02-03T04:05:06", "2025-02-03", "04:05:06")


def test_text(m):
    lines = [r.line for r in meta.as_text(m).where("rec_id = 1").orderBy("ord").collect()]
    assert lines[:3] == ["Title: top", "INFO:", "    Gain            : 1.4mV/V"]


def test_numbers_and_units(spark):
    cases = {"42": (42.0, True, "", 0), "42ms": (42.0, True, "ms", 0), "42.3 ms": (42.3, False, "ms", 1), "42.32.ms": (42.32, False, ".ms", 2), "": (None, False, "", 0), "x": (None, False, "x", 0), "4-2": (None, False, "4-2", 0), "-": (None, False, "-", 0), "-1.5e": (-1.5, False, "e", 1)}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r.s: r.q and tuple(r.q) for r in df.select("s", quantities.parse_number(F.col("s")).alias("q")).collect()}
    assert got == cases | {None: None}
    units = [(5.0, "mm", "cm", 0.5), (5.0, "", "cm", 5.0), (5.0, "mm", "", 5.0), (5.0, "cm", "mm", 50.0), (4.0, "kg", "g", 4000.0), (12.0, "%", "", 0.12), (1.24, "", "%", 124.0), (2.5, "min", "s", 150.0), (3600.0, "s", "h", 1.0), (1.0, "Pa", "Pa", 1.0), (1.0, "mum", "m", 1e-6), (1.0, None, "V", 1.0), (3.0, "m", "mm", 3000.0)]
    df = spark.createDataFrame(units, "v double, a string, b string, w double")
    assert all(abs(r.g - r.w) < 1e-9 for r in df.select("w", quantities.change_unit(F.col("v"), F.col("a"), F.col("b")).alias("g")).collect())


def test_texts(spark):
    df = spark.createDataFrame([("r-2024-01-02T03:04:05.wav",), ("20240102xx030405",), ("20240102",), ("at 03:04:05",), ("none",), ("",), (None,), ("2024-19-39",)], "s string")
    got = [r[0] for r in df.select(texts.parse_datetime(F.col("s"))).collect()]
    d = datetime(2024, 1, 2, 3, 4, 5)
    assert got == [d, d, datetime(2024, 1, 2), datetime(1, 1, 1, 3, 4, 5), None, None, None, None]
    new = F.lit(datetime(2025, 6, 7, 8, 9, 10)).cast("timestamp_ntz")
    assert [r[0] for r in df.select(texts.replace_datetime(F.col("s"), new)).collect()][:3] == ["r-2025-06-07T08:09:10.wav", "20250607xx080910", "20250607"]
    one = lambda c, v: spark.createDataFrame([(v,)], "s string").select(c(F.col("s"))).first()[0]
    assert round(one(texts.note2freq, "a4"), 6) == 440 and round(one(texts.note2freq, "c#4"), 1) == 277.2 and round(one(texts.note2freq, "db4"), 1) == 277.2
    assert [one(texts.note2freq, v) for v in ("h", "da", "d4#", "d-2", "", None)] == [None] * 6
    assert one(texts.parse_channels, "0-2,5,x") == [0, 1, 2, 5] and one(texts.key_values, "a = 1, b=2,c, a=3") == {"a": "3", "b": "2"}
    assert one(texts.format_from_extension, "/x/a.wave") == "WAV" and one(texts.format_from_extension, "/x/a.mpeg3") == "MP3" and one(texts.format_from_extension, "/x.y/a") is None
    assert one(lambda c: texts.history(c, F.lit(44100.0), F.lit(2), F.lit("t")), "PCM_U8") == "A=PCM,F=44100,W=8,M=stereo,T=t"
    assert one(lambda c: texts.fill_name(c, F.create_map(F.lit("Title"), F.lit("a b")), ["Title", "No"]), "{Title}-{No}.wav") == "a_b-{No}.wav"


def test_empty(m):
    e = m.limit(0)
    for op in (meta.flatten, meta.cleanup, meta.as_text, lambda d: meta.find(d, "a.b"), lambda d: meta.add_values(d, {"a": "b"}), lambda d: meta.update_gain(d, 2.0), lambda d: meta.update_starttime(d, 1.0, 1.0), lambda d: meta.remove(d, ["a"])):
        assert op(e).count() == 0
