import io
import struct
import wave

import numpy as np
import pytest
from conftest import rows

from sonargrid.sources import registry, riff, riff_source

MD = {"INFO": {"Software": "s", "Gain": "20mV", "Title": "Käuzchen"}, "BEXT": {"Description": "d" * 300, "OriginationDate": "2024-01-02", "TimeReference": 5, "LoudnessValue": 3}, "IXML": {"PROJECT": "p", "NOTE": {"A": "b"}}, "Free": {"a b": "1", "c": {"d": "x\ny"}}}
MARKS = [(5, 3, "a", "AAA"), (2, 0, "b", None), (300, 10, None, "x"), (400, 0, None, None)]


def ramp(n=500, channels=2):
    t = np.arange(n) / 8000
    x = np.sin(2 * np.pi * 880 * t) * t / t[-1]
    return np.stack([x / (c + 1) for c in range(channels)], 1)


@pytest.mark.parametrize("encoding", list(riff.ENCODINGS))
@pytest.mark.parametrize("channels", [1, 2, 16])
def test_round_trip(encoding, channels):
    x = ramp(200, channels)
    raw = riff.build(x, 8000, encoding, MD, MARKS)
    r = riff.parse(raw)
    assert (r.encoding, r.channels, r.rate, r.frames) == (encoding, channels, 8000.0, 200) and len(raw) % 2 == 0
    assert np.abs(riff.samples(raw, r) - x).max() < {"PCM_U8": 0.01, "PCM_16": 2**-15}.get(encoding, 1e-6)
    assert np.array_equal(riff.samples(raw, r, 10, 25), riff.samples(raw, r)[10:25])


@pytest.mark.parametrize(("encoding", "dtype", "scale"), [("PCM_16", "<i2", 32768), ("PCM_32", "<i4", 2**31)])
def test_samples_equal_the_standard_library(encoding, dtype, scale):
    raw = riff.build(ramp(), 8000, encoding)
    w = wave.open(io.BytesIO(raw))
    assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (2, 8000, 500)
    theirs = np.frombuffer(w.readframes(500), dtype).reshape(-1, 2) / scale
    assert np.array_equal(theirs, riff.samples(raw, riff.parse(raw)))


def test_metadata_and_markers():
    r = riff.parse(riff.build(ramp(), 8000, md=MD, markers=MARKS))
    assert r.metadata["INFO"] == MD["INFO"] and r.metadata["IXML"] == MD["IXML"] and r.metadata["Free"] == MD["Free"]
    assert r.metadata["BEXT"] == MD["BEXT"] | {"Description": "d" * 256}
    assert r.markers == [(2, 0, "b", None), (5, 3, "a", "AAA"), (300, 10, None, "x"), (400, 0, None, None)]
    lbl = riff.parse(riff.build(ramp(), 8000, markers=[(80, 8, "M", "t"), (8, 8, "a", "t")], hint="lbl"))
    assert lbl.markers == [(8, 0, "a", "t"), (80, 8, "M", "t")]
    with pytest.raises(ValueError):
        riff.build(ramp(), 8000, markers=MARKS, hint="x")


def test_rebuild_keeps_samples():
    raw = riff.build(ramp(), 8000, md=MD, markers=MARKS)
    new = riff.rebuild(raw, {"INFO": {"Title": "n"}}, [(1, 1, "z", None)])
    r = riff.parse(new)
    assert r.metadata == {"INFO": {"Title": "n"}} and r.markers == [(1, 1, "z", None)] and np.array_equal(riff.samples(new, r), riff.samples(raw, riff.parse(raw)))


def test_saturation_and_bad_files():
    x = np.array([[1.0], [-1.0], [1.5], [-1.5], [np.nan]])
    raw = riff.build(x, 8000)
    assert np.allclose(riff.samples(raw, riff.parse(raw))[:, 0], [1 - 2**-15, -1, 1 - 2**-15, -1, 0])
    for bad in (b"", b"XYZ!", b"RIFF"):
        with pytest.raises(ValueError):
            riff.parse(bad)
    assert riff.parse(b"RIFF\x04\0\0\0WAVE").frames == 0
    with pytest.raises(ValueError):
        riff.build(x, 8000, "MP3")
    twice = b"WAVE" + b"LIST" + struct.pack("<I", 16) + b"INFOINAM" + struct.pack("<I", 3) + b"ab\0\0" + b"LIST" + struct.pack("<I", 16) + b"INFOINAM" + struct.pack("<I", 3) + b"cd\0\0"
    assert riff.parse(b"RIFF" + struct.pack("<I", len(twice)) + twice).metadata == {"INFO": {"Title": "cd"}}


def test_source(spark, tmp_path):
    riff_source.register(spark)
    x = ramp(3000)
    for i in range(3):
        (tmp_path / f"r-{i}.wav").write_bytes(riff.build(x[i * 1000 : i * 1000 + 1000], 8000, md=MD if i == 0 else {}, markers=MARKS[:1]))
    read = lambda v, **o: spark.read.format("riff").options(view=v, **o).load(str(tmp_path))
    assert [r[2:] for r in rows(read("files", recording="folder").drop("path", "format", "encoding"))] == [(8000.0, 2, 1000, i * 1000, i * 1000 + 1000) for i in range(3)]
    s = read("samples", recording="folder")
    part = read("samples", recording="folder", startFrame=990, stopFrame=1010)
    assert part.count() == 40 and read("samples", recIds="1,2").select("rec_id").distinct().count() == 2
    got = rows(s.where("frame >= 990 AND frame < 1010 AND channel = 1"))
    assert rows(part.where("channel = 1")) == got
    assert [r[2] for r in got] == sorted(range(990, 1010), key=lambda f: repr(got[0][:2] + (f,))) and s.where("rec_id = 7").count() == 0
    assert np.allclose([r[3] for r in sorted(got, key=lambda r: r[2])], x[990:1010, 1], atol=2**-15)
    assert s.count() == 6000 and read("markers").count() == 3 and read("chunks").where("tag = 'DATA'").count() == 3
    assert read("metadata").where("key = 'PROJECT'").count() == 1
    with pytest.raises(Exception, match="no file"):
        spark.read.format("riff").load(str(tmp_path / "none")).count()


def test_sink(spark, tmp_path):
    x = ramp(300)
    s = spark.createDataFrame([(1, c, f, float(x[f, c])) for c in range(2) for f in range(300) if f != 7] + [(1, 0, 7, None)], "rec_id bigint, channel int, frame bigint, x double")
    rates = spark.createDataFrame([(1, 8000.0), (1, 8000.0)], "rec_id bigint, rate double")
    md = spark.createDataFrame([(1, *r) for r in riff.metadata_rows(MD)], "rec_id bigint, ord int, dict_ord int, path array<string>, key string, value string, vtype string, is_section boolean")
    mk = spark.createDataFrame([(1, 5, 3, "a", None), (1, None, 3, "a", None)], "rec_id bigint, pos bigint, span bigint, label string, text string")
    riff_source.write_recordings(riff_source.to_files(s, rates, md, mk), str(tmp_path / "out"))
    raw = (tmp_path / "out" / "rec000001.wav").read_bytes()
    r = riff.parse(raw)
    y = riff.samples(raw, r)
    assert r.markers == [(5, 3, "a", None)] and r.metadata["Free"] == MD["Free"] and (y[7] == 0).all() and np.abs(np.delete(y - x, 7, 0)).max() < 2**-14
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["rec000001.wav"]


def test_registry():
    registry.register("none", ["XYZ"], ["MPEG"], lambda: False)
    try:
        there = registry.installed()
        assert there[:2] == ["riff", "wave"] and {"WAV", "WAVEX"} <= set(registry.formats()) and registry.encodings("wav")[0] == "PCM_U8" and registry.encodings("XYZ") == [] and "none" in registry.unavailable()
        registry.disable("riff")
        assert "riff" not in registry.available() and registry.installed() == there
        registry.enable()
        assert registry.select("riff") and not registry.select("x") and registry.available() == ["riff"]
    finally:
        registry.enable()
        registry.remove("none")


def test_codecs_are_tried_in_order(spark, tmp_path):
    def text_codec(file, size, path):
        """Numbers in lines, a toy format of this test."""
        lines = file.read().decode().split()
        if lines[0] != "numbers":
            raise ValueError("no numbers")
        x = np.array(lines[1:], float)[:, None]
        return riff.Riff(channels=1, rate=10.0, encoding="TEXT", frames=len(x)), lambda a, b: x[a:b]

    (tmp_path / "a.num").write_text("numbers 1 2 3")
    (tmp_path / "b.wav").write_bytes(riff.build(np.full((2, 1), 0.5), 8000))
    registry.register("text", ["NUM"], ["TEXT"], suffixes=(".num",), decoder=text_codec)
    try:
        riff_source.register(spark)
        load = lambda v, **o: rows(spark.read.format("riff").option("view", v).options(**o).load(str(tmp_path)))
        assert load("samples") == [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 0, 2, 3.0), (1, 0, 0, 0.5), (1, 0, 1, 0.5)]
        assert [r[3:6] for r in load("files")] == [("NUM", "TEXT", 10.0), ("WAV", "PCM_16", 8000.0)] and load("metadata") == []
        assert load("samples", recording="folder", startFrame=2, stopFrame=4) == [(0, 0, 2, 3.0), (0, 0, 3, 0.5)]
        (tmp_path / "c.num").write_text("letters")
        with pytest.raises(Exception, match="text: no numbers"):
            load("samples")
        registry.select("wave")  # the standard library reads the second one
        riff_source.register(spark)
        assert load("samples") == [(0, 0, 0, 0.5), (0, 0, 1, 0.5)]
    finally:
        registry.enable()
        registry.remove("text")
        riff_source.register(spark)


def test_empty_and_missing_files(spark, tmp_path):
    riff_source.register(spark)
    (tmp_path / "e.wav").write_bytes(b"")
    with pytest.raises(Exception, match="is empty"):
        spark.read.format("riff").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no file at"):
        spark.read.format("riff").load(str(tmp_path / "x.wav")).collect()


def test_files_in_ranges_and_parts(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (200_000, 2))
    x[70_000:140_000] = 0
    data = [(7, c, f, float(x[f, c])) for c in range(2) for f in [*range(0, 200, 7), *range(140_000, 200_000, 1000), 199_999]]
    want = np.zeros_like(x)
    for _, c, f, v in data:
        want[f, c] = v
    df, rates = spark.createDataFrame(data, "rec_id bigint, channel int, frame bigint, x double"), spark.createDataFrame([(7, 8000.0, "d/n.wav", "DOUBLE")], "rec_id bigint, rate double, name string, encoding string")
    riff_source.write_recordings(riff_source.to_files(df, rates, markers=spark.createDataFrame([(7, 5, 1, "сова", "’œ€")], "rec_id bigint, pos bigint, span bigint, label string, text string")), str(tmp_path))
    raw = (tmp_path / "d" / "n.wav").read_bytes()
    r = riff.parse(raw)
    assert np.array_equal(riff.samples(raw, r), want) and r.markers == [(5, 1, "сова", "’œ€")] and len(raw) == 8 + int.from_bytes(raw[4:8], "little")
    monkeypatch.setattr(riff_source, "SPLIT", 300_000)
    monkeypatch.setattr(riff_source, "RANGE", 10_000)
    reader = riff_source.RiffReader({"path": f"file://{tmp_path}"}, registry.decoders())
    parts = reader.partitions()
    got = np.zeros_like(x)
    n = 0
    for p in parts:
        for b in reader.read(p):
            got[b.column(2).to_numpy(), b.column(1).to_numpy()] = b.column(3).to_numpy()
            n += b.num_rows
    assert len(parts) == -(-len(raw) // 300_000) and n == 400_000 and np.array_equal(got, want)
    with pytest.raises(ValueError, match="4 GB"):
        riff.frame_of(1 << 30, 2, 8000, "PCM_16")


def test_metadata_of_any_alphabet():
    md = {"INFO": {"Title": "œ’€", "Artist": "Käuz"}, "BEXT": {"Description": "сова"}, "Free": {"名": "ふくろう"}}
    r = riff.parse(riff.build(ramp(), 8000, md=md, markers=[(1, 0, "сова", "ふくろう"), (2, 0, "Ã©", "œ’")]))
    r.metadata.pop("GUANO")
    assert r.metadata == md and r.markers == [(1, 0, "сова", "ふくろう"), (2, 0, "Ã©", "œ’")]
    (m,) = riff.parse(riff.build(ramp(), 8000, markers=[(80, 8, "M", "сова" * 30)], hint="lbl")).markers
    assert m[:3] == (80, 8, "M") and ("сова" * 30).startswith(m[3]) and len(m[3]) > 15


@pytest.mark.parametrize("view", ["files", "samples"])
def test_unknown_encodings_are_refused(spark, tmp_path, view):
    riff_source.register(spark)
    raw = bytearray(riff.build(np.zeros((10, 1)), 8000, "PCM_U8"))
    raw[20:22] = (6).to_bytes(2, "little")  # A-law
    (tmp_path / "a.wav").write_bytes(raw)
    with pytest.raises(Exception, match="no known encoding"):
        spark.read.format("riff").option("view", view).load(str(tmp_path)).collect()
