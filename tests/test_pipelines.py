import shutil

import numpy as np
import pytest
from conftest import rows

from sonargrid import cli
from sonargrid.plans.convert import Conversion, convert
from sonargrid.plans.fixtime import fix_timestamps
from sonargrid.sources import riff, riff_source


def tone(n, rate=8000):
    t = np.arange(n) / rate
    return np.stack([0.5 * np.sin(2 * np.pi * 100 * t), 0.25 * np.cos(2 * np.pi * 50 * t)], 1)


@pytest.fixture
def folder(tmp_path):
    x = tone(4000)
    d = tmp_path / "in"
    d.mkdir()
    for i in range(4):
        md = {"INFO": {"DateTimeOriginal": f"2019-01-01T00:00:0{i}", "Gain": "20mV", "Title": "t"}, "BEXT": {"CodingHistory": "A=PCM", "OriginationDate": "2019-01-01", "OriginationTime": "00:00:00"}}
        (d / f"test-2019-01-01T00:00:0{i}.wav").write_bytes(riff.build(x[i * 1000 : i * 1000 + 1000], 8000, md=md, markers=[(10 * i, 5, f"m{i}", None)]))
    return d


def read(path):
    raw = path.read_bytes()
    r = riff.parse(raw)
    return r, riff.samples(raw, r)


def test_merge_and_split(spark, folder, tmp_path):
    convert(spark, str(folder), str(tmp_path / "one"), Conversion(), folders=True)
    (path,) = (tmp_path / "one").iterdir()
    r, x = read(path)
    assert r.frames == 4000 and np.abs(x - tone(4000)).max() < 2**-14 and r.markers == [(1010 * i, 5, f"m{i}", None) for i in range(4)]
    assert r.metadata["INFO"]["Title"] == "t" and r.metadata["BEXT"]["CodingHistory"].splitlines()[1].startswith("A=PCM,F=8000,W=16,M=stereo")
    convert(spark, str(folder), str(tmp_path / "two"), Conversion(), folders=True, merge=2)
    parts = sorted((tmp_path / "two").iterdir())
    assert [read(p)[0].frames for p in parts] == [2000, 2000] and read(parts[1])[0].markers[1] == (1030, 5, "m3", None)


def test_changes(spark, folder, tmp_path):
    c = Conversion(channels=[1], scale=2.0, decimate=2, add={"INFO.Artist": "a"}, remove=["Title"])
    convert(spark, str(folder), str(tmp_path / "out"), c, encoding="FLOAT", folders=True)
    (path,) = (tmp_path / "out").iterdir()
    r, x = read(path)
    assert (r.channels, r.rate, r.frames, r.encoding) == (1, 4000.0, 2000, "FLOAT") and np.abs(x[:, 0] - 2 * tone(4000)[::2, 1])[50:-50].max() < 0.01
    assert r.metadata["INFO"]["Gain"] == "10.0mV" and r.metadata["INFO"]["Artist"] == "a" and "Title" not in r.metadata["INFO"] and r.markers[1] == (505, 2, "m1", None)


def test_unwrap(spark, tmp_path):
    y = 1.5 * np.sin(2 * np.pi * 20 * np.arange(2000) / 8000)
    d = tmp_path / "in"
    d.mkdir()
    (d / "w.wav").write_bytes(riff.build((y - 2 * np.floor((y + 1) / 2))[:, None], 8000, "DOUBLE", {"INFO": {"Gain": "20mV"}}))
    convert(spark, str(d), str(tmp_path / "out"), Conversion(unwrap=1.5, unwrap_mode="halve"), encoding="DOUBLE")
    r, x = read(tmp_path / "out" / "w.wav")
    assert np.allclose(2 * x[:, 0], y) and r.metadata["INFO"]["Gain"] == "40.0mV" and r.metadata["INFO"]["UnwrapThreshold"] == "1.50"


def test_mixed_files_are_refused(spark, folder, tmp_path):
    (folder / "z.wav").write_bytes(riff.build(tone(10)[:, :1], 8000))
    with pytest.raises(ValueError, match="differ"):
        convert(spark, str(folder), str(tmp_path / "out"), Conversion(), folders=True)


def test_times(spark, folder, tmp_path):
    plan = fix_timestamps(spark, str(folder), str(tmp_path / "out"), "2024-05-06T23:59:59")
    assert [r[3] for r in rows(plan)] == ["test-2024-05-06T23:59:59.wav"] * 1 + sorted(r[3] for r in rows(plan))[1:]
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == len({r[3] for r in rows(plan)})
    r, _ = read(files[0])
    assert r.metadata["INFO"]["DateTimeOriginal"].startswith("2024-05-0") and r.metadata["BEXT"]["OriginationDate"] == r.metadata["INFO"]["DateTimeOriginal"][:10]
    assert not (tmp_path / "dry").exists() and fix_timestamps(spark, str(folder), str(tmp_path / "dry"), "2024-05-06T00:00:00", True).count() == 4


def test_command_line(spark, folder, tmp_path, capsys):
    cli.main(["formats"])
    cli.main(["formats", "wav"])
    cli.main(["metadata", str(folder)])
    cli.main(["metadata", str(folder), "-v", "markers"])
    out = capsys.readouterr().out
    assert "WAVEX" in out and "PCM_24" in out and "DateTimeOriginal" in out and "m3" in out
    cli.main(["convert", str(folder), str(tmp_path / "o"), "-c", "0", "-f", "-n", "2"])
    assert len(list((tmp_path / "o").iterdir())) == 2 and cli.channel_list("0-2,5") == [0, 1, 2, 5]


def test_conversion_keeps_what_it_has(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    x = tone(1001)
    (d / "a.wav").write_bytes(riff.build(x, 8000, "DOUBLE", {"INFO": {"Title": "night walk", "Artist": "сова"}, "BEXT": {"Description": "d"}}, [(7, 2, "сова", "œ’")]))
    (d / "b.wav").write_bytes(riff.build(x, 8000, "PCM_24"))
    convert(spark, str(d), str(tmp_path / "same"), Conversion(scale=0.5, name="{Title}_{None}"))
    assert outputs(tmp_path / "same") == ["night_walk_{None}.wav", "{Title}_{None}.wav"]
    r, y = read(tmp_path / "same" / "night_walk_{None}.wav")
    assert r.encoding == "DOUBLE" and np.array_equal(y, 0.5 * x) and r.metadata["INFO"] == {"Title": "night walk", "Artist": "сова"} and r.metadata["gain"] == "2" and r.markers == [(7, 2, "сова", "œ’")]
    assert r.metadata["BEXT"]["CodingHistory"].splitlines() == ["A=DOUBLE,F=8000,M=stereo,T=a.wav", "A=DOUBLE,F=8000,M=stereo,T=night_walk_{None}.wav"]
    r, _ = read(tmp_path / "same" / "{Title}_{None}.wav")
    assert r.encoding == "PCM_24" and r.metadata["CodingHistory"].splitlines()[0] == "A=PCM,F=8000,W=24,M=stereo,T=b.wav"


def test_cuts_that_decimation_does_not_meet(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(2):
        (d / f"{i}.wav").write_bytes(riff.build(tone(1001), 1001, "DOUBLE", {"INFO": {"DateTimeOriginal": f"2019-01-01T00:00:0{i}"}}, [(1000, 0, "m", None)]))
    convert(spark, str(d), str(tmp_path / "out"), Conversion(decimate=2), folders=True, merge=1)
    parts = [read(tmp_path / "out" / f"0-000{i}.wav")[0] for i in range(2)]
    assert [p.frames for p in parts] == [501, 500] and [len(p.markers) for p in parts] == [1, 1]


def test_demo(spark, tmp_path):
    cli.main(["demo", str(tmp_path / "d"), "-c", "3", "-e", "PCM_24"])
    r, x = read(tmp_path / "d" / "demo.wav")
    assert (r.channels, r.frames, r.encoding) == (3, 44100, "PCM_24") and r.metadata["INFO"]["Title"] == "demo" and len(r.markers) == 2 and 0.9 < x[:, 0].max() <= 1


def outputs(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_every_input_has_an_output(spark, folder, tmp_path):
    top = tmp_path / "top"
    for name in "AB":
        shutil.copytree(folder, top / name)
        (top / name / "x.wav").write_bytes(riff.build(tone(10) * (1 if name == "A" else 0.5), 8000))
    plan = fix_timestamps(spark, str(top), str(tmp_path / "fixed"), "2024-05-06T00:00:00")
    names = ["test-2024-05-06T00:00:00" + n for n in (".wav", "_1.wav", "_2.wav", "_3.wav")] + ["x.wav"]
    assert plan.count() == 10 and outputs(tmp_path / "fixed") == [f"{d}/{n}" for d in "AB" for n in names]
    convert(spark, str(top), str(tmp_path / "out"), Conversion(), encoding="DOUBLE")
    assert outputs(tmp_path / "out") == outputs(top)
    for d, k in (("A", 1), ("B", 0.5)):
        assert np.abs(read(tmp_path / "out" / d / "x.wav")[1] - k * tone(10)).max() < 2**-14
    convert(spark, str(top / "*" / "x.wav"), str(tmp_path / "some"), Conversion())
    assert outputs(tmp_path / "some") == ["A/x.wav", "B/x.wav"]


def test_equal_names_are_refused(spark, folder, tmp_path):
    (folder / "x.wav").write_bytes(riff.build(tone(10), 8000))
    (folder / "x.WAV").write_bytes(riff.build(tone(20), 8000))
    with pytest.raises(ValueError, match="x.wav"):
        convert(spark, str(folder), str(tmp_path / "out"), Conversion())
    assert not (tmp_path / "out").exists()
    two = spark.createDataFrame([("a.wav", b"1"), ("a.wav", b"2")], "name string, data binary")
    with pytest.raises(Exception, match="several outputs"):
        riff_source.write_recordings(two, str(tmp_path / "out"))
    assert outputs(tmp_path / "out") == []


def test_metadata_of_all_files_is_merged(spark, tmp_path):
    mds = [
        {"INFO": {"DateTimeOriginal": "2019-01-01T00:00:00", "Title": "first", "Gain": "20mV"}, "BEXT": {"OriginationDate": "2019-01-01", "OriginationTime": "00:00:00"}},
        {"INFO": {"DateTimeOriginal": "2019-01-01T00:00:01", "Title": "second", "Artist": "a"}, "Rec": {"Site": "x", "Deep": {"n": "1"}}},
        {"INFO": {"DateTimeOriginal": "2019-01-01T00:00:02", "Comment": "c"}, "rec": {"site": "y"}, "Timestamp": "2019-01-01T00:00:02"},
    ]
    for d in "AB":
        (tmp_path / "in" / d).mkdir(parents=True)
        for i, md in enumerate(mds if d == "A" else mds[:1]):
            (tmp_path / "in" / d / f"{i}.wav").write_bytes(riff.build(tone(8000), 8000, md=md))
    convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), Conversion(scale=2.0), folders=True, merge=2)
    assert outputs(tmp_path / "out") == ["A/0-0000.wav", "A/0-0001.wav", "B/0-0000.wav"]
    for i in range(2):
        md = read(tmp_path / "out" / "A" / f"0-000{i}.wav")[0].metadata
        assert md["BEXT"].pop("CodingHistory").splitlines() == ["A=PCM,F=8000,W=16,M=stereo,T=A/0.wav", f"A=PCM,F=8000,W=16,M=stereo,T=A/0-000{i}.wav"]
        assert md.pop("GUANO", None) and md == {
            "INFO": {"DateTimeOriginal": "2019-01-01T00:00:00", "Title": "second", "Gain": "10.0mV", "Artist": "a", "Comment": "c"},
            "BEXT": {"OriginationDate": "2019-01-01", "OriginationTime": "00:00:00"},
            "Rec": {"Site": "y", "Deep": {"n": "1"}}, "Timestamp": "2019-01-01T00:00:00",
        }
    md = read(tmp_path / "out" / "B" / "0-0000.wav")[0].metadata
    assert len(md["BEXT"].pop("CodingHistory").splitlines()) == 2 and md == mds[0] | {"INFO": mds[0]["INFO"] | {"Gain": "10.0mV"}}


def test_files_that_do_not_continue_are_refused(spark, tmp_path):
    def made(name, *starts):
        d = tmp_path / name
        d.mkdir()
        for i, s in enumerate(starts):
            (d / f"{i}.wav").write_bytes(riff.build(tone(8000), 8000, md={"INFO": {"Title": "t"} | ({"DateTimeOriginal": f"2019-01-01T{s}"} if s else {})}))
        return str(d)

    out = tmp_path / "out"
    gap, late, first = made("gap", "00:00:00", "00:00:01", "00:00:09"), made("late", "00:00:00", None), made("first", None, "00:00:01")
    for d, bad in ((gap, "2.wav"), (late, "1.wav"), (first, "1.wav")):
        with pytest.raises(ValueError, match=f"{bad} does not continue"):
            convert(spark, d, str(out), Conversion(), folders=True)
    with pytest.raises(ValueError, match="2.wav does not continue"):
        cli.main(["convert", gap, str(out), "-f", "-m", "relaxed"])
    assert not out.exists()
    cli.main(["convert", gap, str(out / "gap"), "-f", "-g", "7"])
    cli.main(["convert", late, str(out / "late"), "-f", "-m", "relaxed"])
    assert [read(out / d / "0.wav")[0].frames for d in ("gap", "late")] == [24000, 16000]
