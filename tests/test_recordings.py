from datetime import datetime

import pytest
from conftest import rows

from sonargrid.operators import recordings as rec

FILES = "rec_id bigint, file_idx int, path string, format string, encoding string, rate double, channels int, frames bigint, start_index bigint, end_index bigint, start_time timestamp_ntz, site_id int, loaded_at timestamp_ntz"


def file(r, i, start, rate=10.0, channels=1, frames=100, loaded=1, fmt="wave"):
    return (r, i, f"/a/r{r}_{i}.WAVE", fmt, "PCM_16", rate, channels, None, i * frames, (i + 1) * frames, start, 1, datetime(2024, 1, loaded))


def test_files(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    data = [file(1, 0, t(0)), file(1, 1, t(10)), file(1, 1, t(10), loaded=2, fmt="WAV"), file(1, 2, t(20)), file(1, 3, t(35)), file(1, 4, t(40)),
            file(2, 0, t(0)), file(2, 1, None), file(2, 2, t(20)), file(3, 0, t(0)), file(3, 1, t(10), rate=11.0), file(4, 0, None), file(4, 1, t(0))]
    f = rec.distinct_files(spark.createDataFrame(data, FILES))
    assert f.count() == 12 and [r.format for r in f.select("format").distinct().collect()] == ["WAV"]
    ok = lambda **k: {(r, i): o for r, i, o, _ in rows(rec.continuity(f, **k))}
    strict, relaxed = ok(), ok(mode="relaxed")
    assert [strict[1, i] for i in range(5)] == [True, True, True, False, False]
    assert [strict[2, i] for i in range(3)] == [True, False, False] and [relaxed[2, i] for i in range(3)] == [True, True, True]
    assert not strict[3, 1] and not relaxed[3, 1] and strict[4, 0] and not strict[4, 1] or relaxed[4, 1]
    assert rows(rec.file_offsets(f).where("rec_id = 1"))[-1] == (1, 4, 100, 400, 500)
    assert rows(rec.file_info(f).where("rec_id = 1 AND file_idx = 0")) == [(1, 0, "r1_0", "WAV", "PCM_16", "10Hz", 1, 100, "10.000s")]
    pos = spark.createDataFrame([(1, 150), (1, 0), (1, 500), (1, -1), (9, 3)], "rec_id bigint, pos bigint")
    assert [(r[1], r[2], r[4]) for r in rows(rec.frame_to_file(pos, f))] == [(0, 0, 0), (150, 1, 50)]
    assert rec.continuity(f.limit(0)).count() == 0


@pytest.mark.parametrize(("frames", "size", "overlap", "want"), [(100, 10, 0, [(i * 10, i * 10 + 10) for i in range(10)]), (25, 10, 0, [(0, 10), (10, 20), (20, 25)]), (25, 10, 5, [(0, 10), (5, 15), (10, 20), (15, 25)]), (26, 10, 5, [(0, 10), (5, 15), (10, 20), (15, 25), (20, 26)]), (3, 10, 5, [(0, 3)])])
def test_blocks(spark, frames, size, overlap, want):
    n = spark.createDataFrame([(1, frames)], "rec_id bigint, frames bigint")
    assert [r[2:] for r in sorted(rows(rec.block_plan(n, size, overlap)), key=lambda r: r[1])] == want
    s = spark.createDataFrame([(1, 0, f, 0.0) for f in range(frames)], "rec_id bigint, channel int, frame bigint, x double")
    got = {}
    for r in rec.into_blocks(s, size, overlap).collect():
        got.setdefault(r.block, []).append(r.frame)
    assert [(min(v), max(v) + 1) for _, v in sorted(got.items())] == want
    with pytest.raises(ValueError):
        rec.block_plan(n, 5, 5)


def test_markers(spark):
    k = spark.createDataFrame([(1, 2, 5, 3, "b", "T"), (1, 1, 5, 0, "a", None), (1, 3, 900, None, None, "x"), (1, 4, None, 1, "", "")], "rec_id bigint, marker_id int, pos bigint, span bigint, label string, text string")
    assert rows(rec.join_labels(k, ["rec_id", "pos"]).where("pos = 5")) == [(1, 5, "a|b", "T")]
    assert rows(rec.markers_in_range(k, 5, 900).select("marker_id", "pos")) == [(1, 0), (2, 0)]
    assert [r[2] for r in rows(rec.marker_table(k))][1] == f"{5:10d} {3:8d} {'b':10s} T"
    files = spark.createDataFrame([(1, 0, 100), (1, 1, 50)], "rec_id bigint, file_idx int, frames bigint")
    local = spark.createDataFrame([(1, 1, 7)], "rec_id bigint, file_idx int, pos bigint")
    assert rows(rec.concat_markers(local, files).select("pos")) == [(107,)]


def test_chunks(spark):
    c = spark.createDataFrame([(1, 0, "data", 10, 3), (1, 1, "DATA", 50, 4), (1, 1, "DATA", 50, 4), (1, 2, None, 1, 1), (2, 0, "fmt ", 20, None)], "rec_id bigint, ord int, tag string, pos bigint, size bigint")
    assert rows(rec.last_chunks(c)) == [(1, "DATA", 50, 4), (2, "FMT ", 20, None)]
