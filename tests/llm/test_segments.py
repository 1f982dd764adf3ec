import numpy as np
import pytest
from conftest import rows

from sonargrid.llm import segments

SCHEMA = "rec_id bigint, channel int, frame bigint, x double"


def recording(rng, n, channels, nulls=3):
    """(channels, n) doubles with quiet stretches and a few NaN."""
    x = rng.normal(0, 0.3, (channels, n))
    at = 0
    while at < n:
        at += rng.integers(20, 400)
        m = rng.integers(30, 160)
        x[:, at : at + m] = 0.1 * np.arange(channels)[:, None] + rng.uniform(-0.009, 0.009, x[:, at : at + m].shape)
        at += m
    x[rng.integers(0, channels, nulls), rng.integers(0, n, nulls)] = np.nan
    return x


def frame_rows(rec, x):
    return [(rec, c, f, None if np.isnan(v) else float(v)) for c in range(x.shape[0]) for f, v in enumerate(x[c])]


def stretches(x, most=0.02, least=50):
    q = (np.abs(x - np.nanmedian(x, axis=1)[:, None]) <= most).all(0)
    b = np.flatnonzero(np.diff(np.concatenate([[0], q.astype(int), [0]])))
    return [(int(a), int(e)) for a, e in zip(b[::2], b[1::2]) if e - a >= least]


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(7)
    recs = {i: recording(rng, n, c) for i, (n, c) in enumerate([(1500, 1), (1000, 2), (2600, 3), (4000, 2)])}
    data = [r for i, x in recs.items() for r in frame_rows(i, x)]
    data += data[:40] + [(9, 0, 5, None), (None, 0, 1, 1.0), (9, None, 1, 1.0), (9, 0, None, 1.0)]
    rng.shuffle(data)
    df = spark.createDataFrame([(*r[:3], r[3]) for r in data], SCHEMA).selectExpr("*", "0 AS block", "'x' AS classes")
    want = sorted([(i, *s) for i, x in recs.items() if x.shape[1] > 1000 for s in stretches(x)], key=repr)
    assert rows(segments.quiet_stretches(df)) == want and len(want) > 10


def test_many_blocks(spark):
    rng = np.random.default_rng(8)
    n = 3 * segments.FRAMES + 777
    x = recording(rng, n, 2, 50)
    x[:, segments.FRAMES - 60 : segments.FRAMES + 70] = 0.1 * np.arange(2)[:, None]  # a quiet stretch across a seam
    x[:, 2 * segments.FRAMES - 30 : 2 * segments.FRAMES + 10] = 5.0
    import pandas as pd

    frame = np.arange(n)
    pdf = pd.concat([pd.DataFrame({"rec_id": 1, "channel": c, "frame": frame, "x": x[c]}) for c in range(2)]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf).selectExpr("CAST(rec_id AS BIGINT) rec_id", "CAST(channel AS INT) channel", "CAST(frame AS BIGINT) frame", "nullif(x, double('NaN')) AS x")
    assert rows(segments.quiet_stretches(df)) == [(1, *s) for s in sorted(stretches(x), key=lambda s: repr((1, *s)))]
    check_pieces(rows(segments.pieces(df)), {1: n})


def cut(x, limit=1000, overlap=50, least=50, most=0.02):
    """Pieces of one recording (channels, n) by a loop over its frames."""
    q = (np.abs(x - np.nanmedian(x, axis=1)[:, None]) <= most).all(0)
    n, reach, half, out, at = x.shape[1], limit - overlap, least // 2, [], 0
    if n <= limit:
        return [(0, n, "end")]
    while at < n:
        end, why = n, "end"
        if n - at > reach:
            quiet = [e for e in range(at + reach, at + overlap + half - 1, -1) if q[e - half : e + half].all()][:1]
            lull = [e for e in range(at + reach, at + reach // 2, -1) if q[e - 1 : e + 1].all()][:1]
            end, why = (quiet[0], "quiet") if quiet else (lull[0], "lull") if lull else (at + reach, "limit")
        out.append((at - (overlap if at else 0), end, why))
        at = end
    return out


def spread(spark, x, at):
    """A recording of channels with its frames at ``at``."""
    import pandas as pd

    pdf = pd.concat([pd.DataFrame({"rec_id": 1, "channel": c, "frame": at, "x": x[c]}) for c in range(len(x))]).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf).selectExpr("CAST(rec_id AS BIGINT) rec_id", "CAST(channel AS INT) channel", "CAST(frame AS BIGINT) frame", "nullif(x, double('NaN')) AS x")


@pytest.mark.parametrize("shift", [0, 65_530, 64_000, -30_123])
def test_pieces_move_with_the_recording(spark, shift):
    rng = np.random.default_rng(4)
    n = 140_000
    x = recording(rng, n, 1, 20)
    x[:, 20_000:90_000] = rng.normal(0, 0.3, 70_000) + 0.5  # hardly any quiet frame: cuts keep the distance they had
    assert [(a - shift, b - shift, why) for _, a, b, why in sorted(rows(segments.pieces(spread(spark, x, np.arange(n) + shift))), key=lambda r: r[1])] == cut(x)


def test_holes_and_long_stretches(spark):
    rng = np.random.default_rng(6)
    x = recording(rng, 70_000, 1, 0)
    x[:, 60_000:66_000] = np.median(x)  # one stretch of several tokens, across a seam
    df = spread(spark, x, np.arange(70_000))
    assert (60_000, 66_000) not in stretches(x) or (1, 60_000, 66_000) in rows(segments.quiet_stretches(df))
    assert rows(segments.quiet_stretches(df)) == sorted([(1, *s) for s in stretches(x)], key=repr)
    at = np.concatenate([np.arange(30_000), np.arange(31_500, 65_000), np.arange(65_900, 72_400)])  # a hole that ends a recording, and one across a seam that doesn't
    got = sorted(rows(segments.pieces(spread(spark, x, at))), key=lambda r: r[1])
    ends = [r for r in got if r[3] == "end"]
    assert [r[2] for r in ends] == [30_000, 72_400] and got[0][1] == 0 and [r[1] for r in got if r[1] > 30_000][0] == 31_500
    parts = [[r for r in got if r[2] <= 30_000], [r for r in got if r[1] >= 31_500]]
    assert all(q[1] == p[2] - 50 and 0 < q[2] - q[1] <= 1000 for ps in parts for p, q in zip(ps, ps[1:]))


def check_pieces(got, lengths):
    by = {}
    for r, a, b, why in got:
        by.setdefault(r, []).append((a, b, why))
    assert set(by) == set(lengths)
    for r, ps in by.items():
        ps.sort()
        assert ps[0][0] == 0 and ps[-1][1] == lengths[r] and all(0 < b - a <= 1000 for a, b, _ in ps)
        assert all(q[0] == p[1] - 50 for p, q in zip(ps, ps[1:]))
        assert [w for _, _, w in ps].count("end") == 1 and ps[-1][2] == "end"


def test_pieces(spark):
    rng = np.random.default_rng(9)
    recs = {i: recording(rng, n, 1, 0) for i, n in enumerate([1, 50, 999, 1000, 1001, 1950, 1951, 7000])}
    df = spark.createDataFrame([r for i, x in recs.items() for r in frame_rows(i, x)], SCHEMA)
    got = rows(segments.pieces(df))
    check_pieces(got, {i: x.shape[1] for i, x in recs.items()})
    quiet = {i: stretches(x) for i, x in recs.items()}
    for r, a, b, why in got:
        inside = [s for s in quiet[r] if s[0] + 25 <= b <= s[1] - 25]
        assert (why == "quiet") == bool(inside and why != "end")
        if why in ("lull", "limit"):  # no quiet stretch was in reach
            low = a + 50 if a else 0
            assert not [s for s in quiet[r] if max(s[0] + 25, low + 75) <= min(s[1] - 25, low + 950)]
    with pytest.raises(ValueError):
        segments.pieces(df, 100, 60)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(segments.quiet_stretches(df)) == [] and rows(segments.pieces(df)) == []
    nulls = spark.createDataFrame([(1, 0, f, None) for f in range(1200)], SCHEMA)
    assert rows(segments.quiet_stretches(nulls)) == []
    assert [r[1:3] for r in rows(segments.pieces(nulls))] == [(0, 950), (900, 1200)]
