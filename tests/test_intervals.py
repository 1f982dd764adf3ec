import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sonargrid.operators import intervals


def covered(pairs):
    """Periods of half-open intervals by a sweep."""
    out = []
    for s, e in sorted((s, e) for s, e in pairs if s is not None and e is not None and e > s):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(p) for p in out]


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_dyadic_periods_equal_a_sweep(pairs):
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    s, e = intervals.dyadic_periods(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), 9)
    assert list(zip(s.tolist(), e.tolist())) == covered(pairs)


def test_gaps_and_periods_of_all_sizes(spark):
    rng = random.Random(3)
    data = []
    for key in ("a", "b", None):
        for _ in range(300):
            s = rng.choice([rng.randrange(-500, 500), rng.randrange(-(10**6), 10**6), rng.randrange(-(10**13), 10**13)])
            data.append((1, key, s, s + rng.choice([1, 5, 100, 65536, 10**5, 10**7, 10**11])))
    data += [(2, "x", 0, 5), (2, "x", 5, 9), (2, "x", 12, 13), (2, "x", 0, 5), (2, "x", None, 7), (2, "x", 20, 20), (2, "x", 30, None), (None, "x", 1, 2)]
    df = spark.createDataFrame(data, "rec_id bigint, label string, start bigint, end bigint")
    want_p, want_g = [], []
    for key in {(r, k) for r, k, _, _ in data}:
        p = covered([(s, e) for r, k, s, e in data if (r, k) == key])
        want_p += [(*key, *x) for x in p]
        want_g += [(*key, a[1], b[0]) for a, b in zip(p, p[1:])]
    assert rows(intervals.gaps(df, ["rec_id", "label"])) == sorted(want_g, key=repr)
    assert rows(intervals.periods(df, ["rec_id", "label"])) == sorted(want_p, key=repr)


def test_extreme_and_empty(spark):
    schema = "rec_id bigint, label string, start bigint, end bigint, tile int, a string, gaps int"
    assert rows(intervals.gaps(spark.createDataFrame([], schema), ["rec_id", "label"])) == []
    df = spark.createDataFrame([(1, "x", -(2**63), -(2**62), 1, "", 1), (1, "x", 2**62, 2**63 - 1, 1, "", 1), (1, "x", 0, 2**61, 1, "", 1)], schema)
    assert rows(intervals.gaps(df, ["rec_id", "label"])) == [(1, "x", -(2**62), 0), (1, "x", 2**61, 2**62)]


def test_markers_are_cleaned(spark):
    data = [(1, 0, 5, " Song ", "t"), (1, 10, 5, "song", "t"), (1, 3, 0, "song", "t"), (1, 3, -4, "song", "t"), (1, None, 4, "song", "t"), (1, 3, None, "song", "t"), (1, 0, 1, "  ", "t"), (1, 0, 1, None, "t"), (1, 2**63 - 2, 9, "end", "t")]
    m = spark.createDataFrame(data, "rec_id bigint, pos bigint, span bigint, label string, start string")
    assert rows(intervals.gaps(intervals.marker_intervals(m), ["rec_id", "label"])) == [(1, "song", 5, 10)]
    assert rows(intervals.marker_intervals(m).where("label = 'end'")) == [(1, "end", 2**63 - 2, 2**63 - 1)]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_touching_intervals_leave_no_gap(spark, n):
    df = spark.createDataFrame([(i * 65536, (i + 1) * 65536) for i in range(n)], "start bigint, end bigint")
    df = df.selectExpr("1 AS k", "*")
    assert rows(intervals.gaps(df, ["k"])) == []
    assert rows(intervals.periods(df, ["k"])) == ([(1, 0, n * 65536)] if n else [])
