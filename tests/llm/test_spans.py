import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sonargrid.llm import spans
from sonargrid.llm.automaton import SuffixAutomaton

W = 40


def stretches(docs, w):
    """[(doc, start, end)] by comparing all windows."""
    owners = {}
    for d, t in docs:
        for i in range(len(t or "") - w + 1):
            owners.setdefault(t[i : i + w], set()).add(d)
    out = set()
    for d, t in docs:
        flags = [len(owners[t[i : i + w]]) > 1 for i in range(len(t or "") - w + 1)] + [False]
        start = None
        for i, f in enumerate(flags):
            if f and start is None:
                start = i
            if not f and start is not None:
                out.add((d, start, i - 1 + w))
                start = None
    return sorted(out, key=repr)


def corpus(seed, n=60, alphabet="abcdefgh é🎧"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randrange(30, 200)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a:] if rng.random() < 0.3 else p, word(rng.randrange(0, 60))]
        docs.append((i, "".join(parts)))
    return docs + [(100, docs[0][1]), (101, docs[0][1]), (102, docs[3][1] + "x")]


@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=5), st.integers(2, 6))
@settings(max_examples=200, deadline=None)
def test_automaton_shares_what_two_owners_hold(texts, least):
    a = SuffixAutomaton()
    for i, t in enumerate(texts):
        a.add(t, i)
    a.settle()
    for i, t in enumerate(texts):
        got = {s for x, y in a.shared(t, range(len(t) + 1), least) for s in range(x, y)}
        want = {s for s in range(len(t) - least + 1) if any(t[s : s + least] in u for j, u in enumerate(texts) if j != i)}
        assert got == want


side = st.text("ab", max_size=6)


@given(st.lists(st.tuples(side, side, st.integers(0, 2), st.integers(0, 1)), min_size=1, max_size=8), st.integers(9, 12))
@settings(max_examples=500, deadline=None)
def test_stretches_cut_where_they_part_equal_brute_force(sides, window):
    held = {}
    for left, right, owner, more in sides:
        if len(left) + 3 + len(right) >= window:
            x = held.get((left + "###" + right, len(left)), (owner, owner + more))
            held[left + "###" + right, len(left)] = min(x[0], owner), max(x[1], owner + more)
    if not held:
        return
    got = spans.solve(held, window)
    for (text, o), (lo, hi) in held.items():
        mine = {s for a, b in got.get((text, o), []) for s in range(a, b)}
        others = {(p - i, t[i : i + window]) for (t, p), (x, y) in held.items() if lo != hi or (x, y) != (lo, lo) for i in range(len(t) - window + 1)}
        assert mine == {s for s in range(len(text) - window + 1) if (o - s, text[s : s + window]) in others}


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(1)
    points, of = rng.integers(97, 100, 5000).astype(np.uint32), np.repeat(np.arange(5), 1000)
    _, place, first, last = spans.anchors(points, of, 250)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(starts) == [s for s in range(5000 - 249) if of[s] == of[s + 249]]
    assert all(a <= p <= b + 249 and p >= b and p + spans.GRAM <= a + 250 for p, a, b in zip(place, first, last))


@pytest.mark.parametrize("crowd", [400, 3, 1])
def test_equal_to_brute_force_whatever_the_crowd(spark, crowd):
    docs = corpus(crowd)
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, shard string, lo int").repartition(5)
    assert rows(spans.shared_spans(df, W, crowd)) == stretches(docs, W)


def test_a_passage_in_every_record(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij") for _ in range(130))
    docs = [(i, "".join(rng.choice("klmnop") for _ in range(rng.randrange(50))) + passage + "".join(rng.choice("qrstuv") for _ in range(rng.randrange(50)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(spans.shared_spans(df, W, 20)) == stretches(docs, W)


def test_nulls_repeats_short_and_long(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef") for _ in range(200_000))
    docs = [(1, long), (2, "zz" + long[1000:90_000]), (3, None), (4, ""), (5, "a" * W), (6, "a" * 500), (6, "a" * 500), (7, "b" * 300), (7, "b" * 300), (8, "c" * 30_000), (9, "c" * 20_000), (None, "a" * 500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = [(1, 1000, 90_000), (2, 2, 89_002), (5, 0, W), (6, 0, 500), (8, 0, 30_000), (9, 0, 20_000)]
    assert rows(spans.shared_spans(df, W)) == want
    got = rows(spans.coverage(df, spans.shared_spans(df, W)))
    assert [g[:3] for g in got] == [(1, 200_000, 89_000), (2, 89_002, 89_000), (5, W, W), (6, 500, 500), (8, 30_000, 30_000), (9, 20_000, 20_000)]
    assert rows(spans.shared_spans(df.limit(0), W)) == []
    with pytest.raises(ValueError):
        spans.shared_spans(df, 32)
