import pytest
from conftest import rows

from sonargrid.llm import leakage

ITEM = "Question: a homemade marker draws 106 units while the echo stays cheap. Which oscillator should be taped first, and why?"


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return sorted({(d, i) for d, t in docs if t for k in range(len(leakage.words(t)) - n + 1) for i in grams.get(tuple(leakage.words(t)[k : k + n]), ())})


def test_words():
    assert leakage.words("<b>Can't</b> [i]stop&nbsp;&#9;now\n> | 3.5 Straße_x <3 a < b") == ["can", "t", "stop", "now", "3", "5", "straße", "x", "3", "a", "b"]
    text = "ab <i>Cd</i>, ef"
    assert [text[a:b].lower() for _, a, b in leakage.placed_words(text)] == leakage.words(text)


@pytest.mark.parametrize("size", [200_000, 20])
def test_found_in_any_dress_and_shards(spark, size):
    w = ITEM.split()
    items = [(1, ITEM), (2, " ".join(w[:14]) + " other end of this item entirely"), (3, "too short"), (4, None), (5, ""), (5, ""), (None, ITEM)]
    docs = [(1, "so " + ITEM.upper() + " yes"), (2, "> " + "\n> ".join(w[:13])), (3, " ".join(w[:11])), (4, "<b>" + " <i>".join(w[3:18]) + "[/b]"), (5, None), (6, ""), (None, ITEM), (7, " ".join(w[:6] + ["and"] + w[6:12])), (1, "so " + ITEM.upper() + " yes"), (8, (ITEM + " ") * 500)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    want = brute([x for x in docs if x[0]], [x for x in items if x[0] and x[1]], 12)
    assert rows(leakage.leaks(d, b, shard_words=size)) == want and len(want) > 5
    assert rows(leakage.leaks(d.limit(0), b)) == [] and rows(leakage.leaks(d, b.limit(0))) == []


@pytest.mark.parametrize("passes", [50, 1])
def test_long_items_in_parts_and_several_passes(spark, monkeypatch, passes):
    import random

    monkeypatch.setattr(leakage, "SHARDS", passes)
    rng = random.Random(3)
    vocabulary = ["oak", "elm", "ash", "fir", "yew", "bay"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([400, 90, 30, 12, 11])] + [(9, "the same words come again and again " * 40)]
    docs = [(i, " ".join(w[a : a + rng.randrange(5, 80)]) + " so " + " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(60) for w in [rng.choice(items)[1].split()] for a in [rng.randrange(len(w))]]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(rows(leakage.leaks(d, b, shard_words=100))) == brute(docs, items, 12)
    whole, parts = rows(leakage.leaked_spans(d, b)), rows(leakage.leaked_spans(d, b, shard_words=100))
    starts = lambda spans: {(doc, item, s) for doc, item, a, e in spans for s in range(a, e - 11)}
    assert starts(parts) == starts(whole) and (passes == 1 or parts == whole)
    assert rows(leakage.removed(d, b, shard_words=100)) == rows(leakage.removed(d, b))


def test_removal(spark):
    d = spark.createDataFrame([(1, "Before. " + ITEM + " " + "After it all goes on and on. " * 20), (2, ITEM), (3, "clean")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    got = rows(leakage.removed(d, b))
    assert [g[0] for g in got] == [1, 2] and got[1][1] is None and got[1][3]
    assert got[0][1].startswith("Before. ? After it") and got[0][2] == len(ITEM) - 1 and not got[0][3]
