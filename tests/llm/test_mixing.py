import random

from conftest import rows

from sonargrid.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]


def docs(spark, n=900, hot=0.4):
    rng = random.Random(2)
    data = [(i, " A " if rng.random() < hot else rng.choice(["b", "c", "other", None]), "word " * rng.randrange(1, 80), i) for i in range(n)]
    data += [(5000, "a", "", 1), (5001, "a", None, 1), (None, "a", "word", 1)] + data[:20]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string, n_tokens int")


def test_shares_repeats_and_whole_use(spark):
    d, t = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, t).cache()
    got = {r.source: r for r in mixing.shares(mixed, t).collect()}
    for s, share, repeats in TARGETS:
        assert abs(got[s].share - share) < 0.005 and got[s].most_uses <= repeats
    sizes = mixing.sizes_by_source(mixing.token_counts(d))
    all_a = sizes.where("source IN ('a', 'b', 'c')").groupBy("source").count().collect()
    full = [s for s, _, repeats in TARGETS if mixed.where(f"source = '{s}'").where(f"uses < {repeats}").isEmpty()]
    assert full, "the scarcest source is used as often as it may"
    assert mixed.count() == mixed.select("doc_id").distinct().count() and len(all_a) == 3
    assert rows(mixed) == rows(mixing.mixture(d.repartition(7), t))


def test_tokens_round_trip(spark):
    import tiktoken

    import base64

    with open(mixing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "It's 25 °C, señal – 🎧 <|endoftext|>\n\n ok"
    assert e.decode(e.encode_ordinary(text)) == text
    d = spark.createDataFrame([(1, "a", text)], "doc_id bigint, source string, text string")
    assert rows(mixing.token_counts(d)) == [(1, "a", len(e.encode_ordinary(text)))]


def test_flight_keeps_totals():
    rng = random.Random(4)
    f = mixing.Flight(1)
    units = [(i, rng.randrange(1, 500)) for i in range(2000)]
    for i, n in units:
        f.add(i, n, 0.37)
    f.land()
    chosen = dict(f.out)
    assert len(chosen) == 2000 and abs(sum(chosen.values()) - 740) <= 2
    assert abs(sum(n * chosen[i] for i, n in units) - 0.37 * sum(n for _, n in units)) <= 1500


def test_probabilities_are_kept():
    hits = [0] * 6
    for seed in range(4000):
        f = mixing.Flight(seed)
        for i in range(6):
            f.add(i, 10 + i * i, 0.3)
        f.land()
        for i, x in f.out:
            hits[i] += x
    assert all(abs(h / 4000 - 0.3) < 0.04 for h in hits)


def test_nothing_to_mix(spark):
    t = spark.createDataFrame([*TARGETS, ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    assert rows(mixing.mixture(docs(spark, 50), t)) == []
    assert rows(mixing.mixture(docs(spark, 50).limit(0), t)) == []
    assert rows(mixing.mixture(docs(spark, 50), t.limit(0))) == []
    equal = spark.createDataFrame([(i, "ab"[i % 2], "same text", 1) for i in range(100)], "doc_id bigint, source string, text string, n_tokens int")
    half = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    assert {r.source: r.docs for r in mixing.shares(mixing.mixture(equal, half), half).collect()} in ({"a": 50, "b": 12}, {"a": 50, "b": 13})


def test_many_flights_in_a_tree(spark):
    d, t = docs(spark, 3000), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, t, flight=50).cache()
    got = {r.source: r for r in mixing.shares(mixed, t).collect()}
    for s, share, repeats in TARGETS:
        assert abs(got[s].share - share) < 0.005 and got[s].most_uses <= repeats
    assert rows(mixed) == rows(mixing.mixture(d.repartition(5), t, flight=50))
