import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sonargrid.llm import encoding

CLEAN = ["Zaunkönig am Flußufer, späte Dämmerung", "crapaud éloigné près du marécage", "búho pequeño junto al río", "świerszcz nad łąką, wiatr północny", "сова у реки, под обрывом", "певчий дрозд за мостом",
         "ふくろうの声, 森の奥", "andorinhão próximo da estação", "hrafn við á, á mýri", "tree frog by the weir", "±3 dB, 25 °C", "5000 µV", "ÅÄÖ", "Ãh", "hulotte à trois notes, après l’orage", "ГРОЗА"]


def garble(text, source, target):
    for _ in range(2 if source.endswith("*2") else 1):
        raw = text.encode(source.removesuffix("*2"))
        back = {b: c for c, b in encoding._bytes_of(target).items()}
        text = "".join(back[b] for b in raw)
    return text


def test_emissions_invert_every_pair():
    for name, source, target in encoding.PAIRS:
        for text in CLEAN:
            try:
                bad = garble(text, source, target)
            except (UnicodeEncodeError, KeyError):
                continue
            size, char = encoding.inverse(encoding._rows_of([bad, "x" * (len(bad) + 2)]), source, target)
            out, i = "", 0
            while i < len(bad):
                assert size[0, i], (name, text, i)
                out += chr(char[0, i])
                i += size[0, i]
            assert out == text, name


def test_utf8_is_read_as_python_reads_it():
    rng = random.Random(2)
    raws = [bytes(rng.choice([0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5]) for _ in range(8)) for _ in range(3000)]
    points = encoding._rows_of([r.decode("latin-1") for r in raws])
    size, char = encoding.inverse(points, "utf-8", "latin-1")
    for r, raw in enumerate(raws):
        for i in range(8):
            want = (0, -1)
            for n in range(1, 5):
                try:
                    c = raw[i : i + n].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(raw[i : i + n]) == n:
                    want = (n, ord(c))
                break
            assert (size[r, i], char[r, i]) == want


def test_labels_do_not_depend_on_what_is_labelled_together():
    pairs, ones = np.zeros(1 << encoding.PAIR_BITS, np.int64), np.zeros(1 << encoding.ONE_BITS, np.int64)
    encoding._counted(CLEAN, [50] * len(CLEAN), pairs, ones)
    model = encoding.Labeller(pairs, ones, 5.5)
    texts = [*CLEAN, *(garble(t, "utf-8", "latin-1") for t in CLEAN), "a�b", "", "x" * 3000 + garble("ä", "utf-8", "latin-1") + "y" * 3000 + "Å›"]
    together = model.labels(texts)
    assert together == [model.label(t) for t in texts] == model.labels(texts[::-1])[::-1]
    assert together[-3] == [(1, 2, "lost", "�")] and [(a, b, new) for a, b, _, new in together[-1]] == [(3000, 3002, "ä"), (6002, 6004, "ś")]
    assert all(encoding.restore(garble(t, "utf-8", "latin-1"), s) == t for t, s in zip(CLEAN, together[len(CLEAN) :]) if len(t) > 12)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    data, i = [], 0
    for text in CLEAN:
        for _ in range(60):
            data.append((i, text + rng.choice(["", f" (take {rng.randrange(200)})"]), False, text))
            i += 1
        for _, source, target in encoding.PAIRS:
            try:
                bad = garble(text, source, target)
            except (UnicodeEncodeError, KeyError):
                continue
            if bad != text and len(text) > 6 and text[0] not in "±5":
                data.append((i, bad + " (take 7)", True, text + " (take 7)"))
                i += 1
    data += [(i, "sp�ter", True, "sp�ter"), (i + 1, "WeiÃstÃ¶rche, Zaunkönig", True, None), (i + 2, None, False, None), (i + 3, "", False, ""), (i + 4, "plain", False, "plain")]
    return spark.createDataFrame(data, "id int, text string, bad boolean, want string").cache()


def test_found_and_restored(cells):
    got = {r.id: r for r in encoding.garbled(cells).collect()}
    all_ = {r.id: r for r in cells.collect()}
    bad = {i for i, r in all_.items() if r.bad}
    assert not [all_[i].text for i in got if i not in bad]
    assert len(bad & set(got)) >= 0.97 * len(bad)
    right = [i for i in bad & set(got) if all_[i].want is not None and got[i].restored == all_[i].want]
    assert len(right) >= 0.95 * len([i for i in bad if all_[i].want is not None])


def test_partly_garbled_repeated_long_and_empty(spark, cells):
    part = spark.createDataFrame([(9000, "Å›wierszcz nad łąką", True, ""), (9000, "Å›wierszcz nad łąką", True, ""), (9001, "x" * 50_000 + " spÃ¤te", True, "")], cells.schema)
    got = rows(encoding.garbled(cells.unionByName(part)).where("id >= 9000").select("id", F.right("restored", F.lit(18))))
    assert got == [(9000, "świerszcz nad łąką"), (9000, "świerszcz nad łąką"), (9001, "x" * 12 + " späte")]
    assert rows(encoding.garbled(cells.limit(0))) == []


def test_cells_of_the_tables(spark):
    m = spark.createDataFrame([(1, 2, ["INFO"], "Title", "a", False), (1, 2, ["INFO"], "Title", "a", False), (1, 3, ["BEXT"], "Title", "a", False), (1, 4, ["info"], "T", None, False), (1, 5, None, "T", "a", False), (1, 6, [], "INFO", None, True)], "rec_id bigint, ord int, path array<string>, key string, value string, is_section boolean")
    k = spark.createDataFrame([(1, 7, "l", None), (1, 7, "l", None), (None, 8, None, "t")], "rec_id bigint, marker_id int, label string, text string")
    assert rows(encoding.text_cells(m, k)) == sorted([("metadata", 1, 2, "value", "a"), ("markers", 1, 7, "label", "l"), ("markers", None, 8, "text", "t")], key=repr)


def test_counts_go_on_after_a_lost_character():
    pairs, ones = np.zeros(1 << encoding.PAIR_BITS, np.int64), np.zeros(1 << encoding.ONE_BITS, np.int64)
    encoding._counted(["a��bc�", ""], [3, 2], pairs, ones)
    n = lambda p: pairs[encoding._pair_buckets(np.array([ord(p[0])]), np.array([ord(p[1])]))[0]]
    start = encoding._START
    assert [n(p) for p in (start + "a", start + "b", "bc", "ab")] == [3, 3, 3, 0] and pairs.sum() == 9
    assert [ones[ord(c)] for c in "abc"] == [3, 3, 3]
