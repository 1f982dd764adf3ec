from fractions import Fraction as Q

import pytest
from conftest import rows

from sonargrid.operators import units

SETTINGS = {"highpass": "frequency", "gain": "voltage"}


def test_compositions_are_shortest_and_consistent():
    c = units.compositions()
    assert c["kHz"] == ("frequency", Q(10**6), Q(0)) and c["1/min"] == ("frequency", Q(1000, 60), Q(0)) and c["V"][1] == 10**6
    quantity, f, o = c["°F"]
    assert quantity == "temperature" and 212 * f + o == Q(37315, 100)


def test_a_cycle_that_disagrees_is_an_error():
    with pytest.raises(ValueError, match="disagrees"):
        units.compositions([("a", "b", Q(2), Q(0)), ("b", "c", Q(3), Q(0)), ("a", "c", Q(7), Q(0))], {"q": "c"})


def test_values(spark):
    cases = [
        ("Highpass", "80 Hz", 80000), ("highpass", "0,3kHz", 300000), ("HIGHPASS", "3.379e+3 mHz", 3379), ("Highpass", "30 /min", 500), ("Highpass", "30 1/min", 500), ("Highpass", "10 1/s", 10000),
        ("Highpass", "corner 1.2 kHz, 6 dB/oct", 1200000), ("Highpass", "~9Hz", 9000), ("Highpass", "1 MHz", 10**9), ("Highpass", "1 mHz", 1), ("Highpass", "5 V", None), ("Highpass", "off", None), ("Highpass", "Hz", None),
        ("Gain", "20 mV/V", 20000), ("Gain", "5000μV/V", 5000), ("Gain", "5000 µV", 5000), ("Gain", "7 muV", 7), ("Gain", "+/- 5 V", 5000000), ("Gain", "FS=2.5V", 2500000), ("Gain", "set to 2.5V at 20 dB", 2500000),
        ("Gain", "20 dB", None), ("Gain", "+20dB", None), ("Gain", "x10", None), ("Gain", "10", None), ("Gain", None, None), ("Gain", "", None), ("Gain", "9" * 400, None), ("Gain", "9" * 100_000 + " V", None), (None, "5 V", None), ("Gain", "-2 mV", -2000),
    ]
    data = [(1, i, [f"s{i}"], k, v, False, "clash") for i, (k, v, _) in enumerate(cases)] * 2
    m = spark.createDataFrame(data, "rec_id bigint, ord int, path array<string>, key string, value string, is_section boolean, spelling string")
    assert rows(units.to_base(m, SETTINGS)) == sorted([(1, i, b) for i, (_, _, b) in enumerate(cases) if b is not None], key=repr)
    assert rows(units.to_base(m.limit(0), SETTINGS)) == []


def test_units_in_another_row(spark):
    said = ["Gain [volt], Highpass [kHz]", "filters in hertz, gain in uV", "unless noted, corner frequencies are kHz and gains V", "gain: mV; highpass: Hz"]
    data = []
    for r, s in enumerate(said):
        data += [(r, 0, ["A"], "Units", s, False), (r, 1, ["A"], "Gain", "2", False), (r, 2, ["A"], "Highpass", " 0.5 ", False), (r, 3, ["B"], "Gain", "2", False), (r, 4, ["A"], "Gain", "x2", False), (r, 5, ["A"], "Gain", "3 V", False)]
    m = spark.createDataFrame(data, "rec_id bigint, ord int, path array<string>, key string, value string, is_section boolean")
    want = [(0, 1, 2000000), (0, 2, 500000), (1, 1, 2), (1, 2, 500), (2, 1, 2000000), (2, 2, 500000), (3, 1, 2000), (3, 2, 500)] + [(r, 5, 3000000) for r in range(4)]
    assert rows(units.to_base(m, SETTINGS)) == sorted(want, key=repr)
