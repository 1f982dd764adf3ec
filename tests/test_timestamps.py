from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from conftest import rows

from sonargrid.operators import timestamps

BERLIN = "Europe/Berlin"


def us(*a, tz="UTC", fold=0):
    return (datetime(*a, tzinfo=ZoneInfo(tz), fold=fold).astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("2024-05-06T07:08:09", BERLIN, us(2024, 5, 6, 7, 8, 9, tz=BERLIN)), ("2024:05:06 07:08:09", BERLIN, us(2024, 5, 6, 7, 8, 9, tz=BERLIN)),
    ("2024-05-06 07:08:09,5", "UTC", us(2024, 5, 6, 7, 8, 9, 500000)), ("2024-05-06T07:08:09.123456789Z", None, us(2024, 5, 6, 7, 8, 9, 123456)),
    ("20240506T070809", "UTC", us(2024, 5, 6, 7, 8, 9)), ("20240506_070809", "UTC", us(2024, 5, 6, 7, 8, 9)), ("6.5.2024, 7:08", "UTC", us(2024, 5, 6, 7, 8)),
    ("5/6/2024 7:08 am", "UTC", us(2024, 5, 6, 7, 8)), ("12/29/2020 12:19 pm", "UTC", us(2020, 12, 29, 12, 19)), ("12/29/2020 12:19:01 AM", "UTC", us(2020, 12, 29, 0, 19, 1)),
    ("Tue, 21 Jan 2025 19:48:12 -0500", None, us(2025, 1, 22, 0, 48, 12)), ("Fri Feb 11 09:17:12 2022", "UTC", us(2022, 2, 11, 9, 17, 12)),
    ("1698715225", None, 1698715225000000), ("1698715225818", None, 1698715225818000), (" 2024-05-06 07:08:09 EDT ", BERLIN, us(2024, 5, 6, 11, 8, 9)),
    ("2024-05-06 07:08:09 [America/New_York]", None, us(2024, 5, 6, 11, 8, 9)), ("2024-05-06 07:08:09 America/Sao_Paulo", None, us(2024, 5, 6, 10, 8, 9)),
    ("2024-05-06 07:08:09 +05:30", None, us(2024, 5, 6, 1, 38, 9)), ("2024-05-06T07:08:09-03", None, us(2024, 5, 6, 10, 8, 9)), ("2024/05/06 070809", "UTC", us(2024, 5, 6, 7, 8, 9)),
    ("2023-10-29 02:30:00", BERLIN, us(2023, 10, 29, 2, 30, tz=BERLIN)), ("2023-03-26 02:30:00", BERLIN, us(2023, 3, 26, 3, 30, tz=BERLIN)),
    ("2023-10-29 02:30:00 CET", BERLIN, us(2023, 10, 29, 1, 30)), ("2000-02-29 00:00:00", "UTC", us(2000, 2, 29)), ("1900-01-01 00:00:00", "UTC", us(1900, 1, 1)),
    ("2024-05-06 07:08:09 [Etc/UTC]", BERLIN, us(2024, 5, 6, 7, 8, 9)), ("2024-05-06 07:08:09 Etc/GMT+5", None, us(2024, 5, 6, 12, 8, 9)), ("2024-05-06 07:08:09 Japan", BERLIN, us(2024, 5, 5, 22, 8, 9)),
    ("2024-05-06 07:08:09 EST5EDT", None, us(2024, 5, 6, 11, 8, 9)), ("2024-05-06 07:08:09 [GB-Eire]", None, us(2024, 5, 6, 6, 8, 9)), ("2024-05-06T07:08:09 America/Argentina/Buenos_Aires", None, us(2024, 5, 6, 10, 8, 9)),
    ("2024-05-06 07:08:09 EST", None, us(2024, 5, 6, 12, 8, 9)), ("2024-05-06 07:08:09", "Etc/GMT+5", us(2024, 5, 6, 12, 8, 9)), ("2024-05-06 07:08:09", "Etc/UTC", us(2024, 5, 6, 7, 8, 9)), ("2024-05-06 07:08:09", "Japan", us(2024, 5, 5, 22, 8, 9)),
    ("2024-05-06 07:08:09", "EST", us(2024, 5, 6, 12, 8, 9)), ("2024-05-06 07:08:09", "UTC", us(2024, 5, 6, 7, 8, 9)), ("2024-05-06 07:08:09 SystemV/AST4", None, None),
    *[(bad, BERLIN, None) for bad in ("", "  ", "unknown", "2024", "Mar 2024", "2024-05-06", "07:08:09", "2023-14-19 03:13:53", "2023-02-29 00:00:00", "1900-02-29 00:00:00", "2024-05-06 24:00:00", "2024-05-06 07:60:00", "13/13/2024 7:08 am", "5/6/2024 13:08 am", "2024-05-06 07:08:09 Mars/Base", "2024-05-06 07:08:09 XYZ", "2024-05-06 07:08:09 +19:00", "x" * 100_000, "1" * 100_000)],
    (None, BERLIN, None), ("2024-05-06 07:08:09", None, None), ("2024-05-06 07:08:09", "No/Where", None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
    got = dict(rows(df.select("i", timestamps.utc_micros("t", "z"))))
    assert [(CASES[i][0] and CASES[i][0][:40], got[i]) for i in got] == [(CASES[i][0] and CASES[i][0][:40], CASES[i][2]) for i in got]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2023-10-29 02:30:00", BERLIN)], "t string, z string")
        assert rows(df.select(timestamps.utc_micros("t", "z"))) == [(us(2023, 10, 29, 2, 30, tz=BERLIN),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_start_times(spark):
    m = "rec_id bigint, ord int, path array<string>, key string, value string, is_section boolean, tz_name int, k string"
    data = [
        (1, 0, ["INFO"], "datetimeORIGINAL", "2024-01-02 03:04:05", False), (1, 0, ["INFO"], "datetimeORIGINAL", "2024-01-02 03:04:05", False),
        (1, 1, ["BEXT"], "OriginationDate", "2024_01_02", False), (1, 2, ["bext"], "OriginationTime", "x", False), (1, 3, ["BEXT"], "OriginationTime", "03-04-05", None),
        (2, 1, ["BEXT"], "OriginationDate", "2024-01-02", False), (3, 0, [], "DateCreated", "2024-01-02 03:04:05Z", False), (4, 0, [], "DateCreated", None, False), (5, 0, [], None, "2024-01-02 03:04:05Z", False),
        (6, 0, None, "DateTimeOriginal", "2024-01-02 03:04:05Z", None), (None, 0, [], "DateCreated", "2024-01-02 03:04:05Z", False),
    ]
    md = spark.createDataFrame([(*r, 1, "z") for r in data], m)
    files = spark.createDataFrame([(1, 7, "a"), (1, None, "a"), (1, 7, "a"), (3, 8, "a")], "rec_id bigint, site_id int, value string")
    sites = spark.createDataFrame([(7, BERLIN), (8, None)], "site_id int, tz_name string")
    local, utc = us(2024, 1, 2, 3, 4, 5, tz=BERLIN), us(2024, 1, 2, 3, 4, 5)
    assert rows(timestamps.start_times(md, files, sites)) == sorted([(1, 0, local), (1, 1, local), (3, 0, utc), (6, 0, utc), (None, 0, utc)], key=repr)
    assert rows(timestamps.start_times(md.limit(0), files, sites)) == []
