from __future__ import annotations

import pytest

from strataloom.operators import timestamps

CASES = [
    ("2024-01-02 03:04:05", "Asia/Shanghai", None, "2024-01-01T19:04:05.000000Z"),
    ("2024-01-02T03:04:05.123Z", "Asia/Shanghai", None, "2024-01-02T03:04:05.123000Z"),
    ("2024-01-02T03:04:05.123456+08:00", None, None, "2024-01-01T19:04:05.123456Z"),
    ("20240102T030405Z", None, None, "2024-01-02T03:04:05.000000Z"),
    ("20240102030405", "UTC", None, "2024-01-02T03:04:05.000000Z"),
    ("1704164645", None, None, "2024-01-02T03:04:05.000000Z"),
    ("1704164645123", None, None, "2024-01-02T03:04:05.123000Z"),
    ("北京时间 2024-01-02 03:04", "UTC", None, "2024-01-01T19:04:00.000000Z"),
    ("２０２４-０１-０２ ０３:０４", "UTC", None, "2024-01-02T03:04:00.000000Z"),
    ("2024年1月2日 下午3:04", "UTC", None, "2024-01-02T15:04:00.000000Z"),
    ("2024年1月2日 上午12:04", "UTC", None, "2024-01-02T00:04:00.000000Z"),
    ("2024年1月2日3时4分5秒", "UTC", None, "2024-01-02T03:04:05.000000Z"),
    ("02.01.2024 03:04", "UTC", None, "2024-01-02T03:04:00.000000Z"),
    ("1/2/2024 3:04 PM", "America/New_York", True, "2024-01-02T20:04:00.000000Z"),
    ("1/2/2024 03:04:05", "Europe/Berlin", False, "2024-02-01T02:04:05.000000Z"),
    ("13/2/2024", None, True, "2024-02-13"),
    ("2/13/2024", None, False, "2024-02-13"),
    ("Sat, 25 Oct 2014 06:10:09 -0400", None, None, "2014-10-25T10:10:09.000000Z"),
    ("Dec 31, 2021 12:25 PM EST", None, None, "2021-12-31T17:25:00.000000Z"),
    ("2018-10-22 07:26:12 JST", None, None, "2018-10-21T22:26:12.000000Z"),
    ("2022-11-16 20:11:53 UTC-5", None, None, "2022-11-17T01:11:53.000000Z"),
    ("17-Oct-2010", None, None, "2010-10-17"),
    ("24 October 2009", None, None, "2009-10-24"),
    ("Nov 6 2015", None, None, "2015-11-06"),
    ("上架：2023-07-23", None, None, "2023-07-23"),
    ("First published 2009.09.06 08:32", "UTC", None, "2009-09-06T08:32:00.000000Z"),
    ("2024年", None, None, "2024"),
    ("2024/04", None, None, "2024-04"),
    ("20240301", None, None, "2024-03-01"),
    # Clock set back: the earlier instant. Clock set forward: moved by the gap.
    ("2017-11-05 01:30:00", "America/New_York", None, "2017-11-05T05:30:00.000000Z"),
    ("2018-03-11 02:30:00", "America/New_York", None, "2018-03-11T07:30:00.000000Z"),
    # Nothing real.
    (None, "UTC", None, None), ("", "UTC", None, None), ("-", "UTC", None, None), ("待定", "UTC", None, None), ("2021-02-30", None, None, None), ("2019-13-05 10:00", "UTC", None, None),
    ("0000-00-00 00:00:00", "UTC", None, None), ("2024-01-02 25:00:00", "UTC", None, None), ("2024-01-02 03:04:05", None, None, None), ("2024-01-02 03:04:05 XYZ", "UTC", None, None), ("x" * 10000, "UTC", None, None),
]


def test_cases(spark):
    frame = spark.createDataFrame([(i, t, z, m) for i, (t, z, m, _) in enumerate(CASES)], "i int, t string, z string, m boolean")
    found = {r.i: r.normal_time for r in timestamps.normalise(frame, "t", "z", "m").collect()}
    wrong = [(CASES[i], found[i]) for i in range(len(CASES)) if found[i] != CASES[i][3]]
    assert not wrong


def test_clashing_columns_repeats_and_empty(spark):
    frame = spark.createDataFrame([("2024", None, None, "old", 1)] * 2, "t string, z string, m boolean, normal_time string, _t0 int")
    assert [(r.normal_time, r._t0) for r in timestamps.normalise(frame, "t", "z", "m").collect()] == [("2024", 1)] * 2
    assert timestamps.normalise(frame.limit(0), "t", "z", "m").count() == 0


def test_other_session_zone_is_refused(spark):
    frame = spark.createDataFrame([("2024", None, None)], "t string, z string, m boolean")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            timestamps.normalise(frame, "t", "z", "m")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
