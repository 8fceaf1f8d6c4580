from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wherry.functions.timestamps import iso_utc, url_host, with_published_utc
from wherry.operators.zones import estimate_zones, normalise_published

SHANGHAI, BERLIN, NEW_YORK, LONDON = "Asia/Shanghai", "Europe/Berlin", "America/New_York", "Europe/London"
CASES = [
    ("2020-11-21 13:49:49", SHANGHAI, "ymd", "2020-11-21T05:49:49.000000Z"),
    ("２０１３－０５－１０ １２：１１：２６", SHANGHAI, "ymd", "2013-05-10T04:11:26.000000Z"),
    ("　2016/04/04 08:52:55 ", SHANGHAI, "ymd", "2016-04-04T00:52:55.000000Z"),
    ("2019-02-26T07:32:58+00:00", SHANGHAI, "ymd", "2019-02-26T07:32:58.000000Z"),
    ("2016-04-10T05:41:45-0300", SHANGHAI, "ymd", "2016-04-10T08:41:45.000000Z"),
    ("2015-02-11T16:17:39.975749+08:00", BERLIN, "dmy", "2015-02-11T08:17:39.975749Z"),
    ("1628916564823", BERLIN, "dmy", "2021-08-14T04:49:24.823000Z"),
    ("1465086624", BERLIN, "dmy", "2016-06-05T00:30:24.000000Z"),
    ("20151009", SHANGHAI, "ymd", "2015-10-08T16:00:00.000000Z"),
    ("20170523132646", SHANGHAI, "ymd", "2017-05-23T05:26:46.000000Z"),
    ("2019年2月26日", SHANGHAI, "ymd", "2019-02-25T16:00:00.000000Z"),
    ("2022年5月30日 下午3:08", SHANGHAI, "ymd", "2022-05-30T07:08:00.000000Z"),
    ("2017年3月10日 上午12:40", SHANGHAI, "ymd", "2017-03-09T16:40:00.000000Z"),
    ("2025年8月11日 下午12:32", SHANGHAI, "ymd", "2025-08-11T04:32:00.000000Z"),
    ("2018年9月17日12:24", SHANGHAI, "ymd", "2018-09-17T04:24:00.000000Z"),
    ("Jun 19, 2016 9:59 PM CST", SHANGHAI, "ymd", "2016-06-19T13:59:00.000000Z"),
    ("Sep 19, 2013 8:40 AM CEST", BERLIN, "dmy", "2013-09-19T06:40:00.000000Z"),
    ("Sun, 02 Aug 2015 07:40:28 +0800", SHANGHAI, "ymd", "2015-08-01T23:40:28.000000Z"),
    ("Tue, 29 Dec 2015 16:57:06 GMT", SHANGHAI, "ymd", "2015-12-29T16:57:06.000000Z"),
    ("2022-10-13 06:38:15 America/New_York", SHANGHAI, "ymd", "2022-10-13T10:38:15.000000Z"),
    ("发布时间：2018-05-28 00:02", SHANGHAI, "ymd", "2018-05-27T16:02:00.000000Z"),
    ("Published: 2021-11-28 01:28", SHANGHAI, "ymd", "2021-11-27T17:28:00.000000Z"),
    ("08/07/2018 13:53", LONDON, "dmy", "2018-07-08T12:53:00.000000Z"),
    ("10/26/2024 21:16", NEW_YORK, "mdy", "2024-10-27T01:16:00.000000Z"),
    ("14.06.2023 01:37", BERLIN, "dmy", "2023-06-13T23:37:00.000000Z"),
    ("2021-10-31 02:30:00", BERLIN, "dmy", "2021-10-31T00:30:00.000000Z"),  # twice: the earlier
    ("2021-03-28 02:30:00", BERLIN, "dmy", "2021-03-28T01:30:00.000000Z"),  # skipped: forward
    ("27/03/2022 01:41", LONDON, "dmy", "2022-03-27T01:41:00.000000Z"),
    ("2021年2月30日", SHANGHAI, "ymd", None), ("99/99/2020", LONDON, "dmy", None), ("0000-00-00 00:00:00", SHANGHAI, "ymd", None), ("2023-13-45", SHANGHAI, "ymd", None),
    ("昨天", SHANGHAI, "ymd", None), ("--", SHANGHAI, "ymd", None), ("", SHANGHAI, "ymd", None), (None, SHANGHAI, "ymd", None), ("x" * 5000, SHANGHAI, "ymd", None), ("2020-01-01 25:00", SHANGHAI, "ymd", None), ("2020-01-01 10:00 Moon/Base", SHANGHAI, "ymd", None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, z string, o string, want string")
    got = with_published_utc(df, "at", F.col("t"), F.col("z"), F.col("o")).select("t", "want", iso_utc(F.col("at")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got if r["got"] != r["want"]] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(1990, 1, 1), datetime(2035, 1, 1)), min_size=1, max_size=40))
def test_agrees_with_zoneinfo(spark, times):
    zones = [SHANGHAI, BERLIN, NEW_YORK, LONDON]
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S"), z) for t in times for z in zones]
    df = spark.createDataFrame(rows, "t string, z string")
    got = with_published_utc(df, "at", F.col("t"), F.col("z"), F.lit("ymd")).select("t", "z", F.unix_seconds("at").alias("s")).collect()
    for r in got:
        local = datetime.strptime(r["t"], "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r["z"]))
        assert r["s"] == int(local.timestamp())


def test_unknown_site_gets_an_estimated_zone(spark):
    rows = [(k, "http://far.example/x", f"2024-05-{d:02d} 20:00:00", datetime(2024, 5, d, 12, 1)) for k, d in enumerate(range(1, 20))]
    records = spark.createDataFrame(rows, "record_no long, url string, published_date string, extracted_at timestamp")
    sites = spark.createDataFrame([], "host string, tz string, date_order string")
    got = normalise_published(records, sites).collect()
    assert len(got) == 19 and got[0]["published_at"].hour == 12
    local = records.select(url_host(F.col("url")).alias("host"), F.col("published_date").alias("local_text"), F.col("extracted_at").alias("seen_at"))
    assert [(r["host"], r["zone"], r["violations"]) for r in estimate_zones(local).collect()] == [("far.example", SHANGHAI, 0)]


@pytest.mark.parametrize("extra", [False, True])
def test_empty_and_extra_columns(spark, extra):
    records = spark.createDataFrame([], "record_no long, url string, published_date string, extracted_at timestamp" + ", tz string, host string" * extra)
    sites = spark.createDataFrame([(None, None, None), ("A.example", "Nowhere", "ymd")], "host string, tz string, date_order string")
    assert normalise_published(records, sites).collect() == []


def test_offsets_of_other_records_tell_the_zone(spark):
    from wherry.operators.zones import estimate_zones

    rows = [("h", f"2019-0{m}-10 08:00:00{z}", "2024-01-01 00:00:00") for m, z in ((1, "-05:00"), (7, "-04:00"), (3, "Z"), (2, ""))] + [("i", "2020-05-01 08:00:00 Asia/Tokyo", "2024-01-01 00:00:00"), ("j", "no date", "2024-01-01 00:00:00"), (None, "2020-05-01", None)]
    df = spark.createDataFrame(rows, "host string, local_text string, seen string").selectExpr("host", "local_text", "cast(seen as timestamp) as seen_at")
    assert {r["host"]: r["zone"] for r in estimate_zones(df).collect()} == {"h": "America/New_York", "i": "Asia/Tokyo"}
    # Records that would be published after they were seen rule zones out where nothing else does.
    late = spark.createDataFrame([("k", "2020-05-01 08:00:00", "2020-05-01 00:10:00"), ("k", "2020-06-01 08:00:00", "2020-06-01 00:00:30")], "host string, local_text string, seen string").selectExpr("host", "local_text", "cast(seen as timestamp) as seen_at")
    assert [(r["zone"], r["violations"]) for r in estimate_zones(late).collect()] == [("Asia/Shanghai", 0)]
