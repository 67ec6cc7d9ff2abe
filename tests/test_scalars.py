"""Golden cases of the scalar functions."""

from __future__ import annotations

import datetime as dt
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strataloom.functions import dates, scalars
from strataloom.functions.text import squeeze


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(function(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("text", "value"), [("731.48万", 7314800), ("未知", None), ("1,234字", 1234), ("12周", 12), ("1.5", 1), ("2亿", 200000000), (None, None)])
def test_display_number(spark, text, value):
    assert one(spark, text, scalars.display_number) == value


@pytest.mark.parametrize(("text", "value"), [("731.48万字", 7314800), ("1.5字", None), ("12", None)])
def test_exact_display_number(spark, text, value):
    assert one(spark, text, lambda c: scalars.display_number(c, exact=True)) == value


@pytest.mark.parametrize(
    ("url", "value"),
    [("//www.books.example/xuanhuan", None), ("https://www.books.example/book/1010868264/", "1010868264"), ("//m.books.example/info/1010868264", "1010868264"), ("https://www.books.example.evil.invalid/book/1010868264/", None), (None, None), ("not a url", None)],
)
def test_id_from_path(spark, url, value):
    assert one(spark, url, lambda c: scalars.id_from_path(c, "books.example", "/(?:book|info)/([0-9]+)/?")) == value


@pytest.mark.parametrize(("url", "value"), [("http://www.b.example/one.php?novelid=42&x=1", "42"), ("http://www.b.example/one.php?novelid=4a", None), ("http://b.invalid/?novelid=42", None)])
def test_id_from_query(spark, url, value):
    assert one(spark, url, lambda c: scalars.id_from_query(c, "b.example", "novelid")) == value


@pytest.mark.parametrize(("text", "value"), [("１２３", False), ("123junk", False), ("", False), (None, False), ("123", True), ("0123", True)])
def test_digits_only(spark, text, value):
    assert one(spark, text, scalars.digits_only) is value


@pytest.mark.parametrize(
    ("title", "role"),
    [("全文完", "all_text_end_marker_update"), ("正文完结", "main_story_end_marker_update"), ("大结局", "ending_marker_update"), ("12. 完结！", "ending_marker_update"), ("正文完（未完待续）", None), ("完结感言", None), ("第一章", None), (None, None)],
)
def test_ending_role(spark, title, role):
    assert one(spark, title, scalars.ending_role) == role


@pytest.mark.parametrize(("genre", "kind"), [("评论", "non_novel"), ("原创-言情-近代现代-爱情", "novel_like"), ("玄幻", "unresolved"), (None, "unresolved")])
def test_sample_class(spark, genre, kind):
    assert one(spark, genre, scalars.sample_class) == kind


def test_first_filled_and_first_true(spark):
    row = spark.createDataFrame([("  ", "0", "x")], "a string, b string, c string").select(scalars.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("f"), scalars.first_true(F.col("a"), F.col("b"), F.col("c")).alias("t")).first()
    assert (row.f, row.t) == ("0", "  ")


def test_names_urls_and_json(spark):
    assert one(spark, "Ｔhe　《钟》 ①!", scalars.normal_name) == "the钟1"
    assert one(spark, "../b?x=1", lambda c: scalars.join_url(F.lit("https://a.example/p/q/r"), c)) == "https://a.example/p/b?x=1"
    assert one(spark, "https://a.example/p?token=1&b=2&Session=3#f", lambda c: scalars.without_query_keys(c, "token|session")) == "https://a.example/p?b=2"
    assert one(spark, '{"a":1,"a":2}', scalars.has_repeated_keys) is True
    assert one(spark, '{"a":1,"b":2}', scalars.has_repeated_keys) is False
    assert one(spark, "['a', 'b']", scalars.literal_list) == ["a", "b"]
    assert one(spark, "a", scalars.literal_list) == ["a"]
    assert one(spark, None, lambda c: scalars.canonical_json(b=c, a=F.lit(1))) == '{"a":1,"b":null}'
    assert one(spark, " a 　b ", squeeze) == "a b"
    assert one(spark, "作者：某 简介：好书 标签：甜", lambda c: scalars.between_markers(c, "简介：", "标签：")) == "好书"


@pytest.mark.parametrize(("failures", "seconds"), [(1, 30), (2, 60), (4, 240), (5, 3600), (20, 86400)])
def test_backoff(spark, failures, seconds):
    assert one(spark, failures, lambda c: scalars.backoff_seconds(c, F.lit(None)), "int") == seconds
    assert one(spark, failures, lambda c: scalars.backoff_seconds(c, F.lit(7)), "int") == 7


def test_retry_after(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 10, 0, 0))
    assert one(spark, "120", lambda c: scalars.retry_after_seconds(c, now)) == 120
    assert one(spark, "Mon, 01 Jan 2024 10:00:30 GMT", lambda c: scalars.retry_after_seconds(c, now)) == 30
    assert one(spark, "soon", lambda c: scalars.retry_after_seconds(c, now)) is None


@pytest.mark.parametrize(
    ("text", "value"),
    [("更新于2013-9-1", "2013-09-01"), ("2013年9月21日 13:36", "2013-09-21 13:36:00"), ("2013/9/21 3:36:56", "2013-09-21 03:36:56"), ("12013-09-01", None), ("2013-02-30", None), ("2013-09-01 25:00", None), (None, None)],
)
def test_date_value(spark, text, value):
    assert one(spark, text, dates.date_value) == value


def test_labelled_and_single_dates(spark):
    tip = "章节首发时间： 2013-09-21 13:36:56 章节更新时间：2015-01-01 00:00:00"
    assert one(spark, tip, lambda c: dates.date_value(c, "章节首发时间")) == "2013-09-21 13:36:56"
    assert one(spark, "章节首发时间：无 2015-01-01", lambda c: dates.date_value(c, "章节首发时间")) is None
    assert one(spark, ["2020", "2020", None], dates.single_date, "array<string>") == "2020"
    assert one(spark, ["2020", "2021"], dates.single_date, "array<string>") is None


SAME = [("2013-09-21T13:36:56+08:00", "2013-09-21 13:36:56"), ("2013-09-21T05:36:56Z", "2013-09-21 13:36:56"), ("2013", "2013")]
DIFFERENT = [
    ("2013-09-21 13:36:56", "2013-09-21 13:36:57"), ("2013-09-21", "2013-09-21 00:00:00"), ("2013-09-21 13:36", "2013-09-21 13:36:00"), ("2013-09-21 13:36:56.0", "2013-09-21 13:36:56.00"),
    ("2013-09-21 13:36:56", "2013-09-21T13:36:56Z"), ("2013", "2013-01-01"), ("2013-02-30 00:00:00", "2013-03-02 00:00:00"),
]


def test_same_moment_key(spark):
    for pairs, equal in ((SAME, True), (DIFFERENT, False)):
        for a, b in pairs:
            assert (one(spark, a, dates.same_moment_key) == one(spark, b, dates.same_moment_key)) is equal, (a, b)
    assert timezone(timedelta(hours=8)).utcoffset(None) == timedelta(hours=8)
