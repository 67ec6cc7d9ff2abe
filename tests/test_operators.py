"""Chapters, matching, orders, audits, events, pages, files and streams on small inputs."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import scalars
from strataloom.operators import audit, chapters, coverage, events, match, order
from strataloom.sources import files, pages


def window(spark, titles, status="连载"):
    rows = spark.createDataFrame([("w", i, t) for i, t in enumerate(titles, 1)], "w string, p int, t string")
    return chapters.windows(rows, "w", "p", "t", F.lit(""), spark.createDataFrame([("w", status)], "w string, status string")).first()


def test_main_text_windows(spark):
    r = window(spark, ["序章", "正文完结", "番外：多年以后"])
    assert (r.main_start, r.main_end, r.last, r.end_basis) == (1, 2, 3, "explicit_main_text_title")
    assert window(spark, ["一", "正文完", "正文完结"]).end_basis == "ambiguous_ending_titles"
    assert window(spark, ["一", "正文完", "正文完结"]).main_end is None
    assert window(spark, ["公告", "一", "二", "番外"]).end_basis == "before_trailing_auxiliary_titles"
    assert window(spark, ["一", "二"], "完本").main_end == 2
    assert window(spark, ["一", "二"]).end_basis == "no_ending_marker_or_completed_status"
    assert window(spark, ["公告"]).end_basis == "unresolved"


def test_islands(spark):
    rows = spark.createDataFrame([("k", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 0, 1])], "k string, p int, f int").withColumn("f", F.col("f") == 1)
    assert sorted((r.start, r.end, r.length) for r in chapters.islands(rows, "k", "p", "f").collect()) == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]


def test_title_links(spark):
    records = spark.createDataFrame([("r1", ["a"], ["x"], None, ""), ("r2", ["b"], [], None, ""), ("r3", ["c"], [], None, ""), ("r4", ["d"], [], None, "slug"), ("r5", ["b"], [], "p2", ""), ("r6", [], [], None, "")], "record string, names array<string>, authors array<string>, platform string, alias string")
    works = spark.createDataFrame([("w1", "a", "x", "p1"), ("w2", "b", "y", "p1"), ("w3", "b", "z", "p2"), ("w4", "d", "", "p1")], "work string, title string, author string, platform string")
    cross = spark.createDataFrame([("slug", "w4")], "alias string, work string")
    found = {r.record: (r.how, r.work) for r in match.title_links(records, works, cross).collect()}
    assert found == {"r1": ("exact_title_author", "w1"), "r2": ("ambiguous_title", None), "r3": ("not_matched", None), "r4": ("dual_title_crosswalk", "w4"), "r5": ("unique_title_only_candidate", "w3"), "r6": ("not_matched", None)}


def test_orders(spark):
    frame = spark.range(10).select("id")
    assert sorted(r.id for r in order.circular(frame, ["id"], 8, 4).collect()) == [0, 1, 8, 9]
    assert order.circular(frame.limit(0), ["id"], 3, 2).count() == 0
    assert [r.id for r in order.evenly(spark.range(100), ["id"], 5).orderBy("id").collect()] == [0, 25, 50, 74, 99]
    sample = order.hash_sample(spark.range(100), "id", 10, 7)
    assert sample.count() == 10 and abs(sample.first().probability - 9 / 99) < 1e-12
    numbered = order.numbered(spark.range(1000).repartition(7), [F.desc("id")], "i").collect()
    assert all(r.i == 999 - r.id for r in numbered)


def test_audits(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert audit.unique(frame, "f", ["k"]).first().n == 1
    assert audit.holds(frame, "v", F.col("v") == "a").first().n == 1
    assert {r.side: r.rows for r in audit.same_bag(frame, frame.distinct()).collect()} == {"left": 1, "right": 0}
    assert audit.same_bag(frame, frame.select("v", "k")).first().side == "schema"
    assert audit.lost_rows(frame, frame.distinct()).count() == 0
    seen = spark.createDataFrame([("p", 1, ["a", "b"]), ("p", 2, ["a", "b"]), ("p", 1, ["a", "b"]), ("q", 3, ["a", "b"])], "part string, page int, ids array<string>")
    assert [tuple(r) for r in audit.repeated_pages(seen, "part", "page", "ids").collect()] == [("p", 2, 1)]
    assert coverage.gate(spark.createDataFrame([], "check string, passed boolean")).first().passed is False
    with pytest.raises(ValueError, match="'z'"):
        coverage.require(frame, ["k", "z"])


def test_events(spark):
    log = spark.createDataFrame([("j1", 1, "failed"), ("j1", 2, "finished"), ("j1", 3, "failed"), ("j2", 4, "failed"), ("j3", 5, "failed")], "job string, id int, e string").withColumn("kind", F.lit("k"))
    failed, reset = F.col("e") == "failed", F.col("e").isin("finished", "requeued")
    assert {r.job: r.failures for r in events.episode(log, "job", "id", failed, reset).collect()} == {"j1": 1, "j2": 1, "j3": 1}
    r = events.circuits(log, ["kind"], "job", "id", failed, reset).first()
    assert (r.jobs, r.is_open) == (3, True)
    requests = spark.createDataFrame([("p", 1, 0.0, 5.0, None), ("p", 2, 1.0, 5.0, 20.0), ("p", 3, 2.0, 5.0, None)], "p string, i int, now double, delay double, blocked double")
    assert [x.slot for x in events.reservations(requests, "p", "i", "now", "delay", "blocked").orderBy("i").collect()] == [0.0, 20.0, 25.0]


PAGE = """<html><body><table><tr><td>1</td><td><a href="/book/12?x=1">甲</a></td><td>A&amp;B</td></tr><tr><td>short</td></tr></table>
<a href="/book/12">甲（新）</a><a href="/book/7">乙</a><p>共9页 当前为第2页</p><p>2024年3月1日</p><span class="bookcell">2020-01-01</span>
<script type="application/ld+json">{"@type": "Book", "@id": "b1", "name": "甲"}</script><script id="state">{"books": [{"id": 1}]}</script></body></html>"""


def test_pages(spark):
    assert pages.table_rows(PAGE, 3) == [["1", "甲", "A&B"]]
    assert pages.page_position(PAGE) == (2, 9)
    assert pages.links(PAGE, r"/book/(\d+)") == [("12", "甲（新）"), ("7", "乙")]
    assert pages.json_ld(PAGE, ("Book",)) == [{"@type": "Book", "@id": "b1", "name": "甲"}]
    assert pages.embedded_state(PAGE, "state") == {"books": [{"id": 1}]} and pages.embedded_state(PAGE, "none") is None
    assert pages.issue_date(PAGE, "bookcell") == "2024-03-01" and pages.issue_date(PAGE, "other") is None
    assert pages.is_challenge("<p>请登录后继续</p>") and not pages.is_challenge(PAGE)
    assert pages.agrees([{"id": 1}], [{"id": "1"}], ["id"]) and not pages.agrees([], [], ["id"])
    tree = {"vs": [{"vN": "卷一", "cs": [{"id": 1}, {"id": 2}]}, {"vN": "卷二", "cs": [{"id": 3}]}]}
    assert [(v, c["id"]) for v, c in pages.flatten(tree)] == [("卷一", 1), ("卷一", 2), ("卷二", 3)]
    with pytest.raises(ValueError, match="b1"):
        pages.json_ld(PAGE.replace("</body>", '<script type="application/ld+json">{"@type": "Book", "@id": "b1", "name": "乙"}</script></body>'), ("Book",))
    frame = spark.createDataFrame([("u1", PAGE), ("u2", None), ("u3", "")], "url string, html string")
    found = pages.parse(frame, "html", lambda h: [{"id": i, "name": n} for i, n in pages.links(h, r"/book/(\d+)")], "id string, name string", ("url",))
    assert [tuple(r) for r in found.collect()] == [("u1", "12", "甲（新）"), ("u1", "7", "乙")]


def test_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes('id,名\n1,"甲,\n乙"\n2,\n'.encode("utf-8-sig"))
    (tmp_path / "csv" / "b.csv").write_bytes("id,地\n3,北京\n".encode("gb18030"))
    rows = files.read_csv_any(spark, str(tmp_path / "csv")).orderBy("id").collect()
    assert [(r["id"], r["名"], r["地"]) for r in rows] == [("1", "甲,\n乙", None), ("2", None, None), ("3", None, "北京")]
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n{broken\n{"a": "2"}\n')
    schema = T.StructType([T.StructField("a", T.StringType())])
    assert files.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema).where("a is not null").count() == 2
    kept = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema, "keep").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    for i, text in enumerate(['[{"a": "1"}]', '{"books": [{"a": "2"}]}', '{"k": {"a": "3"}}']):
        (tmp_path / f"d{i}.json").write_text(text)
    found = [files.read_json_document(spark, str(tmp_path / f"d{i}.json"), schema, "books" if i == 1 else None).first().a for i in range(3)]
    assert found == ["1", "2", "3"]
    with sqlite3.connect(tmp_path / "s.sqlite") as c:
        c.execute("create table t (x integer, y text)")
        c.execute("insert into t values (1, null)")
    assert [tuple(r) for r in files.read_sqlite(spark, str(tmp_path / "s.sqlite"), "t").collect()] == [("1", None)]
    with pytest.raises(ValueError, match="no table"):
        files.read_sqlite(spark, str(tmp_path / "s.sqlite"), "u")


def test_manifest_and_verification(spark, tmp_path):
    for name, content in (("a.txt", b"1"), ("b.txt", b"1"), ("c.txt", b"2")):
        (tmp_path / name).write_bytes(content)
    found = files.manifest(spark, str(tmp_path), "*.txt")
    known = found.where("name = 'c.txt'").select("sha256")
    fresh = files.new_files(found, known, F.when(F.col("name").endswith(".txt"), "text"))
    assert [r.name for r in fresh.collect()] == ["a.txt"]
    one = found.where("name = 'a.txt'").first().sha256
    log = spark.createDataFrame([("a.txt", 200, None, 1, "old"), ("a.txt", 200, None, 2, one), ("a.txt", 500, None, 3, "bad"), ("b.txt", 200, "x", 1, one)], "file string, status int, error string, seq int, sha256 string")
    assert {r.name: r.is_verified for r in files.verified(found, log).collect()} == {"a.txt": True, "b.txt": False, "c.txt": False}
    assert files.git_blob_hash(b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_snapshots_are_read_whole(spark, tmp_path):
    folder = str(tmp_path / "snap")
    frame = spark.range(3)
    files.write_snapshot({"t": frame}, folder)
    files.write_snapshot({"t": spark.range(5)}, folder)
    assert files.read_snapshot(spark, folder)["t"].count() == 5
    assert json.loads(files.schema_document({"t": frame}))["t"]["fields"][0]["name"] == "id"


def test_split_composite(spark):
    row = spark.createDataFrame([("a-b-c",), ("a-b-c-d-e",)], "g string").select(*scalars.split_composite(F.col("g"), ["w", "x", "y", "z"])).collect()
    assert [tuple(r) for r in row] == [("a", "b", "c", None), (None,) * 4]


def test_names_to_be_escaped_and_every_user(spark, tmp_path):
    import json

    from strataloom.plans import further, shaping

    works = [("a", 'Say "N/A"', "x\\y"), ("b", None, "plain"), ("c", "t/u", None)]
    spark.createDataFrame(works, "work_key string, title string, author string").write.parquet(f"{tmp_path}/work_master.parquet")
    found = {r.work_key: json.loads(r.j) for r in shaping.QUERIES["f17_canonical_json"](spark, str(tmp_path)).collect()}
    assert found == {k: {"author": author, "title": title} for k, title, author in works}
    events = [(1, "error", 3, "1"), (2, "error", 4, "x1"), (3, "error", 5, "x"), (4, "view", 3, "1")]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in further.QUERIES["t15_requeued"](spark, str(tmp_path)).collect()} == {1, 2}


def test_running_aggregates_in_blocks_equal_one_window(spark):
    import random

    from pyspark.sql import Window

    draw = random.Random(6)
    rows = [(draw.choice(["a", "b", None]), i * 7 - 300, draw.choice([None, 1.0, 2.5, -3.0])) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, o long, v double")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    for total in (F.sum, F.max):
        want = {r.o: r.x for r in frame.withColumn("x", total("v").over(w)).collect()}
        got = {r.o: r.x for r in order.preceding(frame, ["k"], "o", F.col("v"), total, "x", block=100).collect()}
        assert got == want
    assert order.preceding(frame.limit(0), ["k"], "o", F.col("v"), F.sum, "x").count() == 0


def test_numbered_in_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    found = order.numbered(rows, ["v"], "n").where("n != v").count()
    assert found == 0


def test_a_record_with_several_names_of_one_work(spark):
    records = spark.createDataFrame([("r", ["a", "b"], ["x"], None, "1"), ("s", ["a"], [], "p", "2"), ("t", ["c"], [], "q", None), ("u", ["c"], [], None, "7"), ("v", [], [], None, None)], "record string, names array<string>, authors array<string>, platform string, alias string")
    works = spark.createDataFrame([("w1", "a", "x", "p"), ("w1", "b", "x", "p"), ("w2", "c", "", "p"), ("w2", "c", "", "q"), ("w3", "c", "", "p")], "work string, title string, author string, platform string")
    found = {r.record: (r.how, r.work) for r in match.title_links(records, works, spark.createDataFrame([("2", "w1")], "alias string, work string")).collect()}
    assert found == {"r": ("exact_title_author", "w1"), "s": ("dual_title_crosswalk", "w1"), "t": ("unique_title_only_candidate", "w2"), "u": ("ambiguous_title", None), "v": ("not_matched", None)}


def test_sqlite_in_ranges_views_and_copies(spark, tmp_path):
    for name in ("a.sqlite", "copy.sqlite"):
        with sqlite3.connect(tmp_path / name) as c:
            c.execute("create table t (x integer, y text)")
            c.executemany("insert into t values (?, ?)", [(i, None if i % 3 == 0 else f"v{i}") for i in range(25)])
            c.execute("create view v as select x from t where x > 20")
            c.execute('create table "o""dd" (k text primary key) without rowid')
    (tmp_path / "copy.sqlite").write_bytes((tmp_path / "a.sqlite").read_bytes())
    path = str(tmp_path / "a.sqlite")
    rows = files.read_sqlite(spark, path, "t", slice_rows=4)
    assert {(int(r.x), r.y) for r in rows.collect()} == {(i, None if i % 3 == 0 else f"v{i}") for i in range(25)} and rows.count() == 25
    found = files.read_sqlite_folder(spark, str(tmp_path))
    assert set(found) == {"t", "v", 'o"dd'} and found["t"].count() == 25 and found["v"].count() == 4 and found['o"dd'].count() == 0


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("2", "乙"), ("1", "甲")], "id string, name string")
    files.write_csv(frame, str(tmp_path / "csv"), ["id"], mark=True)
    heads = [p.read_bytes()[:3] for p in (tmp_path / "csv").glob("*.csv") if p.stat().st_size]
    assert heads and all(h == b"\xef\xbb\xbf" for h in heads)
    folder = str(tmp_path / "snap")
    files.write_snapshot({"t": frame}, folder, "gzip", "json")
    assert list((tmp_path / "snap").glob("*/t/*.json.gz"))
    back = files.read_snapshot(spark, folder)
    assert back["t"].schema == frame.schema and sorted(r.id for r in back["t"].collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="holds the input"):
        files.write_snapshot(back, folder)
    files.write_snapshot({"t": back["t"].where("id = '1'")}, folder, apart=False)
    files.views(files.read_snapshot(spark, folder))
    assert spark.sql("select count(*) from t").first()[0] == 1
    first, again = files.summary_document({"t": frame}).first(), files.summary_document({"t": frame.sort("id").repartition(3)}).first()
    assert first == again and (first.name, first.rows, first.columns) == ("t", 2, 2)
    assert files.summary_document({"t": frame.limit(1)}).first().content != first.content


def test_strict_object_and_malformed_lines(spark, tmp_path):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ("{",), (None,), ("[1]",)], "j string").select(scalars.strict_object(F.col("j"), "a int").alias("o")).collect()
    assert [r.o.a if r.o else None for r in rows] == [1, None, None, None, None]
    (tmp_path / "bad.jsonl").write_text('{"a": "1"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), T.StructType([T.StructField("a", T.StringType())]), "fail").collect()
