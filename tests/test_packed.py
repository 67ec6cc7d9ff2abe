from __future__ import annotations

import pytest

from strataloom.operators import packed

SCHEMA = "row struct<k:string>, field string, text string"
TAGS = ["系统", "重生", "星际", "美食", "校园", "武侠", "冒险", "仙侠", "系统;任务流", "1v1, 双洁"]


def corpus():
    lists = [str([a, b]) for a in TAGS for b in TAGS if a != b]
    return lists + ["系统;重生", "美食,校园,武侠", "冒险 / 仙侠", "星际、校园", "武侠|冒险"] * 4


def found(spark, texts):
    background = [((f"c{i}",), "tags", t) for i, t in enumerate(corpus())]
    asked = [((f"q{i}",), "tags", t) for i, t in enumerate(texts)]
    out = {}
    for r in packed.split(spark.createDataFrame(background + asked, SCHEMA)).collect():
        out.setdefault(r.row.k, []).append((r.item_no, r.item_value))
    return [[v for _, v in sorted(out.get(f"q{i}", []))] for i in range(len(texts))]


def test_segmentations(spark):
    texts = ['"系统;任务流", 重生', "系统;任务流；星际；；校园", "美食, 1v1, 双洁", "星际 校园 武侠", "系统,", '["\\u7cfb\\u7edf", null, " 重生 "]', "['美食', '1v1, 双洁']", '"a ""b"" c" | "d"', "星际\n校园"]
    assert found(spark, texts) == [["系统;任务流", "重生"], ["系统;任务流", "星际", "校园"], ["美食", "1v1, 双洁"], ["星际", "校园", "武侠"], ["系统"], ["系统", "重生"], ["美食", "1v1, 双洁"], ['a "b" c', "d"], ["星际", "校园"]]


def test_nulls_blanks_repeats_long_and_empty(spark):
    long = "、".join(["校园", "武侠"] * 600)
    assert found(spark, [None, "", "   ", ";;", long]) == [[], [], [], [], ["校园", "武侠"] * 600]
    frame = spark.createDataFrame([(("a",), "tags", "校园、武侠")] * 3, SCHEMA)
    assert packed.split(frame).count() == 2
    assert packed.split(frame.limit(0)).count() == 0
    assert packed.split(frame.selectExpr("*", "1 as values", "2 as found", "3 as n")).count() == 2


@pytest.mark.parametrize(("text", "values"), [('["a", 1]', ["a", "1"]), ("['it\\'s']", ["it's"]), ("[1, [2]]", None), ("[broken", None), ("plain", None)])
def test_read_list(text, values):
    assert packed.read_list(text) == values


def test_quoted_spans_are_atomic():
    assert packed.tokens('"a, b", c') == [("a, b", True, ","), (" c", False, "")]
    assert packed.tokens('say "hi" now') == [('say "hi" now', False, "")]


def test_many_kinds_of_delimiters_and_many_blanks(spark):
    kinds = "系统,重生；星际|美食、校园/武侠;冒险，仙侠"
    spaced = " ".join(["星际", "校园", "武侠"] * 20)
    assert found(spark, [kinds, spaced]) == [["系统", "重生", "星际", "美食", "校园", "武侠", "冒险", "仙侠"], ["星际", "校园", "武侠"] * 20]


def test_a_hot_shape(spark):
    rows = [((f"h{i}",), "tags", "系统、重生" if i % 2 else "星际,美食") for i in range(3000)]
    assert packed.split(spark.createDataFrame(rows, SCHEMA)).count() == 6000
