from __future__ import annotations

import itertools
from types import SimpleNamespace

import numpy as np
import pytest

from strataloom.llm import linkage as L
from strataloom.llm import names as N

KIND = "id string, titles array<string>, authors array<string>, platform string, years array<int>"


@pytest.fixture(scope="module")
def script(spark):
    nouns = [("镜湖", "Mirror Lake"), ("药铺", "Apothecary"), ("灯塔", "Lighthouse"), ("渡口", "Ferry"), ("纸鸢", "Paper Hawk"), ("算盘", "Abacus"), ("冰川", "Glacier"), ("长街", "Long Street")]
    records = [([f"{a}之{b}", f"The {y} of the {x}", f"{p} Zhi {q}"],) for (a, x), p in zip(nouns, PINYIN, strict=True) for (b, y), q in zip(nouns, PINYIN, strict=True) if a != b]
    return N.learn(spark, spark.createDataFrame(records, "names array<string>"))


PINYIN = ["Jinghu", "Yaopu", "Dengta", "Dukou", "Zhiyuan", "Suanpan", "Bingchuan", "Changjie"]


def test_learned_names(script):
    assert script.sounds("长街之镜湖") == ("chang", "jie", "zhi", "jing", "hu")
    assert script.sounds("Changjie Zhi Jinghu") == script.sounds("長街之鏡湖".translate({ord(k): v for k, v in script.simple.items()}))
    assert script.phrase_key("镜湖之灯塔") == script.phrase_key("The Lighthouse of the Mirror Lake") != ""
    assert script.plain("【鏡湖】（全本）") == "镜湖" and script.plain("镜湖…") == "" and script.plain("佚名") == ""
    assert N.continuation("X: Side Story") == N.continuation("X·外传") == "side" and N.continuation("X") == ""
    assert N.pieces('["a", "b, c"]') == ["a", "b", "c", "a, b", "b, c"] and N.pieces(None) == []


@pytest.mark.parametrize("transliterate", [None, lambda text: text[:-1], lambda text: "" if "|" in text else text])
def test_missing_or_broken_rules_are_an_error(transliterate):
    maker = SimpleNamespace(getInstance=lambda rules: SimpleNamespace(transliterate=transliterate))
    icu = SimpleNamespace(text=SimpleNamespace(Transliterator=maker) if transliterate else SimpleNamespace())
    with pytest.raises(RuntimeError, match="ICU"):
        N.base_script(SimpleNamespace(_jvm=SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=icu)))))


RECORDS = [
    ("exact", ["镜湖之灯塔"], ["甲乙丙丁"], "p", [2020]), ("pinyin", ["Jinghu Zhi Dengta"], ["Jia Yibingding"], None, [None]), ("english", ["The Lighthouse of the Mirror Lake"], ["甲乙丙丁"], None, []),
    ("typo", ["镜湖之灯灯塔"], ["甲乙丙丁"], "p", [2021]), ("missing", ["镜之灯塔"], ["甲乙丙丁"], None, []), ("other_author", ["镜湖之灯塔"], ["戊己庚辛"], "p", [2020]), ("side", ["镜湖之灯塔·外传"], ["甲乙丙丁"], "p", [2020]),
    ("other_platform", ["镜湖之灯塔"], ["甲乙丙丁"], "q", [2020]), ("no_author", ["药铺之渡口"], [None], "p", [2015]), ("no_author_far", ["药铺之渡口"], [], "q", [2001]), ("empty", [None], [None], None, [None]),
    ("twins", ["冰川之算盘"], ["子丑寅卯"], None, []),
]
WORKS = [
    ("w1", ["镜湖之灯塔"], ["甲乙丙丁", "佚名"], "p", [2020]), ("w2", ["药铺之渡口"], ["壬癸子丑"], "p", [2015]), ("t1", ["冰川之算盘"], ["子丑寅卯"], "p", [2010]), ("t2", ["冰川之算盘"], ["子丑寅卯"], "p", [2010]),
    ("void", [None, ""], [], None, [None]),
]


def test_links(spark, script):
    found = {(r.record, r.work): r.confidence for r in L.link(spark.createDataFrame(RECORDS, KIND), spark.createDataFrame(WORKS, KIND), script).collect()}
    same = {k for k, v in found.items() if v >= 0.5}
    assert same == {("exact", "w1"), ("pinyin", "w1"), ("english", "w1"), ("typo", "w1"), ("missing", "w1"), ("no_author", "w2"), ("twins", "t1"), ("twins", "t2")}
    assert found["twins", "t1"] <= 0.5 and found["exact", "w1"] > 0.9


def test_translated_title_with_an_author_one_off(spark, script):
    records = [("replaced", ["The Lighthouse of the Mirror Lake"], ["甲乙丙戊"], "p", [2020]), ("missing", ["The Lighthouse of the Mirror Lake"], ["甲丙丁"], None, []), ("two_off", ["The Lighthouse of the Mirror Lake"], ["甲乙戊己"], "p", [2020])]
    found = L.link(spark.createDataFrame(records, KIND), spark.createDataFrame(WORKS, KIND), script).where("confidence >= 0.5").collect()
    assert {(r.record, r.work) for r in found} == {("replaced", "w1"), ("missing", "w1")}


def test_empty_and_extra_columns(spark, script):
    records, works = spark.createDataFrame(RECORDS, KIND), spark.createDataFrame(WORKS, KIND)
    assert L.link(records.limit(0), works, script).count() == 0
    wide = records.selectExpr("*", "1 as left", "2 as key", "3 as class")
    assert L.link(wide, works.selectExpr("*", "4 as right", "5 as n"), script).where("confidence >= 0.5").count() == 8


def test_one_off_and_keys():
    assert L.one_off(("a", "b", "c"), ("a", "c", "c")) and L.one_off(("a", "b", "c"), ("a", "b", "b", "c")) and not L.one_off(("a", "b", "c"), ("c", "b", "a")) and not L.one_off(("a",), ("b",))
    assert set(L.shortened(("a", "b", "c"))) & set(L.shortened(("a", "x", "c")))


def test_proximal_is_the_minimum():
    random = np.random.default_rng(2)
    features = [random.random(200) for _ in range(5)]
    features[1][::3] = -1
    weights, limits = L.unary(*features)
    near = random.uniform(-0.5, 1.5, 200)
    x = L.proximal(weights, limits, near)

    def cost(v):
        return (weights[:, :2] * np.maximum(0, limits[:, :2] - v[:, None])).sum(1) + (weights[:, 2:] * np.maximum(0, v[:, None] - limits[:, 2:])).sum(1) + L.RHO / 2 * (v - near) ** 2

    for other in np.linspace(0, 1, 41):
        assert (cost(x) <= cost(np.full(200, other)) + 1e-6).all()


def test_exclusivity_and_transitivity(spark):
    kind = "left string, right string, alike long, title double, author double, year double, platform double, most double"
    rows = [("r1", "a", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("r1", "b", 1, 1.0, -1.0, 0.8, 0.8, 1.0), ("r2", "c", 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("r3", "c", 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("r4", "d", 3, 1.0, 1.0, 1.0, 1.0, 0.5)]
    found = {(r.left, r.right): r.confidence for r in L.solve(spark.createDataFrame(rows, kind)).collect()}
    assert found["r1", "a"] > 0.6 > found["r1", "b"] and found["r1", "a"] + found["r1", "b"] < 1.1
    assert found["r2", "c"] > 0.9 and found["r3", "c"] > 0.9 and found["r4", "d"] <= 0.5


def test_solution_is_near_the_minimum_of_all_hinges(spark):
    kind = "left string, right string, alike long, title double, author double, year double, platform double, most double"
    rows = [("r1", "a", 1, 0.9, 0.85, 0.5, 1.0, 1.0), ("r1", "b", 1, 1.0, -1.0, 0.8, 0.8, 1.0), ("r2", "a", 1, 1.0, 1.0, 0.1, 1.0, 1.0), ("r3", "b", 1, 1.0, -1.0, 1.0, 1.0, 0.5)]
    report: list = []
    got = {(r.left, r.right): r.confidence for r in L.solve(spark.createDataFrame(rows, kind), residual=0.001, report=report).collect()}
    assert max(report[-1][1:]) <= 0.001 and report[-1][0] < L.ROUNDS
    weights, limits = L.unary(*[np.array([r[i] for r in rows]) for i in (3, 4, 5, 6, 7)])

    def cost(z):
        z = np.array(z)
        own = (weights[:, :2] * np.maximum(0, limits[:, :2] - z[:, None])).sum() + (weights[:, 2:] * np.maximum(0, z[:, None] - limits[:, 2:])).sum()
        return own + L.EXCLUSIVE * max(0, z[0] + z[1] - 1) + L.TRANSITIVE * (abs(z[0] - z[2]) + abs(z[1] - z[3]))  # a group of two: its own value lies between

    least = min(cost(z) for z in itertools.product(np.linspace(0, 1, 21), repeat=4))
    assert cost([got[r[0], r[1]] for r in rows]) <= least + 0.05


def test_a_hot_title_with_authors_meets_by_author_only(spark, script):
    names = ["".join(x) for x in list(itertools.product("甲乙丙丁戊己庚辛壬癸子丑寅卯", repeat=3))[:2700:3]]
    works = spark.createDataFrame([(f"w{i}", ["镜湖之灯塔"], [n], None, []) for i, n in enumerate(names)], KIND)
    records = spark.createDataFrame([(f"x{i}", ["镜湖之灯塔"], [n], None, []) for i, n in enumerate(names)], KIND)
    found = L.link(records, works, script).where("confidence >= 0.5").collect()
    best = {r.record: r.work for r in sorted(found, key=lambda r: r.confidence)}
    assert sum(best.get(f"x{i}") == f"w{i}" for i in range(len(names))) >= 0.9 * len(names)
