from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import units

SCHEMA = "row struct<k:string>, series string, position long, text string, source string, documented string"


@pytest.mark.parametrize(
    ("text", "number", "unit"),
    [
        ("123", 123, None), ("１２３", 123, None), ("1,234", 1234, None), (" 9,876字 ", 9876, "char"), ("字数：500", 500, "char"), ("约1.5万字", 1.5, "wan"), ("全文0.5W字", 0.5, "wan"),
        ("12.5k", 12.5, "thousand"), ("3千字", 3, "thousand"), ("70KB", 70, "kilobyte"), ("10 bytes", 10, "byte"), ("8B", 8, "byte"), ("1.2亿", 1.2, "yi"), ("10万1千字", 101000, "char"),
        ("三十一万一千字", 311000, "char"), ("一万零四百五十字", 10450, "char"), ("十万字", 100000, "char"), ("七千七百三十三字", 7733, "char"), ("二十三万", 230000, "char"),
    ],
)
def test_parse(spark, text, number, unit):
    row = spark.createDataFrame([(text,)], "t string").select(units.parse(F.col("t")).alias("p")).first().p
    assert float(row.number) == number and row.unit == unit


@pytest.mark.parametrize("text", [None, "", " ", "-", "未知", "N/A", "暂无", "字", "1,23", "1.2.3", "x" * 5000, "万"])
def test_parse_nothing(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(units.parse(F.col("t")).alias("p")).first().p is None


def rows(spark, *items):
    return spark.createDataFrame([((k,), s, p, t, src, d) for k, s, p, t, src, d in items], SCHEMA)


def found(frame):
    return {r.row.k: r.char_count for r in units.convert(frame).collect()}


def test_written_documented_and_decoded_units(spark):
    frame = rows(
        spark,
        ("written", "w", 1, "70KB", "a", "thousand"),
        ("documented", "w", 2, "35.84", "b", "thousand"),
        ("bare", "w", 3, "36", "c", None),  # only its neighbours tell: about 36 thousand characters
        ("level", "w", 4, "36500", "d", "char"),
    )
    assert found(frame) == {"written": 35840, "documented": 35840, "bare": 36000, "level": 36500}


def test_switch_of_a_device_is_found(spark):
    items = [(f"k{i}", "dev", i, str(3000 + i) if i < 20 else str(3 + i / 1000), "x", None) for i in range(40)]
    counts = found(rows(spark, *items))
    assert all(counts[f"k{i}"] == 3000 + i for i in range(20))
    assert all(counts[f"k{i}"] == 3000 + i for i in range(20, 40))


def test_nulls_repeats_ties_and_empty(spark):
    frame = rows(spark, ("a", None, None, "12字", None, None), ("a", None, None, "12字", None, None), ("b", "s", 1, "5", None, None), ("c", "s", 1, "5", None, None), ("d", "s", None, None, None, None))
    assert sorted((r.row.k, r.char_count) for r in units.convert(frame).collect()) == [("a", 12), ("a", 12), ("b", 5), ("c", 5)]
    assert units.convert(frame.limit(0)).count() == 0
    assert found(frame.withColumn("_unit", F.lit(1)).withColumn("number", F.lit(2)))["a"] == 12


def test_viterbi_equals_exhaustive_search():
    random = np.random.default_rng(1)
    factor = np.log(np.array(list(units.UNITS.values())))
    for _ in range(20):
        n = 4
        value = random.uniform(0, 12, n)
        documented, source, fraction = random.integers(-1, 7, n), random.integers(0, 2, n), random.random(n) < 0.3
        score_of = units.emission(np.full(n, -1), documented, fraction)
        path, _ = units.viterbi(value, score_of, source, np.full(n, units.SPREAD), np.array([True, False, False, False]))

        def score(states):
            total = 0.0
            for i, s in enumerate(states):
                total += units.PRIOR[s] if documented[i] < 0 else (0 if s == documented[i] else units.DOCUMENTED)
                total += units.FRACTION if fraction[i] and s in (0, 4) else 0
                if i:
                    jump = value[i] - value[i - 1] + factor[s] - factor[states[i - 1]]
                    p = units.SWITCH_SAME if source[i] == source[i - 1] else units.SWITCH_OTHER
                    total += np.log(1 - p) if s == states[i - 1] else np.log(p / 6)
                    total -= min(0.5 * (jump / units.SPREAD) ** 2, units.CAP)
            return total

        import itertools

        best = max(itertools.product(range(7), repeat=n), key=score)
        assert abs(score(best) - score(tuple(path))) < 1e-9


def test_pieces_of_a_hot_device_agree_with_the_unbroken_chain(spark):
    draw = np.random.default_rng(4)
    texts = [str(int(v)) if draw.random() < 0.5 else f"{v / 1000:.1f}" if draw.random() < 0.8 else f"{v / 1000:.1f}k" for v in 3000 * np.exp(draw.normal(0, 0.2, 3000))]
    frame = rows(spark, *[(f"k{i}", "hot", i // 2, text, "ab"[i % 2], None) for i, text in enumerate(texts)])
    decoded = [{(r.row.k, r.unit, r.char_count) for r in units.convert(frame, piece).collect()} for piece in (1 << 40, 100, 7)]
    assert len(decoded[0]) == 3000 and decoded[0] == decoded[1] == decoded[2]


def test_distant_readings_of_a_device_are_neighbours(spark):
    month = 30 * 86400 * 10**6
    frame = rows(spark, ("first", "w", 0, "250000", "a", "char"), ("later", "w", month, "26", "b", None), ("last", "w", 5 * month, "27万", "c", None))
    assert found(frame)["later"] == 260000


def test_documentation_yields_to_both_neighbours_only(spark):
    frame = rows(spark, ("a", "w", 1, "30", "s", "wan"), ("odd", "w", 2, "30", "t", "char"), ("b", "w", 3, "30.1", "s", "wan"), ("x", "v", 1, "300000", "s", "char"), ("end", "v", 2, "30", "t", "char"))
    counts = found(frame)
    assert counts["odd"] == 300000 and counts["end"] == 30


def test_withheld_documentation(spark):
    """The chain alone, without what the registry says of a source, finds the unit of bare counts of observed works."""
    from pyspark.sql import functions as F

    from strataloom.plans import problems

    readings = problems.lengths(spark, "/root/testdata/sf0.01").where("row.table_name != 'chapters'").cache()
    told = units.convert(readings)
    alone = units.convert(readings.withColumn("documented", F.when(F.col("row.table_name") == "work_master", F.col("documented"))))
    both = told.withColumnRenamed("unit", "u").join(alone, "row").join(readings.select("row", units.parse(F.col("text")).alias("p")), "row").where("p.unit is null and row.table_name = 'source_observation'")
    n, right = both.agg(F.count(F.lit(1)), F.sum((F.col("u") == F.col("unit")).cast("int"))).first()
    assert n > 300 and right / n >= 0.9, (n, right)
