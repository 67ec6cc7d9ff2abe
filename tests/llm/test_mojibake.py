from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from strataloom.llm import mojibake as M

WORDS = ["药铺", "枫林", "月台", "蜃楼", "镜湖", "雾港", "灯塔", "古井", "渡口", "纸鸢", "算盘", "丹炉", "旧账", "夜航", "银杏", "浮桥", "信鸽", "冰川", "漆盒", "寒山"]
LATIN = ["Forêt élémentaire", "Canção às Três", "Brücke für Zwölf", "Légende del Año", "Château à Minuit", "Señor von Süden"]


@pytest.fixture(scope="module")
def model():
    titles = [f"{a}外的{b}{c}" for a in WORDS for b in WORDS for c in WORDS[:6]] + [f"我在{a}守{b}" for a in WORDS for b in WORDS] + [f"他盯着{a}看了半晌，忽然想起{b}的事。" for a in WORDS for b in WORDS]
    return M.fit(titles + LATIN * 60)


CHAINS = [("utf-8", "latin_1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "koi8_r"), ("gb18030", "latin_1"), ("utf-8", "gb18030"), ("gb18030", "big5")]


def garble(text, written, read):
    data = text.encode(written)
    if read in M.SINGLE:
        back = {b: c for c, b in M._TABLES[read].items()}
        return "".join(back[b] for b in data)
    return data.decode(read, "replace")


@pytest.mark.parametrize(("written", "read"), CHAINS)
def test_chains_are_undone_or_lost(model, written, read):
    restored = lost = 0
    for a, b in zip(WORDS, WORDS[5:] + WORDS[:5], strict=True):
        text = f"我在{a}守{b}"
        found = model.restore(garble(text, written, read))
        restored += found == text
        lost += found == ""
        if M.LOST in garble(text, written, read):
            assert found == ""
        else:
            assert found == text, (text, garble(text, written, read), found)
    assert restored + lost == len(WORDS)


def test_two_steps_and_parts(model):
    twice = garble(garble("我在灯塔守渡口", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert model.restore(twice) == "我在灯塔守渡口"
    part = "他盯着灯塔看了" + garble("半晌，忽然想起", "utf-8", "latin_1") + "渡口的事。"
    assert model.restore(part) == "他盯着灯塔看了半晌，忽然想起渡口的事。"
    assert model.restore(garble("Canção às Três", "utf-8", "cp1252")) == "Canção às Três"


@pytest.mark.parametrize("text", ["我在灯塔守渡口", "Forêt élémentaire", "plain", "☆月台", "①纸鸢", "", "１２３字", "𠮷野家", "Ω"])
def test_clean_texts_stay(model, text):
    assert model.restore(text) is None


@pytest.mark.parametrize("written", M.WRITTEN)
def test_shapes_refuse_no_valid_bytes(written):
    pieces = [bytes([a, *rest]) for a in range(256) for rest in [(), *((b,) for b in range(256)), (0x81, 0xBF), (0x30, 0x81, 0x30), (0xBF, 0x80, 0x80)]]
    valid = [p for p in pieces if p.decode(written, "ignore").encode(written, "ignore") == p]
    assert len(valid) > 128 and all(M._decode(p, written) == M._decoded(p, written) == p.decode(written) for p in valid)
    assert M._decode(b"\xe4\xb8\x81\x81"[: 3 + (written != "utf-8")] + b"\x81", written) is None


def test_json_members():
    assert M.json_texts('{"a": {"b": ["x", {"c": "y"}]}, "d": 1}') == [("b", "x"), ("c", "y")]
    assert M.json_texts('{"a": "x", "b": ["y", "z"], "c": "cut of') == [("a", "x"), ("b", "y"), ("b", "z")]
    assert M.json_texts("") == M.json_texts("nonsense") == []


def test_column_with_nulls_long_texts_repeats_and_empty(spark, model):
    bad = garble("我在灯塔守渡口", "utf-8", "latin_1")
    rows = [((str(i),), "title", t) for i, t in enumerate([bad, bad, None, "", "我在灯塔守渡口" * 2000, garble("我在灯塔守渡口" * 300, "utf-8", "latin_1"), "x" + M.LOST])]
    frame = spark.createDataFrame(rows, "row struct<k:string>, field string, text string")
    found = {r.row.k: r.restored_text for r in M.restore(frame.withColumn("restored_text", frame["text"]), model, False).collect()}
    assert found == {"0": "我在灯塔守渡口", "1": "我在灯塔守渡口", "5": "我在灯塔守渡口" * 300, "6": ""}
    assert M.restore(frame.limit(0), model, False).count() == 0
    assert M.fit([]).restore("我在") is None


def test_fit_over_all_texts_has_what_a_sample_lacks(spark):
    texts = [f"我在{a}守{b}" for a in WORDS for b in WORDS] + ["他在灯塔守麒麟", "我在渡口守麒麟", "他在麒麟守古井", "我守麒麟"] + ["我在灯塔守渡口"] * 5000
    frame = spark.createDataFrame([(t,) for t in [*texts, None, "", garble("我在灯塔守渡口", "utf-8", "latin_1")]], "text string")
    found = M.texts_of(frame, "text", json_column=False)
    assert found.distinct().count() == len(set(texts))  # the damaged text has control characters
    model, whole = M.fit_all(found, 5), M.fit(sorted(set(texts)))
    assert "麒" in model.alphabet and model.costs["麒"] < M.UNSEEN
    assert model.alphabet == whole.alphabet and model.costs == pytest.approx(whole.costs)
    assert model.restore("我在灯塔守麒麟") is None and model.restore(garble("我在灯塔守麒麟", "utf-8", "latin_1")) == "我在灯塔守麒麟"


def test_dictionaries_hold_what_all_texts_repeat(spark):
    texts = [f"我在{a}守{b}" for a in WORDS for b in WORDS] + [f"他盯着{a}看了半晌，忽然想起{b}的事。" for a in WORDS for b in WORDS] + [f"The {a} of {b}" for a in range(30) for b in "abc"] + LATIN
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    models = [M.fit_all(M.texts_of(frame.repartition(n), "text", json_column=False), 6) for n in (1, 7)]
    assert models[0].dictionaries == models[1].dictionaries  # neither tasks nor hashes choose
    # 5 or 12,000 texts of a group, by hash, are no longer what a dictionary is made of: each word is in 78 texts.
    assert all(word.encode() in models[0].dictionaries["zh-hans"] for word in [*WORDS, "我在", "他盯着", "看了半晌，忽然想起"])


def test_patterns_and_segments_against_exhaustive_counts(spark):
    texts = ["药铺外的枫林", "药铺外的灯塔", "药铺", "x" * 5, "é", "长" * 50 + "枫林", *(f"key{i:03}" for i in range(40)), "Forêt élémentaire"]
    by = {t: "ascii" if t.isascii() else M._group(t) for t in texts}
    kept = spark.createDataFrame([(by[t], t) for t in texts], "kind string, text string").repartition(3)

    def slots(data):
        return M._windows(data, np.array([len(data)]), 6)[1].tolist()

    for kind, table in M._tables(kept, 6).items():
        whole = Counter(s for t in texts if by[t] == kind for s in slots(t.encode()))
        assert {int(s): int(table[s]) for s in np.flatnonzero(table)} == whole
        pieces = [p for t in texts if by[t] == kind for p in M._cut(t.encode())]
        assert all(t.encode()[i : i + 6] in b"|".join(pieces) for t in texts if by[t] == kind for i in range(len(t.encode()) - 5))
        usual = sorted(whole, key=lambda slot: (-whole[slot], slot))[: M._room(sum(whole.values())) // 6]
        best = [max((sum(whole[s] for s in set(slots(p)) & set(usual)) / len(p), p) for p in pieces if slot in slots(p))[1] for slot in usual]
        assert M._segments(kept, 6)[0][kind] == sorted(best)


def test_texts_of_json(spark):
    frame = spark.createDataFrame([('{"a": "x", "b": ["y", "\\ud800"]}',), ('{"a": "x", "b": "cut of',), (None,)], "text string")
    assert sorted({r.text for r in M.texts_of(frame, "text", json_column=True).collect()}) == ["x", "y"]
    assert M.fit_all(M.texts_of(frame.limit(0), "text", json_column=False), 5).restore("我在") is None
