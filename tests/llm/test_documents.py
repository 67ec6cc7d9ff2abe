"""Subjects, packing and mixing."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import mixing, packing, subjects, tokens

TERMS = {"law": ["法官", "庭审", "contract"], "sport": ["罚球", "守门员", "racket"], "music": ["钢琴", "和弦", "chord"]}


@pytest.fixture(scope="module")
def corpus(spark):
    random = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(240):
        chosen = [list(TERMS)[i % 3]] + ([list(TERMS)[(i + 1) % 3]] if i % 5 == 0 else [])
        words = [TERMS[s][random.integers(3)] for s in chosen for _ in range(4)]
        docs.append((i, "。".join(f"他盯着{w}看了半晌" for w in words) + "。窗外下着雨。" * int(random.integers(1, 4))))
        labels += [(i, s) for s in chosen]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject_code string")


def test_subjects_are_learned(spark, corpus):
    docs, labels = corpus
    asked = spark.createDataFrame([(1000, "法官说了法官的事，又说庭审。"), (1001, "钢琴和弦钢琴。守门员罚球守门员。"), (1002, None), (1003, ""), (1004, "…"), (1005, "法官庭审" * 20000)], "doc_id long, text string")
    model, weight, fold = subjects.train(docs, labels.where("doc_id < 200").union(spark.createDataFrame([(1, "unknown"), (None, "law"), (99999, "law")], labels.schema)), sorted(TERMS))
    got = defaultdict(set)
    for r in subjects.assign(docs.union(asked).withColumn("subject_code", F.lit("x")), model, weight, fold).collect():
        got[r.doc_id].add(r.subject_code)
    want = defaultdict(set)
    for r in labels.collect():
        want[r.doc_id].add(r.subject_code)
    held = [i for i in range(200, 240)]
    hit = sum(len(got[i] & want[i]) for i in held)
    assert 2 * hit / (sum(len(got[i]) for i in held) + sum(len(want[i]) for i in held)) > 0.9
    assert "law" in got[1000] and got[1005] == {"law"} and not got[1002] and not got[1003] and not got[1004]


def test_no_labels_give_no_subjects(spark, corpus):
    docs, labels = corpus
    model, weight, fold = subjects.train(docs, labels.limit(0), sorted(TERMS))
    assert subjects.assign(docs, model, weight, fold).count() == 0


def test_bag_and_gradient():
    document, feature, count = subjects.bag(["ab 法官", "", "AB ab", "x"])
    assert set(document) == {0, 2, 3} and count[document == 2].sum() == 6
    assert len(subjects.bag([])[0]) == 0
    random = np.random.default_rng(0)
    model = (random.normal(size=(subjects.BUCKETS, subjects.SIZE)), random.normal(size=(subjects.SIZE, 2)), random.normal(size=2))
    d, f, share = np.array([0, 0, 1]), np.array([3, 5, 3]), np.array([0.5, 0.5, 1.0])
    y, w = np.array([[1.0, 0], [0, 1]]), np.ones(2)
    a, b, c, loss = subjects.gradient(d, f, share, y, w, model)
    for array, grad, at in ((model[0], a, (3, 2)), (model[1], b, (1, 1)), (model[2], c, (0,))):
        kept = array[at]
        array[at] = kept + 1e-5
        moved = subjects.gradient(d, f, share, y, w, model)[3]
        array[at] = kept
        assert abs((moved - loss) / 1e-5 - grad[at]) < 1e-3


def test_packing_holds_every_token_once(spark, corpus):
    docs, _ = corpus
    docs = docs.union(spark.createDataFrame([(500, None), (501, ""), (502, "法官庭审" * 3000)], docs.schema))
    sized = tokens.with_tokens(docs, "text")
    weight = subjects.rarity(docs, "text", None)
    out = packing.pack(sized.withColumn("shard", F.lit(9)), [(1, 256), (2, 1024), (3, None)], weight, None).toPandas()
    size = {r.doc_id: r.tokens for r in sized.collect()}
    for spec, capacity in ((1, 256), (2, 1024)):
        part = out[out.spec_id == spec]
        assert part.groupby("container_id").tokens.sum().max() <= capacity
        assert part.groupby("doc_id").tokens.sum().to_dict() == {d: n for d, n in size.items() if n}
        whole = part[part.doc_id.map(size) <= capacity]
        assert whole.groupby("doc_id").size().max() == 1
        pieces = part[part.doc_id == 502].sort_values("start_token")
        assert list(pieces.start_token) == list(np.cumsum([0, *pieces.tokens[:-1]]))
        assert part.tokens.sum() / (part.container_id.nunique() * capacity) > 0.9
    assert packing.pack(sized.limit(0), [(1, 256)], weight, None).count() == 0


def test_neighbours_share_containers(spark):
    rows = [(i, ("法官庭审合同" if i % 2 else "钢琴和弦乐谱") * 8) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sized = tokens.with_tokens(docs, "text")
    size = sized.first().tokens
    out = packing.pack(sized, [(1, size * 4)], subjects.rarity(docs, "text", None), None).toPandas()
    assert (out.groupby("container_id").doc_id.apply(lambda d: len(set(d % 2))) == 1).all()


def test_index_ranks_like_brute_force():
    texts = ["法官庭审", "法官钢琴", "钢琴和弦", "守门员罚球", "法官庭审合同"]
    document, term, count = subjects.bag(texts)
    index = packing.Index(document, term, count, len(texts))
    used = np.zeros(len(texts), bool)
    assert list(index.neighbours(0, used))[0] == 4 and 3 not in index.neighbours(0, used)
    used[4] = True
    assert list(index.neighbours(0, used))[0] == 1


def test_mixture_reaches_the_shares(spark):
    random = np.random.default_rng(8)
    rows = [(i, "tiny" if i % 50 == 0 else "small" if i % 7 == 0 else "odd" if i % 11 == 0 else None if i % 13 == 0 else "big", int(random.integers(1, 300))) for i in range(6000)]
    sized = spark.createDataFrame([*rows, (9001, "big", 0), (9002, "big", None)], "doc_id long, source string, tokens long").withColumn("h", F.lit(1))
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 5), ("absent", 0.05, 2)]
    plans = mixing.plan(sized, targets)
    mixed = mixing.mix(sized, plans)
    repeats = {r.source: r["max(repeats)"] for r in mixed.groupBy("source").max("repeats").collect()}
    assert set(repeats) == {"big", "small", "tiny"} and all(repeats[s] <= {"big": 1, "small": 3, "tiny": 5}[s] for s in repeats)
    report = {r.source: r for r in mixing.shares(sized, mixed, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")).collect()}
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.15)):
        assert abs(report[s].actual_share - share / 0.95) < 0.003
    assert report["absent"].mixed_tokens == 0 and report["absent"].actual_share == 0
    # Some source is used as often as it may be: the mixture can't be larger.
    assert any(abs(report[s].mixed_tokens - n * report[s].available_tokens) < 300 for s, n in (("big", 1), ("small", 3), ("tiny", 5)))
    assert mixing.plan(sized.limit(0), targets) == [] and mixing.mix(sized, []).count() == 0


def test_tokens(spark):
    frame = spark.createDataFrame([("hello world",), (None,), ("",), ("法" * 10000,)], "t string")
    sizes = [r.tokens for r in tokens.with_tokens(frame, "t").collect()]
    assert 2 <= sizes[0] <= 4 and sizes[1:3] == [0, 0] and sizes[3] >= 10000


def test_neighbours_score_like_bm25_over_all_terms():
    random = np.random.default_rng(2)
    texts = ["".join(random.choice(list("法官庭审钢琴和弦罚球"), 12)) for _ in range(30)]
    document, term, count = subjects.bag(texts)
    index = packing.Index(document, term, count, len(texts))
    bags = [dict(zip(term[document == d], count[document == d], strict=True)) for d in range(len(texts))]
    length, df = [sum(b.values()) for b in bags], {t: sum(t in b for b in bags) for t in set(term)}
    usual, n = sum(length) / len(length), len(texts)

    def bm25(query, d):
        parts = [np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * bags[d][t] * 2.2 / (bags[d][t] + 1.2 * (0.25 + 0.75 * length[d] / usual)) for t in bags[query] if t in bags[d] and df[t] > 1]
        return sum(parts)

    assert 0 < sum(x > 16 for x in df.values()) < len(df)
    for seed in (0, 7):
        got = index.scores(seed)
        assert all(abs(got[d] - bm25(seed, d)) < 1e-5 for d in range(n) if d != seed)


def test_shards_cover_all_cells_and_cut_large_ones():
    counts = [(0, 100), (1, 200), (packing.CENTRES, 2000), (2 * packing.CENTRES, 1400), (2 * packing.CENTRES + 1, 5000), (2 * packing.CENTRES + 2, 700)]
    places = packing._shards(counts)
    assert set(places) == {c for c, _ in counts}
    held = {}
    for cell, n in counts:
        first, number = places[cell]
        for s in range(first, first + number):
            held[s] = held.get(s, 0) + n / number
    assert max(held.values()) <= 1.5 * packing.SHARD and places[2 * packing.CENTRES + 1][1] == 4
    assert packing._shards([]) == {}
