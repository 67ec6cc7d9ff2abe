"""Subject areas of documents: averaged word and subword embeddings with one logistic output for each subject.

A text becomes a bag of hashed features: words (Latin words; pairs and triples of Han characters, which stand for words
in text without blanks) and subwords (single Han characters, pieces of Latin words). Its vector is the average of the
features' embeddings, over the whole text. Training is synchronous: in every round each partition computes the
gradient of its labelled documents, the driver adds the gradients and makes one step, and the new parameters go out.
Every document is then scored, each on its own, without a shuffle.

Memory: gradients have at most a fixed size (``BUCKETS`` x ``SIZE``), so what reaches the driver in a round is bounded by
the number of training partitions (the session's parallelism, at most ``PARTS``), whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.names import base_script
from strataloom.session import checkpoint_dir

BUCKETS, SIZE = 1 << 16, 16
#: Training: partitions at most, rounds, step, decay of weights; labelled documents that are used, about; share held out for the thresholds.
PARTS, ROUNDS, STEP, SHRINK, LABELLED, HELD = 16, 60, 0.08, 1e-6, 20_000, 0.15
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def bag(texts: list[str], fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, feature, count) of every distinct feature of every text; ``fold`` maps code points."""
    joined = "\x00".join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) == 0:
        return (np.zeros(0, np.int64),) * 3
    document = np.cumsum(codes == 0)
    if fold is not None:
        codes = np.where(codes < len(fold), fold[np.minimum(codes, len(fold) - 1)], codes)
    c = codes.astype(np.uint64)
    han = (codes >= 0x3400) & (codes <= 0x9FFF) | (codes >= 0xF900) & (codes <= 0xFAFF)
    letter = ~han & ((codes >= 97) & (codes <= 122) | (codes >= 0xC0) & (codes <= 0x24F))
    docs, feats = [document[han]], [_mix(c[han] + np.uint64(1 << 40))]
    for n, salt in ((2, 2 << 40), (3, 3 << 40)):
        if len(c) >= n:
            whole = np.logical_and.reduce([han[i : len(han) - n + 1 + i] for i in range(n)])
            value = np.zeros(len(c) - n + 1, np.uint64)
            for i in range(n):
                value = value * _BASE + c[i : len(c) - n + 1 + i]
            docs.append(document[: len(value)][whole])
            feats.append(_mix(value[whole] + np.uint64(salt)))
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        position = np.arange(len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))[: len(c)] if begin[0] == 0 else np.arange(len(c)) - np.concatenate([np.zeros(begin[0], int), np.repeat(begin, np.diff(np.append(begin, len(c))))])
        power = np.cumprod(np.full(64, _BASE, np.uint64))
        term = np.where(letter, c * power[np.minimum(position, 63)], np.uint64(0))
        word = np.add.reduceat(term, begin)
        # Words count three times: their pieces would outweigh them.
        docs += [document[begin]] * 3
        feats += [_mix(word + np.uint64(4 << 40))] * 3
        n = 5
        padded = np.where(letter, c, np.uint64(1))
        if len(c) >= n:
            inside = np.logical_and.reduce([letter[i : len(letter) - n + 1 + i] for i in range(1, n - 1)])
            value = np.zeros(len(c) - n + 1, np.uint64)
            for i in range(n):
                value = value * _BASE + padded[i : len(padded) - n + 1 + i]
            docs.append(document[1 : len(value) + 1][inside])
            feats.append(_mix(value[inside] + np.uint64(5 << 40)))
    key = np.concatenate(docs).astype(np.int64) * BUCKETS + (np.concatenate(feats) % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


@dataclass
class Model:
    subjects: list[str]
    embeddings: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def scores(self) -> np.ndarray:
        """The part of every feature in every subject's logit."""
        return (self.embeddings @ self.outputs).astype(np.float32)


def _logits(n: int, document: np.ndarray, feature: np.ndarray, count: np.ndarray, scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.zeros((n, scores.shape[1]))
    if len(document):
        first = np.flatnonzero(np.diff(document, prepend=-1))
        total = np.add.reduceat(count, first)
        out[document[first]] = np.add.reduceat(scores[feature] * count[:, None], first) / total[:, None]
    return out + bias


def gradient(document: np.ndarray, feature: np.ndarray, share: np.ndarray, labels: np.ndarray, weight: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over documents of the logistic loss's gradient by embeddings, outputs and bias, and the loss.

    ``share`` is a feature's share in its document.
    """
    embeddings, outputs, bias = model
    n = len(labels)
    vectors = np.zeros((n, embeddings.shape[1]))
    for d in range(embeddings.shape[1]):
        vectors[:, d] = np.bincount(document, embeddings[feature, d] * share, n)
    logits = vectors @ outputs + bias
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    error = (p - labels) * weight[:, None]
    loss = float(-(weight[:, None] * (labels * np.log(p + 1e-12) + (1 - labels) * np.log(1 - p + 1e-12))).sum())
    back = error @ outputs.T
    by_feature = np.stack([np.bincount(feature, back[document, d] * share, BUCKETS) for d in range(embeddings.shape[1])], 1)
    return by_feature, vectors.T @ error, error.sum(0), loss


class Adam:
    def __init__(self, shapes: list[tuple]) -> None:
        self.m, self.v, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0

    def step(self, values: list[np.ndarray], gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(values, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.98**self.t)) + 1e-9)


def start(subjects: int) -> list[np.ndarray]:
    random = np.random.default_rng(7)
    return [random.normal(0, 0.1, (BUCKETS, SIZE)), random.normal(0, 0.3, (SIZE, subjects)), np.full(subjects, -2.0)]


def thresholds(probability: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For every subject the threshold of the best F1 on held-out documents, shrunk to the common one where examples are few."""
    grid = np.linspace(0.15, 0.85, 29)

    def f1(p: np.ndarray, y: np.ndarray) -> np.ndarray:
        hit = np.array([((p >= t) & (y > 0)).sum() for t in grid])
        return 2 * hit / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + (y > 0).sum())

    common = f1(probability, labels)
    return np.array([grid[int(np.argmax(f1(probability[:, k], labels[:, k]) * labels[:, k].sum() + 30 * common))] for k in range(labels.shape[1])]) if len(labels) else np.full(labels.shape[1], 0.5)


def folding(spark: SparkSession) -> np.ndarray | None:
    """Code point to code point: traditional forms to simplified ones."""
    simple = base_script(spark).simple
    if not simple:
        return None
    fold = np.arange(0x10000, dtype=np.uint32)
    fold[[ord(a) for a in simple]] = [ord(b) for b in simple.values()]
    return fold


def rarity(texts: DataFrame, text: str, fold: np.ndarray | None) -> np.ndarray:
    """A weight for every feature, the square of its inverse document frequency's logarithm, from all documents; the mean over occurrences is 1."""
    shared = texts.sparkSession.sparkContext.broadcast(fold)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, uses, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            values = list(batch["text"])
            n += len(values)
            for i in range(0, len(values), 200):
                _, feature, times = bag(values[i : i + 200], shared.value)
                seen += np.bincount(feature, minlength=BUCKETS)
                uses += np.bincount(feature, times, BUCKETS).astype(np.int64)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS + 1), "seen": np.append(seen, n), "uses": np.append(uses, 0)}).query("seen > 0")

    rows = texts.select(F.col(text).alias("text")).where("text is not null").mapInPandas(count, "bucket int, seen long, uses long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("uses").alias("uses")).toPandas()
    seen, uses = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    seen[rows["bucket"]], uses[rows["bucket"]] = rows["seen"], rows["uses"]
    weight = np.maximum(np.log(max(seen[-1], 1) / (seen[:-1] + 1)), 0.05) ** 2
    return weight / max(1e-9, float((weight * uses[:-1]).sum() / max(1.0, uses.sum())))


def shares(texts: list[str], weight: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, feature, share): counts over the document's length, times the feature's weight."""
    document, feature, count = bag(texts, fold)
    length = np.maximum(1, np.bincount(document, count, max(1, len(texts))))
    return document, feature, count * weight[feature] / length[document] if len(document) else np.zeros(0)


def _pack(arrays: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(a, np.float32).tobytes() for a in arrays]


def train(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[Model, np.ndarray, np.ndarray | None]:
    """A model of documents (doc_id, text) and labels (doc_id, subject_code), the feature weights and the folding.

    About ``LABELLED`` labelled documents with a text are used, those whose hash of doc_id lies below a threshold that
    their number gives; the others only count for the weights of features. Of a doc_id with several texts the smallest
    one is used. Labels of unknown subjects and of unknown documents are ignored. Without any
    usable label the model gives no document a subject.
    """
    spark = documents.sparkSession
    checkpoint_dir(spark)
    fold = folding(spark)
    weight = rarity(documents, "text", fold)
    per = labels.where(F.col("subject_code").isin(subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_code")).alias("codes"))
    whole = 1 << 40
    share = min(1.0, LABELLED / max(1, per.count()))
    # About LABELLED rows of an id and its codes: small enough to send out, so that the documents stay where they are.
    used = F.broadcast(per.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < int(share * whole)))
    examples = documents.select("doc_id", "text").where("text is not null").join(used, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("codes").alias("codes"))
    parts_used = max(2, min(PARTS, spark.sparkContext.defaultParallelism))
    examples = examples.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts_used)).cast("int")).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1000)) < int(1000 * HELD))
    tools = spark.sparkContext.broadcast((weight, fold, subjects))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        w, f, names = tools.value
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        document, feature, share = shares(list(pdf["text"]), w, f)
        y = np.array([[s in set(codes) for s in names] for codes in pdf["codes"]], np.float32).reshape(len(pdf), len(names))
        return pd.DataFrame({"part": [int(pdf["part"][0])], "document": [document.astype(np.int32).tobytes()], "feature": [feature.astype(np.int32).tobytes()], "share": [share.astype(np.float32).tobytes()], "labels": [y.tobytes()], "held": [pdf["held"].to_numpy(bool).tobytes()]})

    # One row a part, bounded by LABELLED; written to the shared folder, so that a lost executor costs no more than a read.
    parts = examples.groupBy("part").applyInPandas(encode, "part int, document binary, feature binary, share binary, labels binary, held binary").repartition(parts_used, "part").checkpoint()
    shapes = [(BUCKETS, SIZE), (SIZE, len(subjects)), (len(subjects),)]
    values = start(len(subjects))
    adam = Adam(shapes)

    def unpack(row: pd.Series) -> tuple[np.ndarray, ...]:
        y = np.frombuffer(row["labels"], np.float32).reshape(-1, len(subjects)).astype(float)
        return np.frombuffer(row["document"], np.int32), np.frombuffer(row["feature"], np.int32), np.frombuffer(row["share"], np.float32).astype(float), y, np.frombuffer(row["held"], bool)

    def apply(function, schema: str) -> list:  # noqa: ANN001
        shared = spark.sparkContext.broadcast([v.astype(np.float32) for v in values])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    yield function(unpack(row), tuple(shared.value))

        found = parts.mapInPandas(work, schema).collect()
        shared.destroy()
        return found

    def slope(data: tuple, model: tuple) -> pd.DataFrame:
        document, feature, share, y, held = data
        a, b, c, _ = gradient(document, feature, share, y, (~held).astype(float), model)
        used = np.flatnonzero(np.abs(a).sum(1) > 0).astype(np.int32)
        return pd.DataFrame([[used.tobytes(), *_pack([a[used], b, c]), int((~held).sum())]], columns=["used", "a", "b", "c", "n"])

    def held_out(data: tuple, model: tuple) -> pd.DataFrame:
        document, feature, share, y, held = data
        vectors = np.stack([np.bincount(document, model[0][feature, d] * share, len(y)) for d in range(SIZE)], 1)
        p = 1 / (1 + np.exp(-np.clip(vectors @ model[1] + model[2], -30, 30)))
        return pd.DataFrame([_pack([p[held], y[held]])], columns=["p", "y"])

    for _ in range(ROUNDS):
        grown = [np.zeros(s) for s in shapes]
        n = 0
        for row in apply(slope, "used binary, a binary, b binary, c binary, n long"):
            grown[0][np.frombuffer(row.used, np.int32)] += np.frombuffer(row.a, np.float32).reshape(-1, SIZE)
            grown[1] += np.frombuffer(row.b, np.float32).reshape(shapes[1])
            grown[2] += np.frombuffer(row.c, np.float32)
            n += row.n
        if not n:
            break
        adam.step(values, [g / n + SHRINK * v for g, v in zip(grown, values, strict=True)], STEP)
    rows = apply(held_out, "p binary, y binary")
    p, y = (np.concatenate([np.frombuffer(getattr(r, c), np.float32).reshape(-1, len(subjects)) for r in rows]) if rows else np.zeros((0, len(subjects))) for c in ("p", "y"))
    cut = thresholds(p, y) if len(y) and y.sum() else np.full(len(subjects), 0.5)
    if not rows:
        values[2][:] = -30.0
    return Model(subjects, *values, cut), weight, fold


def assign(documents: DataFrame, model: Model, weight: np.ndarray, fold: np.ndarray | None) -> DataFrame:
    """(doc_id, subject_code, probability) of every subject whose probability reaches its threshold.

    Every document is scored on its whole text, on its own. Null and empty texts, and texts without a letter, have no
    subject. A doc_id that occurs several times is scored as often; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.scores() * weight[:, None].astype(np.float32), model.bias, model.thresholds, model.subjects, fold))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, bias, cut, names, folding = shared.value
        for batch in batches:
            for i in range(0, len(batch), 200):
                piece = batch.iloc[i : i + 200]
                document, feature, count = bag(list(piece["text"]), folding)
                p = 1 / (1 + np.exp(-np.clip(_logits(len(piece), document, feature, count, scores, bias), -30, 30)))
                p[np.bincount(document, minlength=len(piece)) == 0] = 0
                at, k = np.nonzero(p >= cut)
                yield pd.DataFrame({"doc_id": piece["doc_id"].to_numpy()[at], "subject_code": np.array(names, object)[k], "probability": p[at, k]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").where("text is not null and text != ''").mapInPandas(score, f"doc_id {kind}, subject_code string, probability double")
