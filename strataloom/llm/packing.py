"""Filling containers of fixed capacity with documents that read well together.

Documents are spread over shards by clusters of their weighted terms, so that neighbours meet; the clusters' centres are
fitted on a bounded sample (``FITTED``), every document is assigned. Each shard holds a BM25 inverted index of its
documents. A seed document opens a container; the index returns its unused neighbours, which
fill the window in order of their score while they fit; what then remains is filled with the largest unused items that
fit. A document longer than the capacity is cut: whole windows are containers of their own, and the rest is an item.

Scale: a cluster that holds a third of all documents is cut by the second nearest centre, and by hash where a cell is
still too large; small clusters share a shard. Shards hold about ``SHARD`` documents, each is one task, and nothing is
exchanged between them. The unused space that this costs is at most one open container a shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.subjects import BUCKETS, bag
from strataloom.llm.tokens import VOCABULARY, encoding

#: Documents of a shard, about, half as many more at most; BM25's parameters; terms of more than one in OFTEN documents are frequent.
SHARD, K1, B, OFTEN = 1500, 1.2, 0.75, 16
#: Length of a document's vector; clusters at most; documents, about, that the clusters are fitted on.
SKETCH, CENTRES, FITTED = 256, 256, 8000


class Index:
    """BM25 over the documents of a shard: a posting list for every term, with the term's part of the score."""

    def __init__(self, document: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> None:
        order = np.lexsort((document, term))
        self.document, term, count = document[order], term[order], count[order].astype(float)
        length = np.bincount(self.document, count, n) if n else np.zeros(0)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.begin, self.end = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        self.begin[term[first]] = first
        self.end[term[first]] = np.append(first[1:], len(term))
        frequency = (self.end - self.begin)[term] if len(term) else np.zeros(0)
        rarity = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        usual = max(1e-9, length.mean()) if n else 1.0
        self.score = rarity * count * (K1 + 1) / (count + K1 * (1 - B + B * length[self.document] / usual)) if len(term) else np.zeros(0)
        self.n = n
        # The query of a document is all its terms that any other document has. Frequent terms are scored by products of
        # dense blocks, the others by their postings; both once for all documents.
        often = np.flatnonzero(self.end - self.begin > max(16, n // OFTEN))
        self.table = np.zeros((n, n), np.float32)
        for block in (often[i : i + 512] for i in range(0, len(often), 512)):
            scores = np.zeros((n, len(block)), np.float32)
            for column, t in enumerate(block):
                scores[self.document[self.begin[t] : self.end[t]], column] = self.score[self.begin[t] : self.end[t]]
            self.table += (scores > 0).astype(np.float32) @ scores.T
        shared = np.flatnonzero((frequency > 1) & (frequency <= max(16, n // OFTEN)))
        shared = shared[np.argsort(self.document[shared], kind="stable")]
        terms, starts = term[shared], np.searchsorted(self.document[shared], np.arange(n + 1))
        for d in range(n):
            own = terms[starts[d] : starts[d + 1]]
            begin, size = self.begin[own], self.end[own] - self.begin[own]
            # The places of all postings of these terms, one list after another.
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            self.table[d] += np.bincount(self.document[at], self.score[at], n)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the whole of the seed as query."""
        return self.table[seed]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, the best first; ties in order of their number."""
        total = self.scores(seed).copy()
        total[used] = 0
        total[seed] = 0
        found = np.flatnonzero(total)
        return found[np.argsort(-total[found], kind="stable")]


def fill(sizes: np.ndarray, capacity: int, index: Index) -> list[list[int]]:
    """Containers, each a list of items; every item with a size from 1 to the capacity is in exactly one."""
    used = (sizes <= 0) | (sizes > capacity)
    free = sorted((int(s), i) for i, s in enumerate(sizes) if not used[i])
    containers = []
    # Large seeds first: small items are left to fill the gaps.
    for _, seed in sorted(free, key=lambda x: (-x[0], x[1])):
        if used[seed]:
            continue
        room, members = capacity - int(sizes[seed]), [seed]
        used[seed] = True
        free.pop(bisect_right(free, (int(sizes[seed]), seed)) - 1)
        if room >= (free[0][0] if free else capacity + 1):
            for near in index.neighbours(seed, used):
                size = int(sizes[near])
                if size <= room:
                    members.append(int(near))
                    used[near] = True
                    free.pop(bisect_right(free, (size, int(near))) - 1)
                    room -= size
                    if not free or room < free[0][0]:
                        break
        while free and room >= free[0][0]:
            size, item = free.pop(bisect_right(free, (room, len(sizes))) - 1)
            members.append(item)
            used[item] = True
            room -= size
        containers.append(members)
    return containers


def sketch(document: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    """Unit vectors of ``SKETCH`` numbers whose products are about the cosines of the documents' weighted terms."""
    mixed = term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    place, sign = (mixed >> np.uint64(40)) % np.uint64(SKETCH), 1.0 - 2.0 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype(float)
    vectors = np.bincount(document * SKETCH + place.astype(np.int64), np.sqrt(count * weight[term]) * sign, n * SKETCH).reshape(n, SKETCH)
    return (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


def centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Centres of ``k`` clusters of unit vectors by the cosine (k-means)."""
    if not len(vectors):
        return np.ones((1, SKETCH), np.float32)
    out = vectors[np.random.default_rng(0).choice(len(vectors), min(k, len(vectors)), False)].copy()
    for _ in range(12):
        near = (vectors @ out.T).argmax(1)
        for i in np.unique(near):
            out[i] = vectors[near == i].sum(0)
        out /= np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))
    return out


def _cells(vectors: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The cell of each vector: its nearest centre and its second nearest."""
    order = np.argsort(-(vectors @ middle.T), axis=1, kind="stable")
    return order[:, 0] * CENTRES + (order[:, 1] if len(middle) > 1 else 0)


def _shards(counts: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Cell to (first shard, number of shards). A cluster of up to one and a half shards stays whole, a larger one is cut between cells."""
    clusters: dict[int, list[tuple[int, int]]] = {}
    for cell, n in sorted(counts):
        clusters.setdefault(cell // CENTRES, []).append((cell, n))
    out, shard, room = {}, -1, 0
    for cells in clusters.values():
        total = sum(n for _, n in cells)
        if total > room:  # small clusters share a shard
            shard, room = shard + 1, max(SHARD, total) if total <= 1.5 * SHARD else SHARD
        for cell, n in cells:
            need = -(-n // SHARD) if n > 1.5 * SHARD else 1
            if need > 1:
                shard += room < SHARD
                out[cell] = (shard, need)
                shard, room = shard + need, SHARD
                continue
            if n > room:
                shard, room = shard + 1, max(n, SHARD)
            out[cell] = (shard, 1)
            room -= n
    return out


def _squeezed(terms: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Terms in two bytes each, counts in one where all fit and in four else."""
    return terms.astype("<u2").tobytes(), counts.astype("u1" if not len(counts) or counts.max() < 256 else "<u4").tobytes()


def _spread_out(terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(terms, "<u2")
    return names, np.frombuffer(counts, "u1" if len(counts) == len(names) else "<u4")


def pack(documents: DataFrame, capacities: list[tuple[int, int]], weight: np.ndarray, fold: np.ndarray | None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents (doc_id, text) as (spec_id, container_id, doc_id, position, start_token, tokens).

    Every token of every document is in exactly one container of each spec. ``position`` counts the items of a
    container from 1; ``start_token`` is 0 but for pieces of a document longer than the capacity. Documents without
    tokens (null or empty text) are in no container. A doc_id that occurs several times is packed as often. Capacities
    that are null or below 1 are left out. Sizes are tokens of ``vocabulary``, taken in the same pass as the terms. An empty table gives no containers; other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.where("text is not null and text != ''").select("doc_id", "text")
    n = texts.count()
    tools = spark.sparkContext.broadcast((weight, fold))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, folding = tools.value
        for batch in batches:
            for i in range(0, len(batch), 200):
                piece = list(batch["text"].iloc[i : i + 200])
                yield pd.DataFrame({"v": [v.tobytes() for v in sketch(*bag(piece, folding), len(piece), w)]})

    whole = 1 << 40
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(whole)) < int(min(1.0, FITTED / max(1, n)) * whole))
    sample = np.array([np.frombuffer(r.v, np.float32) for r in drawn.mapInPandas(sketched, "v binary").collect()]).reshape(-1, SKETCH)
    middle = spark.sparkContext.broadcast(centres(sample, max(1, min(CENTRES, round(1.5 * n / SHARD)))))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, folding = tools.value
        coder = encoding(vocabulary)
        for batch in batches:
            for i in range(0, len(batch), 200):
                piece = batch.iloc[i : i + 200]
                sizes = np.array([len(coder.encode_ordinary(t)) for t in piece["text"]], np.int64)
                piece = piece[sizes > 0]
                document, term, count = bag(list(piece["text"]), folding)
                cut = np.searchsorted(document, np.arange(len(piece) + 1))
                parts = [(term[a:b], count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                cells = _cells(sketch(document, term, count, len(piece), w), middle.value)
                terms, counts = zip(*[_squeezed(*x) for x in parts], strict=True) if parts else ((), ())
                yield pd.DataFrame({"doc_id": piece["doc_id"].to_numpy(), "tokens": sizes[sizes > 0], "cell": cells, "terms": terms, "counts": counts})

    kind = documents.schema["doc_id"].dataType.simpleString()
    sized = texts.mapInPandas(describe, f"doc_id {kind}, tokens long, cell int, terms binary, counts binary").checkpoint()
    places = spark.sparkContext.broadcast(_shards([tuple(r) for r in sized.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]))

    @F.pandas_udf(T.IntegerType())
    def place(cells: pd.Series, salt: pd.Series) -> pd.Series:
        at = places.value
        return pd.Series([at[t][0] + s % at[t][1] for t, s in zip(cells, salt, strict=True)])

    specs = sorted((int(s), int(c)) for s, c in capacities if s is not None and c is not None and c >= 1)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"]).reset_index(drop=True)
        n, shard = len(pdf), int(pdf["shard"].iloc[0])
        parts = [_spread_out(t, c) for t, c in zip(pdf.pop("terms"), pdf.pop("counts"), strict=True)]
        index = Index(np.repeat(np.arange(n), [len(t) for t, _ in parts]), np.concatenate([t for t, _ in parts]).astype(np.int64), np.concatenate([c for _, c in parts]), n)
        total, ids, rows = pdf["tokens"].to_numpy(np.int64), pdf["doc_id"].to_numpy(), []
        for spec, capacity in specs:
            number = 0
            for i in np.flatnonzero(total >= capacity):
                for start in range(0, int(total[i]) - capacity + 1, capacity):
                    rows.append((spec, f"{spec}-{shard}-{number}", ids[i], 1, start, capacity))
                    number += 1
            rest = total % capacity
            for members in fill(rest, capacity, index):
                for position, i in enumerate(members, 1):
                    rows.append((spec, f"{spec}-{shard}-{number}", ids[i], position, int(total[i] - rest[i]), int(rest[i])))
                number += 1
        return pd.DataFrame(rows, columns=["spec_id", "container_id", "doc_id", "position", "start_token", "tokens"])

    spread = sized.withColumn("shard", place("cell", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("int")))
    return spread.groupBy("shard").applyInPandas(one, f"spec_id int, container_id string, doc_id {kind}, position int, start_token long, tokens long")
