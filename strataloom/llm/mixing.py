"""Mixing sources to target shares of the total size, by hash thresholds instead of sorting.

The size of the mix is the largest at which every source can fill its share within its allowed repeats. A source's
documents are used whole a number of times, and a part of them once more: those whose hash lies below a threshold at
which their sizes sum up to what is still missing, to within half of the document at the threshold. The threshold is found by nested histograms: sizes are summed by
source and the leading bits of the hash, the running sum shows the bucket in which the budget ends, and only that
bucket is divided by the next bits, until it holds one document. The result is a filter; nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash that one histogram resolves, and bits in all.
BITS, ALL = 12, 60


@dataclass(frozen=True)
class Plan:
    """What a source gives: whole repeats of all its documents, and one more of those with a hash below the threshold."""

    source: str
    whole: int
    threshold: int


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - ALL)


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens that each source gives. Sources without documents can give nothing; their share goes to the others in proportion."""
    usable = {s: (share, repeats) for s, (share, repeats) in targets.items() if available.get(s, 0) > 0 and share > 0 and repeats > 0}
    weight = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    total = min(repeats * available[s] * weight / share for s, (share, repeats) in usable.items())
    return {s: total * share / weight for s, (share, _) in usable.items()}


def plan(sized: DataFrame, targets: list[tuple[str, float, int]], seed: int = 0) -> list[Plan]:
    """The plan of every target source for documents (doc_id, source, tokens). Only rows about targets reach the driver."""
    wanted = {s: (float(share or 0), int(repeats or 0)) for s, share, repeats in targets if s is not None}
    known = sized.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).withColumn("h", _hash(seed))
    top = known.groupBy("source", F.shiftright("h", ALL - BITS).alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    available: dict[str, int] = {}
    histogram: dict[str, list] = {}
    for row in top.collect():
        available[row.source] = available.get(row.source, 0) + row.t
        histogram.setdefault(row.source, []).append((row.b, row.t, row.n))
    gives = budgets(available, wanted)
    whole = {s: min(int(gives[s] // available[s]), wanted[s][1]) for s in gives}
    rest = {s: gives[s] - whole[s] * available[s] if whole[s] < wanted[s][1] else 0.0 for s in gives}
    threshold, level = dict.fromkeys(gives, 0), BITS
    prefix: dict[str, int] = {}

    def descend(buckets: dict[str, list], shift: int) -> dict[str, int]:
        """Moves every threshold to the start of the bucket in which its budget ends; those buckets that are worth dividing."""
        boundary = {}
        for s, rows in buckets.items():
            for b, t, n in sorted(rows):
                if t > rest[s]:
                    # A single document is taken if that comes closer to the budget than leaving it.
                    closer = n == 1 and t - rest[s] < rest[s]
                    threshold[s] = (b + closer) << shift
                    if n > 1:
                        boundary[s] = b
                    break
                rest[s] -= t
                threshold[s] = (b + 1) << shift
        return boundary

    prefix = descend({s: histogram[s] for s in gives}, ALL - level)
    while prefix and level < ALL:
        inside = F.lit(False)
        for s, b in prefix.items():
            inside = inside | ((F.col("source") == s) & (F.shiftright("h", ALL - level) == b))
        level += BITS
        finer: dict[str, list] = {}
        for row in known.where(inside).groupBy("source", F.shiftright("h", ALL - level).alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            finer.setdefault(row.source, []).append((row.b, row.t, row.n))
        prefix = descend(finer, ALL - level)
    return [Plan(s, whole[s], threshold[s]) for s in sorted(gives)]


def mix(sized: DataFrame, plans: list[Plan], seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every chosen document; repeats is at least 1.

    Documents without a source, of a source without a target, without a text or of size 0 are not chosen. A doc_id that
    occurs several times is chosen as often. Other columns are ignored.
    """
    repeats = F.lit(0)
    for p in plans:
        repeats = F.when(F.col("source") == p.source, F.lit(p.whole) + (F.col("h") < p.threshold).cast("int")).otherwise(repeats)
    chosen = sized.where("tokens > 0").withColumn("h", _hash(seed)).withColumn("repeats", repeats)
    return chosen.where("repeats > 0").select("doc_id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))


def shares(sized: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For every target: its share, the tokens it has, the tokens it gives and the share it reaches; 0 where it has no documents."""
    had = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    gave = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    joined = targets.join(had, "source", "left").join(gave, "source", "left").withColumn("total", F.sum("mixed_tokens").over(Window.partitionBy()))  # one row a target
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("source", "target_share", *[zero(c) for c in ("available_tokens", "mixed_tokens", "documents", "most_repeats")], F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
