"""Matching records of two sources without a common key by soft logic.

Candidates come from joins on composite keys (title with author, each exact, in another script, translated or one
character off). For every candidate pair weighted rules relate its similarities to the truth value of "same thing":
a title and an author that agree imply it; an author, title, platform or year that disagrees denies it; a record
describes one work (exclusivity); records that agree with each other describe the same work (transitivity). Together
they are a convex hinge-loss problem over all truth values, solved by the alternating direction method of multipliers:
every group of rules optimises its own copies of the values, which are then averaged. The truth value is the confidence.

Scale: identical works and identical records are put into classes before they meet, so a title that fills a third of a
table is one class for each author, platform and year; a class of n works shares one truth value of at most 1/n, by
exclusivity. Rules over groups need only sums and means, never the pairs of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm import names as N
from strataloom.session import checkpoint_dir

#: Weights of the rules: title and author agree; title, platform and year agree where no author is known; a missing
#: title, author, platform or year agreement; prior against a match; exclusivity; transitivity. Then the step of the
#: method, rounds at most, rounds between two tests, and the primal and dual residual (root of the mean square) it stops at.
AGREE, PLAIN, NO_TITLE, NO_AUTHOR, NO_PLATFORM, NO_YEAR, PRIOR, EXCLUSIVE, TRANSITIVE = 4.0, 2.0, 8.0, 8.0, 8.0, 1.0, 0.2, 8.0, 1.0
RHO, ROUNDS, CUT_EVERY, RESIDUAL = 4.0, 100, 5, 0.01
#: Similarity of names that differ in one character, that agree in translation; agreement of a year one or two off, or more; of an unknown value.
ONE_OFF, TRANSLATED, YEAR_1, YEAR_2, YEAR_FAR, UNKNOWN = 0.85, 0.9, 0.9, 0.5, 0.1, 0.8


def shortened(sounds: tuple[str, ...]) -> list[str]:
    """The names without one of their syllables, and whole: two names that are one syllable apart share an entry."""
    whole = " ".join(sounds)
    return [whole, *(" ".join(sounds[:i] + sounds[i + 1 :]) for i in range(len(sounds)))] if len(sounds) >= 3 else [whole] if sounds else []


def authors_of(script: N.Script, values: list[str]) -> list[tuple[str, ...]]:
    """Syllables of every author name; of "Family, Given" both orders."""
    out = []
    for value in values:
        parts = [p for p in (script.plain(x) for x in re.split("[,，]", value)) if p]
        for order in [parts, parts[::-1]] if len(parts) == 2 and not any(map(N.HAN.search, parts)) else [[p] for p in parts]:
            if sounds := script.sounds(" ".join(order)):
                out.append(sounds)
    return list(dict.fromkeys(out))


def titles_of(script: N.Script, values: list[str]) -> list[tuple[tuple[str, ...], str, str]]:
    """(syllables, phrase key, kind of continuation) of every title."""
    out = []
    for value in values:
        plain = script.plain(value)
        if plain:
            out.append((script.sounds(plain), script.phrase_key(plain), N.continuation(value)))
    return list(dict.fromkeys(out))


def keys(titles: list, authors: list) -> set[str]:
    """Keys under which a record and a work can meet."""
    out = set()
    for sounds, phrases, kind in titles:
        full = " ".join(sounds)
        for author in authors:
            name = " ".join(author)
            if full:
                out |= {f"t|{full}|{a}" for a in shortened(author)}
                out |= {f"s|{t}|{name}" for t in shortened(sounds)}
            if phrases:
                out |= {f"p|{phrases}|{kind}|{a}" for a in shortened(author)}
        if full:
            out.add(f"0|{full}")
        if phrases:
            out.add(f"1|{phrases}|{kind}")
    return out


def one_off(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two names of three or more syllables are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def title_similarity(left: list, right: list) -> float:
    best = 0.0
    for s, p, k in left:
        for t, q, m in right:
            if s and s == t:
                return 1.0
            if k == m and s and t and one_off(s, t):
                best = max(best, ONE_OFF)
            if k == m and p and p == q:
                best = max(best, TRANSLATED)
    return best


def author_similarity(left: list, right: list) -> float:
    """-1 if a side has no author."""
    if not left or not right:
        return -1.0
    if set(left) & set(right):
        return 1.0
    return ONE_OFF if any(one_off(a, b) for a in left for b in right) else 0.0


def year_similarity(left: list[int], right: list[int]) -> float:
    if not left or not right:
        return UNKNOWN
    gap = min(abs(a - b) for a in left for b in right)
    return (1.0, YEAR_1, YEAR_2)[gap] if gap < 3 else YEAR_FAR


def unary(title: np.ndarray, author: np.ndarray, year: np.ndarray, platform: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and limits of a pair's own hinges. Columns 0 and 1 pull the value up to their limit, the others push it down to theirs."""
    known = author >= 0
    # Without an author the title must carry more: what it lacks to 1 counts three times.
    up = np.stack([np.where(known, title + author - 1, 0), np.where(known, 0, 3 * title + year + platform - 4)], 1)
    down = np.stack([title, np.where(known, author, 1), platform, year, np.zeros_like(title), most], 1)
    weights = np.array([AGREE, PLAIN, NO_TITLE, NO_AUTHOR, NO_PLATFORM, NO_YEAR, PRIOR, EXCLUSIVE])
    limits = np.clip(np.concatenate([up, down], 1), 0, 1)
    # Better agreement pulls harder, so that of a record's candidates an exact one wins over those that are one off.
    weights = np.tile(weights, (len(title), 1))
    weights[:, :2] *= limits[:, :2] ** 2
    return weights, limits


def proximal(weights: np.ndarray, limits: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The value in [0, 1] that minimises its hinges and the squared distance to ``near``: the zero of a rising subgradient."""
    low, high = np.zeros_like(near), np.ones_like(near)
    for _ in range(40):
        x = (low + high) / 2
        slope = RHO * (x - near)
        slope = slope - (weights[:, :2] * (x[:, None] < limits[:, :2])).sum(1) + (weights[:, 2:] * (x[:, None] > limits[:, 2:])).sum(1)
        low, high = np.where(slope < 0, x, low), np.where(slope < 0, high, x)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _own(title: pd.Series, author: pd.Series, year: pd.Series, platform: pd.Series, most: pd.Series, near: pd.Series) -> pd.Series:
    columns = [s.to_numpy(float) for s in (title, author, year, platform, most)]
    return pd.Series(proximal(*unary(*columns), near.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _alone(title: pd.Series, author: pd.Series, year: pd.Series, platform: pd.Series, most: pd.Series) -> pd.Series:
    """The value of a pair that no rule ties to another: the least of its own hinges, the smallest where that is a range."""
    weights, limits = unary(*[s.to_numpy(float) for s in (title, author, year, platform, most)])
    points = np.concatenate([np.zeros((len(title), 1)), limits], 1)
    cost = (weights[:, None, :2] * np.maximum(0, limits[:, None, :2] - points[:, :, None])).sum(2) + (weights[:, None, 2:] * np.maximum(0, points[:, :, None] - limits[:, None, 2:])).sum(2)
    least = cost <= cost.min(1, keepdims=True) + 1e-12
    return pd.Series(np.where(least, points, 2.0).min(1))


def solve(pairs: DataFrame, rounds: int = ROUNDS, residual: float = RESIDUAL, report: list | None = None) -> DataFrame:
    """Pairs (left, right, alike long, title, author, year, platform, most) with confidence.

    ``alike`` names records that agree with each other; ``most`` is the largest value that exclusivity within a class of
    works allows. Transitivity: every group of records that agree and meet one work has a truth value of its own, and each
    member implies it and is implied by it, two hinges a member. A pair that shares neither its record nor its group
    with another is tied to none, and its own hinges decide; the others go through the alternating directions together,
    until the primal and the dual residual are at most ``residual``. ``report`` gets (round, primal, dual) of every test.
    """
    features = ("title", "author", "year", "platform", "most")
    numbers = {"l": F.xxhash64("left"), "g": F.xxhash64("right", "alike")}
    marked = pairs.withColumns(numbers)
    marked = marked.withColumn("ties", F.greatest(F.count(F.lit(1)).over(Window.partitionBy("l")), F.count(F.lit(1)).over(Window.partitionBy("g")))).checkpoint()
    alone = marked.where("ties = 1").select("left", "right", "most", _alone(*features).alias("confidence"))
    tied = marked.where("ties > 1")
    first = F.when(F.col("author") < 0, 0.5).otherwise(F.least("title", "author"))
    state = tied.withColumn("r", F.xxhash64("right")).select("l", "r", "g", *features, first.alias("z"), first.alias("m"), *[F.lit(0.0).alias(u) for u in ("u0", "u1", "u2", "u3")])
    by_left, by_group = Window.partitionBy("l"), Window.partitionBy("g")
    for step in range(1, rounds + 1):
        # Each kind of rule moves its own copies: a pair's own hinges, exclusivity of its record, transitivity of its group.
        state = state.withColumns({"x0": _own(*features, F.col("z") - F.col("u0")), "v1": F.col("z") - F.col("u1"), "v2": F.col("z") - F.col("u2"), "v3": F.col("m") - F.col("u3")})
        excess = (F.sum("v1").over(by_left) - 1) / F.count(F.lit(1)).over(by_left)
        state = state.withColumn("x1", F.col("v1") - F.greatest(F.lit(0.0), F.least(F.lit(EXCLUSIVE / RHO), excess)))
        shift = F.greatest(F.lit(-TRANSITIVE / RHO), F.least(F.lit(TRANSITIVE / RHO), (F.col("v2") - F.col("v3")) / 2))
        state = state.withColumns({"x2": F.col("v2") - shift, "x3": F.col("v3") + shift})
        mean = sum((F.col(f"x{i}") + F.col(f"u{i}") for i in range(3)), F.lit(0.0)) / 3
        state = state.withColumns({"z1": F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), "m1": F.avg(F.col("x3") + F.col("u3")).over(by_group)})
        targets = ("z1", "z1", "z1", "m1")
        gaps = [F.col(f"x{i}") - F.col(t) for i, t in enumerate(targets)]
        state = state.select(
            "l", "r", "g", *features, F.col("z1").alias("z"), F.col("m1").alias("m"), *[(F.col(f"u{i}") + gap).alias(f"u{i}") for i, gap in enumerate(gaps)],
            (sum((gap * gap for gap in gaps), F.lit(0.0)) / 4).alias("primal"), ((F.col("z1") - F.col("z")) * (F.col("z1") - F.col("z"))).alias("dual"),
        )
        if step % CUT_EVERY == 0 or step == rounds:
            state = state.checkpoint()
            primal, dual = ((x or 0.0) ** 0.5 for x in state.agg(F.avg("primal"), F.avg("dual")).first())
            if report is not None:
                report.append((step, primal, RHO * dual))
            if max(primal, RHO * dual) <= residual:
                break
    together = tied.select("left", "right", "most", "l", F.xxhash64("right").alias("r")).join(state.select("l", "r", F.col("z").alias("confidence")), ["l", "r"]).drop("l", "r")
    return alone.unionByName(together)


def link(records: DataFrame, works: DataFrame, script: N.Script) -> DataFrame:
    """(record, work, confidence) for all candidate pairs.

    Both sides: (id, titles array<string>, authors array<string>, platform string, years array<int>). Arrays may be
    empty, hold nulls, placeholders and packed values; ids must not be null. Records and works that agree in everything
    but their id form classes; a pair of classes stands for all its members. Ties between works show as a confidence of
    at most one half. Empty tables give no pairs; other columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(script)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for titles, authors, platform, years in zip(batch["titles"], batch["authors"], batch["platform"], batch["years"], strict=True):
                t = titles_of(known, [x for x in titles if x])
                a = authors_of(known, [x for x in authors if x])
                out.append((sorted({"\x1f".join((" ".join(s), p, k)) for s, p, k in t}), sorted({" ".join(x) for x in a}), platform or "", sorted({int(y) for y in years if y is not None and y == y}), sorted(keys(t, a))))
            yield pd.DataFrame({"id": batch["id"]} | dict(zip(("t", "a", "platform", "y", "keys"), map(list, zip(*out, strict=True)) if out else ([],) * 5, strict=True)))

    schema = "id string, t array<string>, a array<string>, platform string, y array<int>, keys array<string>"
    # A class is named by its smallest id. Keys travel as 64-bit hashes: a collision only adds a pair to compare.
    sign = F.xxhash64(F.concat_ws("\x1e", F.concat_ws("\x1d", "t"), F.concat_ws("\x1d", "a"), "platform", F.concat_ws("\x1d", F.col("y").cast("array<string>")))), F.hash(F.concat_ws("\x1d", "t"))

    def classes(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        described = frame.select("id", "titles", "authors", "platform", "years").mapInPandas(features, schema)
        described = described.select("id", "t", "a", "platform", "y", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys"), F.transform("keys", lambda k: k.rlike("^[01][|]")).alias("nameless"), F.struct(*sign).alias("sign")).checkpoint()
        # Aggregated and joined back, not a window: identical rows may be a large part of the table.
        one = described.groupBy("sign").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
        named = described.join(one, "sign")
        return named.select("id", "class"), named.where("id = class")

    checkpoint_dir(records.sparkSession)
    left_members, left = classes(records)
    right_members, right = classes(works)

    def meeting(frame: DataFrame, name: str, nameless: bool) -> DataFrame:
        wanted = F.filter(F.arrays_zip("keys", "nameless"), lambda k: k["nameless"] == F.lit(nameless))
        return frame.select(F.col("class").alias(name), F.explode(wanted).alias("k")).select(name, F.col("k.keys").alias("key"))

    # Keys without an author serve only where one of the sides has none; each side is told apart before they meet.
    bare = F.size("a") == 0
    found = meeting(left, "left", False).join(meeting(right, "right", False), "key").select("left", "right")
    for l, r in ((bare, F.lit(True)), (~bare, bare)):
        found = found.union(meeting(left.where(l), "left", True).join(meeting(right.where(r), "right", True), "key").select("left", "right"))
    found = found.distinct()
    l_side = left.select(F.col("class").alias("left"), *[F.col(c).alias(f"l_{c}") for c in ("t", "a", "platform", "y")])
    r_side = right.select(F.col("class").alias("right"), F.col("n").alias("r_n"), *[F.col(c).alias(f"r_{c}") for c in ("t", "a", "platform", "y")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def titles(values: list[str]) -> list:
            return [(tuple(s.split()), p, k) for s, p, k in (v.split("\x1f") for v in values)]

        def authors(values: list[str]) -> list:
            return [tuple(v.split()) for v in values]

        for batch in batches:
            rows = [
                (title_similarity(titles(lt), titles(rt)), author_similarity(authors(la), authors(ra)), year_similarity(list(ly), list(ry)), UNKNOWN if not lp or not rp else float(lp == rp), 1.0 / n)
                for lt, la, lp, ly, rt, ra, rp, ry, n in zip(*(batch[c] for c in ("l_t", "l_a", "l_platform", "l_y", "r_t", "r_a", "r_platform", "r_y", "r_n")), strict=True)
            ]
            yield batch[["left", "right", "alike"]].reset_index(drop=True).join(pd.DataFrame(rows, columns=["title", "author", "year", "platform", "most"], dtype=float))

    alike = F.xxhash64(F.concat_ws("\x1d", "l_t"), F.concat_ws("\x1d", "l_a"))
    pairs = found.join(l_side, "left").join(r_side, "right").withColumn("alike", alike).mapInPandas(compare, "left string, right string, alike long, title double, author double, year double, platform double, most double")
    solved = solve(pairs)
    certain = solved
    return (
        certain.join(left_members.select(F.col("id").alias("record"), F.col("class").alias("left")), "left")
        .join(right_members.select(F.col("id").alias("work"), F.col("class").alias("right")), "right")
        .select("record", "work", F.least("confidence", "most").alias("confidence"))
    )
