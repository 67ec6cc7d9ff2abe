"""Best representative of each group of observations of one thing, chosen as a consistent bundle of values.

Fields that depend on each other form a bundle: an author goes with the author ids it was observed with. Every option of a
bundle has a trust: the sum, over the observations that support it, of source priority times recency; placeholders and
values that were cut short have none. Two constraints bind the choice. A functional dependency that holds across the
groups (one author id has one author) forbids options that contradict it. And the surviving record shall be one record:
options of different bundles that were observed together, in trusted observations, strengthen each other. A
branch-and-bound search over the bundles of a group chooses the allowed set of options with the greatest sum of trust and
coherence.

Scale: recency is the number of newer observations, counted within days and over days, so windows over many rows are per
(group, day) and windows per group see one row a day. Everything else is partial aggregation. An option whose trust can't
make up for the best one's, even with every coherence, is dropped before a group is gathered; as weights fall by
``DECAY`` a rank and a priority is at least ``STEP``^5, some sixty options of a bundle remain at most, whatever the size
of the group. Bundles with one option left are decided in the JVM, the search sees the other groups only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import checkpoint_dir

#: Weight of a source one priority step lower (priorities beyond LOWEST count as it), weight of an observation one rank older.
STEP, DECAY, LOWEST = 0.6, 0.4, 6
#: Trust for every other group that confirms a dependency, up to so many, and the groups needed before a dependency binds.
CONFIRMED, MOST_CONFIRMED, BINDING = 0.05, 10, 2
#: What it adds that two options were observed together, as a share of the trust they have in common.
COHERENCE = 0.1
#: Sums closer than this are ties.
TIE = 1e-10
#: Texts that stand for a missing value.
PLACEHOLDERS = ("未知", "暂无", "佚名", "无", "待定", "n/a", "na", "null", "none", "unknown", "anonymous", "-", "--", "?", "？")

Joint = Mapping[tuple[int, int, int, int], float]


def real(value: Column) -> Column:
    """Whether a value is no missing value, placeholder or text that was cut short."""
    bare = F.lower(F.regexp_replace(value, r"^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$", ""))
    return F.coalesce((bare != "") & ~bare.isin(*PLACEHOLDERS) & ~bare.rlike(r"(…|\.{2,})$"), F.lit(False))


def ranked(observations: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """Observations with _rank: how many of their group are newer. Rows without ``at`` come last; ties go by the key's MD5."""
    sign = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    # A part is a day; the rows without a time are spread over 256 parts after all days.
    late = -10_000_000 - F.conv(F.substring("_sign", 1, 2), 16, 10).cast("int")
    parts = observations.withColumn("_sign", sign).withColumn("_part", F.coalesce(F.unix_date(F.to_date(at)), late)).repartition(group, "_part")
    within = parts.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.col(at).desc_nulls_last(), "_sign")))
    sizes = within.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    newer = sizes.select(group, "_part", (F.sum("_size").over(Window.partitionBy(group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_newer"))
    return within.join(newer, [group, "_part"]).withColumn("_rank", F.col("_newer") + F.col("_place") - 1).drop("_sign", "_part", "_place", "_newer")


def search(bundles: Sequence[Sequence[float]], joint: Joint) -> list[int]:
    """Branch and bound: the index of the chosen option of each bundle, the greatest sum of trust and coherence.

    ``bundles`` hold the trust of each option; ``joint`` has, for (bundle, option, later bundle, option), what the two add
    when both are chosen. The bound of a partial choice is what it has and, for each bundle still open, the most that one
    of its options adds: its trust, its coherence with the choices made and the most it could have with the open
    bundles. Ties go to the options that come first.
    """
    n = len(bundles)
    # The most that an option of a bundle can have in common with any option of a later bundle.
    ahead = [[sum(max((joint.get((b, i, c, j), 0.0) for j in range(len(bundles[c]))), default=0.0) for c in range(b + 1, n)) for i in range(len(bundles[b]))] for b in range(n)]
    best, chosen = -1.0, [0] * n

    def gain(path: tuple[int, ...], b: int, i: int) -> float:
        return bundles[b][i] + sum(joint.get((a, j, b, i), 0.0) for a, j in enumerate(path))

    stack: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    while stack:
        total, path = stack.pop()
        depth = len(path)
        bound = total + sum(max(gain(path, b, i) + ahead[b][i] for i in range(len(bundles[b]))) for b in range(depth, n))
        if bound <= best + TIE:
            continue
        if depth == n:
            best, chosen = total, list(path)
            continue
        stack += [(total + gain(path, depth, i), (*path, i)) for i in reversed(range(len(bundles[depth])))]
    return chosen


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, fields, values = [], [], []
        for key, options, together in zip(batch["group"], batch["options"], batch["together"], strict=True):
            by: dict[int, list] = {}
            for o in sorted(options, key=lambda o: (o["bundle"], -round(o["trust"] / o["best"], 10), o["first"], -o["support"], o["value"])):
                by.setdefault(o["bundle"], []).append(o)
            numbers = sorted(by)
            place = {(b, o["value"]): (k, i) for k, b in enumerate(numbers) for i, o in enumerate(by[b])}
            joint = {(*place[t["a"], t["x"]], *place[t["b"], t["y"]]): COHERENCE * t["weight"] / max(by[t["a"]][0]["best"], by[t["b"]][0]["best"]) for t in together}
            for b, i in zip(numbers, search([[o["trust"] / o["best"] for o in by[b]] for b in numbers], joint), strict=True):
                keys.append(key)
                fields.append(b)
                values.append(by[b][i]["value"])
        yield pd.DataFrame({"group": keys, "bundle": fields, "value": values})


def survivors(observations: DataFrame, group: str, fields: Sequence[str], at: str, key: str, priority: str, determinants: dict[str, str]) -> DataFrame:
    """(group, field, value): the best value of every field for every group.

    ``priority`` is 1 for the most trusted source; a null counts as 6, as do lower ones. ``determinants`` maps a field to the
    column that determines it across groups; the two are one bundle. A group without any real value of a field keeps its
    newest one; a field that is null everywhere gives no row. Observations repeated exactly count once; ties go to the
    value that was seen last, then to the one with more supporters, then to the smaller text. Rows without a group are
    left out; other columns are ignored. An empty table gives no rows.
    """
    checkpoint_dir(observations.sparkSession)
    needed = list(dict.fromkeys([group, at, key, priority, *fields, *determinants.values()]))
    rows = observations.select(*needed).where(F.col(group).isNotNull()).distinct()
    step = F.least(F.greatest(F.coalesce(F.col(priority), F.lit(LOWEST)), F.lit(1)), F.lit(LOWEST)) - 1
    placed = ranked(rows, group, at, key).withColumn("_weight", F.pow(F.lit(STEP), step) * F.pow(F.lit(DECAY), F.col("_rank")))
    entries = [F.struct(F.lit(b).alias("bundle"), F.col(f).cast("string").alias("value"), (F.col(determinants[f]) if f in determinants else F.lit(None)).cast("string").alias("by")) for b, f in enumerate(fields)]
    placed = placed.select(F.col(group).alias("group"), "_rank", "_weight", F.filter(F.array(*entries), lambda e: e["value"].isNotNull()).alias("entries")).checkpoint()
    long = placed.select("group", "_rank", "_weight", F.explode("entries").alias("o")).select("group", "_rank", "_weight", "o.*")
    options = long.groupBy("group", "bundle", "value").agg(F.sum("_weight").alias("trust"), F.min("_rank").alias("first"), F.count(F.lit(1)).alias("support"))
    options = options.withColumn("fake", ~real(F.col("value"))).withColumn("trust", F.when(F.col("fake"), 0.0).otherwise(F.col("trust")))
    # Groups that confirm a value for its determinant; a group doesn't confirm itself. Of several determinants the best confirmed counts.
    pairs = long.where(F.col("by").isNotNull() & real(F.col("value"))).select("group", "bundle", "value", "by").distinct()
    confirmed = pairs.groupBy("bundle", "by", "value").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    others = pairs.join(confirmed, ["bundle", "by", "value"]).groupBy("group", "bundle", "value").agg(F.max("others").alias("others"))
    options = options.join(others, ["group", "bundle", "value"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
    options = options.withColumn("trust", F.col("trust") * (1 + CONFIRMED * F.least("others", F.lit(MOST_CONFIRMED)))).checkpoint()
    order = F.struct((-F.col("trust")).alias("t"), "fake", "first", (-F.col("support")).alias("s"), "value")
    known = F.col("others") > 0
    state = options.groupBy("group", "bundle").agg(F.min(order).alias("any"), F.min(F.when(known, order)).alias("sure"), F.max("others").alias("most"), F.sum("others").alias("sum"))
    # The dependency binds where exactly one value is confirmed, by enough groups: then it is the only one allowed.
    binds = (F.col("most") >= BINDING) & (F.col("sum") == F.col("most"))
    state = state.select("group", "bundle", binds.alias("binds"), F.when(binds, F.col("sure")).otherwise(F.col("any")).alias("top"))
    least = 1 / (1 + COHERENCE * (len(fields) - 1))
    near = options.join(state, ["group", "bundle"]).where((~F.col("binds") | known) & (F.col("trust") > 0) & (F.col("trust") >= -F.col("top.t") * least * (1 - TIE)))
    near = near.select("group", "bundle", "value", "trust", "first", "support", (-F.col("top.t")).alias("best"))
    open_groups = near.groupBy("group", "bundle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group").distinct()
    left = near.join(open_groups, "group", "left_semi").checkpoint()
    gathered = left.groupBy("group").agg(F.collect_list(F.struct("bundle", "value", "trust", "first", "support", "best")).alias("options"))
    # Trust that options of two bundles have in common, from the observations that support both.
    seen = placed.join(open_groups, "group", "left_semi").withColumn("pair", F.explode(F.flatten(F.transform("entries", lambda x: F.transform(F.filter("entries", lambda y: y["bundle"] > x["bundle"]), lambda y: F.struct(x["bundle"].alias("a"), x["value"].alias("x"), y["bundle"].alias("b"), y["value"].alias("y")))))))
    common = seen.groupBy("group", "pair").agg(F.sum("_weight").alias("weight")).select("group", "pair.*", "weight")
    for b, v in (("a", "x"), ("b", "y")):
        common = common.join(left.select("group", F.col("bundle").alias(b), F.col("value").alias(v)), ["group", b, v])
    together = common.groupBy("group").agg(F.collect_list(F.struct("a", "x", "b", "y", "weight")).alias("together"))
    ready = gathered.join(together, "group", "left").withColumn("together", F.coalesce("together", F.array().cast(together.schema["together"].dataType)))
    schema = T.StructType([gathered.schema["group"], T.StructField("bundle", T.IntegerType()), T.StructField("value", T.StringType())])
    searched = ready.mapInPandas(_decide, schema).withColumnRenamed("value", "found")
    names = F.array(*map(F.lit, fields))
    return state.join(searched, ["group", "bundle"], "left").select("group", F.get(names, F.col("bundle")).alias("field"), F.coalesce("found", "top.value").alias("value"))


def newest_trusted(observations: DataFrame, group: str, at: str, key: str, priority: str, required: Sequence[str]) -> DataFrame:
    """(group, key): the latest dated observation of each group of two or more, if no other has a better source and its fields are real.

    Rows repeated exactly count once. Of several observations of the latest moment the one with the best source counts,
    then the smaller key. One pass of partial aggregation: no group is gathered.
    """
    rows = observations.select(*dict.fromkeys([group, at, key, priority, *required])).where(F.col(group).isNotNull() & F.col(at).isNotNull()).distinct()
    rank = F.coalesce(F.col(priority), F.lit(6))
    whole = F.lit(True)
    for f in required:
        whole = whole & real(F.col(f).cast("string"))
    # key is negated by keeping the smallest of (not latest, priority, key): max_by with a descending tie-break.
    entry = F.struct(rank.alias("p"), F.col(key).alias("k"), whole.alias("ok"))
    by_time = rows.groupBy(group, at).agg(F.min(entry).alias("e"), F.count(F.lit(1)).alias("n"), F.min(rank).alias("p"))
    best = by_time.groupBy(group).agg(F.max_by("e", at).alias("e"), F.sum("n").alias("n"), F.min("p").alias("p"))
    return best.where("n >= 2 and e.p = p and e.ok").select(group, F.col("e.k").alias(key))
