"""Quantities recorded in different units, brought to one unit by a hidden Markov model per device.

A device is the series of readings of one thing (the length of a work over its observations, the lengths of a work's
chapters). The hidden state of a reading is its unit. Evidence: a unit written beside the number is certain; the unit
that a source's documentation states for bare numbers is strong; a fraction is unlikely in an indivisible unit. A
change of state between neighbours must explain the jump of the logarithm of the value against an underlying level
that moves smoothly. Viterbi decoding finds the most probable units of the whole series at once.

The decoder works on many series at a time (arrays of series x time), so Python's cost is per step, not per reading.
Series are cut at one reading in ``PIECE``, so a device that holds a third of all rows is many pieces, which are
different tasks. The cut doesn't change the result: each piece first gives the best score of every pair of its first and
last state, these small tables are chained along the device, and each piece is then decoded between the states that
the whole chain has at its ends.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.text import keep_filled, narrow, strip

#: Characters in one unit; 1 KB is 1024 bytes, two bytes are one character.
UNITS = {"char": 1.0, "thousand": 1e3, "wan": 1e4, "yi": 1e8, "byte": 0.5, "kilobyte": 512.0, "megabyte": 524288.0}
NAMES = list(UNITS)
PIECE = 1 << 15
#: Log-likelihoods: a state against the written unit, against the documented one, a fraction of an indivisible unit. What
#: documentation says is overruled only where both neighbours have another unit and contradict it by the greatest jumps.
WRITTEN, DOCUMENTED, FRACTION = -1e4, -25.0, -20.0
#: Probability of another unit than the neighbour's within one source and across sources; spread and cap of a jump's log-likelihood.
SWITCH_SAME, SWITCH_OTHER, SPREAD, CAP = 0.02, 0.5, 0.7, 12.0
#: A bare number without documentation is rather a count of characters.
PRIOR = np.log(np.array([0.6, 0.12, 0.1, 0.005, 0.1, 0.07, 0.005]))

_DIGIT = "〇零一二两三四五六七八九"
_N = rf"(\d+(?:\.\d+)?|[{_DIGIT}])"
_CHINESE = rf"^(?:([\d.{_DIGIT}十百千]+?)亿)?零?(?:([\d.{_DIGIT}十百千]+?)万)?零?([\d.{_DIGIT}十百千]*)$"
_SECTION = rf"^(?:{_N}千)?零?(?:{_N}百)?零?(?:({_N[1:-1]})?(十))?零?{_N}?$"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _figure(text: Column) -> Column:
    """A single Arabic or Chinese figure as a decimal; empty is null."""
    return F.translate(F.nullif(text, F.lit("")), _DIGIT, "001223456789").try_cast("decimal(24,8)")


def _section(text: Column) -> Column:
    """A Chinese numeral below ten thousand: thousands, hundreds, tens and units."""
    part = lambda i: _figure(F.regexp_extract(text, _SECTION, i))
    tens = F.when(F.regexp_extract(text, _SECTION, 4) == "十", F.coalesce(part(3), F.lit(1)))
    total = F.coalesce(part(1), F.lit(0)) * 1000 + F.coalesce(part(2), F.lit(0)) * 100 + F.coalesce(tens, F.lit(0)) * 10 + F.coalesce(part(5), F.lit(0))
    return F.when(text == "", F.lit(0).cast("decimal(24,8)")).when(text.rlike(_SECTION), total.cast("decimal(24,8)"))


def parse(text: Column) -> Column:
    """struct<number decimal(28,8), unit string>: the number as written and the unit written with it, null if it states none.

    Accepted: full-width figures, thousands separators, Chinese numerals (三十一万一千, 9万9千), words before (约, 全文, 共) and
    labels (字数：) that name the unit. Placeholders, blanks and other texts give null.
    """
    clean = F.lower(F.regexp_replace(strip(narrow(text)), r"\s+", ""))
    label = r"^(?:总|全文)?(字数|字节数|字符数|大小|长度|words?count|characters?|chars?|bytes?|size)[:=]"
    shape = r"^(?:约|近|共|全文|总计|大约|全书)*([\d,.]+|[\d.〇零一二两三四五六七八九十百千万亿]+)(字节|个字符|字符|个字|千字|万字|字|characters?|chars?|bytes?|kb|mb|k字|w字|[kwb千万]|亿字?)?(?:左右|以上)?$"

    def read(t: Column) -> Column:
        name = F.regexp_extract(t, label, 1)
        rest = F.regexp_replace(t, label, "")
        figures, suffix = F.regexp_extract(rest, shape, 1), F.regexp_extract(rest, shape, 2)
        plain = figures.rlike(r"^(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$")
        arabic = F.regexp_replace(figures, ",", "").try_cast("decimal(24,8)")
        group = lambda i: F.regexp_extract(figures, _CHINESE, i)
        chinese = F.when(
            figures.rlike(f"[{_DIGIT}十百千万亿]") & figures.rlike(_CHINESE),
            (_section(group(1)) * 100000000 + _section(group(2)) * 10000 + _section(group(3))).cast("decimal(28,8)"),
        )
        number = F.when(plain, arabic.cast("decimal(28,8)")).otherwise(chinese)
        counted = ~plain
        unit = (
            F.when(suffix.isin("字节", "b") | suffix.startswith("byte"), "byte")
            .when(suffix == "kb", "kilobyte")
            .when(suffix == "mb", "megabyte")
            .when(suffix.isin("k", "k字", "千", "千字"), "thousand")
            .when(suffix.isin("w", "w字", "万", "万字"), "wan")
            .when(suffix.isin("亿", "亿字"), "yi")
            .when(suffix != "", "char")
            .when(name.isin("字数", "字符数") | name.startswith("char") | name.startswith("word"), "char")
            .when(name.isin("字节数", "大小", "size") | name.startswith("byte"), "byte")
            .when(counted, "char")
        )
        return F.when(number.isNotNull(), F.struct(number.alias("number"), unit.alias("unit")))

    return _let(clean, read)


def emission(written: np.ndarray, documented: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """Log-likelihood of every state for every reading, from what the reading itself says."""
    states = np.arange(len(NAMES))
    score = np.where(written[:, None] >= 0, np.where(states == written[:, None], 0.0, WRITTEN), 0.0)
    bare = (written < 0)[:, None]
    score += np.where(bare & (documented[:, None] >= 0), np.where(states == documented[:, None], 0.0, DOCUMENTED), 0.0)
    score += np.where(bare & (documented[:, None] < 0), PRIOR, 0.0)
    return score + np.where(bare & fraction[:, None] & np.isin(states, (0, 4)), FRACTION, 0.0)


_FACTOR = np.log(np.array(list(UNITS.values())))
_STEP = _FACTOR[None, :] - _FACTOR[:, None]
_MOVES = np.stack([np.where(np.eye(len(NAMES), dtype=bool), np.log(1 - p), np.log(p / (len(NAMES) - 1))) for p in (SWITCH_OTHER, SWITCH_SAME)])


def transition(change: np.ndarray, same_source: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Log-likelihood of every pair of states of neighbours whose log-values differ by ``change``."""
    jump = (change[:, None, None] + _STEP[None]) / spread[:, None, None]
    return _MOVES[same_source.astype(int)] - np.minimum(0.5 * jump**2, CAP)


def viterbi(log_value: np.ndarray, score: np.ndarray, source: np.ndarray, spread: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable state of every reading, and the best score of each series by its last state.

    The arrays hold whole series one after another; ``start`` marks their first readings, ``score`` is their emission.
    """
    n, k = score.shape
    if n == 0:
        return np.zeros(0, int), np.zeros((0, k))
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    best, back = score[first].copy(), np.zeros((n, k), np.int8)
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = first[:live] + t
        total = best[:live, :, None] + transition(log_value[at] - log_value[at - 1], source[at] == source[at - 1], spread[at])
        back[at] = total.argmax(1)
        best[:live] = total.max(1) + score[at]
    path = np.zeros(n, int)
    state = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = first[:live] + t
        path[at] = state[:live]
        state[:live] = back[at, state[:live]]
    ends = np.empty_like(best)
    ends[order] = best
    return path, ends


def through(log_value: np.ndarray, score: np.ndarray, source: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Best score of one series for every pair of its first and last state."""
    n, k = score.shape
    copies = np.tile(score, (k, 1))
    firsts = np.arange(k) * n
    copies[firsts] += np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    return viterbi(np.tile(log_value, k), copies, np.tile(source, k), np.tile(spread, k), np.isin(np.arange(n * k), firsts))[1]


def chain(tables: list[np.ndarray], joints: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of every piece of a series: ``tables`` are theirs from ``through``, ``joints`` the transitions between them."""
    best, backs = np.zeros(len(NAMES)), []
    for i, table in enumerate(tables):
        if i:
            total = best[:, None] + joints[i - 1]
            enter, best = total.argmax(0), total.max(0)
        else:
            enter = np.arange(len(NAMES))
        total = best[:, None] + table
        backs.append((enter, total.argmax(0)))
        best = total.max(0)
    out, last = [], int(best.argmax())
    for enter, first_of in reversed(backs):
        first = int(first_of[last])
        out.append((first, last))
        last = int(enter[first])
    return out[::-1]


_INDEX = {name: i for i, name in enumerate(NAMES)}


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-values, emissions, sources and spreads of readings."""
    value = part["_value"].to_numpy(float)
    written, documented = (part[c].map(_INDEX).fillna(-1).to_numpy(int) for c in ("_unit", "_documented"))
    return np.log(np.maximum(value, 1e-9)), emission(written, documented, value != np.floor(value)), pd.factorize(part["_source"])[0], part["_spread"].to_numpy(float)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches cut between series only, with the marks of the series' first readings."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        part = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if part is None or not len(part):
            continue
        group = pd.factorize(part["_series"] + "\x1e" + part["_piece"].astype(str))[0]
        cut = len(part) if batch is None else int(np.searchsorted(group == group[-1], True))
        rest = part.iloc[cut:].reset_index(drop=True)
        if cut:
            yield part.iloc[:cut].reset_index(drop=True), np.append(True, group[1:cut] != group[: cut - 1])


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, start in _whole(batches):
        log_value, score, source, spread = _arrays(part)
        last = np.append(start[1:], True)
        for column, at in (("_from", np.flatnonzero(start)), ("_to", np.flatnonzero(last))):
            state = part[column].to_numpy()[at]
            at, state = at[state >= 0], state[state >= 0]
            score[at] += np.where(np.arange(len(NAMES)) == state[:, None], 0.0, -np.inf)
        path, _ = viterbi(log_value, score, source, spread, start)
        yield pd.DataFrame({"_row": part["_row"], "_unit": np.array(NAMES, object)[path]})


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, start in _whole(batches):
        cuts = [*np.flatnonzero(start), len(part)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = part.iloc[a:b]
            log_value, score, source, spread = _arrays(piece)
            names = piece["_source"]
            rows.append((piece["_series"].iloc[0], int(piece["_piece"].iloc[0]), through(log_value, score, source, spread).ravel().tolist(), log_value[0], log_value[-1], names.iloc[0], names.iloc[-1], spread[0]))
        yield pd.DataFrame(rows, columns=["_series", "_piece", "table", "head", "tail", "head_source", "tail_source", "spread"])


def _chained(pieces: pd.DataFrame) -> pd.DataFrame:
    p = pieces.sort_values("_piece").reset_index(drop=True)
    k = len(NAMES)
    change = p["head"].to_numpy(float)[1:] - p["tail"].to_numpy(float)[:-1]
    joints = transition(change, p["head_source"].to_numpy()[1:] == p["tail_source"].to_numpy()[:-1], p["spread"].to_numpy(float)[1:])
    ends = chain([np.array(t).reshape(k, k) for t in p["table"]], list(joints))
    return p[["_series", "_piece"]].assign(_from=[a for a, _ in ends], _to=[b for _, b in ends])


def _cuts(readings: DataFrame, piece: int) -> DataFrame:
    """(_series, _cuts): the places where series are cut, at one reading in ``piece``, chosen by the hash of its row."""
    chosen = readings.where("series is not null and text is not null").where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(piece)) == 0)
    return chosen.groupBy(F.col("series").alias("_series")).agg(F.sort_array(F.collect_set(_place())).alias("_cuts"))


def _place() -> Column:
    """A reading's place in its series: its position, nulls last, readings of one position in the order of their row's hash."""
    tie = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.coalesce(F.col("position").cast("double"), F.lit(9.2e18)) + tie


def convert(readings: DataFrame, piece: int = PIECE) -> DataFrame:
    """Readings (row struct, series string, position long, text string, source string, documented string) as (row, char_count, unit).

    ``row`` is carried through; ``series`` and ``position`` order the readings of a device; ``documented`` is the unit (a key
    of ``UNITS``) that the source states for bare numbers, or null. An optional column ``spread`` says how much the logarithm of the level
    moves between neighbours of the series (``SPREAD``). Texts that state no quantity, or more characters than
    a long holds, give no row. A count that isn't whole is cut to the whole characters below it. A reading without series
    stands alone, one without position comes last in its series. Ties are taken in the order of the row. Repeated rows are
    decoded as often as they occur. An empty input gives an empty result. The result doesn't depend on ``piece``.
    """
    cuts = _cuts(readings, piece).checkpoint()
    # The cuts come first, so that the pass over cut series alone parses no other texts.
    known = readings.join(cuts.withColumnRenamed("_series", "series"), "series", "left").withColumn("_cut", F.col("_cuts").isNotNull())
    alone = F.col("series").isNull()
    placed = known.withColumn("_at", F.when(~alone, _place())).select(
        "row",
        F.when(alone, F.sha2(F.to_json("row"), 256)).otherwise(F.col("series")).alias("_series"),
        "_at",
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0)).alias("_piece"),
        "_cut",
        parse(F.col("text")).alias("_p"),
        F.col("documented").alias("_documented"),
        F.coalesce("source", F.lit("")).alias("_source"),
        (F.coalesce("spread", F.lit(SPREAD)) if "spread" in readings.columns else F.lit(SPREAD)).alias("_spread"),
    )

    def read(frame: DataFrame) -> DataFrame:
        filled = keep_filled(frame, "_p").withColumns({"_row": F.struct("row", F.col("_p.number").alias("number")), "_value": F.col("_p.number").cast("double"), "_unit": F.col("_p.unit")})
        return filled.select("_row", "_series", "_at", "_value", "_unit", "_documented", "_source", "_spread", "_piece")

    small, cut = read(placed.where("not _cut")), read(placed.where("_cut"))
    by_piece = lambda frame: frame.repartition("_series", "_piece").sortWithinPartitions("_series", "_piece", "_at", "_row")
    series = small.schema["_series"]
    cell = [series, T.StructField("_piece", T.IntegerType())]
    real, text = T.DoubleType(), T.StringType()
    table = T.StructType([*cell, T.StructField("table", T.ArrayType(real)), T.StructField("head", real), T.StructField("tail", real), T.StructField("head_source", text), T.StructField("tail_source", text), T.StructField("spread", real)])
    bounds = T.StructType([*cell, T.StructField("_from", T.IntegerType()), T.StructField("_to", T.IntegerType())])
    ends = by_piece(cut).mapInPandas(_tables, table).groupBy("_series").applyInPandas(_chained, bounds)
    both = small.withColumns({"_from": F.lit(-1), "_to": F.lit(-1)}).unionByName(cut.join(ends, ["_series", "_piece"]))
    decoded = by_piece(both).mapInPandas(_decode, small.select("_row", "_unit").schema)
    factor = F.create_map(*[x for name, size in UNITS.items() for x in (F.lit(name), F.lit(str(size)).cast("decimal(12,2)"))])
    count = F.floor(F.col("_row.number") * F.element_at(factor, F.col("_unit"))).try_cast("bigint")
    return decoded.select(F.col("_row.row").alias("row"), count.alias("char_count"), F.col("_unit").alias("unit")).where("char_count is not null")
