"""Several values packed in one field, split by expectation-maximisation segmentation.

Lists (JSON or Python notation) and quoted spans are read exactly and stay atomic. Everything between is ambiguous: a
comma may separate values or belong to one. Each such field becomes a set of lattices, one for every scheme (the set of
delimiter characters that separate in this field); an edge of a lattice is a candidate value, which may run over
separators at a price. Expectation-maximisation learns from the whole column how often each value and each shape of
value (its pattern of scripts, words and signs) occurs: the maximisation step counts the values of the best
segmentations, the expectation step is a Viterbi pass with those counts.

Scale: counts live in a distributed table, keyed by value; candidates look their counts up by a shuffle join, so no
vocabulary is collected or broadcast. Python sees only one field at a time.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import checkpoint_dir

#: Characters that may separate values.
DELIMITERS = ",，、;；|｜/\n\t"
BLANKS = "  　​﻿\r\n\t"
#: Most pieces a value runs over (a value holds at most two separators of its scheme: part of the model, not of its search); price (nats) of every separator inside a value; log-priors of schemes by their size.
SPAN, INSIDE, SCHEMES = 3, 7.0, (-3.0, -0.4, -2.5, -4.5)
#: Weight of the shape model against counted values, probability of a shape that wasn't seen and its price for every
#: delimiter in the value, nats a character.
NOVEL, UNSEEN, SIGN, HAN, LETTER = 0.1, 1e-4, 13.0, 5.0, 1.5
#: A scheme that separates at blanks has this log-prior on top, and a price for every value that isn't counted.
SPACED, STRANGE = -1.5, 7.0

_HAN = "㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_HAN}]+|[A-Za-zÀ-ɏ']+|\d+|\s+|.", re.S)


@lru_cache(1 << 16)
def shape(value: str) -> str:
    """The pattern of a value: runs of Han characters by length, words by case, figures, signs; decoration left out."""
    value = re.sub(rf"(?<=[{_HAN}])\s+(?=[{_HAN}，：])|(?<=[，：])\s+(?=[{_HAN}])", "", re.sub(r"[【】《》「」!！]|（[^）]*）$", "", value))
    out = []
    for run in _WORD.findall(value):
        if re.match(f"[{_HAN}]", run):
            out.append(f"H{min(len(run), 8)}")
        elif run[0].isalpha():
            out.append("The" if run == "The" else "A" if run.isupper() and len(run) > 1 else "W" if run[0].isupper() else "w")
        else:
            out.append("9" if run.isdigit() else " " if run.isspace() else run)
    text = "".join(out)
    return re.sub(r"([,，、;；|/])\1+", r"\1", re.sub(r"(?:W ){3,}", "W* ", text))


def read_list(text: str) -> list[str] | None:
    """The values of a JSON or Python list, null entries left out; None if the text is no whole list of plain values."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for reader in (json.loads, ast.literal_eval):
        try:
            values = reader(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(values, list) and all(isinstance(v, (str, int, float)) or v is None for v in values):
            return [str(v).strip(BLANKS) for v in values if v is not None and str(v).strip(BLANKS)]
    return None


def tokens(text: str) -> list[tuple[str, bool, str]]:
    """(token, quoted, following delimiter) of a field; a quoted span starts and ends at delimiters, doubled quotes inside are one."""
    out, i, n = [], 0, len(text)
    quoted = re.compile(r'[  　]*"((?:[^"\\]|""|\\.)*)"[  　]*(?=[' + re.escape(DELIMITERS) + r"]|$)", re.S)
    plain = re.compile("[^" + re.escape(DELIMITERS) + "]*")
    while i <= n:
        if found := quoted.match(text, i):
            value = re.sub(r'\\(["\\])', r"\1", found[1].replace('""', '"'))
            out.append((value.strip(BLANKS), True, text[found.end() : found.end() + 1]))
        else:
            found = plain.match(text, i)
            out.append((found[0], False, text[found.end() : found.end() + 1]))
        i = found.end() + 1
    return out


def lattices(text: str) -> list[tuple[frozenset, list[list[tuple[str, bool]]]]]:
    """Schemes with their pieces. A piece is a list of atoms (token, quoted); pieces are separated by the scheme's delimiters."""
    parts = tokens(text)
    while parts and not parts[-1][1] and not parts[-1][0].strip(BLANKS):
        parts.pop()
        if parts:
            parts[-1] = (parts[-1][0], parts[-1][1], "")
    if not parts:
        return []
    present = sorted({d for _, _, d in parts if d})
    # Next to a quoted span a delimiter always separates, and a line end or tab does everywhere.
    forced = {d for (_, q, d), (_, r, _) in zip(parts, parts[1:], strict=False) if (q or r) and d} | ({"\n", "\t"} & set(present))
    free = sorted(set(present) - forced)
    sets = {frozenset(forced.union(chosen)) for n in range(len(free) + 1) for chosen in combinations(free, n)}
    blank = any(" " in t.strip(BLANKS) or "　" in t.strip(BLANKS) for t, q, _ in parts if not q)
    few = len(present) <= 1
    out = []
    for chosen in sorted(sets, key=lambda s: (len(s), sorted(s))):
        pieces, current = [], ""
        for token, quoted, delimiter in parts:
            if quoted and not current.strip(BLANKS):
                pieces.append((token, True))
            else:
                current += token
                if delimiter and delimiter not in chosen:
                    current += delimiter
                    continue
                pieces.append((current, False))
            current = ""
        if current.strip(BLANKS):
            pieces.append((current, False))
        out.append((chosen, [(p.strip(BLANKS), q) for p, q in pieces if p.strip(BLANKS)]))
        if blank and few and len(chosen) == len(present):
            spaced = [(w, False) for p, q in pieces if not q for w in re.split("[ 　 ]+", p.strip(BLANKS)) if w]
            if not any(q for _, q in pieces):
                out.append((chosen | {" "}, spaced))
    return out


def _joined(pieces: list[tuple[str, bool]], i: int, j: int, text: str, at: list[int]) -> str | None:
    """The text from piece i to before j as written, None if it isn't one plain span."""
    if any(q for _, q in pieces[i:j]):
        return pieces[i][0] if j == i + 1 else None
    return text[at[i] : at[j - 1] + len(pieces[j - 1][0])]


def _places(pieces: list[tuple[str, bool]], text: str) -> list[int]:
    at, i = [], 0
    for p, q in pieces:
        k = text.find(p, i) if not q else -1
        at.append(k)
        i = max(i, k + len(p)) if k >= 0 else i
    return at


def edges(text: str) -> list[tuple[frozenset, list[tuple[int, int, str, bool]], int]]:
    """For every scheme: its edges (from, to, value, quoted) and the number of pieces."""
    out = []
    for chosen, pieces in lattices(text):
        at, own = _places(pieces, text), []
        for i in range(len(pieces)):
            for j in range(i + 1, min(len(pieces), i + SPAN) + 1):
                value = _joined(pieces, i, j, text, at) if j > i + 1 else pieces[i][0]
                if value and (j == i + 1 or (at[i] >= 0 and at[j - 1] >= 0)):
                    own.append((i, j, value, pieces[i][1]))
        out.append((chosen, own, len(pieces)))
    return out


@lru_cache(1 << 16)
def _letters(value: str) -> tuple[int, int, int]:
    """Han characters, other letters and delimiters of a value."""
    han = len(re.findall(f"[{_HAN}]", value))
    return han, len(re.findall(r"\w", value)) - han, sum(c in DELIMITERS for c in value)


def price(value: str, count: float, total: float, shape_count: float, shapes: float) -> float:
    """Minus the log-probability of a value: counted values mixed with the model of shapes."""
    han, letters, signs = _letters(value)
    pattern = math.log(shape_count / shapes) if shape_count > 0 else math.log(UNSEEN) - SIGN * signs
    novel = pattern - HAN * han - LETTER * letters + math.log(NOVEL)
    if count <= 0:
        return -novel
    known = math.log((1 - NOVEL) * count / max(total, 1.0))
    return -(max(known, novel) + math.log1p(math.exp(-abs(known - novel))))


def best(text: str, counts: dict[str, float], shapes: dict[str, float], total: float) -> list[str]:
    """The most probable segmentation of a field; ties go to the scheme with fewer delimiters."""
    least, chosen_values, prices = math.inf, [], {}
    for chosen, own, n in edges(text):
        size = len(chosen - {" "})
        start = -SCHEMES[min(size, len(SCHEMES) - 1)] - (SPACED if " " in chosen else 0.0)
        score, back = [start] + [math.inf] * n, [None] * (n + 1)
        for i, j, value, quoted in own:
            if value not in prices:  # many schemes have the same pieces
                prices[value] = price(value, counts.get(value, 0.0), total, shapes.get(shape(value), 0.0), total)
            cost = 0.0 if quoted else prices[value]
            cost += score[i] + INSIDE * (j - i - 1) + (STRANGE if " " in chosen and counts.get(value, 0.0) <= 0 else 0.0)
            if cost < score[j]:
                score[j], back[j] = cost, (i, value)
        if score[n] < least:
            least, values, j = score[n], [], n
            while j:
                j, value = back[j]
                values.append(value)
            chosen_values = values[::-1]
    return chosen_values


def _lookups(values: list[str]) -> list[str]:
    """The names that a set of candidate values has to look up: v and a value, s and a shape."""
    return ["v" + v for v in values] + ["s" + x for x in sorted({shape(v) for v in values})]


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact readings and first guesses: split at the only kind of delimiter, else no guess; lookups of ambiguous fields."""
    for batch in batches:
        values, lookups = [], []
        for text in batch["text"]:
            text = (text or "").strip(BLANKS)
            listed = read_list(text)
            if listed is not None:
                values.append(listed)
                lookups.append(None)
                continue
            options = edges(text)
            firm = [(chosen, own) for chosen, own, _ in options if " " not in chosen]
            sure = len(options) == 1 and all(j == i + 1 for i, j, _, _ in options[0][1])
            if firm and max(len(chosen) for chosen, _ in firm) <= 1:
                guess = [v for i, j, v, _ in firm[-1][1] if j == i + 1]
            else:
                guess = [v for i, j, v, q in firm[0][1] if q] if firm else []
            values.append(guess)
            lookups.append(None if sure else _lookups(sorted({v for _, own, _ in options for _, _, v, q in own if not q})))
        yield batch.assign(values=values, shapes=[[shape(v) for v in vs] for vs in values], lookups=lookups)


def _viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, own, own_shapes, names, found, total in zip(batch["text"], batch["values"], batch["shapes"], batch["lookups"], batch["found"], batch["total"], strict=True):
            counts, shapes = {}, {}
            for code in found.tolist():
                asked = names[code >> COUNT_BITS]
                (counts if asked[0] == "v" else shapes)[asked[1:]] = float(code & ((1 << COUNT_BITS) - 1))
            for value in own:  # leave the field's own vote out
                counts[value] = counts.get(value, 0.0) - 1
            for pattern in own_shapes:
                shapes[pattern] = shapes.get(pattern, 0.0) - 1
            out.append(best((text or "").strip(BLANKS), counts, shapes, float(total or 1)))
        moved = [list(own) != new for own, new in zip(batch["values"], out, strict=True)]
        yield batch[["row", "field", "text", "lookups"]].assign(values=out, shapes=[[shape(v) for v in vs] for vs in out], moved=moved)


def _tally(frame: DataFrame) -> DataFrame:
    """Occurrences of every value and every shape: field, name (as in ``_lookups``), n."""
    named = F.concat(F.transform("values", lambda v: F.concat(F.lit("v"), v)), F.transform("shapes", lambda v: F.concat(F.lit("s"), v)))
    return frame.select("field", F.explode(named).alias("name")).groupBy("field", "name").agg(F.count(F.lit(1)).alias("n"))


#: A name that more than one in OFTEN of all candidates look up is hot; there are at most OFTEN such names.
OFTEN = 2000
#: A count travels with the place of its name among the field's lookups in one number, of which it takes so many bits.
COUNT_BITS = 40


def _found(wanted: DataFrame, counts: DataFrame, hot: DataFrame) -> DataFrame:
    """``wanted`` (row, field, pos, name) with the counts of their names as (pos, count) in one number, gathered by row and field.

    A name that very many rows ask for is no key of the shuffle join: at most ``OFTEN`` such names are sent out.
    """
    name = ["field", "name"]
    few = F.broadcast(counts.join(F.broadcast(hot), name, "left_semi"))
    rest = wanted.join(F.broadcast(hot), name, "left_anti").join(counts, name)
    return wanted.join(few, name).unionByName(rest).groupBy("row", "field").agg(F.collect_list(F.shiftleft(F.col("pos").cast("bigint"), COUNT_BITS) + F.col("n")).alias("found"))


def split(fields: DataFrame, rounds: int = 6, changed: float = 0.002) -> DataFrame:
    """Fields (row struct, field string, text string) as (row, field, item_count, item_no, item_value), one row a value.

    Value frequencies are learned per ``field`` over all rows, in rounds of expectation and maximisation until at most the
    share ``changed`` of the ambiguous fields is split anew, or ``rounds`` are over. ``item_no`` counts the non-empty values of a
    text from 1; values are without outer blanks, quoting and escapes. Null and blank texts give no row; a text with one
    value gives one row. Rows repeated exactly count once. ``row`` is carried through and must identify the text together
    with ``field``. Texts of any length and with any delimiters are treated alike: every set of the delimiters that a text
    holds is tried.
    """
    checkpoint_dir(fields.sparkSession)
    texts = T.ArrayType(T.StringType())
    base = fields.select("row", "field", "text")
    schema = T.StructType([*base.schema, T.StructField("values", texts), T.StructField("shapes", texts), T.StructField("lookups", texts)])
    solved = T.StructType([*base.schema, T.StructField("lookups", texts), T.StructField("values", texts), T.StructField("shapes", texts), T.StructField("moved", T.BooleanType())])
    read = base.where("trim(text) != ''").distinct().mapInPandas(_first, schema).checkpoint()
    sure, current = read.where("lookups is null"), read.where("lookups is not null")
    certain = _tally(sure).checkpoint()
    wanted = current.select("row", "field", F.posexplode("lookups").alias("pos", "name"))
    asked = wanted.groupBy("field", "name").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = asked.where(F.col("n") > total / OFTEN).select("field", "name")
    for step in range(rounds):
        counts = certain.unionByName(_tally(current)).groupBy("field", "name").agg(F.sum("n").alias("n"))
        totals = counts.where("name like 'v%'").groupBy("field").agg(F.sum("n").alias("total"))
        found = _found(wanted, counts, hot)
        ready = current.join(found, ["row", "field"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>"))).join(totals, "field", "left")
        current = ready.mapInPandas(_viterbi, solved).checkpoint()
        n, moved = current.agg(F.count(F.lit(1)), F.sum(F.col("moved").cast("long"))).first()
        if step and (moved or 0) <= changed * n:
            break
    items = F.posexplode("values").alias("item_no", "item_value")
    both = sure.select("row", "field", "values").unionByName(current.select("row", "field", "values"))
    return both.select("row", "field", F.size("values").alias("item_count"), items).withColumn("item_no", F.col("item_no") + 1)
