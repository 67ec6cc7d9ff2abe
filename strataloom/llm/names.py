"""Names in Chinese, pinyin and English brought to common keys.

Simplified forms and readings of characters come from the Unicode transliteration rules that ship with Spark (ICU);
readings that the data contradict are learned from records that give a name both ways, and so is a dictionary of
Chinese and English phrases. Both tables are bounded: by the number of characters, and by ``LEAST_SHARE``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST, LAST = 0x4E00, 0x9FFF
HAN = re.compile("[㐀-鿿豈-﫿]")
#: A phrase pair is learned if it is in at least this share of the records with both languages (and in LEAST of them), with this Dice coefficient.
LEAST_SHARE, LEAST, DICE = 1e-4, 3, 0.5
#: Words of English titles that carry no name.
FUNCTION_WORDS = frozenset("the of and a an in at as on to for by with from i".split())
#: Words that make a title a continuation, by kind.
CONTINUATIONS = (
    ("part", re.compile(r"第([二三四五六七八九])[部卷季]|part (two|three|four)|book (two|three)|di (?:er|san|si) bu|第[2-9]部|vol(?:ume)?\.? ?[2-9]", re.I)),
    ("side", re.compile(r"外传|番外|side story|waizhuan|fanwai|外傳", re.I)),
    ("sequel", re.compile(r"续集|續集|续篇|sequel|xuji|后传|後傳", re.I)),
    ("prequel", re.compile(r"前传|前傳|prequel|qianzhuan", re.I)),
)
_NOISE = re.compile(r"（[^）]*）|\([^)]*\)|[【】《》〈〉「」『』!！\s]")
#: Texts that stand for a missing name.
MISSING = frozenset(["", "未知", "暂无", "佚名", "无", "待定", "n/a", "-", "--", "unknown", "anonymous", "none", "null"])


@dataclass
class Script:
    """Simplified forms, readings and the phrase dictionary."""

    simple: dict[str, str]
    reading: dict[str, str]
    phrases: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.syllables = frozenset(self.reading.values())
        self.chinese = frozenset(self.phrases.values())

    def plain(self, name: str) -> str:
        """Simplified, without decoration, blanks and remarks in brackets; '' for placeholders and names that were cut short."""
        text = "".join(self.simple.get(c, c) for c in name or "")
        if re.search(r"(…|\.{2,})\s*$", text) or text.strip().lower() in MISSING:
            return ""
        return _NOISE.sub("", text) if HAN.search(text) else re.sub(r"\((?:WN|web ?novel)\)", "", text, flags=re.I).strip()

    def sounds(self, name: str) -> tuple[str, ...]:
        """The syllables of a Chinese name, or of one in pinyin; () if it is neither."""
        if HAN.search(name):
            return tuple(self.reading.get(c, c) for c in name if HAN.match(c) or c.isalnum())
        return self.spelled(re.sub("[^a-z ]", "", name.lower()))

    def spelled(self, letters: str) -> tuple[str, ...]:
        out: list[str] = []
        for word in letters.split():
            cut = _cut(word, self.syllables)
            if cut is None:
                return ()
            out += cut
        return tuple(out)

    def phrase_key(self, name: str) -> str:
        """The known phrases of a title, in Chinese, sorted; '' if fewer than two."""
        out: list[str] = []
        if HAN.search(name):
            i = 0
            while i < len(name) - 1:
                if name[i : i + 2] in self.chinese:
                    out.append(name[i : i + 2])
                    i += 2
                else:
                    i += 1
        else:
            words, i = english(name), 0
            while i < len(words):
                for n in (3, 2, 1):
                    found = self.phrases.get(" ".join(words[i : i + n])) if i + n <= len(words) else None
                    if found:
                        out.append(found)
                        i += n
                        break
                else:
                    i += 1
        return "".join(sorted(out)) if len(out) >= 2 else ""


def english(name: str) -> list[str]:
    return [w for w in re.findall("[a-z]+", re.sub("'s\\b", "", name.lower())) if w not in FUNCTION_WORDS]


@lru_cache(1 << 16)
def _cut(word: str, syllables: frozenset) -> tuple[str, ...] | None:
    """The cut of a word into the fewest syllables."""
    best: list[tuple[str, ...] | None] = [()] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 6), j):
            before = best[i]
            if before is not None and word[i:j] in syllables and (best[j] is None or len(before) + 1 < len(best[j])):
                best[j] = (*before, word[i:j])
    return best[-1]


def continuation(name: str) -> str:
    return next((kind for kind, pattern in CONTINUATIONS if pattern.search(name)), "")


def pieces(field_text: str | None) -> list[str]:
    """All values that a packed field may hold: its parts at every delimiter, and parts of one script with a comma between them together."""
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), field_text or "").strip()
    found = re.split(r"([,，、;；|｜/\n\t])", text)
    parts = [re.sub(r"""^[\s\["'\\]+|[\s\]"'\\]+$""", "", p).replace('""', '"') for p in found[::2]]
    pairs = [f"{a}, {b}" for a, d, b in zip(parts, found[1::2], parts[1:], strict=False) if a and b and d in ",，" and bool(HAN.search(a)) == bool(HAN.search(b))]
    return [p for p in [*parts, *pairs] if p]


def base_script(spark: SparkSession) -> Script:
    """Tables from ICU's rules, for the unified ideographs; an error if ICU isn't there, as without them names only seem to differ."""
    every = "".join(map(chr, range(FIRST, LAST + 1)))
    try:
        maker = spark._jvm.com.ibm.icu.text.Transliterator
        simple = maker.getInstance("Traditional-Simplified").transliterate(every)
        read = maker.getInstance("Han-Latin; Latin-ASCII; Lower").transliterate("|".join(every)).split("|")
    except Exception as error:
        raise RuntimeError("ICU's transliteration rules (com.ibm.icu, which ships with Spark) can't be used") from error
    if len(simple) != len(every) or len(read) != len(every):
        raise RuntimeError(f"ICU gave {len(simple)} simplified forms and {len(read)} readings of {len(every)} ideographs")
    return Script({a: b for a, b in zip(every, simple, strict=True) if a != b}, {c: r.strip() for c, r in zip(every, read, strict=True) if r.strip().isascii() and r.strip().isalpha()})


def _both_ways(script: Script, names: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(character, syllable) wherever a Chinese and a pinyin name of one record agree in all syllables but one or two."""
    plain = [script.plain(n) for n in names]
    chinese = [n for n in plain if HAN.search(n)]
    spelled = [s for n in plain if n and not HAN.search(n) and (s := script.spelled(re.sub("[^a-z ]", "", n.lower())))]
    for name in chinese:
        chars = [c for c in name if HAN.match(c)]
        for sounds in spelled:
            if len(chars) == len(sounds) >= 3 and sum(script.reading.get(c) == s for c, s in zip(chars, sounds, strict=True)) >= len(chars) - 2:
                yield from zip(chars, sounds, strict=True)
                break


def learn(spark: SparkSession, records: DataFrame) -> Script:
    """The script tables for records (names array<string>): every record with a name in two forms is counted."""
    base = base_script(spark)
    shared = spark.sparkContext.broadcast(base)

    def readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([pair for names in batch["names"] for pair in _both_ways(shared.value, names)], columns=["c", "s"])

    seen = records.mapInPandas(readings, "c string, s string").groupBy("c", "s").count()
    best = seen.groupBy("c").agg(F.max_by("s", F.struct("count", "s")).alias("s"), F.max("count").alias("n")).where(f"n >= {LEAST}")
    script = Script(base.simple, base.reading | {r.c: r.s for r in best.collect()})
    told = spark.sparkContext.broadcast(script)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*key, n) for key, n in tally.items()], columns=["kind", "z", "e", "n"])
            tally.clear()
            return out

        for batch in batches:
            for names in batch["names"]:
                plain = [told.value.plain(n) for n in names]
                two = {n[i : i + 2] for n in plain if HAN.search(n) for i in range(len(n) - 1) if HAN.match(n[i]) and HAN.match(n[i + 1])}
                latin = [english(n) for n in plain if n and not HAN.search(n) and not told.value.spelled(re.sub("[^a-z ]", "", n.lower()))]
                words = {" ".join(w[i : i + n]) for w in latin for n in (1, 2, 3) for i in range(len(w) - n + 1)}
                if two and words:
                    tally["r", "", ""] += 1
                    tally.update(("z", z, "") for z in two)
                    tally.update(("e", "", e) for e in words)
                    tally.update(("p", z, e) for z in two for e in words)
            if len(tally) > 400_000:
                yield rows()
        yield rows()

    counted = records.mapInPandas(phrases, "kind string, z string, e string, n long")
    counts = counted.groupBy("kind", "z", "e").agg(F.sum("n").alias("count")).where(f"count >= {LEAST} or kind = 'r'").persist()
    total = counts.where("kind = 'r'").agg(F.sum("count")).first()[0] or 0
    floor = max(LEAST, int(total * LEAST_SHARE))
    z = counts.where(f"kind = 'z' and count >= {floor}").select("z", F.col("count").alias("nz"))
    e = counts.where(f"kind = 'e' and count >= {floor}").select("e", F.col("count").alias("ne"))
    pairs = counts.where(f"kind = 'p' and count >= {floor}").join(z, "z").join(e, "e").withColumn("dice", 2 * F.col("count") / (F.col("nz") + F.col("ne"))).where(f"dice >= {DICE}")
    # The best Chinese phrase of an English one; of equally good English phrases the longer is the name.
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy(F.desc("dice"), "z")))
    phrases_found = {r.e: r.z for r in ranked.where("n = 1").select("e", "z").collect()}
    counts.unpersist()
    return Script(base.simple, script.reading, phrases_found)
