"""Text that was read in a wrong character encoding: find it and restore the original.

Every chain of (encoding it was read in, encoding it was written in) that can be undone gives a candidate text. Each
candidate is compressed with zstandard dictionaries, one for each language group, trained on the same columns;
its description length is the smallest compressed size plus a price for every step of the chain. The shortest wins, and
text that no chain shortens stays unchanged. Damage may cover a part of a text: candidates are made for the spans that
the wrong encoding could have produced.

Prices of characters, the alphabet and the patterns that the dictionaries are made of are counted over every different
text. Every text is examined whole.
"""

from __future__ import annotations

import codecs
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that text was read in by mistake, of one byte and of several bytes a character.
SINGLE = ("latin_1", "cp1252", "mac_roman", "cp1251", "koi8_r", "cp437", "cp850", "cp1250")
MULTI = ("gb18030", "big5", "big5hkscs", "cp932", "cp949")
#: Encodings it was written in.
WRITTEN = ("utf-8", "gb18030", "big5hkscs", "cp932", "cp1252")
#: Bytes of description for one step of a chain and for every cut of the text into a damaged span; most steps.
STEP, CUT, DEPTH = 2.0, 1.0, 3
#: Texts that are followed from one step to the next at first; all are where that leads to no clean text.
BEAM = 3
DICTIONARY, LEVEL = 1 << 16, 15
#: Bytes for a nat of a character's price, nats of a character that no example has, nats a span must gain to be a candidate, nats of a variant above the common form.
RARE, UNSEEN, GAIN, VARIANT = 0.4, 26.0, 6.0, 1.5
#: Bytes of a segment that may go into a dictionary; counters of patterns, and of one block of them.
SEGMENT, SLOTS, BLOCK = 64, 1 << 20, 1 << 12
LOST = "�"
_UTF8 = codecs.getincrementaldecoder("utf-8")


def _single_table(name: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the control character of the same number."""
    table = {chr(b): b for b in range(128)}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_TABLES = {name: _single_table(name) for name in SINGLE}
_TO_LATIN = {name: {ord(c): chr(b) for c, b in table.items()} for name, table in _TABLES.items()}
_RUNS = {name: re.compile("[" + re.escape("".join(c for c in t if ord(c) > 127)) + "](?:[" + re.escape("".join(t)) + "]*[" + re.escape("".join(c for c in t if ord(c) > 127)) + "])?") for name, t in _TABLES.items()}
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff-�]")
#: Bytes of a UTF-8 sequence, as characters of the same numbers.
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Bytes of characters of two bytes each: Latin words hardly have so many letters beyond ASCII in a row.
_HIGH = re.compile("[\x80-\xff]{4,}")
_ASCII = bytes(range(128))
#: Characters of three bytes and more in UTF-8, but for the replacement character.
_FAR = re.compile("[\u0800-\ufffc\ufffe-\U0010ffff]")
#: What bytes must look like to be valid: most readings fail here, which costs less than an exception.
_SHAPES = {
    "utf-8": re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*"),
    "gb18030": re.compile(rb"(?:[\x00-\x7f]|[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[0-9][\x81-\xfe][0-9]))*"),
    "big5hkscs": re.compile(rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\xa1-\xfe])*"),
    "cp932": re.compile(rb"(?:[\x00-\x80\xa0-\xdf\xfd-\xff]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*"),
    "cp1252": re.compile(rb"[^\x81\x8d\x8f\x90\x9d]*"),
}
_HAN = re.compile("[㐀-鿿豈-﫿]")
#: Characters that wrong readings hardly produce: signs of East Asian text, full-width forms, enclosed figures and stars.
_PLAIN = re.compile("[　-〟！-～①-⑳☆★“”‘’…—·]")


def members(value: object, name: str | None = None) -> Iterator[tuple[str, str]]:
    """(innermost member name, text) of every text in a JSON value."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from members(inner, key)
    elif isinstance(value, list):
        for inner in value:
            yield from members(inner, name)
    elif isinstance(value, str) and name is not None:
        yield name, value


_MEMBER = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|\[(?:\s*"(?:[^"\\]|\\.)*"\s*,?)*\]?)', re.S)


def json_texts(raw: str) -> list[tuple[str, str]]:
    """The texts of a JSON document; of one that is cut off or invalid, those members that are whole."""
    try:
        return list(members(json.loads(raw)))
    except (ValueError, RecursionError):
        out = []
        for name, value in _MEMBER.findall(raw):
            for piece in re.findall(r'"(?:[^"\\]|\\.)*"', value):
                try:
                    out.append((json.loads(f'"{name}"'), json.loads(piece)))
                except ValueError:
                    continue
        return out


def _group(text: str) -> str:
    if not _HAN.search(text):
        return "latin"
    try:
        text.encode("gb2312")
        return "zh-hans"
    except UnicodeEncodeError:
        return "zh-hant"


class _Prices(dict):
    """Prices of characters, that of unseen ones included, and for each pair of encodings what every character gains."""

    def __init__(self, costs: dict[str, float]) -> None:
        super().__init__(costs)
        self.gains = {(name, written): _Gains(self, name, written) for name in MULTI for written in WRITTEN[1:] if written != name}

    def __missing__(self, c: str) -> float:
        return UNSEEN


class _Gains(dict):
    """Price of a character less that of the one its bytes were written for; minus infinity where there is none."""

    def __init__(self, prices: _Prices, name: str, written: str) -> None:
        super().__init__((chr(b), 0.0) for b in range(128))
        self.prices, self.name, self.written = prices, name, written

    def __missing__(self, c: str) -> float:
        fixed = _mapped(self.name, self.written, c)
        self[c] = gain = -math.inf if fixed is None else self.prices[c] - self.prices[fixed]
        return gain


@dataclass
class Model:
    """Dictionaries by language group, and the alphabet: characters that occur in texts no chain can undo."""

    dictionaries: dict[str, bytes]
    alphabet: str
    costs: dict[str, float]
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "alphabet": self.alphabet, "costs": self.costs, "_ready": {}}

    def _tools(self) -> dict:
        if not self._ready:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            for name, content in self.dictionaries.items():
                data = zstandard.ZstdCompressionDict(content)
                data.precompute_compress(compression_params=params)
                self._ready[name] = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
            self._ready["plain"] = zstandard.ZstdCompressor(compression_params=params)
            self._prices = _Prices(self.costs)
            self._clean = re.compile(f"[{re.escape(self.alphabet)}\x20-\x7e\n]*")
        return self._ready

    def length(self, text: str) -> float:
        """Description length: compressed bytes by the best dictionary, and a share of the characters' own prices.

        A short text has few repeats that a dictionary could use; there the prices of its characters decide.
        """
        return self._compressed(text) + self.least(text)

    def _compressed(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        return min([len(c.compress(data)) for c in self._tools().values()])

    def least(self, text: str) -> float:
        """A lower bound of ``length``: the characters' prices alone."""
        return RARE * sum(map(self.costs.get, text, repeat(UNSEEN)))

    def clean(self, text: str) -> bool:
        self._tools()
        return self._clean.fullmatch(text) is not None

    def restore(self, text: str) -> str | None:
        """The original text; '' if parts of it are lost; None if the text is not damaged."""
        if LOST in text:
            return ""
        if self.clean(text):
            return None
        steps: dict[str, list[tuple[str, int]]] = {}
        sizes: dict[str, int] = {}
        least = self._shortest(text, BEAM, steps, sizes)
        if not self.clean(least):  # the beam led to no text of the alphabet alone: every chain is followed
            least = self._shortest(text, None, steps, sizes)
        if least != text:
            return "" if _partly_lost(least, text, self.costs) else least
        return "" if _lost(text) else None

    def _shortest(self, text: str, width: int | None, steps: dict[str, list[tuple[str, int]]], sizes: dict[str, int]) -> str:
        """The text of the shortest description that a chain leads to; of the texts of a step the best ``width`` are followed.

        ``steps`` and ``sizes`` keep the candidates and compressed sizes of texts, for a further call.
        """
        seen, frontier = {text: (self.length(text), text)}, [(text, 0.0)]
        for _ in range(DEPTH):
            following = []
            for current, paid in frontier:
                found = steps[current] if current in steps else candidates(current, self._prices)
                if width is not None:  # few texts; all of the chains of a long text would fill the memory
                    steps[current] = found = list(found)
                for candidate, cuts in found:
                    if candidate in seen or _BAD.search(candidate) and not _BAD.search(current):
                        continue
                    price = paid + STEP + CUT * cuts
                    least = self.least(candidate)
                    if least + price >= seen[current][0]:  # it can't be shorter, however well it compresses
                        continue
                    if candidate not in sizes:
                        sizes[candidate] = self._compressed(candidate)
                    seen[candidate] = (sizes[candidate] + least + price, candidate)
                    if seen[candidate] < seen[current]:
                        following.append((candidate, price))
            frontier = sorted(following, key=lambda f: seen[f[0]])[:width]
            # A text made of the alphabet alone hides no further step.
            if not frontier or self.clean(frontier[0][0]):
                break
        return min(seen.values())[1]


def _decoded(data: bytes, written: str) -> str | None:
    """The text that the bytes were written for, None if they are not valid; that of short bytes is remembered."""
    return _decode_short(data, written) if len(data) <= 16 else _decode(data, written)


def _decode(data: bytes, written: str) -> str | None:
    if not _SHAPES[written].fullmatch(data):
        return None
    try:
        return data.decode(written)
    except UnicodeDecodeError:
        return None


_decode_short = lru_cache(1 << 16)(_decode)


def candidates(text: str, prices: _Prices) -> Iterator[tuple[str, int]]:
    """Texts that one wrong reading could have turned into this one, with the number of places where damage starts or ends inside."""
    tried: set[tuple] = set()
    for name, table in _TABLES.items():
        spans = [m.span() for m in _RUNS[name].finditer(text)]
        if not spans:
            continue
        latin = text.translate(_TO_LATIN[name])
        sign = (*spans, *(latin[a:b] for a, b in spans))
        if sign in tried:  # another encoding has the same bytes for these spans
            continue
        tried.add(sign)
        read = [piece.encode("latin-1") for piece in sign[len(spans) :]]
        high = sum([len(data.translate(None, _ASCII)) for data in read])
        # The second byte of a character may be an ASCII letter, which then follows the span.
        longer = [data + latin[b].encode("latin-1") if b < len(text) and text[b] in table else None for (_, b), data in zip(spans, read, strict=True)]
        sequences = [_SEQUENCE.search(latin, a, b) for a, b in spans]
        for written in WRITTEN:
            if written == "cp1252" and name in ("latin_1", "cp1252") or written != "utf-8" and high < 2:
                continue
            out, at, cuts = [], 0, 0
            for (a, b), data, more, found in zip(spans, read, longer, sequences, strict=True):
                if written == "utf-8":
                    fixed = _decoded(data, written) if found else None
                elif (fixed := _decoded(data, written)) is None and more is not None and (fixed := _decoded(more, written)) is not None:
                    b += 1
                if fixed is None and written == "utf-8" and found:
                    # Damage in parts: single sequences between characters that are none.
                    piece, last = [], a
                    while found:
                        try:
                            piece += [text[last : found.start()], found[0].encode("latin-1").decode("utf-8")]
                            last = found.end()
                        except UnicodeDecodeError:
                            pass
                        found = _SEQUENCE.search(latin, found.end(), b)
                    fixed = "".join(piece) + text[last:b]
                    cuts += 2
                if fixed is None:
                    continue
                out.append(text[at:a] + fixed)
                cuts += (a > 0 and ord(text[a - 1]) > 127) + (b < len(text) and ord(text[b]) > 127)
                at = b
            if not out:
                continue
            fixed_text = "".join(out) + text[at:]
            if fixed_text != text:
                yield fixed_text, cuts
    for name in MULTI:
        chunks = [_encoded(name, c) for c in text]
        if len([b for b in chunks if b is not None and len(b) > 1]) < 2:
            continue
        yield from _utf8_spans(text, chunks)
        for written in WRITTEN[1:]:
            if written != name and (found := _aligned_span(text, prices.gains[name, written])):
                yield found


@lru_cache(1 << 17)
def _encoded(name: str, c: str) -> bytes | None:
    try:
        return c.encode(name)
    except UnicodeEncodeError:
        return None


@lru_cache(1 << 18)
def _mapped(name: str, written: str, c: str) -> str | None:
    """The one character that the bytes of this one were written for, if there is one."""
    data = _encoded(name, c)
    try:
        fixed = data.decode(written) if data is not None else None
    except UnicodeDecodeError:
        return None
    return fixed if fixed is not None and len(fixed) == 1 else None


def _utf8_spans(text: str, chunks: list[bytes | None]) -> Iterator[tuple[str, int]]:
    """The text with the spans decoded whose bytes are valid UTF-8 of two characters or more: spans that start and end
    beyond the Latin letters, and, where that differs, all of them."""
    before = None
    for far in (True, False):
        spans, i, n = [], 0, len(text)
        while i < n:
            lead = chunks[i]
            if lead is None or len(lead) < 2 or not (0xE0 if far else 0xC2) <= lead[0] <= 0xF4:
                i += 1
                continue
            decoder, decoded, whole = _UTF8(), "", None
            try:
                for j in range(i, n):
                    if chunks[j] is None:
                        break
                    decoded += decoder.decode(chunks[j])
                    if not decoder.getstate()[0] and (not far or not 0x7F < ord(decoded[-1]) < 0x800):
                        whole = (j + 1, decoded)
            except UnicodeDecodeError:
                pass
            if whole is not None and sum(ord(c) > (0x7FF if far else 127) for c in whole[1]) >= 2:
                spans.append((i, *whole))
                i = whole[0]
            else:
                i += 1
        if not spans or spans == before:
            continue
        before, out, at, cuts = spans, [], 0, 0
        for a, b, decoded in spans:
            out += [text[at:a], decoded]
            cuts += (a > 0) + (b < n)
            at = b
        yield "".join(out) + text[at:], cuts


def _aligned_span(text: str, gains: _Gains) -> tuple[str, int] | None:
    """The text with the one span decoded, character by character, that gains most by the characters' prices."""
    best, a, b, total, start = 0.0, 0, 0, 0.0, 0
    for i, gain in enumerate(map(gains.__getitem__, text)):
        total += gain
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, a, b = total, start, i + 1
    if best < GAIN or b - a < 2:
        return None
    fixed = "".join([c if c < "\x80" else _mapped(gains.name, gains.written, c) for c in text[a:b]])
    return text[:a] + fixed + text[b:], (a > 0) + (b < len(text))


def _lost(text: str) -> bool:
    """Whether a span of the text is mostly another encoding's bytes, though parts of them are gone."""
    for name, table in _TABLES.items():
        for m in _RUNS[name].finditer(text):
            span = m.group()
            high = sum(ord(c) > 127 for c in span)
            if high < 4:
                continue
            decoded = bytes(table[c] for c in span).decode("utf-8", "replace")
            good = sum(ord(c) > 0x7FF and c != LOST for c in decoded)
            if good >= 2 and good * 3 >= 0.6 * high:
                return True
    for name in ("gb18030", "big5hkscs"):
        data = text.encode(name, "ignore")
        decoded = data.decode("utf-8", "replace")
        good = len(_HAN.findall(decoded))
        if good >= 3 and good * 3 >= 0.6 * sum(b > 127 for b in data):
            return True
    return False


def _partly_lost(fixed: str, text: str, costs: dict[str, float]) -> bool:
    """Whether the best chain still leaves control characters or a stray replacement mark beside a restored span."""
    return bool(_BAD.search(fixed)) or ("?" in text and bool(re.search(r"[㐀-鿿]\?|\?[㐀-鿿]", fixed)) and _lost(text))


def undoable(text: str) -> bool:
    """Whether any chain could apply: such texts are no examples of clean text."""
    if LOST in text or _BAD.search(text):
        return True
    if text.isascii():
        return False
    for name, table in _TABLES.items():
        if any(_decoded(bytes(map(table.__getitem__, run)), "utf-8") is not None for run in _RUNS[name].findall(text)):
            return True
    if not _HAN.search(text):
        latin = text.translate(_TO_LATIN["cp1252"])
        if _SEQUENCE.search(latin):  # damage in parts
            return True
        for run in _HIGH.findall(latin):
            for name in ("gb18030", "big5hkscs"):
                try:
                    run.encode("latin-1").decode(name)
                    return True
                except UnicodeDecodeError:
                    continue
    for name in ("gb18030", "big5hkscs"):
        data = text.encode(name, "ignore")
        good = len(_FAR.findall(data.decode("utf-8", "ignore")))
        if good >= 2 and good * 3 >= 0.5 * len(data.translate(None, _ASCII)):
            return True
    return False


GROUPS = ("zh-hans", "zh-hant", "latin")


def _priced(kind: str, text: str) -> str:
    """The group in whose prices a text counts: keys and addresses in ASCII don't make the letters of other Latin texts dear."""
    return "ascii" if kind == "latin" and text.isascii() else kind


def _floor(texts: int) -> int:
    """In how many texts of a group a character must be to count as usual there."""
    # Wrong readings of one multi-byte encoding in another look valid, but most of their characters are rare.
    return max(2, texts // 2000)


def _kept(text: str, usual: set[str], variants: dict[str, str]) -> bool:
    """Whether a text is an example: its characters, or the common forms of them, are usual."""
    return sum(variants.get(c, c) in usual for c in text) >= 0.8 * len(text)


def _room(size: int) -> int:
    """Bytes of the dictionary of texts of this size: what is in few of them stays out."""
    return min(DICTIONARY, max(512, size // 8))


def _model(used: dict[str, Counter], kept: int, examples: dict[str, list[bytes]], rooms: dict[str, int], variants: dict[str, str]) -> Model:
    """Prices and alphabet from the characters of ``kept`` texts by group, dictionaries of ``rooms`` bytes from examples."""
    costs: dict[str, float] = {}
    counts = sum(used.values(), Counter())
    for tally in used.values():
        total = sum(tally.values()) or 1
        for c, n in tally.items():  # a character costs what it costs in the language it is most usual in
            costs[c] = min(costs.get(c, UNSEEN), math.log(total / n))
    for rare, usual in variants.items():
        if usual in costs:
            costs[rare] = min(costs.get(rare, UNSEEN), costs[usual] + VARIANT)
    dictionaries = {}
    for name, samples in examples.items():
        try:
            dictionaries[name] = zstandard.train_dictionary(rooms[name], samples, k=64, d=6, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            dictionaries[name] = b"".join(samples)[-DICTIONARY:]
    often = max(3, kept // 5000)
    usual = {c for c, n in counts.items() if n >= often and (_HAN.match(c) or _PLAIN.match(c))}
    alphabet = "".join(sorted(usual | {rare for rare, form in variants.items() if form in usual}))
    return Model({k: v for k, v in dictionaries.items() if len(v) >= 8}, alphabet, costs)


def fit(texts: list[str], variants: dict[str, str] | None = None) -> Model:
    """Dictionaries, alphabet and character prices from example texts, damaged ones among them left out.

    ``variants`` maps a character to its more common form (traditional to simplified); a variant that the examples lack
    is priced a little above that form.
    """
    variants = variants or {}
    by: dict[str, list[str]] = {name: [] for name in GROUPS}
    for t in sorted(t for t in texts if t and not undoable(t)):
        by[_group(t)].append(t)
    used: dict[str, Counter] = {}
    for name, members_of in by.items():
        floor = _floor(len(members_of))
        if name == "zh-hant":  # such readings gather here: a text counts if its simplified form is usual
            usual = {c for c, n in used["zh-hans"].items() if n >= floor}
            by[name] = [t for t in members_of if _kept(t, usual, variants)]
        else:
            usual = {c for c, n in Counter(c for t in members_of for c in set(t)).items() if n >= floor}
            by[name] = [t for t in members_of if _kept(t, usual, {})]
        for t in by[name]:
            used.setdefault(_priced(name, t), Counter()).update(t)
        used.setdefault(name, Counter())
    examples = {name: [t.encode() for t in texts] for name, texts in by.items()}
    return _model(used, sum(map(len, by.values())), examples, {name: _room(sum(map(len, texts))) for name, texts in examples.items()}, variants)


#: Different texts that a task holds before it hands them on.
_HELD = 50_000


def texts_of(texts: DataFrame, column: str, json_column: bool) -> DataFrame:
    """(text): the texts of a column, with ``json_column`` those of the members of its documents; few of them twice."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[str] = set()
        for batch in batches:
            for raw in batch["text"]:
                # Control characters and single surrogates are in no example, and the latter in no column of texts.
                held.update(t for t in ([v for _, v in json_texts(raw)] if json_column else [raw]) if t and not _BAD.search(t))
            if len(held) > _HELD:
                yield pd.DataFrame({"text": list(held)}, dtype=object)
                held.clear()
        yield pd.DataFrame({"text": list(held)}, dtype=object)

    return texts.select(F.col(column).alias("text")).where("text is not null and text != ''").mapInPandas(work, "text string")


def _windows(data: bytes, lengths: np.ndarray, pattern: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that follow each other in ``data``: where a pattern of so many bytes starts, and its counter."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(codes) - pattern + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(pattern):
        value = value * np.uint64(257) + codes[i : n + i]
    slots = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    at = np.flatnonzero(np.arange(n) + pattern <= ends)
    return at, slots[at]


def _cut(text: bytes) -> list[bytes]:
    """The segments of a text; every pattern of up to half a segment is whole in one of them."""
    return [text[i : i + SEGMENT] for i in range(0, max(1, len(text) - SEGMENT // 2), SEGMENT // 2)]


def _tables(kept: DataFrame, pattern: int) -> dict[str, np.ndarray]:
    """Of each group, ASCII apart, how often the patterns of every counter occur in the texts (kind, text), all of them counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for kind, texts in batch.groupby("kind")["text"]:
                data = [t.encode() for t in texts]
                _, slots = _windows(b"".join(data), np.array(list(map(len, data))), pattern)
                tables.setdefault(kind, np.zeros(SLOTS, np.int64))
                tables[kind] += np.bincount(slots, minlength=SLOTS)
        pack = zstandard.ZstdCompressor(level=1)
        for kind, table in tables.items():
            blocks = table.reshape(-1, BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pd.DataFrame({"kind": kind, "block": used, "counts": [pack.compress(blocks[i].tobytes()) for i in used]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unpack.decompress(x), np.int64) for x in group["counts"])
        return group[["kind", "block"]].iloc[:1].assign(counts=zstandard.ZstdCompressor(level=1).compress(total.tobytes()))

    schema = "kind string, block long, counts binary"
    out: dict[str, np.ndarray] = {}
    for r in kept.mapInPandas(count, schema).groupBy("kind", "block").applyInPandas(add, schema).collect():
        table = out.setdefault(r.kind, np.zeros(SLOTS, np.int64))
        table[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), np.int64)
    return out


def _segments(kept: DataFrame, pattern: int) -> tuple[dict[str, list[bytes]], dict[str, int]]:
    """Of each group, ASCII apart, the segments that hold most of what all texts repeat, and the room of its dictionary.

    For as many patterns as have room, the most frequent of all texts, the segment is chosen that holds it and whose
    frequent patterns occur most often a byte; it counts once for each pattern that it is chosen for. Only sums and
    largest values matter, so the order of the texts and the number of tasks do not.
    """
    tables = _tables(kept, pattern)
    rooms = {kind: _room(int(table.sum())) for kind, table in tables.items()}
    if "ascii" in rooms:  # keys and numbers don't crowd out the other Latin texts
        rooms["ascii"] = min(rooms["ascii"], rooms.get("latin", 0))
    frequent: dict[str, np.ndarray] = {}
    for kind, table in tables.items():
        best = np.argsort(-table, kind="stable")[: rooms[kind] // pattern]
        frequent[kind] = np.zeros(SLOTS, np.int64)
        frequent[kind][best] = table[best]
    shared = kept.sparkSession.sparkContext.broadcast({kind: (np.flatnonzero(table), table[table > 0]) for kind, table in frequent.items()})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best, floors = {}, {}, {}
        for kind, (slots, n) in shared.value.items():
            counts[kind], best[kind], floors[kind] = np.zeros(SLOTS, np.int64), {}, np.zeros(SLOTS)
            counts[kind][slots] = n
        for batch in batches:
            for kind, texts in batch.groupby("kind")["text"]:
                pieces = list(dict.fromkeys(p for t in texts for p in _cut(t.encode())))
                lengths = np.array(list(map(len, pieces)))
                at, slots = _windows(b"".join(pieces), lengths, pattern)
                found = counts[kind][slots] > 0
                owner = np.repeat(np.arange(len(pieces)), lengths)[at[found]]
                owner, slots = np.divmod(np.unique(owner * SLOTS + slots[found]), SLOTS)
                value = np.bincount(owner, counts[kind][slots], len(pieces)) / lengths
                floor = floors[kind]
                better = value[owner] >= floor[slots]
                owner, slots = owner[better], slots[better]
                np.maximum.at(floor, slots, value[owner])
                top = value[owner] == floor[slots]
                for slot, i in zip(slots[top].tolist(), owner[top].tolist(), strict=True):
                    best[kind][slot] = max(best[kind].get(slot, (0.0, b"")), (float(value[i]), pieces[i]))
        for kind, chosen in best.items():
            yield pd.DataFrame([(kind, slot, v, piece) for slot, (v, piece) in chosen.items()], columns=["kind", "slot", "value", "piece"])

    chosen = kept.mapInPandas(choose, "kind string, slot long, value double, piece binary").groupBy("kind", "slot").agg(F.max(F.struct("value", "piece")).alias("best"))
    out: dict[str, list[bytes]] = {}
    for r in chosen.groupBy("kind", "best.piece").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r.kind, []).extend([bytes(r.piece)] * r.n)
    return {kind: sorted(pieces) for kind, pieces in out.items()}, rooms


def fit_all(texts: DataFrame, pattern: int, variants: dict[str, str] | None = None) -> Model:
    """As ``fit``, from every different text of (text), counted where they are.

    The dictionaries are trained on the segments that hold most of the patterns of ``pattern`` bytes that all texts
    repeat. A text counts once however often it is repeated, so that a damaged text of many rows doesn't become usual.
    """
    variants = variants or {}
    spark = texts.sparkSession

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clean = [t for t in batch["text"] if not undoable(t)]
            yield pd.DataFrame({"kind": [_group(t) for t in clean], "text": clean}, dtype=object)

    clean = texts.distinct().mapInPandas(grouped, "kind string, text string").persist()

    def examples(kinds: str, usual: dict[str, set[str]], forms: dict[str, str]) -> DataFrame:
        """The texts of these groups that are examples; kind is the group in whose prices they count."""
        shared = spark.sparkContext.broadcast((usual, forms))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, common = shared.value
            for batch in batches:
                rows = [(_priced(kind, t), t) for kind, t in zip(batch["kind"], batch["text"], strict=True) if _kept(t, known[kind], common)]
                yield pd.DataFrame(rows, columns=["kind", "text"], dtype=object)

        return clean.where(kinds).mapInPandas(work, "kind string, text string").persist()

    def tallied(frame: DataFrame, once: bool) -> tuple[dict[str, Counter], dict[str, int]]:
        """Of each group the characters of its texts, once a text or as often as they occur, and the number of those texts."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = {name: Counter() for name in (*GROUPS, "ascii")}
            for batch in batches:
                for kind, text in zip(batch["kind"], batch["text"], strict=True):
                    counts[kind].update(set(text) if once else text)
                    counts[kind][""] += 1
            yield pd.DataFrame([(kind, c, n) for kind, tally in counts.items() for c, n in tally.items()], columns=["kind", "c", "n"])

        out: dict[str, Counter] = {name: Counter() for name in (*GROUPS, "ascii")}
        for r in frame.mapInPandas(work, "kind string, c string, n long").groupBy("kind", "c").agg(F.sum("n").alias("n")).collect():
            out[r.kind][r.c] = r.n
        return out, {name: tally.pop("", 0) for name, tally in out.items()}

    seen, sizes = tallied(clean, once=True)
    floors = {name: _floor(n) for name, n in sizes.items()}
    usual = {name: {c for c, n in tally.items() if n >= floors[name]} for name, tally in seen.items()}
    others = examples("kind != 'zh-hant'", usual, {})
    used, kept = tallied(others, once=False)
    usual["zh-hant"] = {c for c, n in used["zh-hans"].items() if n >= floors["zh-hant"]}
    traditional = examples("kind = 'zh-hant'", usual, variants)
    hant, kept_hant = tallied(traditional, once=False)
    used["zh-hant"] = hant["zh-hant"]
    chosen, rooms = _segments(others.unionByName(traditional), pattern)
    for frame in (clean, others, traditional):
        frame.unpersist()
    parts = {name: ("latin", "ascii") if name == "latin" else (name,) for name in GROUPS}
    samples = {name: [piece for part in of for piece in chosen.get(part, [])] for name, of in parts.items()}
    rooms = {name: min(DICTIONARY, max(512, sum(rooms.get(part, 0) for part in of))) for name, of in parts.items()}
    return _model(used, sum(kept.values()) + kept_hant["zh-hant"], samples, rooms, variants)


def restore(texts: DataFrame, model: Model, json_column: bool) -> DataFrame:
    """Texts (row struct, field string, text string) as (row, field, restored_text), one row for each damaged text.

    With ``json_column`` the text is a JSON document whose members are examined one by one, and ``field`` is the innermost
    member's name; whole members of a cut-off document are examined too. restored_text is the whole original text, or
    '' if characters are lost for good (a replacement character, or bytes that are gone). Null and empty texts and
    texts without damage give no row. Ties between chains go to the smaller text in code point order. Repeated rows are
    examined as often as they occur.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, memo = shared.value, {}
        for batch in batches:
            at, names, found = [], [], []
            for i, (name, text) in enumerate(zip(batch["field"], batch["text"], strict=True)):
                for member, value in json_texts(text) if json_column else [(name, text)]:
                    if value.isascii():
                        continue
                    if known.clean(value):
                        continue
                    if value not in memo:
                        if len(memo) > 20000:
                            memo.clear()
                        memo[value] = known.restore(value)
                    if memo[value] is not None:
                        at.append(i)
                        names.append(member)
                        found.append(memo[value])
            if at:
                out = batch[["row"]].iloc[at].reset_index(drop=True)
                yield out.assign(field=names, restored_text=found)

    rows = texts.where(r"text is not null and text rlike '[^\\x00-\\x7f]|\\\\u'").select("row", "field", "text")
    schema = rows.drop("text").withColumn("restored_text", F.lit("")).schema
    return rows.mapInPandas(work, schema)
