"""Scalar functions over columns: cleaning, numbers, identifiers, URLs, JSON, hashes, and arithmetic of retries.

All are Catalyst expressions but ``normal_name`` and ``join_url``, which need Unicode tables and URL resolution and are
Arrow-batched. Nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.text import BLANK, squeeze

#: Multipliers of display counts.
MULTIPLIERS = {"": 1, "万": 10_000, "亿": 100_000_000}
#: Spellings of "complete"; the three uses differ on purpose.
COMPLETE_SUMMARY = ("完结", "已完成", "完成", "完本", "已完结", "已完本")
COMPLETE_REFRESH = ("完本", "已完成", "完结", "completed", "finished")
COMPLETE_WINDOW = ("完本", "已完成", "完结", "completed", "finished")
#: Genres that are no novels.
NOT_NOVELS = ("评论", "诗歌", "随笔")
#: Words of titles that announce an ending without being one.
NOT_ENDINGS = ("未完", "未结", "不完结", "假结局", "完结倒计", "完结预告", "完结感言", "结局上", "结局（上", "结局(上")
#: Words of the three kinds of endings; the first kind with a word in the title counts.
ENDINGS = {
    "all_text_end_marker_update": ("全文完", "全文终", "全文已完结", "全书完", "全书终"),
    "main_story_end_marker_update": ("正文完", "正文终章", "正文已完结"),
    "ending_marker_update": ("大结局", "完结章"),
}
#: Fixed value: a title that is this word, but for a number before and signs behind, is an ending of the last kind.
BARE_ENDING = "完结"
#: Words of titles and volumes that are no part of the main text.
AUXILIARY = "番外|外传|花絮|后记|感言|公告|通知|请假|新书|上架|题外话|序言|前言|作者的话|作品相关|预告"


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank, as written. A zero counts as a value."""
    return F.coalesce(*[F.when(F.trim(F.regexp_replace(c.cast("string"), BLANK, " ")) != "", c.cast("string")) for c in columns])


def first_true(*columns: Column) -> Column:
    """The first value that is neither null, empty nor zero."""
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0", "0.0", "false"), c.cast("string")) for c in columns])


def digits_only(c: Column, positive: bool = False) -> Column:
    """Whether a text is ASCII digits only, with ``positive`` not starting with 0. False for null."""
    return F.coalesce(c.rlike("^[1-9][0-9]*$" if positive else "^[0-9]+$"), F.lit(False))


def starts_with_digit(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]"), F.lit(False))


def in_range(c: Column, low: int, high: int) -> Column:
    """The value where it is within the bounds, else null."""
    return F.when(c.between(low, high), c)


def display_number(c: Column, exact: bool = False) -> Column:
    """A count as sites display it (731.48万) as bigint, cut to whole; with ``exact`` null where it isn't whole or lacks its unit."""
    plain = F.regexp_replace(squeeze(c), ",", "") if not exact else squeeze(c)
    pattern = r"^([0-9]+(?:\.[0-9]+)?)(万|亿)?字$" if exact else r"^([0-9]+(?:\.[0-9]+)?)(万|亿)?(?:字|周)?$"
    times = F.create_map(*[F.lit(x) for k, v in MULTIPLIERS.items() for x in (k, v)])
    value = F.regexp_extract(plain, pattern, 1).try_cast("decimal(24,8)") * F.element_at(times, F.regexp_extract(plain, pattern, 2))
    value = F.when(plain.rlike(pattern), value)
    return F.when(value == F.floor(value), value).cast("bigint") if exact else F.floor(value).cast("bigint")


def plain_integer(c: Column) -> Column:
    """Digits with thousands separators and a trailing 字, as bigint; else null."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), ",", ""), "字$", "").try_cast("bigint")


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def ending_role(title: Column) -> Column:
    """The kind of ending that a chapter title announces, or null."""
    text = F.coalesce(squeeze(title), F.lit(""))
    bare = F.rtrim(F.regexp_replace(text, r"\[VIP\]$", ""), F.lit("!！。 "))
    bare = F.ltrim(F.ltrim(bare, F.lit("0123456789")), F.when(bare.rlike("^[0-9]"), " .、").otherwise(""))
    kinds = F.when(_has_any(text, NOT_ENDINGS), None)
    for kind, words in ENDINGS.items():
        kinds = kinds.when(_has_any(text, words), kind)
    return kinds.when(bare == BARE_ENDING, list(ENDINGS)[-1])


def is_auxiliary(title: Column, volume: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(volume, F.lit(""))).rlike(AUXILIARY)


def is_complete(status: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(status)).isin(*words), F.lit(False))


def sample_class(genre: Column) -> Column:
    return F.when(genre.isin(*NOT_NOVELS), "non_novel").when(genre.contains("-"), "novel_like").otherwise("unresolved")


@F.pandas_udf(T.StringType())
def _normal(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum()))


def normal_name(c: Column) -> Column:
    """Compatibility-composed, case-folded, letters and digits only: the form under which names compare equal."""
    return _normal(c)


@F.pandas_udf(T.StringType())
def _join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or u is None else urljoin(b, u) for b, u in zip(base, link, strict=True)])


def join_url(base: Column, link: Column) -> Column:
    """A link resolved against its page's address."""
    return _join(base, link)


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def url_part(url: Column, part: str, key: str | None = None) -> Column:
    """A part of a URL (HOST, PATH, QUERY); null where it can't be parsed."""
    arguments = [with_scheme(url), F.lit(part), *([F.lit(key)] if key else [])]
    return F.try_parse_url(*arguments)


def id_from_path(url: Column, host: str, pattern: str) -> Column:
    """The first group of ``pattern`` on the whole path, if the host is a subdomain of ``host``; else null."""
    on_host = F.lower(url_part(url, "HOST")).endswith("." + host)
    path = url_part(url, "PATH")
    return F.when(on_host & path.rlike(f"^{pattern}$"), F.regexp_extract(path, f"^{pattern}$", 1))


def id_from_query(url: Column, host: str, key: str) -> Column:
    """The first value of a query key, if it is digits and the host a subdomain of ``host``; else null."""
    value = url_part(url, "QUERY", key)
    return F.when(F.lower(url_part(url, "HOST")).endswith("." + host) & digits_only(value), value)


def without_query_keys(url: Column, pattern: str) -> Column:
    """The URL without those query parameters whose key matches, and without its fragment."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    head, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.split_part(bare, F.lit("?"), F.lit(2))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(pattern) & (p != "")), "&")
    return F.when(kept != "", F.concat_ws("?", head, kept)).otherwise(head)


def between_markers(c: Column, start: str, end: str) -> Column:
    """The text after the first ``start`` and before the next ``end``; null without ``start``."""
    after = F.when(F.instr(c, start) > 0, c.substr(F.instr(c, start) + F.lit(len(start)), F.length(c)))
    return F.trim(F.substring_index(after, end, 1))


def split_composite(c: Column, names: Sequence[str], mark: str = "-") -> list[Column]:
    """The parts of a composite text, one column a name; null beyond its parts. Only texts of at most that many parts are split."""
    parts = F.split(c, mark)
    return [F.when(F.size(parts) <= len(names), F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no blanks, and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def has_repeated_keys(json_object: Column) -> Column:
    keys = F.json_object_keys(json_object)
    return F.size(keys) != F.size(F.array_distinct(keys))


def strict_object(c: Column, schema: str) -> Column:
    """A JSON object read by its schema; null where it is no object or repeats a key, so that no value is silently lost."""
    return F.when(~F.coalesce(has_repeated_keys(c), F.lit(True)), F.from_json(c, schema))


def literal_list(c: Column) -> Column:
    """The values of a list written in Python or JSON notation, or of a single text."""
    quoted = F.regexp_replace(F.trim(c), "'", '"')
    return F.when(F.trim(c).startswith("["), F.from_json(quoted, "array<string>")).when(c.isNotNull(), F.array(c))


def identity(*parts: Column) -> Column:
    """A stable id: SHA-256 of the parts with a unit separator between."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def backoff_seconds(failures: Column, server_delay: Column) -> Column:
    """Seconds before the next try: doubling from 30 up to a day, an hour at least from the fifth failure; the server's delay wins."""
    own = F.least(F.lit(86400.0), 30 * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(12))))
    own = F.when(failures >= 5, F.greatest(own, F.lit(3600.0))).otherwise(own)
    return F.coalesce(server_delay.cast("double"), own)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds from a header that holds seconds or an HTTP date; not below 0, null if neither."""
    moment = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(digits_only(F.trim(header)), F.trim(header).cast("bigint")), F.when(moment.isNotNull(), F.greatest(F.lit(0), F.unix_seconds(moment) - F.unix_seconds(now))))


def refresh_days(is_list: Column, status: Column) -> Column:
    """Days until a record is looked at again: none for lists, longer for complete ones."""
    return F.when(is_list, F.lit(None)).when(is_complete(status, COMPLETE_REFRESH), 90).otherwise(14)


def decode_code(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c.cast("string")), F.lit("unknown"))
