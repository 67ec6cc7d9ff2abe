"""Parsers of catalogue pages, run over a column of HTML with Arrow batches. Only the standard library is needed."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self) -> str:
        """The visible text, white space squeezed."""

        def parts(node: Node) -> Iterator[str]:
            for child in node.children:
                if isinstance(child, str):
                    yield child
                elif child.tag not in ("script", "style"):
                    yield from parts(child)

        return " ".join("".join(parts(self)).replace("\xa0", " ").split())

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def all(self, tag: str, **attributes: str) -> list[Node]:
        """Descendants of a tag; an attribute matches if its value is among the blank-separated values of the node's."""
        wanted = {k.rstrip("_"): v for k, v in attributes.items()}
        return [n for n in self.walk() if n.tag == tag and all(v in n.attributes.get(k, "").split() for k, v in wanted.items())]

    def direct(self, tag: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag == tag]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def table_rows(html: str, cells: int) -> list[list[str]]:
    """The texts of all table rows with exactly so many direct cells."""
    rows = [r.direct("td") for r in tree(html).all("tr")]
    return [[c.text() for c in r] for r in rows if len(r) == cells]


def page_position(html: str) -> tuple[int | None, int | None]:
    """(page, pages) from a line such as 共9页 当前为第2页."""
    found = re.search(r"共\s*(\d+)\s*页.{0,20}?第\s*(\d+)\s*页", tree(html).text())
    return (int(found[2]), int(found[1])) if found else (None, None)


def links(html: str, pattern: str) -> list[tuple[str, str]]:
    """(id, text) of links whose address matches; of several links with one id the last counts, in document order."""
    found = [(m[1], a.text(), i) for i, a in enumerate(tree(html).all("a")) if (m := re.search(pattern, a.attributes.get("href", "")))]
    last = {key: (text, i) for key, text, i in found}
    return [(key, text) for key, (text, _) in sorted(last.items(), key=lambda x: x[1][1])]


def json_ld(html: str, kinds: tuple[str, ...]) -> list[dict]:
    """Objects of the given types in JSON-LD scripts; two different objects of one id are an error."""
    out: list[dict] = []
    seen: dict[str, dict] = {}
    for script in tree(html).all("script", type="application/ld+json"):
        try:
            value = json.loads(script.raw())
        except ValueError:
            continue
        for item in value if isinstance(value, list) else value.get("@graph", [value]):
            if isinstance(item, dict) and item.get("@type") in kinds:
                key = str(item.get("@id") or item.get("url") or len(out))
                if seen.setdefault(key, item) != item:
                    raise ValueError(f"conflicting objects for {key}")
                if item not in out:
                    out.append(item)
    return out


def embedded_state(html: str, script_id: str) -> object:
    """The JSON of a script element with an id, None without it."""
    found = tree(html).all("script", id=script_id)
    return json.loads(found[0].raw()) if found else None


def agrees(state: list[dict], visible: list[dict], fields: list[str]) -> bool:
    """Whether two lists have the same length and order and agree in all fields; anything missing is no agreement."""
    return len(state) == len(visible) > 0 and all(str(a.get(f)) == str(b.get(f)) and a.get(f) is not None for a, b in zip(state, visible, strict=True) for f in fields)


def flatten(value: object, volume: str | None = None) -> list[tuple[str | None, dict]]:
    """(nearest volume name, chapter) of a JSON tree of volumes and chapters, in order."""
    out: list[tuple[str | None, dict]] = []
    if isinstance(value, list):
        for item in value:
            out += flatten(item, volume)
    elif isinstance(value, dict):
        inner = [v for v in value.values() if isinstance(v, (list, dict))]
        name = value.get("volume") or value.get("vN") or value.get("volumeName")
        if inner:
            for item in inner:
                out += flatten(item, name if isinstance(name, str) else volume)
        elif value:
            out.append((volume, value))
    return out


def is_challenge(html: str) -> bool:
    """Whether a page is a login, captcha or lock page instead of content."""
    return bool(re.search("验证码|请登录后|访问过于频繁|captcha|access denied|attention required|该文章已被锁定", tree(html).text(), re.I))


def issue_date(html: str, cell: str) -> str | None:
    """The only different date of a page outside cells of a class; None if there is none or there are several."""
    root = tree(html)
    for node in list(root.walk()):
        if cell in node.attributes.get("class", "").split() and node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
    found = {f"{y}-{int(m):02d}-{int(d):02d}" for y, m, d in re.findall(r"((?:19|20)\d\d)[-/年](\d{1,2})[-/月](\d{1,2})", root.text())}
    return found.pop() if len(found) == 1 else None


def next_page(root: Node, words: tuple[str, ...] = ("下一页", "next")) -> str | None:
    """The address behind the link to the next page; None on the last one."""
    return next((a.attributes.get("href") for a in root.all("a") if a.text().lower() in words), None)


def choices(root: Node, name: str) -> list[str]:
    """The filled values that a drop-down list of a name offers, in order."""
    return [o.attributes["value"] for s in root.all("select", name=name) for o in s.all("option") if o.attributes.get("value")]


CATALOG = ("id", "title", "author", "genre", "status", "words", "date")


def catalog_page(html: str) -> list[dict]:
    """The works of a catalogue page, from rows of seven cells, with the page's number, its next page and the years it can be filtered by."""
    root, (page, pages) = tree(html), page_position(html)
    common = {"page": page, "pages": pages, "next": next_page(root), "years": ",".join(choices(root, "year"))}
    return [dict(zip(CATALOG, cells, strict=True)) | common for cells in table_rows(html, len(CATALOG))]


def detail_page(html: str) -> list[dict]:
    """A work's own page: heading, labelled fields and chapters, from a table of (number, title, date) or else from cards."""
    root = tree(html)
    heading = next((h.text() for h in root.all("h1")), None)
    labelled = dict(re.split(r"\s*[：:]\s*", li.text(), maxsplit=1) for li in root.all("li") if re.search("[：:]", li.text()))
    chapters = table_rows(html, 3) or [[card.attributes.get("data-number", ""), card.text(), card.attributes.get("title", "")] for card in root.all("a", class_="chapter")]
    out = {"title": heading, "author": labelled.get("作者"), "status": labelled.get("状态"), "genre": labelled.get("类型")}
    return [out | {"number": n, "chapter": t, "date": d} for n, t, d in chapters] if heading else []


RANK = ("place", "id", "title", "author", "genre", "status", "words", "points")


def rank_page(html: str) -> list[dict]:
    """The entries of a ranking, from rows of eight cells, with the moment that the page says it was made."""
    made = re.search(r"更新时间\D{0,3}(\d{4}-\d\d-\d\d \d\d:\d\d)", tree(html).text())
    return [dict(zip(RANK, cells, strict=True)) | {"made": made[1] if made else None} for cells in table_rows(html, len(RANK))]


def issue_page(html: str) -> list[dict]:
    """The books of an editorial issue, with the issue's date where exactly one stands outside the books."""
    date = issue_date(html, "book")
    return [{"id": key, "title": text, "issued": date} for key, text in links(html, r"/book/(\w+)$")]


def asked_object(html: str, kinds: tuple[str, ...], asked: str) -> list[dict]:
    """The JSON-LD object of a page whose id is the one asked for; nothing where the page is another's or contradicts itself."""
    try:
        return [o for o in json_ld(html, kinds) if str(o.get("@id")) == asked]
    except ValueError:
        return []


def parse(frame: DataFrame, html: str, parser: Callable[[str], list[dict]], schema: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for every record that ``parser`` finds in a page, with the page's ``keep`` columns first.

    Pages that are null or that the parser finds nothing in give no row.
    """
    kept = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*values, *[record.get(n) for n in names]) for page, *values in zip(batch[html], *(batch[c] for c in keep), strict=True) for record in (parser(page) if page else [])]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    return frame.mapInPandas(work, f"{kept}, {schema}")
