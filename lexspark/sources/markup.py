"""Pages as rows of blocks: paragraphs, cells, tables, subdivisions and the text between them, in the order of the page.

Spark has no reader of HTML, so each page is walked once in Python, inside Arrow batches; what comes out are plain rows, and
layouts are told apart and read by DataFrame plans. The walk is linear in the page's length whatever is nested or left open:
an element knows the nearest open paragraph, list item, row and cell that a start tag may end, and counts of open tags say
whether an end tag has anything to end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table td th caption template object html".split())
TABLE = frozenset("table thead tbody tfoot tr".split())
#: What a start tag ends of its own kind, and the elements beyond which it doesn't look.
SIBLINGS = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell"}
HOLDERS = {"ul": "item", "ol": "item", "menu": "item", "dl": "term"}

# Classes of annexes' headings, of what may follow one, and of the structured layout.
ANNEX, AFTER_ANNEX = frozenset(("oj-ti-annex", "oj-ti-annex-1", "title-annex-norm")), frozenset(("oj-doc-ti", "oj-normal"))
STRUCTURED = frozenset(("eli-subdivision", "oj-ti-art", "title-article-norm", "oj-ti-annex", "title-annex-norm"))

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+|[\"'=/]")
_TAG, _WHITE = re.compile(r"[a-z][a-z0-9:._-]*"), re.compile(r"[ \t\r\n\f]+")

BLOCK = "doc_id long, pos long, tag string, id string, classes array<string>, mark string, fragment boolean, root long, recital boolean, heading boolean, title string, titled boolean, layouts array<string>, lang string, text string"
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in BLOCK.split(", "))])


def collapsed(text: str) -> str:
    return " ".join(text.split())


def attributes(raw: str) -> dict[str, str]:
    """A tag's attributes, only to be read: those of short tags, which repeat, are kept."""
    return _short(raw) if len(raw) <= 200 else _attributes(raw)


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


_short = lru_cache(4096)(_attributes)


def events(page: str) -> Iterator[tuple[str, str]]:
    """('', text), (name, its attributes as written) and ('/name', '') in order; comments and declarations are left out."""
    at, n, strict, comments = 0, len(page), True, True
    while at < n:
        sign = page.find("<", at)
        if sign != at:
            yield "", page[at : n if sign < 0 else sign]
            if sign < 0:
                return
        name = _NAME.match(page, sign + 1)
        if name is None:
            if page.startswith("<!--", sign):
                end = page.find("-->", sign + 4) if comments else -1
                comments = end >= 0
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?", "</"), sign):
                end = page.find(">", sign)
                at = end + 1 if end >= 0 else n
            else:
                yield "", "<"
                at = sign + 1
            continue
        whole = _ATTRIBUTES.match(page, name.end()) if strict else None
        if whole is None:  # a quote, or the tag itself, has no end: from here on tags end at the next sign
            strict = False
            end = page.find(">", name.end())
            end = n if end < 0 else end
        else:
            end = whole.end() - 1
        tag = name[2].lower()
        yield name[1] + tag, "" if name[1] else page[name.end() : end]
        at = end + 1
        if not name[1] and tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            end = close.start() if close else n
            if tag in ("textarea", "title"):
                yield "", page[at:end]
            at = end


class Element:
    """``sub``: the nearest subdivision, itself included; ``first``: places of the first paragraphs of each kind below it."""

    __slots__ = ("tag", "parent", "number", "classes", "id", "scope", "item", "term", "row", "cell", "para", "grid", "sub", "first", "unit", "titled")

    def __init__(self, tag: str, parent: Element | None, number: int, own: dict[str, str]):
        self.tag, self.parent, self.number, self.first, self.unit = tag, parent, number, {}, False
        self.classes, self.id = own.get("class", "").split(), own.get("id", "")
        up = parent or self
        if tag in SCOPES or parent is None:
            self.scope, self.item, self.term, self.row, self.cell, self.para = {}, None, None, None, None, None
        else:
            self.scope, self.item, self.term, self.row, self.cell, self.para = up.scope, up.item, up.term, up.row, up.cell, up.para
        if tag in HOLDERS:
            setattr(self, HOLDERS[tag], None)
        if tag in SIBLINGS:
            setattr(self, SIBLINGS[tag], self)
        if tag == "p":
            self.para = self
        self.grid = self if tag == "table" else None if parent is None else up.grid
        self.titled = parent is not None and up.titled or tag == "div" and "eli-title" in self.classes
        is_sub = tag == "div" and "eli-subdivision" in self.classes
        self.sub = self if is_sub else None if parent is None else up.sub


def noted(element: Element | None, kind: str, place: int) -> None:
    """Note a paragraph with all elements around it that have none of its kind yet; they lie below those that have one."""
    while element is not None and kind not in element.first:
        element.first[kind] = place
        element = element.parent


class Page:
    """One walk: ``rows`` of blocks, each with its element."""

    def __init__(self, page: str):
        self.here = self.root = Element("", None, 0, {})
        self.n, self.lang, self.rows = 0, "", []
        self.open: list[tuple[Element, dict, list[str]]] = []  # blocks whose text is being gathered
        self.marks: list[Element] = []
        self.fragment = self.fragment_done = False
        self.loose: dict | None = None
        self.meta: dict[str, str] = {}
        for name, rest in events(page):
            if not name:
                self.text(self.said(rest))
            elif name[0] == "/":
                self.end(name[1:])
            else:
                self.start(name, attributes(rest) if rest.strip(" \t\r\n/") else {}, rest.endswith("/"))
        self.close_to(self.root)
        if not self.fragment_done:
            for r in self.rows:
                r["fragment"] = False

    said = staticmethod(html.unescape)

    def row(self, element: Element, **more) -> dict:
        self.n += 1
        made = {"pos": self.n, "element": element, "tag": element.tag, "fragment": self.fragment, "mark": [], "text": []} | more
        self.rows.append(made)
        self.loose = None
        return made

    def text(self, text: str) -> None:
        for _, r in self.open:
            r["text"].append(text)
        if self.marks and self.open:
            self.open[-1][1]["mark"].append(text)
        if self.here.para is None and text.strip():  # text between paragraphs is a block of its own
            if self.loose is None or self.loose["element"] is not self.here:
                self.loose = self.row(self.here, tag="#text")
            self.loose["text"].append(text)

    def start(self, tag: str, own: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.lang = own.get("lang", self.lang)
        if tag == "meta" and own.get("name"):
            self.meta.setdefault(own["name"], own.get("content", ""))
        if tag == "txt_te":
            self.fragment = not closed and not self.fragment_done
            self.fragment_done = self.fragment_done or closed
        if tag in VOID:
            if tag == "br":
                self.text(" ") if self.open else None
            return
        if tag in ENDS_PARAGRAPH and self.here.para is not None:
            self.close_to(self.here.para.parent)
        if tag in SIBLINGS:
            for kind in {"tr": ("cell", "row")}.get(tag, (SIBLINGS[tag],)):
                old = getattr(self.here, kind)
                if old is not None:
                    self.close_to(old.parent)
        parent = self.here
        element = self.here = Element(tag, parent, self.n + 1, own)
        element.scope[tag] = element.scope.get(tag, 0) + 1
        outer = [e for e, _ in self.open]
        if tag == "p":
            self.paragraph(element)
        elif tag in ("td", "th") and not any(e.tag in ("td", "th") for e in outer) or tag == "table" and not any(e.tag == "table" for e in outer):
            self.open.append((element, self.row(element)))
        elif element.sub is element:
            self.row(element)
            element.unit = element.id.startswith("rct_")
        if "num" in element.classes:
            self.marks.append(element)
        self.loose = None

    def paragraph(self, p: Element) -> None:
        made = self.row(p)
        self.open.append((p, made))
        own, place = set(p.classes), made["pos"]
        if "oj-ti-art" in own or own & ANNEX:
            if p.sub is not None:
                p.sub.unit = True
        if "title-article-norm" in own and p.sub is not None and "norm" not in p.sub.first:
            p.sub.unit = True
            made["norm"] = True
            noted(p.sub, "norm", place)
        if "stitle-article-norm" in own:
            noted(p.parent, "stitle", place)
        if "oj-sti-art" in own and p.titled:
            noted(p.parent, "sti", place)
        if (p.titled or own & {"oj-ti-annex-2", "stitle-annex-norm"}) and not own & ANNEX | own & {"oj-ti-art"}:
            noted(p.parent, "subtitle", place)

    def end(self, tag: str) -> None:
        if tag == "txt_te" and self.fragment:
            self.fragment, self.fragment_done = False, True
        here, e = self.here, None
        if tag in ("td", "th"):
            e = here.cell
        elif tag in TABLE:  # ends what lies open inside, across the cells' borders
            inside = here.cell.parent if here.cell is not None else here
            e = here.grid if tag == "table" else inside.row if tag == "tr" else inside.row.parent if inside.row is not None else inside
            e = e if e is not None and e.tag == tag else None
        elif here.scope.get(tag):
            e = here
            while e.tag != tag:
                e = e.parent
        if e is not None:
            self.close_to(e.parent)

    def close_to(self, element: Element) -> None:
        """End the open elements below ``element``."""
        while self.here is not element:
            e = self.here
            e.scope[e.tag] -= 1
            if self.open and self.open[-1][0] is e:
                self.open.pop()
            if self.marks and self.marks[-1] is e:
                self.marks.pop()
            self.here = e.parent
        self.loose = None


def titles(rows: list[dict]) -> None:
    """Give each heading the paragraph that is its title, if no heading before it has that: an article's is in its
    subdivision, an annex's below its parent. Any other paragraph is given the text of the next sibling whose class may
    follow an annex's heading, as its own words may turn out to be one."""
    by_place = {r["pos"]: r for r in rows}
    following: dict[int, dict] = {}
    after: dict[int, dict] = {}
    for r in reversed(rows):
        p = r["element"]
        if p.tag == "p" and r["tag"] == "p":
            if id(p.parent) in following:
                after[r["pos"]] = following[id(p.parent)]
            following[id(p.parent)] = r
        elif r["tag"] != "#text" and p.parent is not None:
            following.pop(id(p.parent), None)
    for r in rows:
        p = r["element"]
        if r["tag"] != "p":
            continue
        own = set(p.classes)
        r["heading"] = "oj-ti-art" in own or bool(r.get("norm")) or bool(own & ANNEX)
        place = None
        if p.sub is not None and r["heading"]:
            place = p.sub.first.get("sti") if "oj-ti-art" in own else p.sub.first.get("stitle") if r.get("norm") else p.parent.first.get("subtitle")
        found = by_place.get(place)
        if found is None and not ("oj-ti-art" in own or r.get("norm")):
            found = after.get(r["pos"])
            found = found if found is not None and AFTER_ANNEX & set(found["element"].classes) else None
        if found is not None and not found.get("titled"):
            r["title"] = collapsed("".join(found["text"]))
            found["titled"] = r["heading"]


def marks(rows: list[dict]) -> list[str]:
    """The layouts of which the page has marks."""
    elements = [(r["tag"], set(r["element"].classes)) for r in rows]
    p = [own for tag, own in elements if tag == "p"]
    found = {
        "structured": any(own & STRUCTURED for _, own in elements), "legacy": any("ti-art" in own for own in p) and any(own & {"normal", "doc-ti"} for own in p),
        "proposal": any("Titrearticle" in own or {"li", "ManualConsidrant"} <= own for own in p),
    }
    return [name for name, has in found.items() if has]


def blocks_of(doc_id: int, page: str) -> Iterator[tuple]:
    """The page's rows of ``BLOCK``."""
    walked = Page(page)
    titles(walked.rows)
    layouts = marks(walked.rows)
    roots: dict[int, int] = {}
    starts = {id(r["element"]): r["pos"] for r in walked.rows if r["tag"] == "div"}
    recitals = {r["pos"] for r in walked.rows if r["tag"] == "div" and r["element"].id.startswith("rct_")}

    def root(sub: Element | None) -> int:
        seen = []
        while sub is not None and not sub.unit and id(sub) not in roots:
            seen.append(sub)
            sub = sub.parent.sub if sub.parent is not None else None
        found = 0 if sub is None else starts[id(sub)] if sub.unit else roots[id(sub)]
        roots.update((id(s), found) for s in seen)
        return found

    for name, content in walked.meta.items():
        yield doc_id, 0, "meta", name, [], "", False, 0, False, False, None, False, layouts, walked.lang, collapsed(content)
    for r in walked.rows:
        e, at = r["element"], root(r["element"].sub)
        yield (doc_id, r["pos"], r["tag"], e.id, e.classes, collapsed("".join(r["mark"])), r["fragment"], at, at in recitals, r.get("heading", False),
               r.get("title"), r.get("titled", False), layouts, walked.lang, collapsed("".join(r["text"])))


class Tidied(Page):
    """The page written anew: every tag whole, its attributes in double quotes, every element ended, white space as single
    spaces, scripts and comments left out. Patterns that look for the end of a tag or element never look far in it."""

    def __init__(self, page: str):
        self.written: list[str] = []
        super().__init__(page)

    said = staticmethod(str)  # references stay as they are

    def text(self, text: str) -> None:
        self.written.append(_WHITE.sub(" ", text).replace("<", "&lt;") if text else "")

    def start(self, tag: str, own: dict[str, str], closed: bool) -> None:
        if tag in VOID:
            self.written.append(self.tag(tag, own))
            return
        super().start(tag, own, closed)
        self.written.append(self.tag(tag, own))

    def tag(self, tag: str, own: dict[str, str]) -> str:
        return f"<{tag}{''.join(f' {k}=\"{html.escape(v)}\"' for k, v in own.items() if v)}>" if _TAG.fullmatch(tag) else ""

    def row(self, element: Element, **more) -> dict:
        return {"pos": 0, "text": [], "mark": []}

    def close_to(self, element: Element) -> None:
        while self.here is not element:
            tag = self.here.tag
            super().close_to(self.here.parent)
            self.written.append(f"</{tag}>" if _TAG.fullmatch(tag) else "")


@F.pandas_udf(T.StringType())
def tidied(page: pd.Series) -> pd.Series:
    return page.map(lambda x: None if x is None else "".join(Tidied(x).written))


def blocks(pages: DataFrame) -> DataFrame:
    """Rows of ``BLOCK`` of ``pages`` (doc_id, html): paragraphs (tag p), outermost cells (td, th) and tables, subdivisions
    (div) and text between them (#text), numbered by pos from 1, and the meta tags (pos 0, their name as id). ``root`` is the
    place of the nearest subdivision that is a unit (0: none), ``recital`` whether that is a recital's, ``title`` the text of
    the paragraph that is ``titled`` by this heading, ``layouts`` what layouts the page has marks of. Null pages have no rows."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for i, page in zip(part.column(0).to_pylist(), part.column(1)):
                rows += blocks_of(i, page.as_py()) if page.is_valid else ()
                if len(rows) > 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(walk, BLOCK)
