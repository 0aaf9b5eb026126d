"""Operator 8: main-text extraction by tag-path ratios.

A page is walked once. Each text node belongs to a block and has a root-to-leaf tag path. Per path the text length, the
link text and the punctuation are summed; the text-to-tag ratio and the punctuation-to-tag ratio of the paths are smoothed
over the neighbouring blocks, fused by multiplication, and compared with a threshold drawn from the page's own scores.
Blocks of paths above it are content. A path below an element whose class, id or role names a menu, header, footer, sidebar,
notice, advert or reader comments has a twentieth of its score; a name that covers over four fifths of all text doesn't count.

The region is the ``main`` elements, or else the ``article`` elements, that hold nine tenths of the content's text, or
without such the deepest element that does. All blocks of the region are main text, whatever their own length, but for those
below a name that counts; content beside the region is main text too, except beside ``main``. A form and what is shown without
scripts count like a name, so one that holds the page is read. Elements that never hold content (controls of forms, scripts,
navigation and the like) are left out.

A page is read in time linear in its length: the walk keeps for each element its path, block and marks, sums go up the tree
in one pass, and where a quoted attribute has no end tags end at the next ``>``.

Defined cases: null, empty and tag-less html give what text they have ('' if none) with n_chars 0 where there is none;
repeated rows and ties are extracted each by itself; an empty table gives an empty table; only page_id, url and html are
read. Pages of any length are walked whole.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm.shared import record_batch, slices

SCHEMA = "page_id long, url string, text string, n_chars long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
INLINE_FORMAT = frozenset("a abbr b big cite code em font i mark q s small span strike strong sub sup tt u".split())
NEVER = frozenset("aside button canvas dialog embed fieldset footer head iframe input label menu nav object script search select style svg template textarea title video audio".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are boilerplate like those with such a name, unless they hold the page.
FRAMES = frozenset(("form", "noscript"))
#: Words of class, id and role that name what isn't content, and words that may stand beside them.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog discussion discussions footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo recommended recommendations related replies respond share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar contentinfo complementary".split())
NEUTRAL = frozenset("site page main left right top bottom list box container wrapper block area section bar widget inner outer global primary secondary user reader post blog links link buttons button title slot unit text".split())
NAMED_SHARE, NAMED_LIMIT, REGION_SHARE, DEVIATIONS = 0.05, 0.8, 0.9, 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>?|([^<]+)", re.S)
#: Tags of pages in which a quote has no end.
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?][^>]*>?|([^<]+)", re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؛،]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


class Element:
    """``number``: place in the order of the page; ``path``: number of its tag path; ``block``: innermost block element;
    ``excluded``: never content; ``named``: its own class, id or role says that it isn't; ``semantic``: the tags among
    main and article that it lies in, itself included."""

    __slots__ = ("tag", "parent", "number", "path", "block", "excluded", "named", "semantic", "linked")

    def __init__(self, tag, parent, number, path, excluded=False, named=False):
        self.tag, self.parent, self.number, self.path, self.excluded, self.named = tag, parent, number, path, excluded, named
        self.block = self if parent is None or tag in BLOCKS or excluded != parent.excluded or named else parent.block
        own = (tag,) if tag in ("main", "article") else ()
        self.semantic = own if parent is None else parent.semantic + own if own and tag not in parent.semantic else parent.semantic
        self.linked = parent is not None and (parent.linked or tag == "a") and tag not in BLOCKS


class Block:
    __slots__ = ("element", "parts", "link_chars")

    def __init__(self, element):
        self.element, self.parts, self.link_chars = element, [], 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def names_boilerplate(attributes: str) -> bool:
    """Whether one of the names in class, id or role consists of such words and neutral ones alone."""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
            if words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL:
                return True
    return False


def walk(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements and blocks in order."""
    root = Element("", None, 0, 0)
    paths: dict[tuple[int, str], int] = {}
    elements, out, here, current = [root], [], root, None
    open_tags: dict[str, int] = {}
    token, at = _TOKEN, 0

    def close_to(element):
        nonlocal here, current
        while here is not element:
            open_tags[here.tag] -= 1
            here = here.parent
        current = None

    def start_block(tag):
        """A block's start ends what can't hold it: an open paragraph, and formatting that was left open."""
        e = here
        while e.tag in INLINE_FORMAT:
            e = e.parent
        if e.tag == "p":
            e = e.parent
        ends = CLOSES.get(tag, ())
        if any(open_tags.get(x) for x in ends):
            x = e
            while x.tag and x.tag not in ("ul", "ol", "dl", "table", "select", "menu") and x.tag not in ends:
                x = x.parent
            if x.tag in ends:
                e = x.parent
        close_to(e)

    while at < len(page):
        m = token.match(page, at)
        if m is None and token is _TOKEN and _TAG.match(page, at):
            token = _LOOSE
            m = token.match(page, at)
        closing, tag, attributes, text = m.groups() if m else (None, None, None, "<")  # a sign by itself
        at = m.end() if m else at + 1
        if text is not None:
            if current is None:
                current = Block(here.block)
                out.append(current)
            decoded = html.unescape(text)
            current.parts.append(decoded)
            if here.linked:
                current.link_chars += len(decoded)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if not open_tags.get(tag):
                if tag == "p":
                    current = None
                continue
            e = here
            while e.tag != tag:
                e = e.parent
            keep = None if e.block is e else current
            inner = here.block is not e.block
            close_to(e.parent)
            current = None if inner else keep
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                start_block(tag)
            continue
        if tag in BLOCKS:
            start_block(tag)
        judged = bool(attributes) and tag not in ("html", "body", "article", "main")
        excluded = here.excluded or tag in NEVER or judged and bool(_HIDDEN.search(attributes)) or tag == "header" and not here.semantic
        named = not excluded and (tag in FRAMES or judged and names_boilerplate(attributes))
        e = Element(tag, here, len(elements), paths.setdefault((here.path, tag), len(paths) + 1), excluded, named)
        if e.block is e:
            current = None
        elements.append(e)
        if tag in RAW or tag in ("template", "iframe"):
            end = _END[tag].search(page, at)
            if excluded:
                current = None
            at = end.end() if end else len(page)
        else:
            here = e
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return elements, out


_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in (*RAW, "template", "iframe")}


def path_scores(blocks: list[Block], texts: list[str], named: np.ndarray) -> np.ndarray:
    """For each block the fused, smoothed ratio of its tag path; ``named``: blocks below a name that counts."""
    paths = [(b.element.path, below) for b, below in zip(blocks, named.tolist())]
    length: dict[tuple, float] = {}
    marks: dict[tuple, float] = {}
    count: dict[tuple, int] = {}
    for path, b, t in zip(paths, blocks, texts):
        length[path] = length.get(path, 0) + max(0, len(t) - b.link_chars)
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(t)) * (len(t) > b.link_chars)
        count[path] = count.get(path, 0) + 1
    ratio = np.array([length[p] / count[p] for p in paths])
    points = np.array([1 + marks[p] / count[p] for p in paths])
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), kernel / kernel.sum(), "valid")
    return np.minimum(smooth(ratio), ratio) * smooth(points) * np.where(named, NAMED_SHARE, 1.0)


def content_blocks(blocks: list[Block], texts: list[str], named: np.ndarray) -> np.ndarray:
    """Which blocks are content by their paths' scores: the threshold is a share of the scores' deviation."""
    scores = path_scores(blocks, texts, named)
    content = scores >= max(DEVIATIONS * scores.std(), 1e-9)
    return content if content.any() else np.ones(len(blocks), bool)


def upwards(elements: list[Element], own: np.ndarray) -> np.ndarray:
    """For each element the sum of ``own`` over it and all below."""
    total = own.astype(float)
    for e in reversed(elements[1:]):
        total[e.parent.number] += total[e.number]
    return total


def downwards(elements: list[Element], own: np.ndarray) -> np.ndarray:
    """For each element whether it or an element above has ``own``."""
    out = own.copy()
    for e in elements[1:]:
        out[e.number] |= out[e.parent.number]
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; blocks are joined by newlines."""
    elements, blocks = walk(page or "")
    found = [(b, t) for b in blocks if not b.element.excluded and (t := b.text())]
    if not found:
        return ""
    blocks, texts = [b for b, _ in found], [t for _, t in found]
    at = np.array([b.element.number for b in blocks])
    size = np.array([len(t) for t in texts])
    named = np.array([e.named for e in elements])
    if named.any():
        every = upwards(elements, np.bincount(at, size, len(elements)))
        named &= every <= NAMED_LIMIT * every[0]
        named = downwards(elements, named)
    below = named[at]
    content = content_blocks(blocks, texts, below)
    held = upwards(elements, np.bincount(at, np.where(content, size, 0), len(elements)))
    enough = REGION_SHARE * held[0]
    region = np.zeros(len(elements), bool)
    beside = True
    for tag in ("main", "article"):
        roots = [e.number for e in elements if e.tag == tag and held[e.number] and tag not in e.parent.semantic]
        if roots and held[roots].sum() >= enough:
            region[roots], beside = True, tag != "main"
            break
    else:
        # Numbers grow downwards, and two elements that hold that much lie one in the other: the last is the deepest.
        region[max(e.number for e in elements if held[e.number] >= enough and e.tag not in ("p", "li", "h1", "h2", "h3"))] = True
    inside = downwards(elements, region)[at] & ~(below & ~content)
    return "\n".join(t for t, ok in zip(texts, inside | (content & beside)) if ok)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``. No shuffle."""

    def extract(batches):
        for b in slices(batches, column="html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, _ARROW)

    return pages.select(pages.page_id.cast("long").alias("page_id"), "url", "html").mapInArrow(extract, SCHEMA)
