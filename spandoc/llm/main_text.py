"""Main text of web pages: tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE) for tag in RAW}
# Elements that are never part of the article, whatever they hold.
DROPPED = frozenset(
    "head nav aside footer form script style noscript template iframe svg canvas object select button textarea dialog menu audio video".split())
# Parts of class and id names of page furniture, and those of readers' comments.
ADVERTS = frozenset("ad ads adslot adsense advert adverts advertisement advertising sponsor sponsored".split())
FURNITURE = frozenset(
    "promo promotion banner sidebar menu menubar nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager "
    "skip".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# What an opening tag closes without saying so, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
HEADING = frozenset(("header",))  # no furniture inside an article
FURNITURE_WEIGHT = 0.05  # per element on the path that is furniture by name
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")


class _Element:
    __slots__ = ("tag", "label", "parent", "dropped", "aside", "weight", "depth", "link")

    def __init__(self, tag: str, rest: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or parent is not None and parent.link
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if not attributes and parent:  # most elements
            self.label, self.aside = tag, parent.aside
            self.weight = 1.0 if tag in ("article", "main") else parent.weight
            self.dropped = parent.dropped or tag in DROPPED or tag == "header" and not parent.within("article", "main")
            return
        names = set(_NAME_PARTS.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) - {""}
        self.label = ".".join([tag, *sorted(names)]) if tag in ("div", "section", "table", "article") else tag
        inside = parent is not None and (tag == "header" or bool(names & HEADING)) and parent.within("article", "main")
        hard = tag in DROPPED or tag == "header" and not inside
        hard |= attributes.get("role", "").lower() in ROLES or "hidden" in attributes and tag not in ("html", "body")
        hard |= attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        named = tag not in ("body", "html")
        self.dropped = bool(hard or parent and parent.dropped)
        # Adverts and comments; other furniture by name, which a careless page may call its content, only weighs less.
        self.aside = bool(named and names & (COMMENTS | ADVERTS) or parent and parent.aside)
        self.weight = parent.weight if parent else 1.0
        if tag in ("article", "main"):
            self.weight = 1.0
        elif named and names & (FURNITURE - HEADING if inside else FURNITURE):
            self.weight *= FURNITURE_WEIGHT

    def within(self, *tags: str) -> bool:
        e = self
        while e and e.tag not in tags:
            e = e.parent
        return e is not None

    def path(self) -> str:
        parts, e = [], self
        while e:
            if e.tag in BLOCKS:
                parts.append(e.label)
            e = e.parent
        return "/".join(reversed(parts))


def _blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(innermost element, text, characters in links) of every block of text outside dropped elements."""
    out: list[tuple[_Element, str, int]] = []
    root = here = _Element("html", "", None)
    text: list[str] = []
    linked, owner, done = 0, root, 0

    def flush():
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            out.append((owner, words, linked))
        text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked, owner
        if here.dropped:
            return
        piece = unescape(piece)
        if not text or owner is root or "".join(text).isspace():
            owner = here
        text.append(piece)
        if here.link:
            linked += len(piece)

    def close(tags: set[str], stop: set[str]):
        nonlocal here
        e = here
        while e.parent and e.tag not in tags and e.tag not in stop:
            e = e.parent
        if e.tag in tags and e.parent:
            here = e.parent

    m = _TOKEN.search(page)
    while m:
        if m.start() > done:
            add(page[done:m.start()])
        done = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            pass
        elif m["end"]:
            if tag in BLOCKS:
                flush()
            e = here
            while e.parent and e.tag != tag and (tag in BLOCKS or e.tag not in BLOCKS):
                e = e.parent
            if e.tag == tag and e.parent:
                here = e.parent
        elif tag in ("html", "body"):
            flush()
            if tag == "body":
                here = _Element("body", m["rest"], root)
        else:
            if tag in BLOCKS:
                flush()
                close({"p"}, {"article", "aside", "blockquote", "body", "button", "div", "li", "section", "table", "td"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag == "br":
                text.append(" ")
            elif tag in RAW:
                done = _RAW_END[tag].search(page, done).end()
            elif tag not in VOID and not m["rest"].endswith("/") or tag in BLOCKS and tag != "hr":
                here = _Element(tag, m["rest"], here)
        m = _TOKEN.search(page, done)
    if done < len(page):
        add(page[done:])
    flush()
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    weights = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), weights, "valid")


def path_scores(paths: list[str], chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Fused ratio of every block: text and punctuation per block of its tag path, smoothed along the page."""
    known: dict[str, int] = {}
    path = np.array([known.setdefault(p, len(known)) for p in paths])
    nodes = np.bincount(path)
    text, points = (np.bincount(path, x) / nodes for x in (chars, marks))
    return _smooth(text[path]) * (1 + _smooth(points[path]))


def main_text(page: str | None) -> str:
    """The article of one page; see ``extract``."""
    found = _blocks(page or "")
    kept = [b for b in found if not b[0].aside]
    if not kept:
        return ""
    chars = np.array([max(0, len(t) - linked) for _, t, linked in kept], float)
    marks = np.array([len(_MARKS.findall(t)) for _, t, _ in kept], float)
    path_weight = np.array([e.weight for e, _, _ in kept])
    plain = (path_weight == 1) & (chars > 0)
    paths = [e.path() for e, _, _ in kept]
    fused = path_scores(paths, chars, marks) * path_weight
    content = fused >= fused.std() / 2
    weight = np.where(content, fused * chars, 0) + chars * path_weight * 1e-6
    held: dict[_Element, float] = {}
    for (e, _, _), w in zip(kept, weight):
        while e:
            held[e] = held.get(e, 0.0) + w
            e = e.parent
    articles = [e for e in held if e.tag == "article"] or [e for e in held if e.tag == "main"]
    if articles:
        region = max(articles, key=lambda e: (held[e], -e.depth))
        content |= plain
    else:
        total = held[max(held, key=lambda e: (held[e], -e.depth))]
        deep = [e for e in held if e.tag in ("html", "body", "div", "section", "table", "td") and held[e] >= 0.95 * total]
        region = max(deep, key=lambda e: e.depth)
        if region.tag not in ("html", "body"):
            content |= plain
        else:  # no element of its own: everything from the first to the last content path, but lists of links
            at = np.flatnonzero(content)
            content[at[0]:at[-1] + 1] |= plain[at[0]:at[-1] + 1]

    def inside(e: _Element | None) -> bool:
        while e and e is not region:
            e = e.parent
        return e is not None

    return "\n".join(t for (e, t, _), c in zip(kept, content) if c and inside(e))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    ``pages`` has ``entity_id``, ``url`` and ``html``; other columns are ignored.  The project has no records of
    web pages, so this works on any table of that form.  Returns per input row entity_id, url, text.  Text
    runs outside menus, page headers, footers, adverts, forms, scripts and comments
    are blocks; each root-to-leaf tag path gets its text and punctuation per block, both are smoothed
    along the page and fused, and paths above half a standard deviation are content.  Class names of furniture
    (sidebars, notices and the like) lower the weight of what they hold, but not of an article in them.
    The article element with most content, or else the smallest element that holds nearly all of it, is the article; its
    blocks are returned in page order, one per line, white space collapsed, references decoded: all that have text
    besides links and no furniture around them, and of the others those that are content by their ratios.
    A null or empty page, or one without text, gives an empty text.
    """
    rows = pages.select("entity_id", "url", "html")
    schema = T.StructType([rows.schema["entity_id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["entity_id", "url", "text"])

    return rows.mapInArrow(run, schema)
