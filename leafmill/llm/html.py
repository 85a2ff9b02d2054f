"""HTML extraction by the maximum-scoring subsequence.

A page is a row of words and tags. Only code, hidden elements, form controls and embedded media are left out by rule;
menus, adverts, footers and the like stand in the row. Words score positive (those of unwanted block classes nothing)
and tags negative, with weights learned from labelled pages: a bounded sample, first in hash order of page_id, of pages
that mark their content by an article or main element. A block's classes are its landmark element, its role and the
tokens of class and id; what stands outside the content is put down to its outermost block, so that a list isn't
blamed for the menu it stands in. Names such as "sidebar" start as unwanted, as if UNWANTED words of it had been seen
outside; labelled pages overrule that. One linear scan finds the contiguous region of the highest score; unwanted
blocks that stand between words of the region are cut out.

Null and empty html, and pages without words, give an empty text. Unclosed and misnested elements, quotes and comments
are tolerated. Of equally good regions the first is taken. Repeated rows give the same text each; a repeated page_id
is learned from once; extra columns are not seen. Without labelled pages the weights are the defaults. Time and memory
are linear in the page.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, only, tune

#: Labelled pages that the weights are learned from, and their bytes in all.
SAMPLE, SAMPLE_BYTES = 600, 64 << 20
WORD_RANGE, TAG_RANGE = (0.05, 4.0), (-6.0, -0.1)
#: Weights of words and tags that no labelled page has, and the words outside that an unwanted name starts with.
DEFAULT_WORD, DEFAULT_TAG, DEFAULT_INLINE, UNWANTED = 1.0, -2.0, -0.5, 50
#: What passing over an unwanted block costs a region, whatever stands in it; code costs next to nothing.
PASSED = -1.0

# Element names of the HTML standard by their part here.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head form script style textarea title noscript iframe template button select option dialog svg math canvas object audio video xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CONTENT = ("article", "main")
_LANDMARKS = frozenset("nav header footer aside menu search".split())
# Names of class, id and role that start as unwanted, alone or with words that say nothing of the content.
_HINTS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary comment comments commentlist disqus reply replies respond footer contentinfo masthead header topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager skip".split())
_NEUTRAL = frozenset("left right top bottom main site page global list box block wrapper wrap container inner outer section area item items link links bar unit slot primary secondary thread text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STEP = re.compile(r"[a-z]+|[^a-z]+")


def _unwanted(key: str) -> bool:
    """Whether a landmark or a class token starts as unwanted: "left-sidebar" does, "with-sidebar" doesn't."""
    if key in _LANDMARKS:
        return True
    parts = [p for p in _STEP.findall(key[1:]) if p.isalpha()]
    return any(p in _HINTS for p in parts) and all(p in _HINTS or p in _NEUTRAL for p in parts)


@dataclass
class Element:
    name: str
    parent: int
    keys: tuple[str, ...]
    #: In, or itself, an article or main element; and whether it has one inside.
    content: bool
    holds: bool = False
    #: Left out by rule, with all that stands in it.
    dropped: bool = False
    #: Its tokens in the row: from its opening tag to after its closing one.
    first: int = 0
    last: int = 0


@dataclass
class Page:
    """elements[0] is the page itself. A token of row is (element, text), or (element, None) for a tag of it."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, (), False)])
    row: list[tuple[int, str | None]] = field(default_factory=list)


def _attributes(name: str, attributes: str, content: bool) -> tuple[tuple[str, ...], bool]:
    """The block's classes, and whether it is hidden."""
    keys = [name] if name in _LANDMARKS and not (name == "header" and content) else []
    hidden = False
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                keys += [f".{token}" for token in value.split()]
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    return tuple(keys), hidden


def parse(text: str) -> Page:
    page = Page()
    elements, row = page.elements, page.row
    stack: list[int] = [0]
    open_names: Counter[str] = Counter()
    dropped = 0  # depth of the stack at which a left-out element was opened, or 0
    raw, at = "", 0

    def close(k: int) -> None:
        nonlocal dropped
        while len(stack) > k:
            e = stack.pop()
            open_names[elements[e].name] -= 1
            if dropped and len(stack) <= dropped:
                dropped = 0
            if not dropped:
                row.append((e, None))
            elements[e].last = len(row)

    def words(piece: str) -> None:
        if piece and not dropped:
            row.append((stack[-1], references.unescape(piece) if "&" in piece else piece))

    while at < len(text):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(text, at)
            at = m.start() if m else len(text)
            raw = ""
            continue
        m = _TOKEN.search(text, at)
        if not m:
            words(text[at:])
            break
        words(text[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if closing:
            if open_names[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].name == name))
            continue
        if name in _CLOSES_P and open_names["p"] > 0:
            # A paragraph ends where a block begins; unclosed inline elements in it end with it.
            k = len(stack) - 1
            while elements[stack[k]].name in _INLINE:
                k -= 1
            if elements[stack[k]].name == "p":
                close(k)
        elif name == "li" and open_names["li"] > 0:
            k = len(stack) - 1
            while elements[stack[k]].name not in ("li", "ul", "ol", ""):
                k -= 1
            if elements[stack[k]].name == "li":
                close(k)
        if name in _CONTENT and dropped:
            close(dropped)
        inside = elements[stack[-1]].content or name in _CONTENT
        keys, hidden = _attributes(name, attributes, inside)
        e = len(elements)
        elements.append(Element(name, stack[-1], keys, inside, first=len(row), last=len(row) + 1))
        if not dropped:
            row.append((e, None))
        if name in _VOID:
            continue
        if not dropped and (hidden or name in _DROP) and name not in _CONTENT:
            dropped, elements[e].dropped = len(stack), True
        stack.append(e)
        open_names[name] += 1
        if name in _CONTENT:
            above = elements[e].parent
            while above >= 0 and not elements[above].holds:
                elements[above].holds = True
                above = elements[above].parent
        if name in _RAW and not attributes.endswith("/"):
            raw = name
    close(1)
    return page


def _tag_key(element: Element) -> tuple[str, ...]:
    return element.keys or (element.name,)


class Weights:
    def __init__(self, inside: tuple[Counter, Counter] | None = None, outside: tuple[Counter, Counter] | None = None) -> None:
        self.inside, self.outside = inside or (Counter(), Counter()), outside or (Counter(), Counter())

    def odds(self, what: int, key: str) -> float | None:
        """Log-odds that words (0) or tags (1) of a class are content; None if nothing is known of it."""
        less = UNWANTED if (key in _LANDMARKS or key[0] == ".") and _unwanted(key) else 0
        more = UNWANTED if key in _CONTENT else 0
        if not (less or more or self.inside[what][key] or self.outside[what][key]):
            return None
        return math.log((self.inside[what][key] + more + 0.5) / (self.outside[what][key] + less + 0.5))

    def of(self, page: Page) -> tuple[list[float], list[bool]]:
        """The score of each token of the row, and for each element whether it stands in an unwanted block."""
        known: list[float | None] = []
        unwanted: list[bool] = []
        tags: list[float] = []
        for e in page.elements:
            classes = (e.name,) if e.name in _CONTENT else () if e.holds else e.keys
            least = min((x for x in (self.odds(0, k) for k in classes) if x is not None), default=None)
            above = known[e.parent] if e.parent >= 0 else None
            known.append(above if least is None or e.name in _CONTENT and above is not None else least if above is None else min(above, least))
            passed = e.parent >= 0 and unwanted[e.parent] and e.name not in _CONTENT
            unwanted.append(passed or (least is not None and least < 0))
            own = min((x for x in (self.odds(1, k) for k in _tag_key(e)) if x is not None), default=None) if e.name else None
            if e.dropped:
                tags.append(TAG_RANGE[1] if e.name in _RAW else PASSED / 2)
            elif unwanted[-1]:
                # Its opening and closing tag share the cost; what stands in it has none.
                tags.append(0.0 if passed else PASSED / 2)
            elif own is not None:
                tags.append(min(TAG_RANGE[1], max(TAG_RANGE[0], own)))
            else:
                tags.append(TAG_RANGE[1] if e.content else DEFAULT_INLINE if e.name in _INLINE else DEFAULT_TAG)
        plain = [0.0 if bad else DEFAULT_WORD if k is None else min(WORD_RANGE[1], max(WORD_RANGE[0], k)) for k, bad in zip(known, unwanted, strict=True)]
        return [tags[e] if text is None else plain[e] * len(text.split()) for e, text in page.row], unwanted


def learn(pages: list[str]) -> Weights:
    """Count words and tags of each class inside and outside the labelled content."""
    inside, outside = (Counter(), Counter()), (Counter(), Counter())
    for text in pages:
        page = parse(text)
        if not any(e.content for e in page.elements):
            continue
        # What lies outside counts for its outermost block that holds no content.
        outermost = [0] * len(page.elements)
        skipped = [False] * len(page.elements)
        for i, e in enumerate(page.elements):
            if i and not e.content and not e.holds and e.name not in ("html", "body"):
                outermost[i] = outermost[e.parent] or i
            # A block of an unwanted name within the content says nothing for that name.
            skipped[i] = i > 0 and (skipped[e.parent] or (e.content and any(_unwanted(k) for k in e.keys)))
        for e, piece in page.row:
            n, what = (1, 1) if piece is None else (len(piece.split()), 0)
            if page.elements[e].content:
                if not skipped[e]:
                    if what:
                        inside[1].update(dict.fromkeys(_tag_key(page.elements[e]), 1))
                    else:
                        at = e
                        while at > 0 and page.elements[at].content:
                            inside[0].update(dict.fromkeys(page.elements[at].keys, n))
                            at = page.elements[at].parent
            elif outermost[e] and (not what or outermost[e] == e):
                outside[what].update(dict.fromkeys(page.elements[outermost[e]].keys if not what else _tag_key(page.elements[e]), n))
    return Weights(inside, outside)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region of the highest positive score, in one scan."""
    best, best_from, best_to = 0.0, 0, 0
    total, start = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, best_from, best_to = total, start, k + 1
    return best_from, best_to


def extract(text: str | None, weights: Weights) -> str:
    """The text of the best region: blocks joined by one space, white space inside made one space, trimmed."""
    page = parse(text or "")
    scores, unwanted = weights.of(page)
    start, end = best_region(scores)
    wanted = [k for k in range(start, end) if page.row[k][1] is not None and not unwanted[page.row[k][0]]]
    first, last = (wanted[0], wanted[-1]) if wanted else (end, start)
    out = [" " if piece is None and page.elements[e].name not in _INLINE else piece or "" for k, (e, piece) in enumerate(page.row[start:end], start) if piece is None or not unwanted[e] or not first < k < last]
    return " ".join("".join(out).split())


def fit(pages: DataFrame) -> Weights:
    """Learn from labelled pages, first in hash order of page_id."""
    labelled = only(pages, "page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[\\s/>]"))
    return learn([r["html"] for r in bounded_sample(labelled, "page_id", "html", SAMPLE, SAMPLE_BYTES)])


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
