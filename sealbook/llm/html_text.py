"""Main text of web pages by two passes over their blocks.

A page is cut into blocks of text at block-level tags; text inside scripts, forms, navigation and the like
belongs to no block. The first pass judges each block alone by its length, its share of stop words and its share of
linked characters: good, bad, or undecided where it is short. The second gives undecided blocks the label
of the nearest decided ones in the same part of the page. Inside an element marked as the article one good
neighbour is enough and the element's borders are good. Elsewhere the nearer one counts, at a border of the page
the only one; of two equally near ones that differ the good one counts for headings and for prose. On a page
without a good block prose is good at a smaller length. On a page in a language of which no stop words are known,
sentence marks take the place of stop words, and characters of scripts without spaces count threefold.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from sealbook.llm.common import slices

# Elements of HTML by what they do to text, and names that sites give to what is not the article.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside form menu dialog select button datalist head iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An end tag or a new block closes these without an end tag of their own.
CLOSED_BY_BLOCK = frozenset("p".split())
OTHER_PARTS = re.compile(
    r"ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|"
    r"comments?|commentlist|disqus|reply|replies|respond|thread|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|search|popup|modal|overlay|widgets?|"
    r"toolbar|pagination|pager|copyright|skiplink|teaser",
    re.I,
)
# Names of comments that are as well names of sections of an article: they count outside of one.
OTHER_OUTSIDE = re.compile("discussions?|reviews", re.I)
TITLE_PARTS = frozenset("header entry post article story content".split())
# What follows a part's name without making it another: boxes, kinds of entries, places, numbers.
OF_PART = re.compile(
    r"area|articles|bar|block|bottom|box|boxes|buttons?|col|column|container|content|entries|feed|footer|form|group|icons?|inner|items?|left|links?|list|message|module|news|outer|overlay|"
    r"panel|placeholder|popup|posts|primary|right|row|secondary|section|slot|stories|text|top|unit|wrap|wrapper|zone|\d\w*",
    re.I,
)
DOUBLE = {("side", "bar"): "sidebar", ("pop", "up"): "popup", ("skip", "link"): "skiplink"}
NOT_PARTS = frozenset("has with no not without".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be by at from this have or an not which but were their "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le les et des en un une du que est dans qui par pour au sur pas ne se il elle "
    "el los las que y del se con no una su al lo es por para como más".split()
)
LONG, STOPS_HIGH, STOPS_LOW, LINKS_HIGH, SHORT, FEW_WORDS = 200, 0.30, 0.20, 0.35, 70, 5
#: A page with a smaller share of stop words is in a language of which none are known. There prose is told by its sentence
#: marks: one in so many characters is as much as a high share of stop words, one in twice as many as a low one.
STOPS_NONE, MARK_EVERY = 0.08, 120
#: Characters of scripts that write a word with one or two of them count for so many.
WIDE_COUNTS = 3

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_TAG_BEGINS = re.compile(r"<(/?)[A-Za-z]")
_NAME_ENDS = re.compile(r"[\s/>]")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden)\b", re.I)
_BLANK = re.compile(r"\s+")
_MARKS = re.compile("[.,;:!?\u2026\u0589\u060c\u061b\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u17d4\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f]")
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    linked: int
    article: int  # number of the article or main element around it, 0 for none
    heading: bool
    stops: float = 0.0  # share of stop words
    foreign: bool = False  # on a page in a language without known stop words
    listed: bool = False  # mostly links beside another block of mostly links
    named: tuple[int, ...] = ()  # numbers of the elements around it that are other parts by their class or id


def _other_part(name: str, in_article: bool) -> bool:
    """Whether one class or id names another part of the page: by its last noun, so not ``has-sidebar`` or ``search-enabled``."""
    parts = [x for x in re.split("[_-]+", name.lower().split("--")[0] or name.lower()) if x]
    if NOT_PARTS.intersection(parts):
        return False
    while len(parts) > 1 and (joined := DOUBLE.get((parts[-2], parts[-1]))):
        parts[-2:] = [joined]
    if parts and parts[-1] == "header" and (in_article or len(parts) > 1 and TITLE_PARTS.issuperset(parts)):
        return False
    while len(parts) > 1 and not OTHER_PARTS.fullmatch(parts[-1]) and OF_PART.fullmatch(parts[-1]):
        parts.pop()
        if joined := DOUBLE.get(tuple(parts[-2:])):
            parts[-2:] = [joined]
    return bool(parts) and bool(OTHER_PARTS.fullmatch(parts[-1]) or not in_article and OTHER_OUTSIDE.fullmatch(parts[-1]))


def _apart(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is another part of the page than its article: for certain, or by its class or id alone."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True, False
    if not _NAMED.search(attributes) or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in OTHER_ROLES):
            return True, False
        if name in ("class", "id"):
            named = named or any(_other_part(x, in_article) for x in value.split())
    return False, named


def _without_named(found: list[Block], opened: list[tuple[int, bool]]) -> list[Block]:
    """The blocks without those of elements that are other parts by name.

    Such an element stays if most of the article text of the page is of articles that it contains: then it is
    a wrapper, whatever its name. ``opened`` has, per element, the articles begun before it and whether it lies in one.
    """
    total = sum(len(b.text) for b in found if b.article)
    held = [0] * len(opened)
    for b in found:
        for k in b.named:
            if b.article > opened[k][0]:
                held[k] += len(b.text)
    gone = {k for k, (_, in_story) in enumerate(opened) if in_story or not held[k] or 2 * held[k] < total}
    return [b for b in found if gone.isdisjoint(b.named)]


class _Tags:
    """The tags of a page, found in time that grows with its length, however broken it is.

    Comments, declarations and CDATA count as tags without a name. A tag ends at the first ``>`` outside quotes. Where there is none
    the ``<`` is text, unless no other follows: then the rest of the page is the tag.
    """

    def __init__(self, page: str):
        self.page, self.last, self.ends = page, page.rfind("<"), None

    def after(self, at: int):
        """Start, end, slash, name and attributes of the next tag from ``at`` on; None if there is none."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                return i, self._past("-->", i + 4), "", "", ""
            if page.startswith("<![CDATA[", i):
                return i, self._past("]]>", i + 9), "", "", ""
            if page[i + 1 : i + 2] in ("!", "?"):
                return i, self._past(">", i + 2), "", "", ""
            if self.ends is None and (m := _TAG.match(page, i)):
                return i, m.end(), m[1], m[2], m[3]
            if _TAG_BEGINS.match(page, i):
                if self.ends is None:
                    self._find_ends()
                if found := self._known(i):
                    return found
                if i == self.last:
                    return i, len(page), "", "", ""
            at = i + 1
        return None

    def _past(self, end: str, at: int) -> int:
        found = self.page.find(end, at)
        return len(self.page) if found < 0 else found + len(end)

    def _find_ends(self) -> None:
        """Of every quote and ``>``: where a tag ends that comes to it outside quotes. Made once a tag has no end, so that no
        other such tag is read to the end of the page."""
        self.at = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.stops = [m.start() for m in _NAME_ENDS.finditer(self.page)] + [len(self.page)]
        self.ends, self.good = [-1] * (len(self.at) + 1), [-1] * (len(self.at) + 1)
        seen: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            char = self.page[self.at[k]]
            if char == ">":
                self.ends[k] = self.at[k] + 1
            else:
                if char in seen:
                    self.ends[k] = self.ends[seen[char] + 1]
                seen[char] = k
        # The last of them up to each that lets a tag end.
        for k in range(len(self.at)):
            self.good[k] = k if self.ends[k] >= 0 else self.good[k - 1] if k else -1

    def _known(self, i: int):
        m = _TAG_BEGINS.match(self.page, i)
        if not m:
            return None
        name = self.stops[bisect_left(self.stops, m.end())]
        k = bisect_left(self.at, name)
        if self.ends[k] < 0:
            # A quote inside the name may begin the attributes instead; the last that leads to an end does.
            k = self.good[k - 1] if k else -1
            if k < 0 or self.at[k] < m.end():
                return None
            name = self.at[k]
        return i, self.ends[k], m[1], self.page[m.end() - 1 : name], self.page[name : self.ends[k] - 1]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those of elements that are never the article."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they stand apart, and whether by name
    named: list[int] = []
    opened: list[tuple[int, bool]] = []
    apart = links = articles = stories = 0
    inside: list[int] = []
    heading = False

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
            if text:
                linked = sum(len(html.unescape(t).strip()) for t, a in parts if a)
                out.append(Block(text, linked, inside[-1] if inside else 0, heading, named=tuple(named)))
            parts = []

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        m = tags.after(at)
        if not m:
            if not apart:
                parts.append((page[at:], links > 0))
            break
        start, end, closing, tag, attributes = m
        if start > at and not apart:
            parts.append((page[at:start], links > 0))
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or n if end else n
            if tag in ("iframe", "object"):
                flush()
            continue
        if tag in BLOCKS:
            flush()
            heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag == "br":
            parts.append((" ", links > 0))
        if tag in VOID:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS or tag in NEVER:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        for name, was, by_name in reversed(stack[k:]):
                            apart -= was
                            if by_name:
                                named.pop()
                            stories -= name == "article"
                            if name in ("article", "main") and inside:
                                inside.pop()
                        del stack[k:]
                        links = 0
                        break
        elif tag == "a":
            links = 1
        elif tag in BLOCKS or tag in NEVER:
            if tag in CLOSED_BY_BLOCK and stack and stack[-1][0] == tag:
                _, was, by_name = stack.pop()
                apart -= was
                if by_name:
                    named.pop()
            was, by_name = _apart(tag, attributes, bool(inside))
            apart += was
            if by_name:
                named.append(len(opened))
                opened.append((articles, stories > 0))
            stack.append((tag, was, by_name))
            stories += tag == "article"
            if tag in ("article", "main"):
                articles += 1
                inside.append(articles)
    flush()
    return _without_named(out, opened) if opened else out


def stop_share(words: list[str]) -> float:
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def size(block: Block) -> int:
    """Characters, those of a page in another language by how much they say."""
    return len(block.text) + (WIDE_COUNTS - 1) * len(_WIDE.findall(block.text)) * block.foreign


def prose_share(block: Block) -> float:
    """How much a block reads like prose, on the scale of shares of stop words."""
    if not block.foreign:
        return block.stops
    return min(STOPS_HIGH, STOPS_HIGH * len(_MARKS.findall(block.text)) * MARK_EVERY / size(block))


def linked_mostly(block: Block) -> bool:
    return block.linked > LINKS_HIGH * len(block.text)


def _with_page(found: list[Block]) -> list[Block]:
    """The blocks with what they need to know of the page: whether its language has known stop words, and lists of links."""
    many = [False, *(linked_mostly(b) for b in found), False]
    words = stops = 0
    for i, b in enumerate(found):
        own = b.text.lower().split()
        b.stops = stop_share(own)
        b.listed = many[i + 1] and (many[i] or many[i + 2])
        if not many[i + 1]:
            words, stops = words + len(own), stops + b.stops * len(own)
    for b in found:
        b.foreign = stops < STOPS_NONE * words
    return found


def first_pass(block: Block) -> bool | None:
    """Good, bad or undecided, from the block alone."""
    n = size(block)
    if linked_mostly(block):
        # In the article a paragraph may well be a link; several side by side are a list of links.
        return None if block.article and not block.listed else False
    share = prose_share(block)
    if n < SHORT or block.heading:
        return None
    if block.article:  # marked up as the article: prose or not, only links speak against it
        return True if share >= STOPS_LOW or n >= LONG else None
    if share >= STOPS_HIGH:
        return True if n > LONG else None
    return None if share >= STOPS_LOW else False


def _shorter_prose(found: list[Block], labels: list[bool | None]) -> None:
    """Where no block is good, those undecided ones are that read like prose: of some length, or else of some words."""
    prose = [i for i, b in enumerate(found) if labels[i] is None and not b.heading and prose_share(b) >= STOPS_HIGH]
    words = {i: max(len(found[i].text.split()), len(_WIDE.findall(found[i].text)) * found[i].foreign // 2) for i in prose}
    for i in [i for i in prose if size(found[i]) >= SHORT] or [i for i in prose if words[i] >= FEW_WORDS]:
        labels[i] = True


def main_text(page: str | None) -> str:
    """Good blocks, one line each."""
    found = _with_page(blocks(page or ""))
    labels = [first_pass(b) for b in found]
    # Pages that mark their article have it there; others are judged as a whole, also those that mark only a small part.
    marked = any(b.article for b in found)
    if marked:
        within = sum(len(b.text) for b, label in zip(found, labels) if b.article and label is not False)
        outside = sum(len(b.text) for b, label in zip(found, labels) if not b.article and label)
        if outside > 2 * within:
            marked, found = False, [replace(b, article=0) for b in found]
            labels = [first_pass(b) for b in found]
    if not marked and True not in labels:
        _shorter_prose(found, labels)
    # The nearest decided block on each side: its label and how far it is.
    none = (None, 0)
    near: list[tuple[tuple[bool | None, int], tuple[bool | None, int]]] = []
    before: dict[int, tuple[bool, int]] = {}
    for i, b in enumerate(found):
        label, at = before.get(b.article, none)
        near.append(((label, i - at), none))
        if labels[i] is not None:
            before[b.article] = labels[i], i
    after: dict[int, tuple[bool, int]] = {}
    for i in range(len(found) - 1, -1, -1):
        label, at = after.get(found[i].article, none)
        near[i] = near[i][0], (label, at - i)
        if labels[i] is not None:
            after[found[i].article] = labels[i], i
    kept = []
    for b, label, ((left, l_far), (right, r_far)) in zip(found, labels, near):
        if marked and not b.article:
            continue
        if label is None and b.article:  # the borders of an article count as good
            label = left is not False or right is not False
        elif label is None and (left is None or right is None or left == right or b.heading):
            label = bool(left or right)
        elif label is None and l_far != r_far:
            label = left if l_far < r_far else right
        elif label is None:
            label = size(b) >= SHORT and prose_share(b) >= STOPS_HIGH
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every row of ``pages``.

    A null or empty page, or one without a good block, has an empty text. Null ids and urls are passed
    through, identical rows give identical rows, and an empty table gives none; other columns are not looked
    at. Broken markup is read as far as it goes: open elements end with the page.
    """
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return base.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
