"""Main text of web pages by tag-path ratios.

Every piece of text of a page has a path of tags from the root. Pieces with equal paths are aggregated: their
text length and punctuation, each per piece, say how much the path looks like running text. Both ratios are
smoothed along the page, fused by multiplication with the share of text outside links, and paths
above a threshold are content. What markup itself names as something else (menus, headers of the page, footers, side
bars, notices, adverts, forms, scripts, reader comments) is never content, but a class or id name or a form gives way
where it encloses the page's article, and a form or a name that is only a part of a compound also where it encloses most of the
text of high-scoring paths: such an element is a wrapper. Where a page marks an article, the
threshold is zero inside, so that a short heading there is text too, and outside it is the article's best score.

Blocks are cut at block-level tags. Character references are decoded; white space inside a block becomes one
space. A page is worked on as a whole in one row, so pages are independent of each other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import with_arrays

# The element names that HTML gives these roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img input embed".split()
)
BOILERPLATE = frozenset(
    "nav header footer aside form button select option menu dialog head script style noscript template iframe object canvas audio video svg math "
    "textarea title figcaption input label fieldset".split()
)
ARTICLE = {"main": 1, "article": 2}
# Tags that end an open element of the same group, as authors leave end tags out.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
INLINE_LIMITS = frozenset("article main td th".split())
SCOPES = frozenset("table ul ol dl div section article body html td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names that stand for something other than the article.
NAMED = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent gdpr disclaimer disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification pagination pager popup related recommended share sharing sidebar sidebars sidemenu social subscribe subscription tags toolbar "
    "widget widgets signup login reply replies respond".split()
)
HEADERS = frozenset("header masthead banner".split())
COMMENTS = frozenset("comment comments reply replies".split())
# How firmly markup names something else: not; by a part of a name; by a whole name; by its tag, role or hiding.
NOT, PART, WHOLE, NEVER = range(4)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:(>)|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
# Weights of a block's neighbours in the smoothing along the page, and the share of the mean that a path must reach.
SMOOTHING = np.array([0.25, 0.5, 0.25])
THRESHOLD = 0.5


@dataclass
class Block:
    """Text between two block-level tags: its path, its pieces, and what encloses it."""

    path: int
    banned: bool
    article: int
    # The innermost element around it that a name or a form may ban, and whether it goes on after the block before it.
    named: int = -1
    continues: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named_otherwise(tag: str, attributes: str, article: int) -> int:
    """How firmly a tag or its class, id or role names something that is not the article.

    A header or a figure's caption inside an article is not the page's.
    """
    if tag in BOILERPLATE and tag != "form" and not (article == ARTICLE["article"] and tag in ("header", "figcaption")):
        return NEVER
    found = PART if tag == "form" else NOT
    if not attributes or tag in ("body", "html", "main"):
        return found
    names = COMMENTS if tag == "article" else NAMED - HEADERS if article else NAMED
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return NEVER
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return NEVER
        if name == "role" and value.lower() in ROLES:
            return NEVER
        if name in ("class", "id"):
            for token in value.split():
                parts = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
                if names.intersection(parts):
                    if tag == "article":
                        return NEVER
                    found = max(found, WHOLE if parts <= names or parts & COMMENTS else PART)
    return found


def _lift_bans(found: list[Block], firmness: list[int], around: list[int], landmarks: list[tuple[str, int]]) -> None:
    """Bans the blocks inside named elements, but for elements that enclose the article or most of the text.

    Named elements are numbered in page order, and `around` has the next one outside each (or -1), a smaller number.
    """
    lifted = [False] * len(firmness)
    usable = [b for b in found if not b.banned and b.text]

    def text_in(within: list[Block]) -> list[int]:
        sizes = [0] * len(firmness)
        for block in within:
            if block.named >= 0:
                sizes[block.named] += len(block.text)
        for element in range(len(sizes) - 1, -1, -1):
            if around[element] >= 0:
                sizes[around[element]] += sizes[element]
        return sizes

    def outermost() -> list[int]:
        """The outermost element around each that is not lifted, itself included; -1 if all are lifted."""
        first = [-1] * len(firmness)
        for element, outside in enumerate(around):
            first[element] = first[outside] if outside >= 0 and first[outside] >= 0 else -1 if lifted[element] else element
        return first

    def free(element: int, first: list[int]) -> bool:
        return element < 0 or first[element] < 0

    # Where names enclose every article, the one around most of the articles' text is lifted, from the outside in.
    of_articles = text_in([b for b in usable if b.article])
    within = sorted({named for _, named in landmarks})
    # The elements around each landmark from the outside in, and how many of them are lifted.
    chains = []
    for named in within if within and within[0] >= 0 else []:
        chain = []
        while named >= 0:
            chain.append(named)
            named = around[named]
        chains.append(chain[::-1])
    done = [0] * len(chains)
    while chains and all(d < len(c) for d, c in zip(done, chains)):
        lifted[min({c[d] for d, c in zip(done, chains)}, key=lambda n: (-of_articles[n], n))] = True
        for i, chain in enumerate(chains):
            while done[i] < len(chain) and lifted[chain[done[i]]]:
                done[i] += 1
    if PART in firmness and usable:
        scores = path_scores(usable)
        # Inside the landmarks, if there are any that no name encloses.
        first = outermost()
        level = max((ARTICLE[tag] for tag, named in landmarks if free(named, first)), default=0)
        strong = [b for b, high in zip(usable, scores >= THRESHOLD * scores.mean()) if high and b.article >= level]
        total = sum(len(b.text) for b in strong)
        for element, size in enumerate(text_in(strong)):
            lifted[element] = lifted[element] or (firmness[element] == PART and 2 * size > total)
    first = outermost()
    for block in found:
        block.banned = block.banned or not free(block.named, first)


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in their order. Time and memory are linear in the page, however deep its tags are nested."""
    found: list[Block] = []
    # Tag, banned, inside an article, the innermost named element around, and the path of block-level tags as a number.
    stack: list[tuple[str, bool, int, int, int]] = []
    opened: Counter = Counter()
    paths: dict[tuple[int, str], int] = {}
    firmness: list[int] = []
    around: list[int] = []
    landmarks: list[tuple[str, int]] = []
    open_block: Block | None = None
    position = 0

    def top() -> tuple[str, bool, int, int, int]:
        return stack[-1] if stack else ("", False, 0, -1, 0)

    def push(tag: str, banned: bool, article: int, named: int) -> None:
        path = top()[4]
        if tag not in INLINE:
            path = paths.setdefault((path, tag), len(paths) + 1)
        stack.append((tag, banned, article, named, path))
        opened[tag] += 1

    def add(text: str) -> None:
        nonlocal open_block
        if not text:
            return
        _, banned, article, named, path = top()
        if open_block is None or (open_block.banned, open_block.named) != (banned, named):
            if not text.strip():
                if open_block is not None:
                    open_block.pieces.append(" ")
                return
            open_block = Block(path, banned, article, named, open_block is not None)
            found.append(open_block)
        decoded = html.unescape(text) if "&" in text else text
        open_block.pieces.append(decoded)
        if opened["a"]:
            open_block.linked += len(decoded.strip())

    def close(tag: str, limits: frozenset[str] = frozenset()) -> None:
        if not opened[tag]:
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == tag:
                for ended, *_ in stack[depth:]:
                    opened[ended] -= 1
                del stack[depth:]
                return
            if stack[depth][0] in limits:
                return

    while position < len(page):
        token = _TOKEN.search(page, position)
        if token is None:
            add(page[position:])
            break
        add(page[position : token.start()])
        position = token.end()
        ended, begun = token.group(1), token.group(2)
        if ended:
            tag = ended.lower()
            if tag not in INLINE:
                open_block = None
            close(tag, INLINE_LIMITS if tag in INLINE else frozenset())
        elif begun and token.group(4):
            tag, attributes = begun.lower(), token.group(3)
            if tag not in INLINE:
                open_block = None
            if tag in VOID:
                continue
            if tag in ENDS_PARAGRAPH:
                close("p", SCOPES)
            for other in CLOSES.get(tag, ()):
                close(other, SCOPES - {other})
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, position)
                if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                position = end.start() if end else len(page)
                push(tag, True, top()[2], top()[3])
                continue
            _, banned, article, named, _ = top()
            firm = NEVER if banned else _named_otherwise(tag, attributes, article)
            if firm in (PART, WHOLE):
                around.append(named)
                named = len(firmness)
                firmness.append(firm)
            if tag in ARTICLE and firm != NEVER:
                landmarks.append((tag, named))
            push(tag, firm == NEVER, max(article, ARTICLE.get(tag, 0)), named)
    for block in found:
        block.text = " ".join("".join(block.pieces).split())
    if firmness:
        _lift_bans(found, firmness, around, landmarks)
    # Text goes on across the border of an inline element whose name bans nothing.
    whole: list[Block] = []
    for block in found:
        if block.continues and whole and whole[-1].banned == block.banned:
            whole[-1].pieces += block.pieces
            whole[-1].linked += block.linked
        else:
            whole.append(block)
    for block in whole:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in whole if b.text]


def path_scores(page_blocks: list[Block]) -> np.ndarray:
    """The fused score of each block's tag path: smoothed text ratio times smoothed punctuation ratio times the share outside links."""
    texts = [b.text for b in page_blocks]
    paths, where = np.unique([b.path for b in page_blocks], return_inverse=True)
    pieces = np.bincount(where, minlength=len(paths))
    sizes = np.array([len(t) for t in texts], dtype=float)
    length = np.bincount(where, sizes, minlength=len(paths)) / pieces
    marks = np.bincount(where, [len(_MARKS.findall(t)) for t in texts], minlength=len(paths)) / pieces
    linked = np.bincount(where, [min(b.linked, s) for b, s in zip(page_blocks, sizes)], minlength=len(paths))
    outside = 1 - linked / np.maximum(1, np.bincount(where, sizes, minlength=len(paths)))

    def smoothed(ratio: np.ndarray) -> np.ndarray:
        along = np.convolve(np.pad(ratio[where], 1, mode="edge"), SMOOTHING, mode="valid")
        return np.bincount(where, along, minlength=len(paths)) / pieces

    return (np.log1p(smoothed(length)) * np.log1p(smoothed(marks)) * outside)[where]


def main_text(page: str | None) -> str:
    """The text of the content blocks, joined by one space; empty if there are none."""
    candidates = [b for b in blocks(page or "") if not b.banned]
    if not candidates:
        return ""
    scores = path_scores(candidates)
    level = np.array([b.article for b in candidates])
    inside = (level == level.max()) & (level > 0)
    limit = np.where(inside, 0.0, scores[inside].max() if inside.any() else THRESHOLD * scores.mean())
    above = inside | (scores > limit) if inside.any() else scores >= limit
    return " ".join(b.text for b, kept in zip(candidates, above) if kept)


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`pages` with `text string`; empty for a null or empty page and for one without content. Repeated rows are kept."""

    def start() -> Callable:
        return lambda values: [pa.array([main_text(v) for v in values], pa.string())]

    return with_arrays(pages, html_column, start, "text string", keep)
