"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by
stop-word density, length and link density, and those whose markup says that they
are no article; short and middling blocks stay open. In pass two an open block
inherits the label of its nearest decided neighbours. Rules after Pomikalek,
"Removing Boilerplate and Duplicate Content from Web Corpora" (2011).

The stop words are English, German, French and Spanish. Where no block of a page
holds enough of them, the page's language is taken as unknown and length decides.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# --- fixed values: HTML element names and common words ---
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select button label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article, wherever they stand; a header is none
#: inside an article, where it holds the title.
FURNITURE = frozenset("aside dialog footer menu nav".split())
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner sidebar aside comment comments respond reply replies "
    "disqus review reviews discussion discussions rating ratings feedback cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login share sharing social related recommended "
    "breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer header masthead toolbar widget popup modal overlay disclaimer copyright skip".split()
)
#: Marks of what is no part of an article however long it is and whatever it holds.
APART = frozenset(
    "ad ads advert adverts advertisement adsbygoogle comment comments respond reply replies disqus review reviews discussion discussions rating ratings "
    "feedback cookie cookies consent gdpr notice newsletter subscribe subscription signup login popup modal overlay".split()
)
#: A heading that says only this belongs to the comments below it.
COMMENTS = re.compile(
    r"\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply)|post a comment)"
    r"(?:\s*\(\d+\))?\W*", re.IGNORECASE
)
#: Words that may stand beside a mark in one name without changing what it says.
LAYOUT = frozenset(
    "area article bar block bottom box button buttons card cell col column container content entry feed form global group holder icon icons inner item items js left "
    "level line link links list main mobile module outer page pane panel post primary reader right row secondary section site slot small sticky sub text thread top "
    "unit user view widgets wrap wrapper".split()
)
#: A name with one of these tells a state of what is inside, not what it is.
STATES = frozenset("has no not with without is enabled disabled open opened closed fixed hidden visible active".split())
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in is it its more not of on one or she so that the their them they "
    "this to was we were what when which who will with would you "
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist man mit nach nicht noch nur "
    "oder sich sie sind über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais même ne nous on ou où par pas plus pour qu que qui sa se ses son "
    "sont sur un une vous y "
    "al como con del el ella ellos era esta este fue ha hay la las lo los más muy no para pero por porque que se sin sobre son su sus también te una unos ya".split()
)

SHORT, LONG = 70, 200
LOW_STOP, HIGH_STOP = 0.15, 0.30
MAX_LINKS = 0.33
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_BITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """An open or closed block element that says something about its blocks."""

    up: Element | None
    hard: bool = False  # never part of an article
    mark: str = ""  # "apart", "form" or "other": what its name says
    article: int = 0  # number of the article element around it, 0 if none
    holds_article: bool = False
    holds_title: bool = False  # a heading of the page's highest level
    holds_prose: bool = False  # a long block without links
    holds_frame: bool = False  # a page's own header, navigation or footer
    blocks: int = 0  # of what may be article

    def furniture(self, all_blocks: int) -> bool:
        """A mark counts unless its element wraps the article: what holds the article
        element, or the title and prose, or every block that may be article, is a
        wrapper; length says nothing."""
        if self.hard or self.mark == "apart":
            return True
        wraps = self.holds_article or self.blocks == all_blocks > 0
        titled = self.holds_title and self.holds_prose and (self.mark != "form" or self.holds_frame)
        return bool(self.mark) and not wraps and not titled


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    item: bool  # of a list
    furniture: bool  # markup says it is not the article
    article: int  # number of the article element that holds it, 0 if none


def _marked(attrs: str) -> str:
    """What class, id or role say: "apart", "other" or nothing. Every word of a name
    must be a mark or a word of layout, one of them a mark, and none a state."""
    said = ""
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            bits = {b.lower() for b in _BITS.findall(name)}
            if bits & MARKS and bits <= MARKS | LAYOUT:
                if bits & APART:
                    return "apart"
                said = "other"
    return said


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in order; broken markup is taken as it comes."""
    found: list[tuple[str, int, int, bool, Element]] = []
    root = Element(None)
    stack: list[tuple[str, Element]] = []
    names: Counter[str] = Counter()  # of the open elements
    pieces: list[str] = []
    linked, in_link, level, n_articles, at = 0, False, 0, 0, 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())

    def close() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                name, element = stack[-1] if stack else ("", root)
                found.append((text, linked, level, name == "li", element))
            pieces.clear()
        linked = 0

    elements = [root]
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text_to(n)
            break
        text_to(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        shut = bool(m[1])
        if not shut and name in RAW:
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not shut
        elif name in BLOCKS:
            close()
            in_link = False
            if shut:
                if names[name]:
                    while True:
                        gone, _ = stack.pop()
                        names[gone] -= 1
                        if gone == name:
                            break
                level = 0
            elif name not in VOID:
                if stack and stack[-1][0] == "p":  # a paragraph ends where a block begins
                    stack.pop()
                    names["p"] -= 1
                element = up = stack[-1][1] if stack else root
                attrs = m[3]
                mark = _marked(attrs) if attrs else ""
                if name in ("article", "main"):
                    n_articles += 1
                    apart = mark if mark == "apart" else ""  # a reader's comment may be an article element
                    element = Element(up, mark=apart, article=up.article or n_articles, holds_article=not apart)
                elif name not in ("html", "body"):
                    hidden = bool(attrs) and ("hidden" in attrs or "none" in attrs) and bool(_HIDDEN.search(attrs))
                    hard = hidden or name in FURNITURE or (name == "header" and not up.article)
                    mark = "form" if name == "form" and mark != "apart" else mark
                    if hard or mark:
                        element = Element(up, hard, mark, up.article, holds_frame=hard and name in ("header", "nav", "footer"))
                if element is not up:
                    elements.append(element)
                stack.append((name, element))
                names[name] += 1
                level = int(name[1]) if name in HEADINGS else 0
    close()
    return _decided(found, elements)


def _decided(found: list[tuple[str, int, int, bool, Element]], elements: list[Element]) -> list[Block]:
    """The blocks, with what the markup of all elements around them says."""
    outside = lambda e: e.hard or e.mark == "apart"
    top = min((level for _, _, level, _, e in found if level and not outside(e)), default=0)
    for text, linked, level, _, e in found:
        e.holds_title |= bool(level) and level == top
        e.holds_prose |= len(text) - linked > LONG
        e.blocks += 1
    for e in reversed(elements):  # an element comes after the one that holds it
        if e.up is not None:
            e.up.holds_frame |= e.holds_frame
            if not outside(e):
                e.up.holds_article |= e.holds_article
                e.up.holds_title |= e.holds_title
                e.up.holds_prose |= e.holds_prose
                e.up.blocks += e.blocks
    state: dict[int, bool] = {id(elements[0]): False}
    for e in elements[1:]:
        state[id(e)] = state[id(e.up)] or e.furniture(elements[0].blocks)
    return [Block(t, k, bool(h), i, state[id(e)] or (bool(h) and bool(COMMENTS.fullmatch(t))), e.article) for t, k, h, i, e in found]


GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"


def density(b: Block) -> float:
    words = [w.strip(".,;:!?\"'()[]«»„“”…").lower() for w in b.text.split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(b: Block, known: bool = True) -> str:
    """A block's label by itself. ``known``: the page's language has stop words here."""
    size = len(b.text)
    if b.furniture:
        return BAD
    if b.article:
        if b.item and b.linked >= 0.9 * size:  # a list of links
            return BAD
    elif b.linked > MAX_LINKS * size:
        return BAD
    if size < SHORT:
        return BAD if b.linked and not b.article else OPEN
    if not known:
        return GOOD if size > LONG else NEAR
    share = density(b)
    if share >= HIGH_STOP:
        return GOOD if size > LONG else NEAR
    # Inside an article prose that looks like none is left to its neighbours.
    return NEAR if share >= LOW_STOP or b.article else BAD


def labels_of(blocks: list[Block]) -> list[str]:
    known = any(len(b.text) >= SHORT and not b.furniture and density(b) >= LOW_STOP for b in blocks)
    return [first_pass(b, known) for b in blocks]


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of the nearest decided block on either side.

    An article element is a region of its own: its blocks ask only decided ones
    of the same article, furniture in it aside, and if there is none they follow
    the article's markup.
    Where the sides differ a middling block is kept, and a short one follows the
    nearer side (a heading the one below; a tie goes to the article if there is one).
    On a page without any good or middling block the short ones are the text.
    """
    n = len(blocks)
    lone = GOOD not in labels and NEAR not in labels and not any(b.article and not b.furniture for b in blocks)

    def sides(step: int) -> list[tuple[int, str | None]]:
        found, last = [(0, None)] * n, {}
        for i in range(n)[::step]:
            region = blocks[i].article
            found[i] = last.get(region, (0, None))
            if labels[i] in (GOOD, BAD) and not (region and (blocks[i].furniture or labels[i] == BAD)):
                last[region] = (i, labels[i])
        return found

    before, after = sides(1), sides(-1)
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        (x, a), (y, b) = before[i], after[i]
        inside = bool(blocks[i].article)
        if lone:
            out.append(True)
        elif a is None and b is None:
            out.append(inside or label == NEAR)
        elif a is None or b is None:
            out.append((a or b) == GOOD or (label == NEAR and inside))
        elif a == b:
            out.append(a == GOOD or (label == NEAR and inside))
        elif label == NEAR:
            out.append(True)
        elif blocks[i].heading:
            out.append(b == GOOD)
        else:
            near, far = ((a, b), (b, a))[i - x > y - i]
            tie = inside and i - x == y - i
            out.append(near == GOOD and (inside or i - x != y - i) or (tie and far == GOOD))
    return out


def extract(page: str | None) -> str:
    blocks = blocks_of(page or "")
    keep = second_pass(blocks, labels_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def main_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(extract)

    return of(page)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    Null, empty and wholly boilerplate pages have the empty text. Rows that
    repeat, null ids and extra columns make no difference to others. An empty
    table gives an empty result.
    """
    short_batches(pages.sparkSession)
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
