"""Main text of web pages by a minimum cut.

A page becomes blocks of text in page order. A linear classifier over a block's length, its
links, its form, its wording, its share of the page's text, and the marks around it (an
article, a menu, a class name) gives the cost of calling it content or boilerplate: the
capacities to the two terminals. Smoothness edges join neighbours in page order and blocks
under one parent, weaker ones across a mark. The minimum cut is the labelling of least total
cost. No mark decides by itself: long prose outweighs a name that may be wrong, a list of links
in an article goes, and short or doubtful blocks go the way of what is around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in HTML.
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it runs to the end of the page if they have no end tag.
_RAW = frozenset("script style title textarea".split())
#: Elements whose content is shown only in their stead; without an end tag they hold nothing.
_MEDIA = frozenset("noscript template iframe object svg math canvas audio video head".split())
_BOILER = frozenset("nav footer aside menu button select dialog fieldset option".split())
#: What an opening tag closes, if it is open: an item closes an item, a block closes a paragraph.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table article section div body html nav aside footer main header select td th".split())
_NO_P = _BLOCK - frozenset("body html button option select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of the text of what holds them.
_PARTS = frozenset("p li dt dd pre blockquote figcaption td th h1 h2 h3 h4 h5 h6".split())

# Words of class names, ids and roles.
#: Boilerplate wherever it stands.
_ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion comment comments commentlist commentform disqus replies "
    "cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay breadcrumb breadcrumbs pagination pager".split())
#: Boilerplate by themselves, also in an article, but not around one.
_LAYOUT = frozenset("sidebar widget nav navbar navigation menu footer masthead topbar toolbar complementary contentinfo".split())
#: Boilerplate outside of an article; in one, only a hint.
_HINTS = frozenset(
    "side foot banner notice alert signup login share sharing social search form legal copyright disclaimer related recommended recommendations "
    "reply respond discussion skip".split())
_HEADER = frozenset("header head".split())  # of a page, unless in an article
#: Words that say nothing about the content when they stand beside others.
_NEUTRAL = frozenset(
    "a an and area article articles bar block body bottom box btn button buttons center col column container content div entry footer global google group header "
    "holder icon icons inner item items left link links list main message module msg nav outer page panel post posts primary right row secondary section site slot "
    "small stories story sub text the thread title tools top ul unit us wrap wrapper".split())
_GOOD_WORDS = frozenset("article content main story post entry body text".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

#: Fixed weights of the classifier (evidence for content, negative for boilerplate).
BIAS, LENGTH, SENTENCE, HEADING, LINKS, NAMED_GOOD = -1.0, 2.5, 0.5, 0.5, -2.0, 1.0
FULL_LENGTH = 150
#: A share of the page's text, in a block's parent, that speaks for it in full; a short block that is
#: alone in a lesser one; the wording of notices in a short block; a short text that comes again elsewhere.
PARENT, FULL_SHARE, ALONE, NOTICE, AGAIN, SHORT = 1.2, 0.3, -2.0, -2.0, -0.75, 200
#: The marks: hidden elements; names that are boilerplate anywhere; elements of menus, footers and
#: forms; names of the layout and headers; hints; articles, main parts, and what lies outside of these.
MARKS = {"hidden": -6.0, "always": -4.5, "boiler": -3.5, "form": -2.5, "layout": -1.75, "hint": -1.5, "article": 2.5, "main": 1.5, "outside": -3.0, "page": 0.0}
#: Edges: neighbours in page order, and more under one parent; across a mark a part of it.
ADJACENT, SIBLING, ACROSS = 0.5, 0.75, 0.1
_UNIT = 1000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)\s*(=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
#: The wording of notices.
_NOTICE = re.compile(r"©|\(c\)\s|\b(?:copyright|all rights reserved|privacy|cookies|terms of (?:use|service)|newsletter|subscribe|advertisement|sponsored)\b", re.I)


@dataclass(eq=False)
class Mark:
    """Evidence that an element gives for all that it holds."""

    kind: str  # page, outside, article, main, boiler (and what kind of), form, hint
    outer: Mark | None = None
    yields: bool = False  # no mark if an article or main element is in it
    wraps: bool = False  # there is one in it
    cost: str = ""  # which of MARKS, if not the kind

    def gain(self, known: dict[Mark, float]) -> float:
        """Its own evidence and that of the marks around it; an article or a main part speaks for
        what is in it whatever is around, but not for boilerplate in it. known: what has been told of
        other marks, so that nested ones cost no more than their number."""
        chain, mark = [], self
        while mark not in known:
            chain.append(mark)
            if mark.outer is None or mark.kind in ("article", "main"):
                break
            mark = mark.outer
        for m in reversed(chain):
            own = MARKS[m.cost or m.kind]
            if m.outer is not None and m.kind not in ("article", "main"):
                around = known[m.outer]
                own += min(0.0, around) if m.kind in ("boiler", "form") else around
            known[m] = own
        return known[self]


@dataclass
class Block:
    text: str
    parent: int
    score: float
    mark: Mark
    good: bool = False  # a container's name speaks for it
    linked: int = 0  # characters in links


class _Open:
    """An open element: its number, the nearest mark, and the nearest block element."""

    __slots__ = ("good", "link", "mark", "media", "name", "number", "owner", "within")

    def __init__(self, name: str, number: int, outer: _Open | None, mark: Mark, good: bool = False):
        self.name, self.number, self.mark, self.good = name, number, mark, good
        self.link = name == "a" or bool(outer and outer.link)
        self.media = outer.media if outer else 0
        self.owner = self if outer is None or name in _BLOCK else outer.owner
        self.within = outer.owner.number if outer and name in _PARTS else number  # what its text is a part of


# ---------------------------------------------------------------- tokens
def tags(page: str) -> Iterator[tuple[int, int, str, bool, bool, dict[str, str]]]:
    """(start, end, name, closes, empty, attributes) of the tags of a page and, with an empty
    name, of its comments and declarations; what lies between them is text. Attributes are
    read as browsers do. A quoted value without an end is taken to end before the next '>'. The
    content of elements without markup goes with their start tag. Time is linear in the page."""
    at, n, gone = 0, len(page), set()  # gone: quotes and end tags of which there is no more

    def find(what: str, start: int) -> int:
        place = -1 if what in gone else page.find(what, start)
        if place < 0:
            gone.add(what)
        return place

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            short = page.startswith((">", "->"), start + 4)
            end = page.find(">", start + 4) + 1 if short else (found + 3 if (found := page.find("-->", start + 4)) >= 0 else n)
            yield start, end, "", False, False, {}
            at = end
            continue
        closes = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closes)
        if not name:
            if closes or page.startswith(("!", "?"), start + 1):
                end = (found + 1 if (found := page.find(">", start)) >= 0 else n)
                yield start, end, "", False, False, {}
                at = end
            else:
                at = start + 1
            continue
        place, attributes = name.end(), {}
        while True:
            found = _ATTRIBUTE.match(page, place)
            if not found:
                break
            place, value = found.end(), ""
            if found[2]:
                quote = page[place : place + 1]
                if quote in ("'", '"') and quote:
                    end = find(quote, place + 1)
                    if end < 0:
                        end = found_end if (found_end := page.find(">", place)) >= 0 else n
                        value, place = page[place + 1 : end], end
                    else:
                        value, place = page[place + 1 : end], end + 1
                else:
                    value = _UNQUOTED.match(page, place)[0]
                    place += len(value)
            attributes.setdefault(found[1].lower(), value)
        end = (found_end if (found_end := page.find(">", place)) >= 0 else n)
        empty = page.startswith("/", end - 1) and end > place
        end, low = min(n, end + 1), name[0].lower()
        if low in _RAW and not closes:
            end = _raw_end(page, end, low, gone)
        yield start, end, low, closes, empty, attributes
        at = end


_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}


def _raw_end(page: str, at: int, name: str, gone: set[str]) -> int:
    done = None if "</" + name in gone else _RAW_ENDS[name].search(page, at)
    if done is None:
        gone.add("</" + name)
    return done.end() if done else len(page)


# ---------------------------------------------------------------- marks
def _words(token: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(token) if w]


def named(attributes: dict[str, str], inside: bool) -> str:
    """What class, id and role say: boiler, layout (boilerplate, unless an article is in it),
    hint, or nothing."""
    best = ""
    for token in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = set(_words(token))
        bad = words & (_ALWAYS | _LAYOUT | _HINTS | (frozenset() if inside else _HEADER))
        if not bad:
            continue
        if words - bad - _NEUTRAL:  # it has a subject of its own, as in related-work
            best = best or "hint"
        elif bad & _ALWAYS:
            return "boiler"
        elif bad & _LAYOUT or not inside:
            best = "related" if bad & {"related", "recommended", "recommendations"} and not bad & _LAYOUT else "layout"
        else:
            best = best or "hint"
    return "boiler" if best == "related" else best


def _hidden(attributes: dict[str, str]) -> bool:
    style = "".join(attributes.get("style", "").lower().split())
    return "hidden" in attributes or "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden", "").lower() == "true"


def mark_of(name: str, attributes: dict[str, str], outer: Mark) -> Mark:
    """The mark of an element that stands in `outer`; outer itself if it says nothing."""
    inside = outer.kind in ("article", "main")
    sure = outer.kind == "boiler"
    if name in ("html", "body"):
        return outer
    if attributes and _hidden(attributes):
        return Mark("boiler", outer, cost="hidden")
    if name in _BOILER:
        return Mark("boiler", outer)
    says = named(attributes, inside or outer.kind == "hint") if attributes else ""
    if says == "boiler":
        return Mark("boiler", outer, cost="always")
    if name in ("article", "main") and not (sure and not outer.yields):
        mark, around = Mark(name, outer), outer
        while around is not None and not around.wraps:
            around.wraps, around = True, around.outer
        return mark
    if sure:
        return outer
    if says == "layout" or name == "header" and not inside and outer.kind != "hint":
        return Mark("boiler", outer, yields=True, cost="layout")
    if name == "form":
        return outer if outer.kind == "form" else Mark("form", outer, yields=True)
    return Mark("hint", outer) if says == "hint" else outer


# ---------------------------------------------------------------- blocks
def blocks(page: str | None) -> list[Block]:
    """The blocks of a page with their scores. Broken markup is read as it comes: an end
    tag without a start is skipped, open elements end with the page."""
    page = page or ""
    out: list[Block] = []
    whole = Mark("page")
    stack = [_Open("", 0, None, whole)]
    where: dict[str, list[int]] = {}  # places of the open elements by name
    scopes = [0]
    within: dict[int, int] = {}  # media elements and those around them
    ended: set[int] = set()
    media: list[int] = []  # of each block
    numbers, at = 1, 0
    parts: list[str] = []
    linked, owner, good = 0, stack[0], False

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                size = len(text)
                score = BIAS + LENGTH * min(1.0, size / FULL_LENGTH) + LINKS * min(1.0, linked / size)
                score += HEADING * (owner.name in _HEADINGS) + SENTENCE * (text[-1] in ".!?…\"'»”’:;")
                out.append(Block(text, owner.within, score + NAMED_GOOD * good, owner.mark, good, min(size, linked)))
                media.append(owner.media)
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, owner, good
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            top = stack[-1]
            alone = top is not top.owner and (top.mark is not top.owner.mark or top.media != top.owner.media)
            if alone and piece.strip():  # an inline element that is marked stands by itself
                end_block()
                owner, good = top, top.good
                parts.append(piece)
                linked += len(piece) * top.link
                end_block()
                return
            if not parts:
                owner, good = top.owner, top.good
            parts.append(piece)
            linked += len(piece) * top.link

    def close(index: int) -> None:
        if any(e.name in _BLOCK for e in stack[index:]):
            end_block()
        while len(stack) > index:
            name = stack.pop().name
            where[name].pop()
            if scopes[-1] == len(stack):
                scopes.pop()

    for start, end, name, closes, empty, attributes in tags(page):
        add(page[at:start])
        at = end
        if not name or name in _RAW:
            continue
        if closes:
            found = where.get(name)
            if found and (name in _BLOCK and name != "p" or name in _MEDIA or found[-1] > scopes[-1]):
                if name in _MEDIA:
                    end_block()
                    ended.add(stack[found[-1]].number)
                close(found[-1])
            elif name == "p":
                end_block()
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in _VOID:
            if name in _BLOCK:
                end_block()
            continue
        if name in _BLOCK:
            end_block()
            closed = _CLOSES.get(name, ()) + (("p",) if name in _NO_P else ())
            while (last := max((where[c][-1] for c in closed if where.get(c)), default=0)) and last >= scopes[-1]:
                close(last)
        if empty and name not in _BLOCK:
            continue
        outer = stack[-1]
        mark = mark_of(name, attributes, outer.mark)
        if name not in _BLOCK and mark.kind == "hint":
            mark = outer.mark
        element = _Open(name, numbers, outer, mark, outer.good or bool(attributes and name not in ("html", "body") and _GOOD_WORDS & set(_words(attributes.get("class", "") + " " + attributes.get("id", "")))))
        if name in _MEDIA:
            end_block()
            element.media = numbers
            within[numbers] = outer.media
        where.setdefault(name, []).append(len(stack))
        if name in _SCOPES:
            scopes.append(len(stack))
        stack.append(element)
        numbers += 1
    add(page[at:])
    end_block()
    gone = {0: False}
    for m, around in within.items():  # in page order, so what is around comes first
        gone[m] = m in ended or gone[around]
    return _resolved([b for b, m in zip(out, media) if not gone[m]])


def _resolved(page: list[Block]) -> list[Block]:
    """The blocks with marks that hold: one around an article gives way to what is around
    it, as does a form around most of the text; text outside is boilerplate where articles
    hold a good part of the text."""
    sizes: Counter[Mark] = Counter()
    for b in page:
        sizes[b.mark] += len(b.text)
    free = sum(n for m, n in sizes.items() if m.kind != "boiler" or m.yields and m.wraps)
    names: dict[Mark, Mark] = {}

    def holds(mark: Mark) -> Mark:
        chain = []
        while mark not in names and mark.outer is not None:
            chain.append(mark)
            mark = mark.outer
        last = names.setdefault(mark, mark)
        for m in reversed(chain):
            wide = m.kind == "form" and 2 * sizes[m] > free
            if m.yields and (m.wraps or wide):
                names[m] = last
            else:
                m.outer = last
                names[m] = m
            last = names[m]
        return last

    own = 0
    for b in page:
        b.mark = holds(b.mark)
        inner = b.mark.outer if b.mark.kind == "hint" else b.mark
        own += len(b.text) * (inner.kind in ("article", "main"))
    if page and 4 * own >= free:
        root = page[0].mark
        while root.outer is not None:
            root = root.outer
        root.kind = "outside"
    if own:  # names of containers tell the content only where no element does
        for b in page:
            b.score -= NAMED_GOOD * b.good
    _weigh(page)
    return page


def _weigh(page: list[Block]) -> None:
    """Adds what a block's surroundings and wording tell to its score, and its marks."""
    gains: dict[Mark, float] = {}
    for b in page:
        b.mark.gain(gains)
    prose: Counter[int] = Counter()
    blocks_of = Counter(b.parent for b in page)
    texts = Counter(text for _, text in {(b.parent, b.text) for b in page})
    for b in page:
        prose[b.parent] += (len(b.text) - b.linked) * (gains[b.mark] >= 0)
    whole = sum(prose.values())
    for b in page:
        share = prose[b.parent] / whole if whole else 1.0
        b.score += gains[b.mark] + PARENT * min(1.0, share / FULL_SHARE)
        if len(b.text) < SHORT:
            b.score += ALONE * (blocks_of[b.parent] == 1 and share < FULL_SHARE) + AGAIN * (texts[b.text] > 1) + NOTICE * bool(_NOTICE.search(b.text))


# ---------------------------------------------------------------- the cut
def graph(page: list[Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(gains, edges): the blocks' gains, and edges (i, j, capacity) between neighbours in page
    order and successive blocks of a parent."""
    gains = [round(b.score * _UNIT) for b in page]
    last: dict[int, int] = {}
    out = []
    for i, b in enumerate(page):
        near = {i - 1: ADJACENT} if i else {}
        if b.parent in last:
            near[last[b.parent]] = near.get(last[b.parent], 0.0) + SIBLING
        out += [(j, i, int(c * _UNIT * (1.0 if page[j].mark is b.mark else ACROSS))) for j, c in near.items()]
        last[b.parent] = i
    return gains, out


def min_cut(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of a minimum cut: node i hangs on the source with gain[i] if that is
    positive, else on the sink with -gain[i]. Nodes whose gain exceeds all their edges are
    decided at once and pass their edges on to their neighbours' gains, which keeps the
    minimum; max-flow by shortest augmenting paths decides the rest. A node that could be on either
    side is boilerplate."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in links:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    total = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) <= total[i] and not (abs(gain[i]) == total[i] and gain[i] < 0):
            continue
        label[i] = gain[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                gain[j] += c if label[i] else -c
                total[j] -= c
                del near[j][i]
                queue.append(j)
        near[i].clear()
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i in _source_side(left, gain, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], gain: list[int], near: list[dict[int, int]]) -> set[int]:
    s, t = -1, -2
    rest: dict[int, dict[int, int]] = {i: dict(near[i]) for i in nodes}
    rest[s] = {i: gain[i] for i in nodes if gain[i] > 0}
    rest[t] = {}
    for i in nodes:
        rest[i].setdefault(s, 0)
        if gain[i] < 0:
            rest[i][t] = -gain[i]
    while True:
        came = {s: s}
        queue = deque([s])
        while queue and t not in came:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if t not in came:
            return {i for i in came if i >= 0}
        path, j = [], t
        while j != s:
            path.append((came[j], j))
            j = came[j]
        push = min(rest[i][j] for i, j in path)
        for i, j in path:
            rest[i][j] -= push
            rest[j][i] = rest[j].get(i, 0) + push


def main_text(page: str | None) -> str:
    """The text of the blocks that the cut leaves with the content."""
    found = blocks(page)
    labels = min_cut(*graph(found))
    return " ".join(b.text for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars. A null or empty page has empty text, a
    very long one is read whole in linear time; ties of the cut go to boilerplate; repeated
    rows repeat; empty in, empty out; extra columns, of whatever name, don't matter."""
    @F.pandas_udf("string")
    def of(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    rows = pages.select("page_id", "url", of(F.col("html")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
