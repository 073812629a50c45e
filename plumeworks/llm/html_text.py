"""Main text of web pages by line-block distribution (operator 7).

Markup is stripped to lines, one for each block of the page, and the lengths of
lines are summed over sliding windows. Where a sum surges over a threshold the
text begins, where it dives to next to nothing the text ends, and what stands
between is kept, short lines included. So are short lines between and behind
kept lines of the same container. Tags and class words weigh a line before the
sums are made: lines in main elements weigh more, and others less, the more of
the page's text main elements hold; lines that are mostly links weigh nothing;
lines of menus, adverts, comments and other surroundings weigh a thousandth, or a
hundredth where the name often stands for the whole page too, as a form does.
Blank lines part surroundings from what is around them. So windows decide about
surroundings as about all else: their sums have to surge over a share of the page's
fullest window (`SHARE`) and over `AROUND_SURGE` characters of that weight, which
they do only where the page has its text there and nowhere else. A line that weighs
under the dive doesn't begin or end a text.

Cases: null and empty html give the empty string and 0 characters. Unclosed
elements end with their page or with an enclosing element; a tag without an end
is text. Pages are read whole, in time that grows with their length, and are
independent of each other, so repeated rows give repeated rows. Where several
windows are equally full each is taken. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, slices, texts

# Elements of HTML by their part in a page.
UNSEEN = {"script", "style", "template", "noscript", "svg", "math", "head", "title", "iframe", "object", "canvas", "textarea", "select", "option"}
AROUND = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "search"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | AROUND
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN = {"article", "main"}
CONTAINERS = {"article", "main", "section", "div", "center", "details", "td", "html", "body"}
#: Words of class, id or role that name surroundings, and those of them that name whole pages too, or headlines within main elements.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "sidebar", "side", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "respond", "reply", "replies", "disqus", "contentinfo", "complementary", "search", "form", "hidden"}

WIDE = {"header", "masthead", "social", "side", "form", "search", "widget", "hidden", "login", "signup", "modal", "menu"}
#: Tags of surroundings that hold whole pages at times.
WIDE_TAGS = {"form", "header", "dialog"}
#: Weights of lines in surroundings, of those in wide ones, and of social and side parts of main elements.
AROUND_WEIGHT, WIDE_WEIGHT, INNER_WEIGHT = 0.001, 0.01, 0.05
#: Share of their weight that lines outside main elements lose where these hold all text.
LOWERED = 0.99
#: What a window of surroundings has to reach: of the fullest window, and in weighted characters.
SHARE, AROUND_SURGE = 1 / 8, 1.6

#: First parts of names that tell of a layout, as in no-sidebar or with-menu.
LAYOUT = {"no", "not", "without", "has", "with"}

_PART = re.compile(r"[_-]+")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noscript")}
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """A block of the page: text, characters inside links, if it stands in a main element, its weight by surroundings (1 outside), and its container."""

    text: str
    linked: int
    main: bool
    weight: float
    container: int


BLANK = Line("", 0, False, 1.0, -1)


def tag_weight(name: str, rest: str, main: bool) -> float:
    """What an element weighs by its tag and the words of its class, id and role: 1 unless it is of the surroundings."""
    if name in ("html", "body"):
        return 1.0
    named = [_PART.split(x) for g in _NAMED.findall(rest) for x in "".join(g).lower().split()] if "=" in rest else []
    words = {w for parts in named if parts[0] not in LAYOUT for w in parts} & NAMES
    if main:
        words -= {"header", "masthead"}
    tag = name in AROUND or (name == "header" and not main)
    if not tag and not words:
        return 1.0
    if (tag and name not in WIDE_TAGS) or words - WIDE:
        return AROUND_WEIGHT
    return INNER_WEIGHT if main and not tag and words <= {"social", "side"} else WIDE_WEIGHT


class Tags:
    """The markup of a page in order: (name, rest of the tag) with a slash before the name of an end, or ("", text)."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """Where the tag that is open at `at` ends, outside of quotes; once none has, quotes are like other characters."""
        while self.quotes:
            stop = _STOP.search(self.page, at)
            if stop and stop.group() == ">":
                return stop.start()
            at = self.page.find(stop.group(), stop.end()) + 1 if stop else 0
            if not at:
                self.quotes = False
        return -1

    def __iter__(self):
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            open_ = page.find("<", at)
            if open_ != at:
                yield "", page[at : open_ if open_ >= 0 else size]
                at = open_ if open_ >= 0 else size
                continue
            for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(begin, at):
                    to = page.find(end, at + len(begin))
                    at = to + len(end) if to >= 0 else size
                    break
            else:
                name = _NAME.match(page, at + 1)
                if not name and page[at + 1 : at + 2] not in ("!", "?"):
                    yield "", "<"
                    at += 1
                    continue
                to = self.end(name.end()) if name and self.quotes else -1
                to = to if to >= 0 else page.find(">", at)
                if to < 0:  # no tag ends from here on
                    yield "", page[at:]
                    return
                if name:
                    yield name.group().lower(), page[name.end() : to]
                at = to + 1
                if name and (raw := _RAW.get(name.group().lower())) and not page[name.end() : to].endswith("/"):
                    tail = raw.search(page, at)
                    at = tail.end() if tail else size


def page_lines(page: str, window: int) -> list[Line]:
    """The page's blocks in order; `window` blank lines stand around surroundings, so that no window spans their edge."""
    lines, text, linked = [], [], 0
    # open elements: name, unseen, weight before them if they are surroundings, container of their text and of what is in them
    stack: list[tuple[str, bool, float | None, int, int]] = []
    open_: Counter = Counter()
    unseen, weight, main, link, opened = 0, 1.0, 0, 0, 0

    def end_line():
        nonlocal linked
        if text:
            if line := _SPACE.sub(" ", html.unescape("".join(text))).strip():
                lines.append(Line(line, linked, main > 0, weight, stack[-1][3] if stack else 0))
            text.clear()
        linked = 0

    def close() -> bool:
        nonlocal unseen, weight, main, link
        name, hidden, before, *_ = stack.pop()
        open_[name] -= 1
        unseen -= hidden
        weight = weight if before is None else before
        main -= name in MAIN
        link -= name == "a"
        return before is not None

    for name, rest in Tags(page):
        if not name:
            if not unseen:
                text.append(rest)
                if link:
                    linked += len(rest)
            continue
        ends, name = name[0] == "/", name.lstrip("/")
        if name in BLOCKS:
            end_line()
        if ends:
            if open_[name]:
                left = False
                while stack[-1][0] != name:
                    left |= close()
                left |= close()
                if left:
                    lines.extend([BLANK] * window)
            continue
        if name in VOID or rest.endswith("/") or (name in _RAW and name in UNSEEN):
            continue
        hidden = name in UNSEEN
        own_weight = 1.0 if hidden else tag_weight(name, rest, main > 0)
        named = own_weight < 1
        if name == "p" and stack and stack[-1][0] == "p":
            close()
        if hidden or named:
            end_line()
        if named:
            lines.extend([BLANK] * window)
        opened += 1
        inner = stack[-1][4] if stack else 0
        own = inner if name in BLOCKS else (stack[-1][3] if stack else 0)
        open_[name] += 1
        stack.append((name, hidden, weight if named else None, own, opened if name in CONTAINERS and name not in ("html", "body") else inner))
        unseen += hidden
        weight *= own_weight
        main += name in MAIN
        link += name == "a"
    end_line()
    return lines


def line_sizes(lines: list[Line], link_share: float) -> tuple[list[int], list[float]]:
    """Of each line its length, 0 for links and surroundings, and its weighted length, which the windows sum."""
    linking = [x.linked > link_share * max(1, len(x.text)) for x in lines]
    plain = [0 if k or x.weight < 1 else len(x.text) for x, k in zip(lines, linking, strict=True)]
    share = sum(n for n, x in zip(plain, lines, strict=True) if x.main) / max(1, sum(plain))
    return plain, [0.0 if k else len(x.text) * (1 + 3 * share if x.main else 1 - LOWERED * share) * x.weight for x, k in zip(lines, linking, strict=True)]


def main_text(page: str, window: int = 3, surge: int = 80, dive: int = 10, link_share: float = 0.5) -> str:
    """Text between surge and dive points of the line-block distribution."""
    lines = page_lines(page, window)
    plain, size = line_sizes(lines, link_share)
    blocks = [sum(size[i : i + window]) for i in range(len(size))]
    most = max(blocks, default=0)
    surges = [min(surge, most) if x.weight == 1 else max(AROUND_SURGE, SHARE * most) for x in lines]
    dives = [min(dive, most) if x.weight == 1 else dive * WIDE_WEIGHT for x in lines]
    kept, i, n = set(), 0, len(size)
    while i < n:
        if size[i] and blocks[i] >= surges[i]:  # a surge
            run = []
            while i < n and blocks[i] >= dives[i]:  # until the dive
                if size[i]:
                    run.append(i)
                i += 1
            least = lambda k: size[k] >= dives[k] or (plain[k] and lines[k].main)
            while run and not least(run[0]):
                run.pop(0)
            while run and not least(run[-1]):
                run.pop()
            kept.update(run)
        else:
            i += 1
    seen = set()
    for i, line in enumerate(lines):  # short lines between and behind
        if i in kept:
            seen.add((line.container, line.weight))
        elif size[i] and (line.container, line.weight) in seen:
            kept.add(i)
    return "\n".join(lines[i].text for i in sorted(kept))


def _extract(batches, key: str, url: str, column: str, options: dict):
    for batch in slices(batches, column):
        found = [main_text(x, **options) for x in texts(batch, column)]
        yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [key, url, "text", "n_chars"])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html", **options) -> DataFrame:
    """One row per page: its key, url, main text and the text's code points."""
    return pages.select(key, url, column).mapInArrow(partial(_extract, key=key, url=url, column=column, options=options), f"{key} {id_type(pages, key)}, {url} {id_type(pages, url)}, text string, n_chars long")
