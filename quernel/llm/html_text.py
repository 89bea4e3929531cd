"""Main text of web pages by scoring the tree of their blocks.

A page is read once into a tree of its block elements.  Every paragraph has points
for its length and its commas, less the share of its characters that are links.  It
passes them to the element around it, which passes half of what it has been given on
to the next.  The element with the most points, its own share of links taken off, is
the container; it is kept, with those of its siblings that are prose as well.
Elements that name or mark themselves as menus, headers, footers, side bars,
notices, adverts, forms or comments count for nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm._shared import map_batches, unused

# Elements of HTML by what they do.
BLOCK = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAVE_P_OPEN = frozenset("button caption head legend tbody td tfoot th thead tr".split())
VOID = frozenset(["hr"])
#: Elements whose content is no text of the page; the first ones go on to the page's end if they are not closed.
RAW = "script style textarea title iframe noembed noframes xmp".split()
RAW_IF_CLOSED = "noscript template svg object video audio canvas select".split()
ITEMS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr", "table"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table")}
SCOPES = frozenset("caption table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dd dt blockquote figcaption address summary".split())
NOT_A_CONTAINER = frozenset("blockquote dl figure li ol p table tbody tfoot thead tr ul".split())
LISTS = frozenset("dl menu ol table ul".split())
LEFT_OUT = frozenset("aside button dialog footer head menu nav".split())
FORMS = frozenset("fieldset form".split())
# Words in roles, classes and ids.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
COMMENTS = frozenset("comment commentform commentlist comments disqus replies reply respond".split())
OTHERS = frozenset(
    "ad adbox ads adsense adslot adv advert advertisement advertising adverts alert banner banners breadcrumb breadcrumbs colophon consent cookie cookies copyright foot footer form gdpr header login "
    "masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion rail recommendations recommended "
    "register related search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar trending widget widgets".split()
)
BODY = frozenset("article body content entry main post story text".split())
ABOUT_OTHERS = frozenset("has is js no with without".split())
AFTERWARDS = re.compile(
    r"(?:\d+ )?(?:(?:reader |user )?comments?|responses?|leave a (?:comment|reply)|post a comment|join the (?:conversation|discussion)|related (?:articles|posts|stories)|you may also like"
    r"|kommentare?|leserkommentare|commentaires?|comentarios?)(?: ?\(\d+\)| ?: ?\d+)?:?", re.I,
)

COMMAS = re.compile(r"[,،、，]")
MAIN_BONUS, BODY_BONUS = 30.0, 10.0  # points of an element that says it is the article
SHARE = 0.2  # of the container's points that make a sibling part of the article

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_BETWEEN = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in [*RAW, *RAW_IF_CLOSED]}
_WANTED = frozenset(["class", "id", "role", "style", "hidden", "aria-hidden", "itemprop"])


def markup(s: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``(kind, text or tag, attributes)`` of a page in order; kinds are ``text``, ``start`` and ``end``.

    Comments, declarations and the content of scripts and the like are left out.  What
    is missing is looked for once, so that any page takes time in proportion to its length.
    """
    at, n, missing = 0, len(s), set()

    def past(mark: str, start: int) -> int:
        """The place after the next ``mark``, 0 if none comes."""
        found = -1 if mark in missing else s.find(mark, start)
        if found < 0:
            missing.add(mark)
            return 0
        return found + len(mark)

    while at < n:
        m = _MARKUP.search(s, at)
        if m is None or m.start() > at:
            yield "text", s[at : m.start() if m else n], {}
        if m is None:
            return
        at, lead = m.start(), m.group()
        if lead in ("<!--", "<!", "<?"):
            at = past("-->" if lead == "<!--" else ">", at + 2) or n
            continue
        name = _NAME.match(s, m.end() - 1)
        tag, attributes = name.group().lower(), {}
        at = name.end()
        while True:
            at = _BETWEEN.match(s, at).end()
            if at >= n or s[at] == ">":
                break
            key = _KEY.match(s, at)
            at, value = key.end(), ""
            equals = _EQUALS.match(s, at)
            if equals:
                at = equals.end()
                to = past(s[at], at + 1) if s[at : at + 1] in ('"', "'") else 0
                if to:
                    value, at = s[at + 1 : to - 1], to
                else:
                    bare = _BARE.match(s, at)
                    value, at = bare.group(), bare.end()
            if key.group().lower() in _WANTED:
                attributes.setdefault(key.group().lower(), html.unescape(value))
        at += 1  # a tag that never ends is the last of the page
        if lead[1] == "/":
            yield "end", tag, {}
        elif tag in _RAW_END:
            ends = None if tag in missing else _RAW_END[tag].search(s, at)
            if ends:
                at = past(">", ends.end()) or n
            else:
                missing.add(tag)
                at = n if tag in RAW else at
        else:
            yield "start", tag, attributes


def named_parts(attributes: dict[str, str]) -> list[frozenset]:
    """The parts of each word of the class and the id, lower-cased; words like ``has-sidebar`` speak of others."""
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    parts = [[p.lower() for p in _PARTS.findall(w)] for w in words]
    return [frozenset(p) for p in parts if p and p[0] not in ABOUT_OTHERS]


def own_standing(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[str, float]:
    """What an element says of itself: ``comments``, ``other``, ``form`` or nothing, and its bonus as an article."""
    named, role = named_parts(attributes), attributes.get("role", "").lower()
    if any(parts & COMMENTS for parts in named):
        return "comments", 0.0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "other", 0.0
    if tag in ("article", "main") or role in ("article", "main") or attributes.get("itemprop") == "articleBody":
        return "", MAIN_BONUS
    titled = [parts for parts in named if parts & OTHERS == {"header"} and parts & BODY]  # the header of an article has its title
    if tag in LEFT_OUT or role in ROLES or (tag == "header" and not in_main) or any(parts & OTHERS for parts in named if parts not in titled):
        return "other", 0.0
    return "form" if tag in FORMS else "", BODY_BONUS if any(parts & BODY for parts in named) else 0.0


class Page:
    """The block elements of a page and its blocks of text, both in page order.

    Of element ``k``: ``up[k]`` is the element around it, ``tag[k]`` its tag, ``out[k]``
    why it is not the article, ``bonus[k]`` what speaks for it and ``last[k]`` the last
    element inside it.  A block is ``(element, text, characters in links)``; white
    space inside is one space, and text between two ends of elements is one block.
    """

    def __init__(self, source: str):
        self.up, self.tag, self.out, self.bonus, self.last = [-1], ["body"], [""], [0.0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open, self._scopes = [0], {}, [0]
        self._main = self._link = 0  # open articles; depth at which the open link began
        self._text: list[str] = []
        self._linked: list[str] = []
        for kind, value, attributes in markup(source):
            if kind == "text":
                self._add(value)
            elif value == "br":
                self._add(" ")
            elif value == "a":
                self._link = len(self._stack) if kind == "start" else 0
            elif value == "body":
                self._leave_head()
            elif value in BLOCK:
                self._start(value, attributes) if kind == "start" else self._end(value)
        self._close(0)

    def _add(self, text: str) -> None:
        if self.tag[self._stack[-1]] == "head" and not text.isspace():
            self._leave_head()
        self._text.append(text)
        if self._link:
            self._linked.append(text)

    def _leave_head(self) -> None:
        if self.tag[self._stack[-1]] == "head":
            self._close(len(self._stack) - 1)

    def _flush(self) -> None:
        if self._text:
            text, linked = (" ".join(html.unescape("".join(parts)).split()) for parts in (self._text, self._linked))
            if text:
                self.blocks.append((self._stack[-1], text, len(linked)))
            self._text, self._linked = [], []

    def _close(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        self._flush()
        while len(self._stack) > depth:
            k = self._stack.pop()
            self.last[k] = len(self.up) - 1
            if self._open.get(self.tag[k]):
                self._open[self.tag[k]].pop()
            self._main -= self.bonus[k] == MAIN_BONUS
            if self._scopes[-1] == len(self._stack):
                self._scopes.pop()
        if self._link > len(self._stack):
            self._link = 0

    def _innermost(self, tags: str) -> int:
        return max((self._open[t][-1] for t in tags.split() if self._open.get(t)), default=-1)

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        self._leave_head()
        top = self.tag[self._stack[-1]]
        if top == "p" and tag not in LEAVE_P_OPEN or top in HEADINGS and tag in HEADINGS:
            self._close(len(self._stack) - 1)
        if tag in ITEMS:  # an item ends the one before it, not one around its list
            same, around = map(self._innermost, ITEMS[tag])
            if same > around:
                self._close(same)
        self._flush()
        if tag in VOID:
            return
        outer = self.out[self._stack[-1]]
        why, bonus = ("", 0.0) if outer in ("comments", "other") else own_standing(tag, attributes, self._main > 0)
        self.up.append(self._stack[-1])
        self.tag.append(tag)
        self.out.append(why or outer)
        self.bonus.append(bonus)
        self.last.append(0)
        self._main += bonus == MAIN_BONUS
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in SCOPES:
            self._scopes.append(len(self._stack))
        self._stack.append(len(self.up) - 1)

    def _end(self, tag: str) -> None:
        depth = self._innermost(tag)
        if depth > 0 and depth >= self._scopes[-1]:
            self._close(depth)
        else:
            self._flush()


def points(text: str, linked: int) -> float:
    return (1 + len(COMMAS.findall(text)) + len(text) / 100) * (1 - linked / max(1, len(text)))


def _settle(page: Page) -> None:
    """Takes forms that hold most of a page for what they are, and what follows a heading of comments for comments."""
    shares = {True: 0.0, False: 0.0}
    prose = 0
    for k, text, linked in page.blocks:
        if page.out[k] in ("", "form") and page.tag[k] not in HEADINGS:
            shares[page.out[k] == "form"] += points(text, linked)
            prose += len(text) * (page.out[k] == "form" and page.tag[k] == "p")
    if shares[True] > shares[False] and prose > (250 if shares[False] else 0):
        page.out = ["" if why == "form" else why for why in page.out]
    kept, first, upto = [], 0, -1  # elements from ``first`` to ``upto`` hold what follows such a heading
    for k, text, linked in page.blocks:
        if not first <= k <= upto:
            first, upto = 0, -1
            if page.tag[k] in HEADINGS and AFTERWARDS.fullmatch(text):
                first, upto = page.up[k], page.last[page.up[k]]
            else:
                kept.append((k, text, linked))
    page.blocks = kept


def main_blocks(page: Page) -> list[str]:
    """The blocks of the container and of its siblings that are prose."""
    _settle(page)
    n = len(page.up)
    given, size, linked, pieces, title = [0.0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k, text, links in page.blocks:
        if not page.out[k]:
            size[k] += len(text)
            linked[k] += links
            pieces[k] += 1
            if page.tag[k] in HEADINGS:
                title[k] = page.tag[k] in ("h1", "h2")
            else:
                given[page.up[k] if page.tag[k] in PARAGRAPHS else k] += points(text, links)
    for k in range(n - 1, 0, -1):  # elements come after those around them
        up = page.up[k]
        given[up] += given[k] / 2
        size[up] += size[k]
        linked[up] += linked[k]
        pieces[up] += pieces[k]
        title[up] = title[up] or title[k]
    share = [links / max(1, chars) for links, chars in zip(linked, size)]
    worth = [0.0 if why or not g else g * (1 - s) + b for g, s, b, why in zip(given, share, page.bonus, page.out)]
    best = max(range(n), key=worth.__getitem__)
    if not worth[best]:
        return [text for k, text, _ in page.blocks if not page.out[k]]
    most, k = worth[best], best
    while k > 0 and page.bonus[k] < MAIN_BONUS:
        k = page.up[k]
    marked = k > 0
    if marked:
        best = k
    while best > 0 and page.tag[best] in NOT_A_CONTAINER:
        best = page.up[best]

    def belongs(k: int) -> bool:
        """Whether a sibling of the container is part of the article."""
        if page.out[k] or not size[k]:
            return False
        if page.tag[k] in HEADINGS:
            return page.tag[k] == "h1" or not marked
        if marked and page.bonus[k] < MAIN_BONUS:
            return False
        if share[k] > 1 / 3:
            return False
        return worth[k] >= SHARE * most or (not marked and (page.tag[k] in PARAGRAPHS or page.tag[k] in NOT_A_CONTAINER or title[k]))

    around = page.up[best]
    keeps = bytearray(n)
    for k in range(n):
        up = page.up[k]
        if k == best or (up >= 0 and keeps[up]) or (best > 0 and up == around and belongs(k)):
            menu = k != best and page.tag[k] in LISTS and pieces[k] >= 3 and share[k] > 0.9
            keeps[k] = not page.out[k] and not menu
    return [text for k, text, _ in page.blocks if keeps[k]]


def main_text(source: str | None) -> str:
    return "\n".join(main_blocks(Page(source or "")))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``column``, and ``n_chars``, its code points.

    Character references are decoded, white space inside a block is one space, and
    blocks are joined by line feeds in page order.  A page is read whole in the task
    that has it: no shuffle, and memory for one page at a time besides the slice.

    * A null or empty page, or one without text outside menus and the like, has an empty text.
    * Repeated rows give a row each; pages of any length and depth are read whole.
    * Other columns stay; added names that clash are put behind underscores.  An
      empty table gives no rows.
    """
    pages = pages.withColumn(column, F.col(column).cast("string"))
    text, n_chars = unused(pages, "text", "n_chars")
    kept = pages.columns

    def work(c: dict[str, list]) -> dict[str, list]:
        found = [main_text(s) for s in c[column]]
        return {name: c[name] for name in kept} | {text: found, n_chars: [len(t) for t in found]}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{text}` string", f"`{n_chars}` long"])
    return map_batches(pages, work, schema, rows=64)
