"""Main text of web pages by tree scoring.

The page becomes a small tree. Menus, adverts, forms, comments and the like are cut by tag, role,
class and id. Every paragraph then passes points for its length and commas to its ancestors, each
ancestor's sum is discounted by its link density, and the best container is kept together with
siblings that score well. The blocks of what is kept are joined in page order.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
_CUT_TAGS = frozenset(
    "script style noscript template svg math nav footer aside form button input select textarea iframe "
    "dialog menu object canvas head title audio video map fieldset".split())
_CUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert menu menubar "
                       "alertdialog form toolbar".split())
#: Words in class or id that mark menus, notices, adverts, comments and other surroundings.
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices alert sidebar sidenav rail comment comments "
    "disqus discussion replies reply respond menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer footnav masthead topbar toolbar share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets search "
    "form hidden skip copyright legal disclaimer outbrain taboola".split())
#: Cut as well, but not inside an article, where they hold its title.
_HEADER = "header"
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARAGRAPHS = frozenset("p pre td th blockquote li dd dt figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left ends an open element on the right, unless a tag of the third set lies between.
_ENDS = {"li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))),
         "dd": (("dt", "dd"), frozenset(("dl",))), "tr": (("tr", "td", "th"), frozenset(("table",))),
         "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
         "option": (("option",), frozenset(("select",)))}
_P_SCOPE = frozenset("table td th caption button object template html".split())
#: Points reach so many ancestors: in full, half, then a third of the distance.
LEVELS = 6
#: Points that a container starts with.
_BONUS = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0}
_OPEN_TAG_AT_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z")


class _Node:
    __slots__ = ("tag", "parent", "parts", "cut", "chars", "linked", "commas", "links", "score", "main")

    def __init__(self, tag: str, parent: "_Node | None", cut: bool, main: str):
        self.tag, self.parent, self.cut, self.main = tag, parent, cut, main
        self.parts: list = []
        self.chars = self.linked = self.commas = self.links = 0
        self.score = 0.0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _is_cut(tag: str, attrs: dict[str, str | None], in_main: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in _CUT_TAGS or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if tag == _HEADER and not in_main:
        return True
    if (attrs.get("role") or "").strip().lower() in _CUT_ROLES or _CUT_STYLE.search(attrs.get("style") or ""):
        return True
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    if names == " " or tag in _HEADINGS or tag == "main":
        return False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        marks = sum(w in _CUT_WORDS for w in words)
        # inside an article a mark is half of a name at least: a discussion-of-results stays
        if marks * 2 >= len(words) > 0 or (not in_main and (marks or _HEADER in words)):
            return True
    return False


class _Tree(HTMLParser):
    """Builds the tree; tags that HTML lets authors leave out are closed where HTML closes them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None, False, "")
        self.nodes, self.stack, self.open = [self.root], [self.root], {"html": 1}

    def _pop_to(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _close(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        at = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in scope:
                break
            if tag in tags:
                at = i
        if at is not None:
            self._pop_to(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag not in _INLINE:
            self._close(("p",), _P_SCOPE)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        parent, named = self.stack[-1], dict(attrs)
        role = (named.get("role") or "").strip().lower()
        main = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
        node = _Node(tag, parent, parent.cut or _is_cut(tag, named, bool(parent.main)), main or parent.main)
        parent.parts.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if tag in _INLINE and self.stack[i].tag not in _INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].cut:
            self.stack[-1].parts.append(data)


def _score(nodes: list[_Node]) -> None:
    """Sizes from the leaves up, then points from every paragraph to its ancestors."""
    for node in reversed(nodes):
        if node.cut:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
                node.commas += part.count(",")
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.parent is not None:
            up = node.parent
            up.chars, up.linked = up.chars + node.chars, up.linked + node.linked
            up.commas, up.links = up.commas + node.commas, up.links + node.links
    for node in nodes:
        if node.cut or not node.chars:
            continue
        own = any(isinstance(p, str) and p.strip() for p in node.parts)
        if node.tag not in _PARAGRAPHS and not (own and node.tag not in _INLINE and node.tag not in _HEADINGS):
            continue
        points = 1.0 + node.commas + min(node.chars / 100, 3.0)
        # text directly inside a container makes the container its own parent
        up, level = node.parent if node.tag in _PARAGRAPHS else node, 0
        while up is not None and level < LEVELS:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for node in nodes:
        if node.score:
            node.score = (node.score + _BONUS.get(node.tag, 0.0)) * (1 - node.density())


def _link_list(node: _Node) -> bool:
    return (node.tag not in _INLINE and node.tag not in _HEADINGS and node.tag != "p"
            and node.links >= 3 and node.density() > 0.5)


def _kept(nodes: list[_Node]) -> list[_Node]:
    """The best container and the siblings kept with it, in page order."""
    root = nodes[0]
    scored = [n for n in nodes if n.score > 0 and not n.cut]
    if not scored:
        return [root]
    best = max(scored, key=lambda n: n.score)
    for wanted in ("article", "main"):
        up = best
        while up is not None and up.tag != wanted and not (up.main == wanted and up.parent and up.parent.main != wanted):
            up = up.parent
        if up is not None:
            best = up
            break
    if best.parent is None:
        return [best]
    floor = max(10.0, 0.2 * best.score)
    kept = []
    for part in best.parent.parts:
        if part is best:
            kept.append(part)
        elif isinstance(part, _Node) and not part.cut and part.chars:
            plain = not best.main and part.density() < 0.25 and (part.tag == "p" or part.tag in _HEADINGS)
            if plain or (part.score >= floor and (not best.main or part.tag == best.tag)):
                kept.append(part)
    return kept


def _blocks(top: _Node) -> list[str]:
    """Texts of the blocks below ``top``; white space inside a block becomes one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = [(top, False)]
    while todo:
        item, leaving = todo.pop()
        if isinstance(item, str):
            line.append(item)
        elif leaving:
            flush()
        elif item.tag == "br":
            line.append(" ")
        elif not item.cut and not (item is not top and not item.main and _link_list(item)):
            if item.tag not in _INLINE:
                flush()
                todo.append((item, True))
            todo.extend((part, False) for part in reversed(item.parts))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by two line feeds; empty for null, empty or textless pages."""
    if not html:
        return ""
    end = _OPEN_TAG_AT_END.search(html, html.rfind(">") + 1)
    tree = _Tree()
    tree.feed(html[:end.start()] if end else html)
    tree.close()
    _score(tree.nodes)
    return "\n\n".join(block for top in _kept(tree.nodes) for block in _blocks(top))


def extracted(html: str = "html") -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page if isinstance(page, str) else None))

    return extract(F.col(html).cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row. Null html gives empty text; repeated rows stay.

    An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    return (pages.select("page_id", "url", extracted().alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
