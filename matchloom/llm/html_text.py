"""Main text of HTML pages by line-block distribution.

Markup is stripped first: comments, scripts, styles, forms and other elements that never
hold running text go with their contents, block-level tags become line ends, and the rest
of the tags vanish. What is left is a list of lines. The length of text in a sliding
window of lines is the page's distribution: the main text begins where the sum surges and
ends where it dives to nothing, and the lines between are kept. All regions are kept, not the
greatest alone.

Elements that name their role are used as hard borders: navigation, headers of the page,
footers, asides, and blocks whose class or id marks adverts, menus, notices, sidebars or
reader comments count as no text (within an article, and for ids of sections anywhere, only whole
classes and ids of a narrower list do, and ids of headings never). What is dropped for its class, or for being a form, is only set
aside: it comes back where it holds an article, or on pages without one most of the page's text, as wrappers of whole pages do; reader
comments come back only where they hold the page's main element or title. An ``article`` marked as a comment, or within comments, is one. ``article`` and ``main``
elements weigh on the distribution: their lines count as surges each, so nothing within
them is lost, and where they hold a third of the page's text the other lines count nothing. On other pages
everything from the first surge to the last dive is kept, and with it the short
lines next to these ends, up to an element that was dropped for its role or a line of links
alone, and what follows a heading before the first surge.

A page is read once, from left to right, in time that grows with its length whatever it holds.
The start of a block ends a paragraph, and that of a list item, cell or row the one before it, as in browsers. A tag that
never ends is dropped with what follows it, as there is no other markup to come.

Character references are decoded, runs of white space become one blank, and blocks are
joined in page order by one blank.

Defined cases: null, empty or text-free html gives an empty text; unclosed elements end
with their parent; repeated rows are extracted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Elements of the HTML standard by what they do to text.
DROPPED = {"script", "style", "noscript", "template", "form", "select", "button", "textarea", "svg", "math", "canvas", "iframe", "object", "head", "title", "nav", "footer", "aside", "dialog", "menu", "audio", "video", "map", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end the text next to them when they are dropped; others may stand within it.
BORDERS = {"nav", "header", "footer", "aside", "dialog", "menu", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in a class, id or role that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|widget\w*|related|share|sharing|social|comments?|commentlist|replies|disqus|respond|footer\w*|masthead|subscribe|newsletter|signup|login|pagination|pager|navigation|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
#: Elements that the start of another one ends, as the HTML standard has it.
ENDS_P = BLOCKS - {"br", "caption", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"form", "nav", "footer", "aside", "menu", "dialog"}
ENDED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "a": ("a",)}
LISTS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select", "datalist"), "a": ()}
#: Elements that end tags of other elements don't reach out of.
SCOPES = {"article", "main", "body", "td", "th"}
#: Elements whose own end tags do.
THROUGH = {"html", "body", "main", "article", "table", "tbody", "thead", "tfoot", "tr", "td", "th"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag up to its end, which may not stand in quotes; nothing is tried twice.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Whole classes and ids that mark the same within an article, where ids are often slugs of headings.
INNER_MARKS = re.compile(
    r"(?:(?:ads?|adverts?|cookies?|newsletter|comments?|sponsor(?:ed)?|promo|site|share|social)-(?:slot|bar|box|area|unit|banner|notice|wrapper|section|container|list|form|widget)|ads?|adverts?|advertisements?|advertising|sponsored|promo|comments?|comment-?list|replies|respond|disqus(?:_thread)?|share|sharing|share-(?:bar|buttons?|links)|social-(?:bar|buttons?|links|share)|related-(?:articles|links|posts|stories)|newsletter(?:-signup)?|subscribe|signup|sidebar|breadcrumbs?|pagination|pager|nav|navbar|navigation|cookie-(?:banner|consent|notice)|popup)",
    re.I,
)
#: Words in a class or id that mark reader comments.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|disqus|respond)(?:$|[\s_-])", re.I)
ROLES = re.compile(r"navigation|complementary|contentinfo|banner", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Parts of a class that tell what an element is with or without, not what it is.
MODIFIER = re.compile(r"(?:has|have|with|without|no|is|show|hide)-\S+", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def roles_of(name: str, rest: str, within: bool) -> tuple[bool, bool, bool]:
    """Whether the attributes of a tag mark it as no text of the article, whether as comments, and whether they hide it; ``within``: it stands in an article."""
    marked = hidden = talk = False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and UNSHOWN.search(value):
            hidden = True
        elif key in ("class", "id", "role") and not (key == "id" and name in HEADINGS):  # such an id is an anchor
            talk = talk or bool(COMMENTS.search(MODIFIER.sub("", value)))
            if within or key == "id" and name == "section":
                marked = marked or any((ROLES if key == "role" else INNER_MARKS).fullmatch(x) for x in value.split())
            else:
                marked = marked or bool(MARKS.search(MODIFIER.sub("", value)))
    return marked, talk, hidden


class Aside:
    """An element set aside, within ``parent``: what tells whether it comes back."""

    def __init__(self, parent: int, talk: bool) -> None:
        self.parent, self.talk = parent, talk
        self.chars = 0
        self.article = self.whole = False  # whether it holds an article, and the page's main element or title


class Place(NamedTuple):
    """How a line stands: in a heading, in links alone, after a border."""

    heading: bool
    linked: bool
    bordered: bool


class Open(NamedTuple):
    """An open element, and whether it drops its text."""

    name: str
    drops: bool
    aside: bool = False
    article: bool = False


class Scanner:
    """One pass over a page to its text lines; every tag takes constant time, spread over the page.

    Open elements are on a stack. What is asked of them (is one of this name open, does one
    drop text, is one an article) is counted, so that no question walks the stack.
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inside: list[bool] = []
        self.places: list[Place] = []
        self.asides: list[Aside] = []
        self.aside_of: list[int] = []  # by line, the innermost element set aside, or -1
        self.begun_before: list[list[int]] = []  # by line, those begun since the line before
        self.begun: list[int] = []
        self.open_asides: list[int] = []
        self.held: list[str] = []
        self.loose = self.border = False  # whether text outside links is held, and whether a border came before it
        self.stack: list[Open] = []
        self.count: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # of elements since the last of SCOPES was opened
        self.within: dict[str, list[int]] = {k: [0] for k in LISTS}  # of elements by name since their list was opened
        self.drops = self.articles = self.headings = 0

    def hold(self, text: str) -> None:
        if not self.drops and text:
            self.held.append(text)
            self.loose = self.loose or not self.count["a"] and bool(text.strip())

    def flush(self) -> None:
        if self.held:
            text = SPACE.sub(" ", references.unescape("".join(self.held))).strip()
            self.held.clear()
            if text:
                self.lines.append(text)
                self.inside.append(self.articles > 0)
                self.places.append(Place(self.headings > 0, not self.loose, self.border))
                self.aside_of.append(self.open_asides[-1] if self.open_asides else -1)
                self.begun_before.append(self.begun)
                self.border, self.begun = False, []
        self.loose = False

    def push(self, name: str, drops: bool, aside: bool = False, talk: bool = False) -> None:
        article = name in ("article", "main") and not (aside and talk)
        self.stack.append(Open(name, drops, aside, article))
        if not self.drops and self.open_asides and (article or name == "h1"):
            held = self.asides[self.open_asides[-1]]
            held.article, held.whole = held.article or article, held.whole or name in ("main", "h1")
        if aside:
            self.asides.append(Aside(self.open_asides[-1] if self.open_asides else -1, talk))
            self.open_asides.append(len(self.asides) - 1)
            self.begun.append(len(self.asides) - 1)
        self.count[name] += 1
        self.scopes[-1][name] += 1
        if name in SCOPES:
            self.scopes.append(Counter())
        for inner, lists in LISTS.items():
            if name in lists:
                self.within[inner].append(0)
        if name in self.within:
            self.within[name][-1] += 1
        self.drops += drops
        self.articles += article
        self.headings += name in HEADINGS

    def pop(self) -> str:
        name, drops, aside, article = self.stack[-1]
        if name in BLOCKS or drops or aside:
            self.flush()
        self.stack.pop()
        if aside:
            self.open_asides.pop()
        if name in SCOPES:
            self.scopes.pop()
        self.count[name] -= 1
        self.scopes[-1][name] -= 1
        if name in self.within:
            self.within[name][-1] -= 1
        for inner, lists in LISTS.items():
            if name in lists:
                self.within[inner].pop()
        self.drops -= drops
        self.articles -= article
        self.headings -= name in HEADINGS
        return name

    def close(self, name: str) -> None:
        """End the last element of the name and all in it, if it can be reached."""
        if (self.count if name in THROUGH else self.scopes[-1])[name] > 0:
            while self.pop() != name:
                pass

    def started(self, name: str, rest: str) -> None:
        if name in ENDS_P:
            self.close("p")
        for ended in ENDED_BY.get(name, ()):
            if self.within[ended][-1] > 0:
                self.close(ended)
        quiet = self.drops > 0
        drops, marked, talk, hidden = name in DROPPED and name != "form", False, False, False
        if not quiet and not drops and rest:
            marked, talk, hidden = roles_of(name, rest, self.articles > 0)
        if name == "header" and not self.articles:  # of the page, not of the article
            drops = True
        drops = (drops or hidden and name not in ("article", "main")) and name not in ("body", "html")
        if name in ("article", "main"):
            marked = marked and talk and name == "article"
        aside = not quiet and not drops and (marked or name == "form") and name not in ("body", "html")
        if name in BLOCKS or drops or aside:
            self.flush()
        self.border = self.border or not quiet and drops and (marked or name in BORDERS)
        if name not in VOID and name not in RAW and not rest.endswith("/"):
            self.push(name, drops, aside, talk)

    def ended(self, name: str) -> None:
        if name == "br" or name == "p" and not self.scopes[-1]["p"]:
            self.flush()
        else:
            self.close(name)

    def read(self, page: str) -> None:
        at, last, quoted = 0, page.rfind(">"), True
        while True:
            tag = page.find("<", at)
            if tag < 0:
                break
            self.hold(page[at:tag])
            following = page[tag + 1 : tag + 2]
            if following in ("!", "?"):
                at = self.declared(page, tag)
                continue
            end_tag = following == "/"
            name = NAME.match(page, tag + 1 + end_tag)
            if not name:
                self.hold("<")
                at = tag + 1
                continue
            if name.end() > last:
                return self.flush()  # a tag without an end
            rest = REST.match(page, name.end()) if quoted else None
            if rest:
                at, attributes = rest.end(), rest[1]
            else:  # from here on quotes may not be paired, so tags end at the next sign for it
                quoted, end = False, page.find(">", name.end())
                at, attributes = end + 1, page[name.end() : end]
            tag_name = name[0].lower()
            if end_tag:
                self.ended(tag_name)
                continue
            self.started(tag_name, attributes)
            if tag_name in RAW and not attributes.endswith("/"):
                end = RAW_END[tag_name].search(page, at)
                at = end.end() if end else len(page)
        self.hold(page[at:])
        self.flush()

    def declared(self, page: str, tag: int) -> int:
        """Pass over a comment, a declaration or an instruction; text in a CDATA section stays."""
        if page.startswith("<!--", tag):
            start, mark = tag + 4, "-->"
        elif page.startswith("<![CDATA[", tag):
            start, mark = tag + 9, "]]>"
        else:
            start, mark = tag + 1, ">"
        end = page.find(mark, start)
        if mark == "]]>":
            self.hold(page[start : end if end >= 0 else len(page)].replace("&", "&amp;"))
        return end + len(mark) if end >= 0 else len(page)


#: Share of a page's text, and characters, beyond which an element is a wrapper of the page, whatever its class says; a notice may hold most of a page of a few words.
WRAPPED_SHARE, WRAPPED_CHARS = 1 / 2, 120


def lines_of(page: str) -> tuple[list[str], list[bool], list[Place]]:
    """The text lines of a page, whether each lies in an ``article`` or ``main`` element, and how it stands."""
    scanner = Scanner()
    scanner.read(page)
    asides = scanner.asides
    for line, g in zip(scanner.lines, scanner.aside_of, strict=True):
        if g >= 0:
            asides[g].chars += len(line)
    for x in reversed(asides):  # from the inner ones outwards; comments count for nothing around them
        if x.parent >= 0 and not x.talk:
            outer = asides[x.parent]
            outer.chars, outer.article, outer.whole = outer.chars + x.chars, outer.article or x.article, outer.whole or x.whole
    # Where an article tells what the text is, size tells nothing.
    named = any(x.article for x in asides) or any(own and g < 0 for own, g in zip(scanner.inside, scanner.aside_of, strict=True))
    least, stays = WRAPPED_SHARE * sum(map(len, scanner.lines)), []
    for x in asides:
        wraps = x.article or not named and x.chars > max(least, WRAPPED_CHARS)
        stays.append((x.whole if x.talk else wraps) and (x.parent < 0 or stays[x.parent]))
    lines, inside, places, bordered = [], [], [], False
    for line, own, place, g, begun in zip(scanner.lines, scanner.inside, scanner.places, scanner.aside_of, scanner.begun_before, strict=True):
        bordered = bordered or place.bordered or not all(stays[k] for k in begun)
        if g < 0 or stays[g]:
            lines.append(line)
            inside.append(own)
            places.append(place._replace(bordered=bordered))
            bordered = False
    return lines, inside, places


#: Share of a page's text that its article elements hold, from which on they bound the search.
ARTICLE_SHARE = 1 / 3


def surges(weights: list[int], *, window: int = 3, surge_chars: int = 120, quiet_chars: int = 30) -> list[tuple[int, int]]:
    """The regions of text, each from its surge point to one past its dive point.

    ``weights``: characters by line. A region opens at a line of at least ``quiet_chars``
    where the sum over the next ``window`` lines reaches ``surge_chars``, and closes where
    that sum falls under ``quiet_chars``.
    """
    upto = [0, *accumulate(weights)]
    sums = [upto[min(i + window, len(weights))] - upto[i] for i in range(len(weights))]
    found, k = [], 0
    while k < len(weights):
        end = k
        if sums[k] >= surge_chars and weights[k] >= quiet_chars:
            while end < len(weights) and sums[end] >= quiet_chars:
                end += 1
            while weights[end - 1] < quiet_chars:
                end -= 1
            found.append((k, end))
        k = max(end, k + 1)
    return found


def widened(start: int, end: int, places: list[Place]) -> tuple[int, int]:
    """The region from ``start`` to ``end`` with the lines next to it and those from the first heading before it on."""
    start = next((i for i in range(start) if places[i].heading and not places[i].linked), start)
    while start and not places[start].bordered and not places[start - 1].linked:
        start -= 1
    while end < len(places) and not places[end].bordered and not places[end].linked:
        end += 1
    return start, end


def main_text(page: str | None, *, window: int = 3, surge_chars: int = 120, quiet_chars: int = 30) -> str:
    """The text between the surge and dive points.

    A line of an article element has the weight of a surge at least. Where the articles of a page
    hold a share of ``ARTICLE_SHARE`` of its text or more, other lines weigh nothing there, and
    every region is kept without the lines that weigh nothing. On other pages all from the
    first region to the last is kept, with what ``widened`` adds, or all lines where the text
    never surges.
    """
    lines, inside, places = lines_of(page or "")
    own = sum(len(x) for x, i in zip(lines, inside, strict=True) if i)
    marked = own > 0 and own >= ARTICLE_SHARE * sum(map(len, lines))
    weights = [max(len(x), surge_chars) if i else 0 if marked else len(x) for x, i in zip(lines, inside, strict=True)]
    regions = surges(weights, window=window, surge_chars=surge_chars, quiet_chars=quiet_chars)
    if not marked:
        regions = [widened(regions[0][0], regions[-1][1], places)] if regions else [(0, len(lines))]
    return " ".join(lines[i] for a, b in regions for i in range(a, b) if weights[i])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits: int) -> DataFrame:
    """Return ``(id, url, text)`` for every row of ``pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": [main_text(x, **limits) for x in batch["html"]]})

    kind = pages.schema[id_col].dataType.simpleString()
    rows = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(run, f"id {kind}, url string, text string")
