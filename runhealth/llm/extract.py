"""HTML extraction: deduce each host's template from tokens that occur alike, and read the main slot's text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import kept, map_rows
from runhealth.llm.url_filter import host_and_path

# Comments, raw-text elements, declarations, tags; an attribute value may hold ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|math|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?"
    r"(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WHITE = re.compile(r"\s+")
# Fixed values of HTML: elements without content, elements that do not break a line of text,
# and elements that an opening tag of the same kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span "
    "strike strong sub sup time tt u var wbr".split())
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select article section div body nav aside header footer form main td".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
# Elements that never hold an article's text, and words in class, id or role that mark such elements.
ASIDE_TAGS = frozenset("head nav header footer aside form button select menu dialog title object canvas audio video".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb "
    "breadcrumbs header footer masthead sidebar aside widget related share social cookie cookies consent notice alert "
    "popup modal newsletter subscribe signup login search comment comments disqus respond reply replies pagination pager "
    "toolbar skip copyright complementary contentinfo form".split())
MODIFIERS = frozenset("has with without no not hide show".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story articlebody".split())
SUPPORT = 0.5
MAX_DEPTH = 100
# Up to this many hosts, about 20 MB, the templates are sent to the tasks; more are joined by shuffle.
BROADCAST_HOSTS = 1 << 17


def marks(attributes: str) -> list[str]:
    """Lower-case words in class, id and role. What follows a modifier in a name, as in ``has-sidebar``, says what stands
    beside or inside an element and not what it is."""
    if "=" not in attributes:
        return []
    found: list[str] = []
    for values in NAMED.findall(attributes):
        for name in "".join(values).split():
            parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            found += takewhile(lambda w: w not in MODIFIERS, parts)
    return found


class Page:
    """One pass over a page: tokens (places of elements by their path) and text with the path it stands in.

    A place is the path of names from the root, ``tag`` or ``tag.mark.mark``; inline elements are no
    places. ``texts`` has (place, text, block), where block numbers grow at every break.
    """

    def __init__(self, source: str):
        self.opened: Counter[str] = Counter()
        self.texts: list[tuple[str, str, int]] = []
        stack: list[tuple[str, str]] = []
        block, at = 0, 0
        here = ""
        for m in MARKUP.finditer(source):
            if m.start() > at:
                self.texts.append((here, source[at:m.start()], block))
            at = m.end()
            end, tag, attributes = m.group(2, 3, 4) if m[3] else m.group(5, 6, 7)
            if tag is None:
                continue
            tag = tag.lower()
            if tag in VOID or tag in INLINE and not end and attributes.endswith("/"):
                block += tag in ("br", "hr")
                continue
            if tag in INLINE:
                if tag in ("span", "a"):  # inline notices and adverts are places, other inline elements are not
                    if not end and any(w in ASIDE_WORDS for w in marks(attributes)):
                        stack.append((tag, f"{here}/{tag}.{'.'.join(marks(attributes))}"))
                        here = stack[-1][1]
                    elif end and stack and stack[-1][0] == tag:
                        stack.pop()
                        here = stack[-1][1] if stack else ""
                continue
            block += 1
            if end:
                if any(tag == t for t, _ in stack):
                    while stack and stack.pop()[0] != tag:
                        pass
                    here = stack[-1][1] if stack else ""
                continue
            if tag in CLOSES_P:
                self._close(stack, {"p"}, SCOPES)
            if tag in SIBLINGS:
                self._close(stack, SIBLINGS[tag], SCOPES - {tag} if tag != "td" else SCOPES - {"td"})
            here = stack[-1][1] if stack else ""
            name = ".".join([tag, *marks(attributes)]) if tag not in ("html", "body") else tag
            if len(stack) < MAX_DEPTH:  # deeper elements count as part of the one they stand in
                here = f"{here}/{name}"
                self.opened[here] += 1
            stack.append((tag, here))
        if at < len(source):
            self.texts.append((here, source[at:], block))

    @staticmethod
    def _close(stack: list[tuple[str, str]], tags: set[str], scopes: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                del stack[depth:]
                return
            if stack[depth][0] in scopes:
                return


def aside(name: str) -> bool:
    """Whether an element, as named in a path, is no part of an article."""
    tag, *words = name.split(".")
    return tag in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(words)


def main_like(name: str) -> bool:
    tag, *words = name.split(".")
    return not aside(name) and (tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words))


def names(place: str) -> list[str]:
    return place.split("/")[1:]


def set_aside(place: str, main: str = "") -> bool:
    """Whether any element on the way down from ``main`` to ``place`` is set aside."""
    return any(aside(name) for name in names(place[len(main):]))


def by_tag(place: str, main: str = "") -> bool:
    """Whether an element on the way down is set aside by its tag, whatever it is called."""
    return any(name.split(".")[0] in ASIDE_TAGS for name in names(place[len(main):]))


def tagged_main(place: str) -> bool:
    """Whether an element is an article or main element that no tag above it sets aside."""
    return names(place)[-1].split(".")[0] in MAIN_TAGS and not by_tag(place)


def inside(place: str, region: str) -> bool:
    return place == region or place.startswith(region + "/")


def deduce(tokens: list[tuple[str, int, int, int]], n_pages: int) -> str | None:
    """The place of a host's main slot, from tokens (place, vector, pages, characters).

    Tokens with equal occurrence vectors form a class. A class is valid if it is on at least
    ``SUPPORT`` of the host's pages. Valid classes nest: a class stands in the slot of another if its
    places lie inside that one's. Slots of elements set aside are no candidates. From the root, the
    deduction goes down into the slot that is named as the main one, else into the one with most
    of the text below, and stops where text is spread over elements that repeat or stand alone.
    """
    classes: dict[int, list[str]] = {}
    own: dict[str, int] = {}
    frequent = [t for t in tokens if t[2] >= SUPPORT * n_pages]
    hidden: Counter[str] = Counter()  # text below article and main elements that stand in an element named as no part of one
    for place, _, _, chars in frequent:
        parts = names(place)
        for depth in range(1, len(parts) + 1):
            hidden["".join("/" + p for p in parts[:depth])] += chars
    for place, vector, pages, chars in frequent:
        if not set_aside(place):
            classes.setdefault(vector, []).append(place)
            own[place] = chars
    below: Counter[str] = Counter()
    children: dict[str, set[str]] = {}
    for place, chars in own.items():
        parts = names(place)
        for depth in range(len(parts) + 1):
            below["".join("/" + p for p in parts[:depth])] += chars
        above = "".join("/" + p for p in parts[:-1])
        children.setdefault(above, set()).add(place)
    # Only tokens that occur like their parent class, once wherever it does, open slots of a template.
    vector_of = {place: vector for vector, places in classes.items() for place in places}
    named = sorted((p for p in own if main_like(names(p)[-1]) and below[p] > 0), key=lambda p: (len(names(p)), -below[p], p))
    if named:
        return named[0]
    if not sum(own.values()):  # a word in a name never sets aside what holds the article
        wrapped = sorted((t[0] for t in frequent if tagged_main(t[0]) and hidden[t[0]] > 0), key=lambda p: (len(names(p)), -hidden[p], p))
        return wrapped[0] if wrapped else None
    here = ""
    while True:
        inner = [p for p in children.get(here, ()) if not here or vector_of[p] == vector_of.get(here, vector_of[p])]
        best = max(inner, key=lambda p: (below[p], p), default=None)
        if best is None or 2 * below[best] <= below[here] or names(best)[-1].split(".")[0] in SIBLINGS:
            return here or None
        here = best


def article(page: Page, main: str | None) -> str:
    """Text of the main slot in page order, one line per block; elements set aside inside it are left out.

    A page without the slot falls back to its own article or main element, then to all that is not set aside. Where
    that leaves no text, words in names set nothing aside any more: first in an article or main element, then anywhere.
    """
    if main is None or not any(inside(place, main) for place in page.opened):
        own = sorted((p for p in page.opened if main_like(names(p)[-1]) and not set_aside(p)), key=lambda p: len(names(p)))
        main = own[0] if own else ""
    found = text_of(page, main, set_aside)
    if not found:
        wrapped = sorted((p for p in page.opened if tagged_main(p)), key=lambda p: len(names(p)))
        found = next(filter(None, (text_of(page, p, rule) for p in [*wrapped, ""] for rule in (set_aside, by_tag))), "")
    return found


def text_of(page: Page, main: str, left_out: Callable[[str, str], bool]) -> str:
    blocks: list[list[str]] = []
    last = None
    for place, text, block in page.texts:
        if inside(place, main) and not left_out(place, main):
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    lines = (WHITE.sub(" ", html.unescape("".join(parts))).strip() for parts in blocks)
    return "\n".join(line for line in lines if line)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, place, vector, pages, chars): each token's occurrence vector as a sum of hashes over pages.

    Equal sums stand for equal vectors of (page, count). Sums add up in any order, so a host of any
    size is counted without gathering its pages.
    """
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            page = Page(row["html"])
            chars: Counter[str] = Counter()
            for place, text, _ in page.texts:
                chars[place] += len(text.strip())
            yield row["host"], row["page"], "", 1, 0
            for place, n in page.opened.items():
                yield row["host"], row["page"], place, n, chars[place]

    found = map_rows(pages, "host string, page long, place string, n int, chars long", rows)
    # 2**31 values a page keep sums inside 64 bits for four billion pages of a host.
    return found.groupBy("host", "place").agg(
        F.sum(F.shiftrightunsigned(F.xxhash64("page", "n"), 33)).alias("vector"),
        F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main): the place of each host's main slot. A host's group holds its frequent tokens only."""
    tokens = occurrences(pages)
    totals = tokens.where("place = ''").select("host", F.col("pages").alias("n_pages"))
    frequent = tokens.where("place != ''").join(totals, "host").where(F.col("pages") >= SUPPORT * F.col("n_pages"))

    def deduced(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame[["place", "vector", "pages", "chars"]].itertuples(index=False, name=None))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "main": [deduce(rows, int(frame["n_pages"].iloc[0]))]})

    return frequent.groupBy("host").applyInPandas(deduced, "host string, main string")


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The template of a host is deduced from all its pages. Null or empty html gives empty text. URLs
    without a host share the empty host. Repeated rows give repeated results and count once each in
    the template. Character references are decoded, white space in a block becomes one space, and
    blocks are joined by line ends. Other columns are ignored; an empty table gives no rows.
    """
    host, _, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"),
                        host.alias("host"))
    known = kept(templates(rows.select("host", "html", F.xxhash64("page_id", "url", "html").alias("page"))), "templates")
    if known.count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)

    def extracted(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            text = article(Page(row["html"]), row["main"])
            yield row["page_id"], row["url"], text, len(text)

    return map_rows(rows.join(known, "host", "left").drop("host"),
                    "page_id long, url string, text string, n_chars long", extracted)
