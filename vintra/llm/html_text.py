"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events over the page. A line is what stands between two block boundaries. Scripts,
styles, form controls and what isn't shown are no lines. Every other line gets its ratio of text to tags. Tags are a prior:
a line counts a two-hundredth of its ratio if its tag, role or class says that it is no article text (menus, page headers and
footers, sidebars, notices, adverts, forms, comments), or if an article element or a block named so holds most of the
page's text and not this line; a line of links counts nothing. What an element's tag or words say doesn't hold if the element wraps the
page: if it has the article element with the most text in it, and that is more than all that no one doubts, or if it's no menu, footer
or the like by its tag, and no reader comments, and holds half of a page of which nearly all is doubted. Ratios are smoothed by a Gaussian over neighbours of the same
prior, and the levels part into two clusters by Otsu's threshold. The upper cluster is content. The region goes from the
first content line to the last, in the deepest block that holds nearly all content text, and grows to the ends of an
article; in it gaps close: lines below the threshold stay if their prior doesn't speak against them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names, roles and class words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split()
)
CONTAINERS = frozenset("article body center div main section table tbody td".split())
ARTICLE = frozenset("article main".split())
NEVER = frozenset("button canvas datalist embed head iframe input noscript object option script select style svg template textarea title".split())
DOUBTED = frozenset("aside dialog footer form menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An element with one of these words in its class or id, unless the word follows one of WITHOUT.
BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: A block with one of these words in its class or id says that it is the article, if no article or main element does.
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
WITHOUT = frozenset("has no with without".split())
#: An element of this class or id is reader comments even if it holds most of a page's text.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies responses".split())
#: Fewer characters outside links than this are no article that a doubted element could wrap.
WRAPPED = 200
#: What a doubted line's ratio counts.
DOUBT = 0.005
KEPT_WHOLE = frozenset("article body html main".split())

WORDS = re.compile("[a-z]+")
SIGMA, NEAR = 1.5, 4


class Lines(HTMLParser):
    """Collects (text, tags, characters in links, container, doubt) for each line that is shown. A container is a number, at
    which kinds has what it is, parents the container around it and doubt_of the doubt it is in. A doubt is the number of the
    innermost doubted element, at which around has the doubted element around that and firm whether no amount of text helps it; -1 is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.doubt_of: list[int] = []
        self.around: list[int] = []
        self.firm: list[bool] = []
        #: (tag, what its text is: shown 0, doubted 1, left out 2; container; doubt) of open elements, and how many of each tag
        self.open: list[tuple[str, int, int, int]] = []
        self.count: Counter = Counter()
        self.parts, self.tags, self.linked, self.doubt = [], 0, 0, -1

    def state(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (0, -1, -1)

    def cut(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.lines.append((text, self.tags, self.linked, self.state()[1], self.doubt))
        self.parts, self.tags, self.linked, self.doubt = [], 0, 0, -1

    def rank(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in NEVER:
            return 2
        if tag in DOUBTED or (tag == "header" and not self.count["article"] and not self.count["main"]):
            return 1
        if tag in KEPT_WHOLE or not attrs:
            return 0
        a = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            return 2
        words = WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")
        if a.get("role") in ROLES or any(w in BOILERPLATE and (not k or words[k - 1] not in WITHOUT) for k, w in enumerate(words)):
            # inside a line nothing can be parted
            return 1 if tag in BLOCKS else 2
        return 0

    def close_from(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.count[tag] -= 1
        del self.open[k:]

    def close_to(self, tags: frozenset[str], within: frozenset[str]) -> None:
        """Ends an open element of tags, with all inside it, unless one of within is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.close_from(k)
                return
            if self.open[k][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
            self.close_to(frozenset({"p"}), CONTAINERS)
            if tag == "li":
                self.close_to(frozenset({"li"}), frozenset({"ul", "ol"}))
            elif tag in ("dt", "dd"):
                self.close_to(frozenset({"dt", "dd"}), frozenset({"dl"}))
            elif tag == "tr":
                self.close_to(frozenset({"tr"}), frozenset({"table"}))
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        state, inside, doubt = self.state()
        own = self.rank(tag, attrs)
        if own == 1 and state < 2:
            self.around.append(doubt)
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().split()
            self.firm.append(tag == "header" or (tag in DOUBTED and tag != "form") or not COMMENTS.isdisjoint(names))
            doubt = len(self.around) - 1
        state = max(state, own)
        if tag in CONTAINERS and state < 2:
            named = tag == "div" and any(k in ("class", "id") and v and not ARTICLE_WORDS.isdisjoint(WORDS.findall(v.lower())) for k, v in attrs)
            self.kinds.append("named" if named else tag)
            self.parents.append(inside)
            self.doubt_of.append(doubt)
            inside = len(self.kinds) - 1
        self.open.append((tag, state, inside, doubt))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        self.close_to(frozenset({tag}), frozenset() if tag in BLOCKS else CONTAINERS - {tag})

    def handle_data(self, data: str) -> None:
        state, _, doubt = self.state()
        if state < 2:
            self.parts.append(data)
            if self.doubt < 0 and not data.isspace():
                self.doubt = doubt
            if any(x[0] == "a" for x in self.open[-3:]):
                self.linked += len(data)


def smoothed(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbours of the same kind, renormalised where some are of another or missing."""
    kernel, out = np.exp(-0.5 * (np.arange(-NEAR, NEAR + 1) / SIGMA) ** 2), np.zeros(len(x))
    for k in np.unique(kind):
        of = kind == k
        out[of] = (np.convolve(x * of, kernel)[NEAR : NEAR + len(x)] / np.maximum(np.convolve(of * 1.0, kernel)[NEAR : NEAR + len(x)], 1e-9))[of]
    return out


def threshold(level: np.ndarray) -> float:
    """The level from which on the upper of two clusters begins: Otsu's, over logarithms. Levels that are all alike are one cluster."""
    x = np.sort(np.log1p(level))
    below = np.arange(1, len(x))
    low, high = np.cumsum(x)[:-1] / below, (x.sum() - np.cumsum(x)[:-1]) / (len(x) - below)
    spread = below * (len(x) - below) * (high - low) ** 2 * (x[1:] > x[:-1])
    return float(np.expm1(x[1:][spread.argmax()])) * (1 - 1e-9) if len(spread) and spread.max() > 0 else 0.0


def article_of(kinds: list[str], votes: list[int], total: int) -> set[int]:
    """The containers that the page's tags call its article; none if they hold too little of its text."""
    first = max((c for c, v in enumerate(votes) if v and kinds[c] in ARTICLE), key=lambda c: (votes[c], -c), default=None)
    if first is not None and votes[first] * 2 >= total:
        # several articles of one page, and what main holds besides, follow each other
        return {c for c, kind in enumerate(kinds) if kind == kinds[first]}
    return {c for c in [max((c for c, v in enumerate(votes) if v and kinds[c] == "named" and v >= 0.85 * total), default=-1)] if c >= 0}


def doubted_lines(page: Lines, plain: np.ndarray) -> np.ndarray:
    """Which lines stand in a doubted element that doesn't wrap the page. plain: a line's characters outside links."""
    n, kinds = len(page.around), page.kinds
    doubt = np.array([x[4] for x in page.lines])
    # text of each article element that nothing inside it doubts; containers have greater numbers than those around them
    own = [0] * len(kinds)
    for x, chars in zip(page.lines, plain.tolist(), strict=True):
        if x[3] >= 0 and x[4] == page.doubt_of[x[3]]:
            own[x[3]] += chars
    for c in range(len(kinds) - 1, -1, -1):
        if (up := page.parents[c]) >= 0 and page.doubt_of[up] == page.doubt_of[c]:
            own[up] += own[c]
    holds = [0] * n
    for d, chars in zip(doubt.tolist(), plain.tolist(), strict=True):
        if d >= 0:
            holds[d] += chars
    for d in range(n - 1, -1, -1):
        if page.around[d] >= 0:
            holds[page.around[d]] += holds[d]
    wraps = [False] * n

    def doubted() -> np.ndarray:
        held = []
        for d in range(n):
            held.append(not wraps[d] or (page.around[d] >= 0 and held[page.around[d]]))
        return np.array([d >= 0 and held[d] for d in doubt.tolist()], bool)

    now, total = doubted(), int(plain.sum())
    article = max((c for c, kind in enumerate(kinds) if kind in ARTICLE), key=lambda c: (own[c], -c), default=None)
    plainly = any(kind in ARTICLE and page.doubt_of[c] < 0 and own[c] * 10 >= total for c, kind in enumerate(kinds))
    if article is not None and not plainly and page.doubt_of[article] >= 0 and own[article] > plain[~now].sum():
        d = page.doubt_of[article]
        while d >= 0:
            wraps[d], d = True, page.around[d]
        now = doubted()
    while plain[~now].sum() * 10 < total:
        d = next((d for d in range(n) if not wraps[d] and not page.firm[d] and holds[d] * 2 >= total and holds[d] >= WRAPPED), None)
        if d is None:
            break
        wraps[d] = True
        now = doubted()
    return now


def main_text(html: str | None) -> str:
    """The article's lines joined by \\n; empty for null, for no text and for a page of menus, notices and the like only."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.cut()
    if not page.lines:
        return ""
    texts, tags, linked, inside, _ = (list(c) for c in zip(*page.lines, strict=True))
    size = np.array([len(t) for t in texts])
    links = np.array(linked) / size
    doubted = doubted_lines(page, np.maximum(0, size - np.array(linked)))
    if doubted.all():
        return ""

    def votes(of: np.ndarray) -> list[int]:
        """Characters of those lines in each container; a container's number is above those of all around it."""
        out = [0] * len(page.kinds)
        for n, c in zip(size[of].tolist(), np.array(inside)[of].tolist(), strict=True):
            if c >= 0:
                out[c] += n
        for c in range(len(out) - 1, -1, -1):
            if page.parents[c] >= 0:
                out[page.parents[c]] += out[c]
        return out

    def lines_in(wanted: set[int]) -> np.ndarray:
        within = [False] * len(page.kinds)
        for c in range(len(within)):
            within[c] = c in wanted or (page.parents[c] >= 0 and within[page.parents[c]])
        return np.array([c >= 0 and within[c] for c in inside])

    article = article_of(page.kinds, votes(~doubted), int(size[~doubted].sum()))
    whole = lines_in(article) if article else np.zeros(len(size), bool)
    doubted |= ~whole & bool(article)
    level = smoothed(size / np.maximum(1, tags) * np.where(doubted, DOUBT, 1.0) * (links < 0.5), doubted)
    content = level >= threshold(level)
    elected = votes(content)
    best = max((c for c, v in enumerate(elected) if v >= 0.85 * size[content].sum()), default=None)
    inner = whole if article and not (content & ~whole).any() else np.ones(len(size), bool) if article or best is None else lines_in({best})
    at = np.flatnonzero(inner & content)
    region = inner & (np.arange(len(size)) >= at.min(initial=len(size))) & (np.arange(len(size)) <= at.max(initial=-1))
    region = (region & ((links < 0.5) | (size > 200))) | (whole & bool((region & whole).any()))
    keep = region & (content | ~doubted)
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of pages (page_id, url, html): one row for each row, repeated ones too; text is never null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text, na_action=None)

    texts = F.pandas_udf(run, "string")
    return pages.select("page_id", "url", texts("html").alias("text"))
