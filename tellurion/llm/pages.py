"""The main text of web pages as a maximum-scoring run of words and tags.

A page is a sequence of tags and words.  Each has a feature: what it is, and in what kind of place it stands.
Words of a likely article score above zero, tags and words of other places below.  The weights are log odds,
learned from pages labelled by their own markup: those that mark their article.  Such pages are read twice, as
they are and with the marks hidden, so that pages without marks have weights too.  One pass over the sequence
finds the contiguous run with the largest sum.  Of that run, the text of its blocks is given back without what
lies in other places (menus, adverts, forms, comments, ...), which cuts nothing else.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, unit_hash

#: Elements whose content is no markup and no text of a page, that hold other things than its
#: article, that have no content, and that begin a block of their own.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
ASIDE = frozenset("head nav footer aside form button select menu dialog header template svg math object canvas datalist".split())
IN_HEAD = frozenset("head title base link meta script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog".split())
#: Elements whose end tag may be left out before another of the kind.
OPEN_ENDED = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Words in a class or id that name other things than an article; those that do so only if all words beside
#: them are of LAYOUT; and words that turn the next one's meaning.
OTHER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus cookie cookies consent newsletter subscribe signup login popup pagination pager masthead".split())
PERHAPS = frozenset("alert banner header menu modal notice overlay recommended related replies reply respond share sharing social toolbar widget".split())
LAYOUT = frozenset("area bar block bottom box buttons container content div fixed global group icons inner item items left links list main outer page panel posts right row section site sticky stories strip top web widgets wrap wrapper".split())
NOT = frozenset("a has hide is no non not on with without".split())
#: Names that tags are counted by; all others are one.
NAMES = frozenset("a abbr b cite code em i img q small span strong sub sup time u br label input".split()) | BLOCK | ASIDE | {"th", "col"}

_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s<>/]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s<>/]*)([^<>]*)>|(<)|[^<]+", re.S)
_CLASS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class PageParams:
    """About `train_pages` pages are read for the weights, chosen by a hash of page_id."""

    train_pages: int = 4000


#: Weights before any page was seen, by feature.  Tags of a marked article cost next to nothing: it stays whole.
PRIOR = {"word": 1.0, "link": -0.5, "other word": -0.05, "other tag": -0.05, "in word": 2.0, "in tag": -1e-6, "out word": -1.0, "out tag": -1.0, "tag": -0.25}
#: Within these each feature's weight stays, whatever the pages teach.
RANGE = {"word": (0.5, 2.0), "link": (-1.0, 0.5), "other word": (-0.05, -0.01), "other tag": (-0.05, -0.01), "in word": (0.5, 2.0), "in tag": (-1e-5, -1e-7), "out word": (-2.0, -0.5), "out tag": (-2.0, -0.5), "tag": (-1.5, -0.05)}


@dataclass
class PageWeights:
    """By feature: a word's or a tag's place, or "tag " and its name where the page marks nothing."""

    by: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def __getitem__(self, feature: str) -> float:
        return self.by.get(feature, PRIOR["tag"])


@dataclass
class Place:
    """An element that stands for what is in it: kind is tag, class, article or main; words are its own."""

    kind: str
    up: int
    words: int = 0
    other: bool = False


@dataclass
class Page:
    """kinds: text, open or close; values: text or name; at: the innermost place; linked: within a link."""

    kinds: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    places: list[Place] = field(default_factory=lambda: [Place("page", -1)])
    marked: set[int] = field(default_factory=set)


def names_other(attributes: str) -> bool:
    """Whether a class, id or role names something else than an article.

    "comments" or "top-ad" does; "has-sidebar" and "no-comments" name what is or isn't beside it; "social
    science" and "notice-of-results" hold words that could name one but further words that don't."""
    for m in _CLASS.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        names = [_PARTS.findall(x.lower()) for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).split()]
        for parts in names:
            for k, x in enumerate(parts):
                if x in OTHER and not (set(parts[:k]) & NOT):
                    return True
        every = [x for parts in names for x in parts]
        if any(x in PERHAPS for x in every) and all(x in PERHAPS or x in LAYOUT or x in OTHER for x in every):
            return True
    return False


def read_page(page: str) -> Page:
    """A page's tags and words in order, in time linear in its length.  Comments, declarations and raw
    elements are left out.  Elements left open end with the one around them."""
    out = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # name, and the place, link and article to go back to
    count: Counter = Counter()
    place, link, inside = 0, False, False
    at, n = 0, len(page)

    def leave() -> str:
        nonlocal place, link, inside
        name, place, link, inside = stack.pop()
        count[name] -= 1
        return name

    def add(kind: str, value: str) -> None:
        out.kinds.append(kind)
        out.values.append(value)
        out.at.append(place)
        out.linked.append(link)

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[7] or page[m.start()] != "<":
                if count["head"] and not m[0].isspace():
                    while leave() != "head":  # text ends a head left open
                        pass
                out.places[place].words += len(m[0].split())
                add("text", m[0])
            continue
        name, attributes, last = name.lower(), m[3] if m[2] else m[6], page.endswith("/>", 0, at)
        if m[1] or m[4]:
            if count[name]:
                while leave() != name:
                    pass
            add("close", name)
            continue
        if count["head"] and name not in IN_HEAD:
            while leave() != "head":
                pass
        if name in RAW:
            if not last:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in BLOCK and count["p"]:
            while leave() != "p":
                pass
        if name in OPEN_ENDED and stack and stack[-1][0] in OPEN_ENDED[name]:
            first = leave()
            if name == "tr" and first != "tr" and stack and stack[-1][0] == "tr":
                leave()
        add("open", name)
        if name in VOID or last:
            continue
        stack.append((name, place, link, inside))
        count[name] += 1
        kind = ""
        if name in ASIDE:
            kind = "tag" if name != "header" or not inside else ""
        elif name not in ("html", "body") and attributes and names_other(attributes):
            kind = "class"
        if name in ("article", "main"):
            if kind:
                out.places.append(Place(kind, place))
                place = len(out.places) - 1
            kind, inside = name, True
        if kind:
            out.places.append(Place(kind, place))
            place = len(out.places) - 1
        link = link or name == "a"
    settle(out)
    return out


def settle(page: Page) -> None:
    """Decides which places are other ones, and which are marked as the article."""
    places = page.places
    total = [p.words for p in places]
    for k in range(len(places) - 1, 0, -1):
        total[places[k].up] += total[k]

    def above(k: int) -> Iterator[int]:
        while k > 0:
            k = places[k].up
            yield k

    for k, p in enumerate(places):
        p.other = p.kind in ("tag", "class") or (k > 0 and places[p.up].other)
    plain = sum(p.words for p in places if not p.other)
    own_tag = [p.kind == "tag" for p in places]
    for k, p in enumerate(places):
        own_tag[k] = own_tag[k] or (k > 0 and own_tag[p.up])
    released: set[int] = set()
    for kind in ("article", "main"):
        marks = [k for k, p in enumerate(places) if p.kind == kind and not own_tag[k]]
        if marks:
            largest = max(marks, key=lambda k: total[k])
            open_ = [k for k in marks if not places[k].other]
            # An article in a wrapper whose class names something beside it: the wrapper is no other place.
            if places[largest].other and not any(total[k] * 4 >= total[largest] for k in open_):
                released = {k for k in above(largest) if places[k].kind == "class"}
            break
    else:
        by_class = sum(p.words for k, p in enumerate(places) if p.other and not own_tag[k])
        if by_class > 20 * plain:  # all the page is in a wrapper
            tops = [k for k, p in enumerate(places) if p.kind == "class" and not places[p.up].other]
            released = {max(tops, key=lambda k: total[k])} if tops else set()
    if released:
        for k, p in enumerate(places):
            p.other = (p.kind in ("tag", "class") and k not in released) or (k > 0 and places[p.up].other)
    for kind in ("article", "main"):
        first = {k for k, p in enumerate(places) if p.kind == kind and not p.other}
        if first:
            page.marked = first
            for k, p in enumerate(places):
                if k > 0 and p.up in page.marked:
                    page.marked.add(k)
            break


def features(page: Page, marks: bool = True) -> list[tuple[str, int]]:
    """Of every tag and text its feature, and how often it counts: once a tag, once a word.  Without `marks`
    as if the page marked no article."""
    marks = marks and bool(page.marked)
    out = []
    for kind, value, at, linked in zip(page.kinds, page.values, page.at, page.linked, strict=True):
        text = kind == "text"
        if page.places[at].other:
            if marks and at in page.marked:  # an advert in an article, which must not cut it
                out.append(("in tag", 1))
                continue
            feature = "other word" if text else "other tag"
        elif marks:
            feature = ("in " if at in page.marked else "out ") + ("word" if text else "tag")
        elif text:
            feature = "link" if linked else "word"
        else:
            feature = "tag " + (value if value in NAMES else "unknown")
        out.append((feature, len(value.split()) if text else 1))
    return out


def fit_page_weights(pages: DataFrame, params: PageParams = PageParams()) -> PageWeights:
    """From pages that mark their article: how often each feature is in and outside of it.  A weight is the log
    of these odds, drawn to the prior while little was seen, within its range.  Without such pages the
    priors hold.  Features are of a fixed vocabulary; the driver gets a number or two for each."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["html"]:
                page = read_page(text or "")
                if page.marked:
                    for marks in (True, False):
                        for (feature, n), at in zip(features(page, marks), page.at, strict=True):
                            if marks or not feature.startswith("other"):
                                seen[feature, at in page.marked] += n
            yield pd.DataFrame([(k, a, c) for (k, a), c in seen.items()], columns=["name", "inside", "n"])

    total = pages.count()
    sample = pages.where(unit_hash(F.col("page_id").cast("string"), F.lit("pages")) < params.train_pages / max(total, 1)).select("html")
    sums = sample.mapInPandas(counted, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    weights = PageWeights()
    got: dict[str, list[int]] = {}
    for r in sums.collect():
        got.setdefault(r["name"], [0, 0])[int(r["inside"])] += r["n"]
    for name, (outside, within) in got.items():
        of = "tag" if name.startswith("tag ") else name
        low, high = RANGE[of]
        odds = math.log((within + 1) / (outside + 1)) / 2
        if of == "tag":
            odds -= 1  # tags are between the words of an article too: only those that stand in it as a rule cost little
        seen = (within + outside) / (within + outside + 50)
        weights.by[name] = min(high, max(low, PRIOR[of] * (1 - seen) + odds * seen))
    return weights


def best_run(scores: Sequence[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, as first and end; the first of equals, (0, 0) if no sum is
    above zero."""
    best, begin, end, now, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, k
        now += s
        if now > best:
            best, begin, end = now, start, k + 1
    return begin, end


def main_text(text: str | None, weights: PageWeights) -> str:
    """The text of the best run: blocks joined by line ends; empty if no word scores above zero."""
    page = read_page(text or "")
    begin, end = best_run([weights[f] * n for f, n in features(page)])
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if line := " ".join("".join(held).split()):
            blocks.append(line)
        held.clear()

    for k in range(begin, end):
        value = page.values[k]
        if page.kinds[k] == "text":
            if not page.places[page.at[k]].other:
                held.append(html.unescape(value))
        elif value in BLOCK:
            close()
        elif value == "br":
            held.append(" ")
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, weights: PageWeights) -> DataFrame:
    """Of every row: page_id, url, text and n_chars.  The whole html is read; null is empty.  Pages
    without main text get an empty text.  Repeated rows and null ids are rows like any other; other columns
    are left out.  No shuffle."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, weights) for x in batch], dtype=object)

    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_page_weights(pages))
