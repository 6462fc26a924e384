"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of text pieces and tags. A word scores by the elements around it, a tag
negatively; the weights are log-odds learned from labelled pages. One linear scan finds the
contiguous region with the highest sum; pieces inside it whose words score below zero (an advert in
the article, say) are left out.

Defined results: null, empty and word-free pages give an empty text; repeated rows give equal rows;
pages are read whole, cut off anywhere, with unclosed elements or not, in time that grows with their
length however deep they nest; other columns are not read; an empty table gives no rows. White space
is Unicode's.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Never shown as text, whatever the weights.
HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg canvas object select option datalist head".split())
#: An opening tag on the left closes the open elements on the right.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|$)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")


@dataclass
class Weights:
    """Log-odds of features in millionths, so that sums don't depend on the order of addition, and costs of tags."""

    words: dict[str, int] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


class Around:
    """The distinct features of the open elements, kept as elements open and close."""

    def __init__(self):
        self.count: dict[str, int] = {}
        self.hidden = 0

    def keep(self, feature: str) -> bool:
        return True

    def open(self, features: frozenset) -> list[str]:
        """The features to close again."""
        kept = [f for f in features if f in HIDING or self.keep(f)]
        for f in kept:
            n = self.count[f] = self.count.get(f, 0) + 1
            if n == 1:
                self.change(f, 1)
        return kept

    def close(self, kept: list[str]) -> None:
        for f in kept:
            self.count[f] -= 1
            if not self.count[f]:
                del self.count[f]
                self.change(f, -1)

    def change(self, feature: str, by: int) -> None:
        self.hidden += by * (feature in HIDING)


class Scored(Around):
    """The score of a word below the open elements: 1 where nothing speaks against it.

    Words of other parts cost little, so that an article goes on after a long advert; they are left out all the same.
    """

    def __init__(self, weights: Weights):
        super().__init__()
        self.words, self.against, self.favour = weights.words, 0, 0

    def keep(self, feature: str) -> bool:
        return bool(self.words.get(feature))

    def change(self, feature: str, by: int) -> None:
        super().change(feature, by)
        w = self.words.get(feature, 0)
        if w < 0:
            self.against += by * w
        else:
            self.favour += by * w

    def word(self) -> float:
        if self.hidden:
            return 0.0
        if not self.against:
            return 1.0
        return max(-0.25, min(1.0, 1.0 + self.against / 1e6 + min(3.0, self.favour / 1e6)))


#: Features of elements that are never shown.
HIDING = frozenset({"hidden", *(f"<{t}>" for t in HIDDEN)})


def features_of(tag: str, attrs: str, in_article: bool) -> frozenset:
    """Features of one element: its tag, and the words of its class, id and role; hidden ones have their own."""
    out = {f"<{tag}-in-article>" if tag == "header" and in_article else f"<{tag}>"}
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role", "aria-label"):
                out.update(f".{w}" for w in _NAME.findall(value))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.add("hidden")
    return frozenset(out)


def pieces(page: str, around: Around) -> Iterator[tuple[str | None, str, bool]]:
    """The page in order: (text, "", False), or (None, tag, whether it breaks the line); ``around`` follows the open elements."""
    stack: list[tuple[str, list[str]]] = []
    depth: Counter = Counter()

    def pop() -> str:
        tag, kept = stack.pop()
        depth[tag] -= 1
        around.close(kept)
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            yield page[at:], "", False
            return
        if m.start() > at:
            yield page[at : m.start()], "", False
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield html.escape(m[0][9:].removesuffix("]]>"), quote=False), "", False
            continue
        tag, breaks = m[2].lower(), m[2].lower() not in INLINE
        yield None, tag, breaks
        if m[1]:
            while depth[tag] and pop() != tag:
                pass
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW:
            continue
        shut = CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        while stack and stack[-1][0] in shut or stack and stack[-1][0] in INLINE and shut and any(t in shut for t, _ in stack[-4:]) and tag in CLOSES_P:
            pop()
        kept = around.open(features_of(tag, m[3], bool(depth["article"] or depth["main"])))
        stack.append((tag, kept))
        depth[tag] += 1
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            if close is None:
                return


def best_region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the greatest sum, the first of those that tie; (0, 0) if no sum is above zero."""
    best = best_from = best_to = run = start = 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0, i
        run += score
        if run > best:
            best, best_from, best_to = run, start, i + 1
    return best_from, best_to


def extract(page: str | None, weights: Weights) -> str:
    """The main text: block texts in page order, joined by one space."""
    if not page:
        return ""
    around = Scored(weights)
    scores: list[float] = []
    parts: list[tuple[str | None, bool]] = []  # text, and whether it may be shown or breaks the line
    for text, tag, breaks in pieces(page, around):
        if text is None:
            scores.append(weights.tag(tag))
            parts.append((None, breaks))
        else:
            scores.append(around.word() * len(text.split()))
            parts.append((text, not around.hidden))
    a, b = best_region(scores)
    out: list[str] = []
    block: list[str] = []
    for score, (text, flag) in zip(scores[a:b], parts[a:b], strict=True):
        if text is None:
            if flag:
                out.append("".join(block))
                block = []
        elif score > 0 or flag and not text.strip():
            block.append(html.unescape(text))
    out.append("".join(block))
    return " ".join(w for b in out for w in b.split())


def fit(labelled: list[tuple[str, frozenset]]) -> Weights:
    """Weights from labelled pages, given as (page, the words that are content): see labelled_pages.

    The weight of a feature is the smoothed log-odds of words below it being content.
    """
    good, bad, tag_good, tag_bad = Counter(), Counter(), Counter(), Counter()
    for page, marks in labelled:
        around, last_tag = Around(), ""
        for text, tag, _ in pieces(page, around):
            if text is None:
                last_tag = tag
                tag_bad[tag] += 1
                continue
            words = text.split()
            if not words or around.hidden:
                continue
            main = words[0] in marks
            (good if main else bad).update({f: len(words) for f in around.count})
            if main:
                tag_good[last_tag] += 1
    g, b = sum(good.values()) or 1, sum(bad.values()) or 1
    out = Weights()
    for f in good.keys() | bad.keys():
        w = math.log((good[f] + 0.5) / (g + 1)) - math.log((bad[f] + 0.5) / (b + 1))
        if abs(w) > 1.5:
            out.words[f] = round(max(-8.0, min(2.0, w)) * 1e6)
    for t in tag_bad:
        out.tags[t] = -min(0.5, max(0.02, 0.05 * math.log((tag_bad[t] + 1) / (tag_good[t] + 1)) + 0.05))
    return out


#: What people call the parts of a page that are not its article (fixed values).
BOILER_NAMES = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead banner topbar "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations "
    "pagination pager toolbar search copyright legal disclaimer form contentinfo complementary teaser outbrain taboola skip"
).split()
CONTENT_NAMES = ("content", "article", "post", "entry", "story", "main", "body", "text")
_BOILER_TAGS = ("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "address")


def labelled_pages(n: int = 160, seed: int = 5) -> list[tuple[str, frozenset]]:
    """Labelled pages, laid out by a rule from made-up words: (page, the words that are content).

    Every page has words of its own in each part, so a word tells whether its part is content.
    """
    rng = random.Random(seed)
    out = []
    for k in range(n):
        count, main = 0, set()

        def say(size: int, content: bool, k=k, main=main) -> str:
            nonlocal count
            words = []
            for _ in range(size):
                count += 1
                words.append(f"{'m' if content else 'x'}{k}w{count}")
            if content:
                main.update(words)
            return " ".join(words)

        def boiler(depth: int = 0, k=k, rng=rng) -> str:
            tag = rng.choice((*_BOILER_TAGS, "div", "div", "section", "ul"))
            name = rng.choice(BOILER_NAMES) if tag in ("div", "section", "ul") or rng.random() < 0.3 else ""
            attr = f' {rng.choice(("class", "id"))}="{name}{rng.choice(("", "-box", " wide"))}"' if name else ""
            if rng.random() < 0.5:
                inner = "".join(f'<li><a href="/{j}">{say(1 + j % 2, False)}</a></li>' for j in range(rng.randint(2, 8)))
                inner = f"<ul>{inner}</ul>"
            else:
                inner = "".join(f"<p>{say(rng.randint(3, 25), False)}</p>" for _ in range(rng.randint(1, 3)))
            return f"<{tag}{attr}>{inner}</{tag}>"

        body = [f"<h1>{say(rng.randint(3, 9), True)}</h1>"]
        for _ in range(rng.randint(1, 12)):
            body.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}<br>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>", '<p><a href="/x">{}</a></p>')).format(say(rng.randint(5, 60), True)))
            if rng.random() < 0.15:
                body.append(boiler())
        if rng.random() < 0.2:
            body[0] = f"<header>{body[0]}</header>"
        wrap = rng.choice(("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="{}">'.format(rng.choice(CONTENT_NAMES)) + "{}</div>", "<div>{}</div>"))
        page = "".join(boiler() for _ in range(rng.randint(0, 4))) + wrap.replace("{}", "".join(body)) + "".join(boiler() for _ in range(rng.randint(0, 4)))
        out.append((f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>", frozenset(main)))
    return out


@functools.lru_cache(1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    weights = weights or default_weights()

    def each(batches):
        for ids, urls, pages_ in batches:
            yield [(i, u, t, len(t)) for i, u, h in zip(ids, urls, pages_, strict=True) for t in [extract(h, weights)]]

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", each)
