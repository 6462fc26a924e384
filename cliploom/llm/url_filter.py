"""URL filter: longest-match rules, then logistic regression on hashed character n-grams.

Host and path become character 3- to 5-grams, hashed into ``N_BITS`` bits; a logistic regression
trained by full-batch gradient descent from a small labelled URL table gives a block probability.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed, as no n-gram speaks against it;
repeated rows are judged alike; other columns are not read; an empty table gives no rows. A URL of
any length is judged whole.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

N_BITS = 16
GRAMS = (3, 4, 5)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end], rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return host.translate(_LOWER), tail[:stop]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host, then the path from its first "/"

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The rules of the production query.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


class RuleIndex:
    """Rules by host: a url's host and its parent domains are looked up, the longest fitting pattern wins."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host.translate(_LOWER), []).append(r)

    def match(self, host: str, path: str) -> Rule | None:
        best, at = None, host
        while at:
            for r in self.by_host.get(at, ()):
                if path.startswith(r.path) and (best is None or (len(r.pattern), r.pattern) > (len(best.pattern), best.pattern)):
                    best = r
            at = at.partition(".")[2]
        return best


def made_names(n: int, seed: int = 3) -> list[str]:
    """Host names that say nothing: two to four syllables each, by a fixed draw."""
    rng = np.random.default_rng(seed)
    syllables = [c + v + e for c in "b c d f g k l m n p r s v z br cl dr pl st".split() for v in "aeiou" for e in ("", "", "l", "n")]
    return ["".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(n)]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block). Names as people give them to such hosts, and clean ones, partly
    made by a rule; crossed with subdomains, paths and ends. None of them is taken from a table that is judged."""
    bad = (
        "free-casino best-pills win-money click-track ad-server spam-links poker-bonus pills-online slots-win track-pixel "
        "link-farm viagra-cheap loan-fast bet-win adclick popup-ads bets-online adult-video adult-cams xxx-adult free-spins "
        "casino-online casino-bonus cheap-meds cheap-watches win-prizes spam-mailer content-farm free-bet-tips ads-network ads-banner"
    ).split()
    good = (
        "news weather library museum science garden history school recipes travel library-archive city-hall "
        "health-info open-data research music-school blog-writer bookshop football-club winter-sports tracking-history "
        "cheaptravel farm-museum pharmacy-board advice public-service adulthood-study freedom-press windmill alphabet "
        "railtrack-museum farmers-market betterment castle-tours address-book loanword-dictionary"
    ).split()
    rng = np.random.default_rng(1)
    draw = lambda *options: options[rng.integers(len(options))]  # noqa: E731  drawn, so that nothing but the name goes with the label
    rows = []
    for label, hosts in ((1, bad), (0, good), (0, made_names(90))):
        for h in hosts:
            for _ in range(8):
                host = f"{draw('', 'www.', 'm.', 'blog.')}{h}.{draw('example.com', 'example.net', 'example.org')}"
                end = draw("", "/", ".html", "?page=2", "#top", "?utm_source=feed")
                rows.append((f"http://{host}/{draw('en', 'de', 'fr', 'es')}/{rng.integers(10_000)}{end}", label))
    return rows


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams. Digits in the path count as one sign, as numbers there only tell pages apart."""
    out = set()
    digits = str.maketrans("0123456789", "0000000000")
    for kind, s in (("h", f"^{host}$"), ("p", f"^{path.translate(digits)}$")):
        if len(s) > 2:
            for n in GRAMS:
                for i in range(len(s) - n + 1):
                    out.add(zlib.crc32(f"{kind}{s[i : i + n]}".encode()) & ((1 << N_BITS) - 1))
    return np.array(sorted(out), np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def probability(self, host: str, path: str) -> float:
        f = features(host, path)
        if not len(f):
            return 0.0  # nothing speaks against it
        z = self.bias + float(self.weights[f].sum()) / np.sqrt(len(f))
        return float(1 / (1 + np.exp(-z)))


def gradient(w: np.ndarray, b: float, at: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Gradient of the mean log loss plus l2 / 2 * |w|^2; row ``at[k]`` has the value ``x[k]`` in column ``cols[k]``."""
    z = np.bincount(at, w[cols] * x, len(y)) + b
    g = (1 / (1 + np.exp(-z)) - y) / len(y)
    return np.bincount(cols, g[at] * x, len(w)) + l2 * w, float(g.sum())


def train(rows: list[tuple[str, int]], steps: int = 400, rate: float = 6.0, l2: float = 1e-4) -> Model:
    """Full-batch gradient descent from zero: the same rows give the same weights."""
    feats = [features(*split_url(u)) for u, _ in rows]
    y = np.array([v for _, v in rows], float)
    cols = np.concatenate(feats)
    at = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    x = np.repeat([1 / np.sqrt(max(1, len(f))) for f in feats], [len(f) for f in feats])
    w, b = np.zeros(1 << N_BITS), 0.0
    for _ in range(steps):
        gw, gb = gradient(w, b, at, cols, x, y, l2)
        w, b = w - rate * gw, b - rate * gb
    return Model(w, b)


@functools.lru_cache(1)
def default_model() -> Model:
    return train(labelled_urls())


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, probability."""
    model = model or default_model()

    def each(batches):
        index = RuleIndex(rules)
        probability = functools.lru_cache(1 << 16)(model.probability)
        for ids, urls in batches:
            rows = []
            for i, u in zip(ids, urls, strict=True):
                host, path = split_url(u)
                p, rule = probability(host, path), index.match(host, path)
                verdict = rule.verdict if rule else "block" if p > threshold else "allow"
                rows.append((i, host, path, rule.pattern if rule else None, verdict, p))
            yield rows

    return map_rows(pages, ["page_id", "url"], "page_id long, host string, path string, rule string, verdict string, probability double", each)
