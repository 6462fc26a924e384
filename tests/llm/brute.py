"""Plain Python versions that the operators are held against."""

import hashlib
import math
from collections import Counter, defaultdict


def base_columns(text):
    words = text.encode().split() if text else []
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), chars, symbols, dup, len(hit)


def shingle_set(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def components(rows, percent=85):
    """(doc_id, text) of distinct ids -> {doc_id: (n_shingles, component_id, kept)}, by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def removals(rows, window=20):
    """(doc_id, text) of distinct ids -> {doc_id: (words, mask of removed words)}."""
    first, words = {}, {}
    for d, t in sorted(rows):
        words[d] = (t or "").encode().split()
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out[d] = (w, gone)
    return out


def removal_digests(rows):
    return {d: (len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for d, (w, g) in removals(rows).items()}


def conversation_digests(rows):
    """(conv_id, turn, role, text) -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def quality_verdicts(rows, q):
    """(doc_id, text, lang, source, _) of distinct ids -> {doc_id: kept}, {(lang, source): {metric: (low, high)}}."""
    groups, values = defaultdict(lambda: defaultdict(list)), {}
    for d, text, lang, source, _ in rows:
        x = dict(zip(q.COUNTS, q.counts(text), strict=True))
        chars, words = max(x["word_chars"], 1), max(x["n_words"], 1)
        v = {
            "punctuation": x["n_punctuation"] / chars, "dup_lines": x["n_dup_lines"] / max(x["n_lines"], 1), "repeats": x["n_repeat_words"] / words,
            "capitals": x["n_capitals"] / chars, "word_length": x["word_chars"] / words,
        }
        values[d] = v, (lang, source), x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        if not values[d][2]:
            for m in q.METRICS:
                if v[m.name] > 0 or not m.rare:
                    for g in ((lang, source), (lang,), ()):
                        groups[g][m.name].append(v[m.name])

    def quartile(xs, share):
        x = sorted(xs)[math.ceil(share * len(xs)) - 1]
        return q.GAMMA ** math.ceil(math.log(x) / math.log(q.GAMMA)) * 2 / (1 + q.GAMMA) if x > 0 else 0.0

    fences = defaultdict(dict)
    for g in [g for g in groups if len(g) == 2]:
        for m in q.METRICS:
            if own := groups[g].get(m.name):
                enough = lambda *xs: next((x for x in xs[:-1] if len(x) >= q.LEAST_DOCS), xs[-1])
                lang = enough(groups[g[:1]][m.name], groups[()][m.name])
                pairs = [(enough(own, lang), q.GROUP_REACH), (lang, q.LANGUAGE_REACH)]
                ends = [(quartile(x, 0.25), quartile(x, 0.75), reach) for x, reach in pairs]
                high = min((b * (b / a) ** q.RARE_REACH if m.rare else b + r * (b - a)) * q.GAMMA for a, b, r in ends)
                low = max((a - r * (b - a)) / q.GAMMA for a, b, r in ends)
                fences[g][m.name] = low, high
    kept = {}
    for d, (v, g, failed) in values.items():
        kept[d] = not failed and all(m.name not in fences[g] or v[m.name] <= fences[g][m.name][1] and (not m.two_sided or v[m.name] >= fences[g][m.name][0]) for m in q.METRICS)
    return kept, fences
