"""Plain versions of the operators' contracts, over lists."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def covered(texts: list, width: int) -> list[list[bool]]:
    """Places of each sequence that lie in a window found twice or more in all of them."""
    cut = lambda t, k: t[k : k + width] if isinstance(t, bytes) else tuple(t[k : k + width])
    windows = [[cut(t, k) for k in range(len(t) - width + 1)] for t in texts]
    counts = Counter(w for own in windows for w in own)
    out = []
    for t, own in zip(texts, windows):
        gone = [False] * len(t)
        for k, w in enumerate(own):
            if counts[w] > 1:
                gone[k : k + width] = [True] * width
        out.append(gone)
    return out


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    repeat = {i for at in places.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w))


def contamination(texts: dict, items: dict, n: int = 13) -> dict:
    """doc_id -> (n_words, n_hit, items as sorted strings)."""
    windows = defaultdict(set)
    for item, text in items.items():
        w = PLAIN_WORD.findall(low(text))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    out = {}
    for doc, text in texts.items():
        w = PLAIN_WORD.findall(low(text))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit.update(range(k, k + size))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def simhash(text: str | None) -> int:
    w = WORD.findall(low(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable over fingerprints within bits."""
    root = {d: d for d in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def near_groups(texts: list, least: float = 0.8, words: int = 5) -> list[int]:
    """For each text the first one of its group, by links between texts whose word shingles have a Jaccard similarity of ``least`` or more."""
    sets = []
    for t in texts:
        w = low(t).encode().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if texts[i] == texts[j] or not (a or b) or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def class_score(tokens: list[str], model, words: dict, class_before, unknown_class) -> float:
    """log10 probability of tokens (None: the end) by the tables of a class model; words: token -> (count, class)."""
    total, before = 0.0, 0
    room = model.tokens + model.types + 1
    for t in tokens:
        count, k = words.get(t) or (0, unknown_class(t))
        own = count if count else model.unknown[k] / model.unseen[k]
        base = (count + 1) / room / (1 if count else sum(model.unseen))
        total += math.log10(model.share * model.step[before][k] * own / model.within[k] + (1 - model.share) * base)
        before = 0 if t is None else class_before(t)
    return total


def languages(pages: list[tuple], langs: list[str], logs, counts_of, strength: float = 5.0, weight: float = 60) -> list[tuple]:
    """(text_lang, lang, posterior) of pages (html, host, domain, suffix, declared) by plain sums over all pages; counts_of(html): trigram counts."""
    told = []
    for page, *where in pages:
        counts = counts_of(page)
        n = sum(counts.values())
        ll = [sum(c * logs[k][g] for g, c in counts.items()) * (min(1.0, weight / n) if n else 0.0) for k in range(len(langs))]
        told.append((ll, max(range(len(langs)), key=lambda k: (ll[k], -k)) if n else None, where))
    votes = [Counter((w[i], best) for _, best, w in told if best is not None) for i in range(4)]
    total = [sum(best == k for _, best, _ in told) for k in range(len(langs))]
    kinds = [len({w[i] for _, _, w in told}) for i in range(4)]
    out = []
    for ll, best, where in told:
        own = [int(best == k) for k in range(len(langs))]
        less = lambda i: [votes[i][where[i], k] - own[k] for k in range(len(langs))]  # noqa: E731, B023
        share = lambda x: [v / sum(x) for v in x]
        domain = share([a + strength * (t + 1) / (sum(total) + len(langs)) for a, t in zip(less(1), total)])
        host = share([a + strength * d for a, d in zip(less(0), domain)])
        logp = [ll[k] + math.log(host[k]) + sum(math.log((less(i)[k] + 1) / (total[k] - own[k] + kinds[i])) for i in (2, 3)) for k in range(len(langs))]
        top = max(logp)
        out.append((None if best is None else langs[best], langs[logp.index(top)], 1 / sum(math.exp(x - top) for x in logp)))
    return out
