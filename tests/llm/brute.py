"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def folded(text):
    return WORD.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, benchmark):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = folded(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i:i + 10])].add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, items = folded(text), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= ids
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def repeats(docs, window=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    owner = {}
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i:i + window])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if owner[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near_links(docs, least=0.8):
    """Links of each document, and the first document it hangs together with."""
    sets = []
    for _, t in docs:
        w = folded(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(docs)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    return links, root


def near_duplicates(docs, least=0.8):
    links, root = near_links(docs, least)
    least_id = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least_id[root[i]].append(d)
    return [(d, min(least_id[root[i]], default=None), len(links[i])) for i, (d, _) in enumerate(docs)]


def top_products(vectors, every=20, k=20):
    import math

    whole = [(i, tuple(math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in v)) for i, v in vectors
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked, out = {w for w in whole if w[0] % every == 0}, []
    for q in {i for i, _ in asked}:
        scores = [(-sum(a * b for a, b in zip(mine, v)), i) for j, mine in asked if j == q for i, v in whole if i != q and len(v) == len(mine)]
        out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def same(frame, expected):
    got, expected = Counter(tuple(r) for r in frame.collect()), Counter(expected)
    assert got == expected, (list((got - expected).items())[:5], list((expected - got).items())[:5])
