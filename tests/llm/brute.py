"""Plain versions of the operators, for tests."""

import re
from collections import Counter, defaultdict
from math import log2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard(docs, percent=80):
    """{doc_id: (set size, component)} for unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    lists, classes = defaultdict(list), defaultdict(list)
    for i, s in sorted(sets.items()):
        if s:
            classes[frozenset(s)].append(i)
    reps = {v[0]: k for k, v in classes.items()}
    edges = [(v[0], x) for v in classes.values() for x in v[1:]]
    for i, s in reps.items():
        for x in s:
            lists[x].append(i)
    both = defaultdict(int)
    for ids in lists.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    edges += [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(reps[a]) + len(reps[b]) - n)]
    top = roots(sets, edges)
    return {i: (len(s), top[i]) for i, s in sets.items()}


def entropy_spans(text, known):
    """Spans of high-entropy windows beside known spans: (start, end)."""
    text, out = list(text), []
    for a, b in known:
        text[a:b] = " " * (b - a)
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", "".join(text)):
        bounds = [(m.start(), m.end()) for m in re.finditer(r"(?<![^/])[A-Z]?[a-z]{3,}(?=/)|(?i:example|placeholder|sample|dummy|x{6,})", run[0])]
        for a, b in zip([0, *(e for _, e in bounds)], [*(s for s, _ in bounds), len(run[0])], strict=True):
            piece = run[0][a:b]
            if b - a < 20 or re.fullmatch(r"[0-9_=+/-]+|[A-Za-z_=+/-]+|[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{0,8}", piece):
                continue
            least = 2.8 if re.fullmatch("[0-9a-fA-F]+", piece) else 3.6
            bits = [-sum(n / 20 * log2(n / 20) for n in Counter(piece[i : i + 20]).values()) for i in range(len(piece) - 19)]
            good = [i for i, x in enumerate(bits) if x >= least - 1e-9]
            if good:
                out.append((run.start() + a + good[0], run.start() + a + good[-1] + 20))
    return out
