"""What the operators should return, by the plainest means, for small tables: lists of (doc_id, text)."""

import hashlib
import re
from collections import defaultdict


def sha(b):
    return hashlib.sha256(b).hexdigest()


def op1(docs, width=13):
    first, words = {}, {}
    for n, (i, t) in enumerate(docs):
        words[n] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for j in range(len(words[n]) - width + 1):
            w = tuple(words[n][j : j + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for n, (i, t) in enumerate(docs):
        w, gone = words[n], set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def op2(docs, items, width=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, lower(t))
        k = min(width, len(w))
        for j in range(len(w) - k + 1) if k else ():
            windows[tuple(w[j : j + k])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, ids = re.findall(pattern, lower(t)), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    hit.update(range(j, j + k))
                    ids |= windows[x]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return out


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(sets):
    """Links of (id, set), by an inverted index."""
    where, size = defaultdict(list), {i: len(s) for i, s in sets}
    links = []
    for i, s in sets:
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                both[j] += 1
            where[x].append(i)
        links += [(i, j) for j, n in both.items() if 100 * n >= 80 * (size[i] + size[j] - n)]
    return links


def op4(docs, width=2):
    sets = [(i, shingles(t, width)) for i, t in docs]
    comp = components([i for i, _ in sets], near(sets))
    return [(i, len(s), comp[i], comp[i] == i) for i, s in sets]


def op9(docs, width=400):
    count = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for j in range(len(b) - width + 1):
            count[b[j : j + width]] += 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if count[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def op10(docs):
    places, sets = defaultdict(list), {}
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if t is not None and x.strip(" \t\n\r\x0b\x0c"):
                places[x].append((i, n))
                sets[x] = {x[j : j + 5] for j in range(len(x) - 4)} or {x}
    names = sorted(places, key=lambda x: min(places[x]))
    comp = components(range(len(names)), near([(n, sets[x]) for n, x in enumerate(names)]))
    keep, gone = {}, defaultdict(set)
    for n, x in enumerate(names):
        keep[comp[n]] = min(keep.get(comp[n], (1 << 62, 0)), min(places[x]))
    for n, x in enumerate(names):
        for i, j in places[x]:
            if (i, j) != keep[comp[n]]:
                gone[i].add(j)
    out = []
    for i, t in docs:
        x = [] if t is None else t.split("\n")
        kept = "\n".join(y for n, y in enumerate(x) if n not in gone[i])
        out.append((i, len(x), len(gone[i]), sha(kept.encode())))
    return out


def op8(rows, k=20, each=20):
    import numpy as np

    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = []
    for q in np.flatnonzero(ids % each == 0):
        s = (x * x[q]).cumsum(1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out
