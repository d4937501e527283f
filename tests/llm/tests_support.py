"""Plain versions of operators that several tests hold results against."""

import collections
import hashlib
import re

LOW = {c: c + 32 for c in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(t):
    w = SPACE_WORD.findall((t or "").translate(LOW))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def roots_of(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def contamination_brute(rows, items):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    out = {}
    for i, t in rows:
        w = ALNUM_WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        near = {x for k, names in windows.items() for s in range(len(w)) if set(k) <= set(w[s : s + len(k) + 5]) for x in names}
        digest = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest(found), bool(hit) and 20 * len(hit) >= len(w), len(near), digest(near))
    return out
