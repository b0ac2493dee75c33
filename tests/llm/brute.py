"""Plain versions of the operators over Python lists, for comparison."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def near(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t).encode())
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def substrings(docs, size=13):
    words = {i: WORD.findall((t or "").encode()) for i, t in docs}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][j : j + size]), i)
    out = {}
    for i, w in words.items():
        cut = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                cut[j : j + size] = [True] * size
        out[i] = (len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode())
    return out


def contamination(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = {}
    for i, t in docs:
        w = ITEM_WORD.findall(lower(t))
        cut, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                got = windows.get(tuple(w[j : j + k]))
                if got:
                    found |= got
                    cut[j : j + k] = [True] * k
        out[i] = (len(w), sum(cut), sorted(found), cut)
    return out


def cut_spans(text, cut):
    """Text without every run of hit words, from the first word's start to the last one's end."""
    places = [m.span() for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+", text or "")]
    out, at, j = [], 0, 0
    while j < len(cut):
        if cut[j]:
            e = j
            while e + 1 < len(cut) and cut[e + 1]:
                e += 1
            out.append(text[at : places[j][0]])
            at, j = places[e][1], e + 1
        else:
            j += 1
    return "".join(out) + text[at:]


def lines(docs, size=3):
    seen, out = set(), {}
    for i, t in sorted(docs):
        rows = t.split("\n")
        gone = set()
        for p in range(len(rows) - size + 1):
            w = tuple(rows[p : p + size])
            if w in seen:
                gone |= set(range(p, p + size))
            seen.add(w)
        out[i] = (len(rows), len(gone), "\n".join(r for k, r in enumerate(rows) if k not in gone) if gone else t)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
