"""Plain Python versions of the operators' definitions."""

from __future__ import annotations

import re
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = spaced_words((text or "").translate(LOW))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def groups(docs, size, percent):
    """{doc_id: (set size, smallest linked id)} from all pairs; ids must be distinct."""
    sets = {i: shingles(t, size) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, bench, size=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = letter_words(text)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k:k + m])].add(item)
    out = []
    for doc, text in docs:
        w, hit, items = letter_words(text), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k:k + m])):
                    hit |= set(range(k, k + m))
                    items |= own
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


def line_drops(docs, min_docs=5, min_chars=40):
    """[(doc_id, kept text, lines, dropped)]"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                held[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != doc  # noqa: E731,B023
        kept = [x for x in lines if not gone(x)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def base_statistics(text):
    w = spaced_words(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for k in range(len(w) - 4):
        windows[tuple(w[k:k + 5])].append(k)
    covered = {p for v in windows.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
