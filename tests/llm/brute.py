"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import unicodedata
import zlib

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == 2


def shingle_sets(texts):
    out = []
    for text in texts:
        w = words((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def components(rows):
    """rows of (doc_id, text) -> list of (set size, smallest doc_id linked)."""
    sets, parent = shingle_sets([t for _, t in rows]), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    postings = collections.defaultdict(list)
    for i, own in enumerate(sets):
        shared = collections.Counter()
        for s in own:
            shared.update(postings[s])
            postings[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(len(sets[i]), least.get(top(i))) for i in range(len(rows))]


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def kept_lines(rows):
    """rows of (doc_id, text) -> list of kept texts and numbers of lines."""
    holders = collections.defaultdict(list)
    for n, (d, text) in enumerate(rows):
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                holders[key].append((n, d))
    out = []
    for d, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            found = holders.get(line_key(line), [])
            ids = [x for _, x in found if x is not None]
            if len(found) >= 3 and d != (max(ids) if ids else None):
                continue
            kept.append(line)
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def targets(sizes):
    """{source: size} -> {source: target}, resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        out.update({s: 3.0 * sizes[s] for s in over})
        left -= sum(out[s] for s in over)
        free -= over
    return out


def branches_of(text):
    """Sections of a text as sets of (digest, leaves): the tree of op1 in plain Python."""
    paragraphs, found = [[]], []
    for leaf in re.findall(r"[^.!?\n]{1,48}[.!?\n]*|[.!?\n]+", text):
        paragraphs[-1].append(sha(leaf))
        if leaf.endswith("\n\n") or (leaf.endswith("\n") and xxhash.xxh64_intdigest(leaf.encode(), 42) % 8 == 0):
            found.append(paragraphs)
            paragraphs = [[]]
        elif leaf.endswith("\n"):
            paragraphs.append([])
    found.append(paragraphs)
    return [(sha("".join(sha("".join(p)) for p in s)), tuple(x[:16] for p in s for x in p)) for s in found]


def likeness(one, other):
    a, b = set(branches_of(one)), set(branches_of(other))
    same = sum(len(x) for _, x in a & b)
    here, there = ({leaf for _, x in s for leaf in x} for s in (a - b, b - a))
    whole = 2 * same + len(here) + len(there)
    return 2 * (same + len(here & there)) / whole if whole else 1.0


def language_ranks(text):
    """n-grams of one to three letters of a text in order of frequency, then of code points."""
    grams = collections.Counter()
    for letters, word in itertools.groupby((text or "").lower(), lambda c: unicodedata.category(c)[0] == "L"):
        if not letters:
            continue
        points = [32, *map(ord, word), 32]
        grams.update((0, 0, p) for p in points[1:-1])
        grams.update((0, a, b) for a, b in zip(points, points[1:]))
        grams.update(zip(points, points[1:], points[2:]))
    return grams


def languages(rows, size, held):
    """doc_id -> (language, score) of rows (doc_id, text, lang), by profiles of those not held out."""
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
    learned = collections.defaultdict(collections.Counter)
    for d, text, lang in rows:
        if lang is not None and not held(d):
            learned[lang].update(language_ranks(text))
    learned = {k: c for k, c in learned.items() if c}
    places = {k: {g: i for i, g in enumerate(order(c))} for k, c in learned.items()}
    out = {}
    for d, text, _ in rows:
        own = order(language_ranks(text))
        away = {k: sum(min(abs(p[g] - i), size) if g in p else size for i, g in enumerate(own)) for k, p in places.items()}
        best = min(sorted(away), key=away.get) if own and away else "und"
        out[d] = (best, 1 - away[best] / (size * len(own)) if own and away else 0.0)
    return out
