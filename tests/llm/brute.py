"""Plain versions of the corpus operators' contracts, one text or all pairs at a time."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def crc(text):
    return zlib.crc32((text or "").encode())


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = words(w)
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Index of each item's component; links of all pairs at most four bits apart."""
    v = np.array(prints, np.uint64)
    label = np.arange(len(v))
    while True:
        before = label.copy()
        for i in range(len(v)):
            near = np.bitwise_count(v ^ v[i]) <= 4
            label[near] = label[near].min()
        if (label == before).all():
            return label


def removed(texts, size=35):
    """Per text: number of words, removed ones, digest of the kept ones."""
    split = [words(t) for t in texts]
    count = {}
    for w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            count[k] = count.get(k, 0) + 1
    found = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        found.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    """Base spans (start, kind, end) in order."""
    text, found = text or "", []
    only = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and _luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    ]
    for k, (kind, pattern, fine) in enumerate(kinds):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if fine(m.group())]
    return [(kind, s, e) for s, k, kind, e in sorted(found)]


def shingle_groups(texts, size=5, least=0.8):
    """Index of each text's component; links of all pairs of texts whose shingle sets are similar."""
    sets = []
    for text in texts:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            alike = a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b))
            if alike and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label
