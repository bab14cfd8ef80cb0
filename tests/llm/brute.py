"""Plain-Python restatements that operators are checked against."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w, text = words(text), text or ""
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(hit)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep,
            n < 50 or 100 * rep > 50 * n)


def secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ("assign", "access", "hex")
    found.sort()
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
    return (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def all_secrets(text, ratios, margin=12.0):
    """(start, kind, end) of the fixed patterns, and of tokens that the pair ratios call random."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= 16 and not any(s < m.end() and m.start() < e for s, _, e in found):
            at = [alphabet.index(c) for c in m[0]]
            if sum(ratios[a * len(alphabet) + b] for a, b in zip(at, at[1:])) >= margin:
                more.append((m.start(), 3, m.end()))
    return sorted(found + more)


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: {source: size}. Deals by weight, again and again, until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free and rest > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = 0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target
