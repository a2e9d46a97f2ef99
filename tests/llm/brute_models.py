"""Plain Python versions of the set join, the packing and the code lengths."""

import collections
import math
import re

from brute_native import LOWER


def components(documents, words=4, numerator=85):
    """Per document its set's size and the smallest id reachable by links."""
    sets = {}
    for doc, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = (
            {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words
            else {tuple(w)} if w else set()
        )
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= numerator * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def cheapest(places, penalties, size):
    """Least cost of cutting at some of the places, the last sequence free of padding."""
    at, n = [0, *places], len(places)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            if at[j] - at[i] <= size:
                cost = best[i] + (0 if j == n else penalties[j - 1] + size - (at[j] - at[i]))
                best[j] = min(best[j], cost)
    return best[n]


def ppm_bits(train, text, symbols, order):
    """Code length of ``text`` after ``train`` (lists of symbols), method C with exclusion, frozen."""
    followers = collections.defaultdict(collections.Counter)
    for t in train:
        padded = [0] * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                followers[tuple(padded[i - k:i])][padded[i]] += 1

    def chance(context, symbol):
        if context is None:
            return 1 / symbols
        seen = followers.get(context)
        shorter = context[1:] if context else None
        if not seen:
            return chance(shorter, symbol)
        n, d = sum(seen.values()), len(seen)
        mass = sum(chance(shorter, s) for s in range(symbols) if s not in seen)
        if mass <= 0:
            return seen[symbol] / n
        return seen[symbol] / (n + d) if symbol in seen else d / (n + d) * chance(shorter, symbol) / mass

    padded = [0] * order + text
    return sum(-math.log2(chance(tuple(padded[i - order:i]), padded[i])) for i in range(order, len(padded)))
