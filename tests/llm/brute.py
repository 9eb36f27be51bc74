"""Slow, plain versions of the operators, written from their definitions."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, size=3):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(prints, k=2):
    """Smallest number reachable over links of k or fewer bits, for each distinct fingerprint."""
    prints = sorted(set(prints))
    edges = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= k]
    return roots(prints, edges)


class Katz:
    """The bigram backoff model with dictionaries."""

    def __init__(self, docs, k=5):
        import zlib
        from collections import Counter

        self.k = k
        self.held = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 10 == 0
        self.uni, self.pair = Counter(), Counter()
        for d, text in docs:
            if not self.held(d):
                t = self.tokens(text)
                self.uni.update(t)
                self.pair.update(zip([None, *t], t))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.context = Counter()
        for (h, _), c in self.pair.items():
            self.context[h] += c
        self.low1, self.low2 = self.discounts(self.uni), self.discounts(self.pair)
        self.unknown = 1 - sum(self.cut(c, self.low1) for c in self.uni.values()) / self.n if self.n else 1.0
        self.after = {}
        for (h, w), c in self.pair.items():
            self.after.setdefault(h, []).append((w, c))
        self.alpha = {}
        for h, own in self.after.items():
            left = 1 - sum(self.cut(c, self.low2) for _, c in own) / self.context[h]
            self.alpha[h] = left / (1 - sum(self.p1(w) for w, _ in own))

    @staticmethod
    def tokens(text):
        return [*WORD.findall(lower(text)), 0]

    def discounts(self, counts):
        """Good-Turing from a straight line through the logarithms of the counts of counts."""
        import math
        from collections import Counter

        n, k = Counter(counts.values()), self.k
        points = [(math.log(r), math.log(n[r])) for r in range(1, k + 2) if n[r]]
        b = -2.0
        if len(points) > 1:
            mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
            b = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
        smooth = [0, *[r ** min(b, -1.1) for r in range(1, k + 2)]]
        cut = (k + 1) * smooth[k + 1] / smooth[1]
        star = [(r + 1) * smooth[r + 1] / smooth[r] for r in range(1, k + 1)]
        return [0, *[r * (s / r - cut) / (1 - cut) for r, s in enumerate(star, 1)]]

    def cut(self, c, low):
        return low[c] if c <= self.k else c - 0.5

    def p1(self, w):
        return self.cut(self.uni[w], self.low1) / self.n if w in self.uni else self.unknown

    def p2(self, h, w):
        if h not in self.context:
            return self.p1(w)
        if (h, w) in self.pair:
            return self.cut(self.pair[h, w], self.low2) / self.context[h]
        return self.alpha[h] * self.p1(w)

    def score(self, text):
        from math import log10

        t = self.tokens(text)
        base = sum(log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return len(t), sum(w in self.uni for w in t), base, sum(log10(self.p2(h, w)) for h, w in zip([None, *t], t))


def repeat_words(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)})


def quality_kept(docs, host_limit=0.8):
    """Identifiers of the (id, text, host) rows that document and host rules keep."""
    facts = {}
    for d, text, host in docs:
        facts[d] = (len(WORD.findall(text or "")), repeat_words(text), sum(c in "#*$%&|<>" for c in text or ""), host)

    def broken(n, repeats, symbols, s=1.0):
        return n < 20 * s or 100 * repeats * s > 30 * n or symbols * s > 0.5 * n

    hosts = {}
    for n, repeats, symbols, host in facts.values():
        f, k = hosts.get(host, (0, 0))
        hosts[host] = (f + broken(n, repeats, symbols), k + 1)
    alpha = beta = 1.0
    failed, every = sum(f for f, _ in hosts.values()), sum(k for _, k in hosts.values())
    if len(hosts) > 1 and 0 < failed < every:
        mean, rates = failed / every, [f / k for f, k in hosts.values()]
        centre = sum(rates) / len(rates)
        spread = sum((r - centre) ** 2 for r in rates) / (len(rates) - 1)
        noise = mean * (1 - mean)
        between = max(spread - noise * sum(1 / k for _, k in hosts.values()) / len(hosts), noise * 1e-4)
        strength = max(noise / between - 1, 1.0)
        alpha, beta = mean * strength, (1 - mean) * strength
    rate = {h: (f + alpha) / (k + alpha + beta) for h, (f, k) in hosts.items()}
    return {
        d for d, (n, repeats, symbols, h) in facts.items()
        if rate[h] <= host_limit and not broken(n, repeats, symbols, max(1.0, rate[h] / (alpha / (alpha + beta))))
    }
