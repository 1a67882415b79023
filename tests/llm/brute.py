"""Plain versions of the operators, one text or pair at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def jaccard(rows):
    """Sorted (doc_id, n, component, links) of (doc_id, text) rows."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def cut_repeats(rows, length=50):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if d is not None:
                first[w] = min(first.get(w, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def secrets(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def closure(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    low = {}
    for start in sorted(near):
        if start not in low:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in low:
                    low[x] = start
                    todo += near[x]
    return low


class KneserNey:
    """Two classes of words, letter by letter: six bytes of each class over the shared
    continuation counts of five and fewer, by the textbook's formulas."""

    def __init__(self, words, discount=0.75):
        """words: (word, class) pairs, repeated as often as they occur."""
        self.d, self.top, self.shared = discount, (Counter(), Counter()), {}
        for w, c in words:
            self.top[c].update(self.grams(w))
        seen = set(self.top[0]) | set(self.top[1])
        for order in range(5, 0, -1):
            self.shared[order] = Counter(g[1:] for g in seen)
            seen = set(self.shared[order])
        self.after = {k: self.follow(t) for k, t in [*self.shared.items(), ("0", self.top[0]), ("1", self.top[1])]}

    @staticmethod
    def grams(word):
        raw = b"     " + word + b" "
        return [raw[i : i + 6] for i in range(len(raw) - 5)]

    @staticmethod
    def follow(counts):
        out = defaultdict(lambda: [0, 0])
        for g, n in counts.items():
            out[g[:-1]][0] += n
            out[g[:-1]][1] += 1
        return out

    def mix(self, counts, after, gram, low):
        n, f = after.get(gram[:-1], (0, 0))
        return (max(counts[gram] - self.d, 0) + self.d * f * low) / n if n else low

    def p(self, gram, order):
        return self.mix(self.shared[order], self.after[order], gram, self.p(gram[1:], order - 1)) if order else 1 / 256

    def evidence(self, word, margin):
        total = 0.0
        for g in self.grams(word):
            low = self.p(g[1:], 5)
            zero, one = (self.mix(self.top[c], self.after[str(c)], g, low) for c in (0, 1))
            total += math.log(one) - math.log(zero)
        return max(0.0, total / max(3, len(word) + 1) - margin)
