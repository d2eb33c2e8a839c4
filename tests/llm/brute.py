"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    b = (text or "").encode()
    if lower:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return WORD.findall(b)


def suffix_dedup(docs, width=200):
    """docs: (doc_id, text) rows. Sorted rows of the result."""
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def seed_extend(docs, width=13):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingles(text, n=3):
    w = words(text, lower=True)
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard(docs, percent=90, n_words=3):
    """Component of each row with a doc_id, by comparing all sets."""
    sets = sorted({shingles(t, n_words) for d, t in docs if d is not None} - {frozenset()}, key=len)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if len(a) * 100 < percent * len(b):
                break
            both = len(a & b)
            if both * 100 >= percent * (len(a) + len(b) - both):
                up[root(j)] = root(i)
    of = {s: root(i) for i, s in enumerate(sets)}
    least = {}
    for d, t in docs:
        s = shingles(t, n_words)
        if d is not None and s:
            least[of[s]] = min(least.get(of[s], d), d)
    out = []
    for d, t in docs:
        s = shingles(t, n_words)
        out.append((d, len(s), None if d is None else least[of[s]] if s else d))
    return sorted(out, key=str)


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def contaminated(docs, items, window=12, wrong=2):
    """doc row number -> items that overlap it."""
    out = defaultdict(set)
    known = [(i, tokens(t)) for i, t in items]
    for r, (_, text) in enumerate(docs):
        d = tokens(text)
        for i, t in known:
            for shift in range(-(len(t) - window), len(d) - window + 1):
                same = [d[shift + j] == t[j] if 0 <= shift + j < len(d) else None for j in range(len(t))]
                if any(None not in same[s : s + window] and sum(same[s : s + window]) >= window - wrong for s in range(len(t) - window + 1)):
                    out[r].add(i)
                    break
    return out


def number(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:12], 16)


def poisson_counts(rows, seed, temper=0.5):
    """rows: (doc_id, source). Count of each row."""
    sizes = Counter(s or "" for _, s in rows)
    weight = {s: n**temper for s, n in sizes.items()}
    total = sum(weight.values())
    out = []
    for d, s in rows:
        rate = len(rows) * weight[s or ""] / total / sizes[s or ""]
        u, k, term = number(seed, d) / 2**48, 0, math.exp(-rate)
        cdf = term
        while cdf <= u:
            k += 1
            term *= rate / k
            cdf += term
        out.append(k)
    return out


def losses(docs, good, prior=2.0, least=2):
    """(n_words, target bits, background bits) of each row, with its own counts left out."""
    texts = [[w for w in words(t, lower=True)] for _, t in docs]
    every = Counter(w for t in texts for w in t)
    vocabulary = {w for w, n in every.items() if n >= least}
    target = [d is not None and d in good for d, _ in docs]

    def counts(members):
        one, two = Counter(), Counter()
        for t, m in zip(texts, members):
            if m:
                one.update(t)
                two.update(zip(t, t[1:]))
        return one, two

    models = [(counts(target), target), (counts([True] * len(docs)), [True] * len(docs))]
    out = []
    for r, t in enumerate(texts):
        if not t:
            out.append((0, None, None))
            continue
        own_one, own_two, bits = Counter(t), Counter(zip(t, t[1:])), []
        for (one, two), member in models:
            m = member[r]
            size = sum(one.values()) - (len(t) if m else 0)
            rare = sum(n for w, n in one.items() if w not in vocabulary) - (sum(w not in vocabulary for w in t) if m else 0)
            total = 0.0
            for i, w in enumerate(t):
                n = one[w] - (own_one[w] if m else 0) if w in vocabulary else rare
                p = (n + 1) / (size + len(vocabulary) + 1)
                if i:
                    v = t[i - 1]
                    c = one[v] - (own_one[v] if m else 0) if v in vocabulary else 0
                    j = two[v, w] - (own_two[v, w] if m else 0) if v in vocabulary and w in vocabulary else 0
                    p = (j + prior * p) / (c + prior)
                total -= math.log2(p)
            bits.append(total / len(t))
        out.append((len(t), *bits))
    return out


def without_common_lines(rows, line_docs=10, line_percent=10):
    """rows: (text, host). Texts without the lines that more than both limits of their host's documents have."""

    def normal(line):
        return b" ".join(words(re.sub("[0-9]", "0", line), lower=True))

    hosts = Counter(h or "" for _, h in rows)
    count = Counter((h or "", n) for t, h in rows for n in {normal(x) for x in (t or "").split("\n")} if n)
    over = {k for k, n in count.items() if n > line_docs and n * 100 > hosts[k[0]] * line_percent}
    return ["\n".join(x for x in (t or "").split("\n") if (h or "", normal(x)) not in over) for t, h in rows]
