"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_duplicates(docs, width, percent):
    """{doc_id: (set sizes, component)} for ids that are not null; rows with one id are one document."""
    rows = [(i, shingles(t, width)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            n = len(s & t)
            if s and t and 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in rows}


def repeats(docs, width):
    """(n_bytes, n_removed, n_spans, rest) for each text."""
    raw = [(t or "").encode() for t in docs]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b))), rest))
    return out


def contamination(docs, items, window=13):
    """(n_words, n_hit, n_items, sha256, contaminated) for each text."""
    windows = defaultdict(set)
    for item, text in items:
        w = LETTERED.findall((text or "").translate(LOW))
        if item is not None:
            for i in range(max(1, len(w) - window + 1) if w else 0):
                windows[tuple(w[i : i + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w = LETTERED.findall((text or "").translate(LOW))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def plain_passages(texts, words=51, width=400):
    """What the pipeline's stage leaves: no byte of a repeated passage of 51 words, or of 400 bytes."""
    raw = [(t or "").encode() for t in texts]
    spans, seen = [], Counter()
    for b in raw:
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        spans.append([("words", x[0], y[1]) for x, y in zip(w, w[words - 1 :])] + [("bytes", i, i + width) for i in range(len(b) - width + 1)])
        seen.update((kind, b[x:y]) for kind, x, y in spans[-1])
    out = []
    for b, s in zip(raw, spans):
        gone = bytearray(len(b))
        for kind, x, y in s:
            if seen[kind, b[x:y]] > 1:
                gone[x:y] = b"\1" * (y - x)
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def drop_repeats(rows, words=51, width=400):
    """(id, text) rows that the pipeline's stage leaves."""
    left = plain_passages([t for _, t in rows], words, width)
    return [(i, new if t is not None else None) for (i, t), new in zip(rows, left) if new or not t]


class Languages:
    """Word likelihoods from byte trigrams and EM over sets of languages, one document at a time."""

    def __init__(self, rows, bits, alpha, bucket):
        self.bucket, counts = bucket, defaultdict(Counter)
        for text, lang in rows:
            counts[lang].update(g for w in self.words(text) for g in w)
        self.langs = sorted(counts)
        total = {k: sum(c.values()) + alpha * 2**bits for k, c in counts.items()}
        self.p = lambda k, g: math.log((counts[k][g] + alpha) / total[k])

    def words(self, text):
        """Buckets of the trigrams of each word: letters a-z (lower-cased) and bytes over 127, with an edge on either side."""
        for w in re.findall(rb"[a-z\x80-\xff]+", bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())):
            b = b" " + w + b" "
            yield [self.bucket(b[i], b[i + 1], b[i + 2]) for i in range(len(w))]

    def fit(self, like, langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(500):
            new = dict.fromkeys(langs, 0.0)
            for x in like:
                total = sum(x[k] * share[k] for k in langs)
                for k in langs:
                    new[k] += x[k] * share[k] / total / len(like)
            share = new
        return share, sum(math.log(sum(x[k] * share[k] for k in langs)) for x in like)

    def predict(self, text):
        """(language, its share)"""
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        like = []
        for w in self.words(text):
            v = {k: sum(self.p(k, g) for g in w) for k in self.langs}
            like.append({k: math.exp(max(x - max(v.values()), -60)) for k, x in v.items()})
        every, _ = self.fit(like, self.langs)
        order = sorted(self.langs, key=lambda k: -every[k])
        fits = [(*self.fit(like, order[: n + 1]), n) for n in range(len(order))]
        share = max(fits, key=lambda f: f[1] - 0.5 * f[2] * math.log(max(len(like), 2)))[0]
        return max(share.items(), key=lambda x: x[1])
