"""Plain versions of the text operators, for small inputs."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k=5):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, percent=75):
    """{row number: (n_shingles, component id)} by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + s for i, w in enumerate(windows) if count[w] > 1 for s in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def suffix_rows(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    rows = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        rows.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return rows


def leaks(docs, items, k=5):
    def bag(w):
        return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    found = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for item, text in items:
            x = WORD.findall((text or "").lower())
            size = len(x)
            s = min(k, size)
            if not x or len(w) < s:
                continue
            want = collections.Counter(tuple(x[i:i + s]) for i in range(size - s + 1))
            for at in range(max(1, len(w) - size + 1)):
                part = w[at:at + size]
                have = collections.Counter(tuple(part[i:i + s]) for i in range(len(part) - s + 1))
                both, every = sum((have & want).values()), sum((have | want).values())
                if both and 100 * both >= 75 * every:
                    found.add((d, item))
                    break
    return found


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / open_weight if open_weight else 0
        over = {s for s in order if s not in full and level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def crc(text):
    return zlib.crc32((text or "").encode())
