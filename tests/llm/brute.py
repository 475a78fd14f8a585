"""Plain restatements of what the corpus operators return, one document at a time."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = [False] * len(w)
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            covered[k : k + 3] = [True] * 3
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, sum(covered), len(w) < 50 or 100 * sum(covered) > 50 * len(w)


def kept_bytes(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of (doc_id, text)."""
    first, out = {}, {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, b in texts:
        for k in range(len(b) - window + 1):
            x = b[k : k + window]
            first[x] = min(first.get(x, d), d)
    for d, b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < d:
                mask[k : k + window] = b"\1" * window
        out[d] = len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), sha(bytes(x for x, m in zip(b, mask, strict=True) if not m))
    return out


def kept_words(docs, window=20):
    """{doc_id: (n_words, n_removed, sha256)}."""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        mask = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (d, k)) != (d, k):
                mask[k : k + window] = [True] * window
        out[d] = len(w), sum(mask), sha(" ".join(x for x, m in zip(w, mask, strict=True) if not m).encode())
    return out


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    """{item: smallest item reachable}."""
    items = sorted(items)
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return [sum(x[0] == k for x in found) for k in kinds], ",".join(f"{k}:{a}:{b}" for k, a, b in found)
