"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

FOLD = {c: c + 32 for c in range(65, 91)}


def split(text):
    return (text or "").encode().split()


def union(n, links):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def shingles(text, n):
    w = [bytes(FOLD.get(c, c) for c in x) for x in split(text)]
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_groups(texts, n, percent):
    """Sizes of the sets, and the first text of each text's group."""
    sets = [shingles(t, n) for t in texts]
    holds = defaultdict(list)
    links = []
    for k, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in holds[g]).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                links.append((j, k))
        for g in s:
            holds[g].append(k)
    return [len(s) for s in sets], union(len(texts), links)


def without_windows(texts, n):
    """Per text: words, removed words, digest of the rest."""
    rows = [split(t) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in rows for k in range(len(w) - n + 1))
    out = []
    for w in rows:
        go = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                go.update(range(k, k + n))
        out.append((len(w), len(go), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in go)).hexdigest()))
    return out


def without_strings(texts, n):
    """Per text, in order: bytes, removed bytes, spans, digest of the rest."""
    seen, out = set(), []
    for t in texts:
        d = (t or "").encode()
        go = bytearray(len(d))
        for k in range(len(d) - n + 1):
            w = d[k : k + n]
            if w in seen:
                go[k : k + n] = b"\x01" * n
            seen.add(w)
        spans = sum(1 for k, g in enumerate(go) if g and not (k and go[k - 1]))
        out.append((len(d), sum(go), spans, hashlib.sha256(bytes(x for x, g in zip(d, go) if not g)).hexdigest()))
    return out


def vector_links(vectors, least):
    """Per vector: links, first of its component."""
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok)]
    links = [(a, b) for b in range(len(vectors)) for a in range(b) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = Counter(x for link in links for x in link)
    return [n[k] for k in range(len(vectors))], union(len(vectors), links)


def packing_is_valid(pieces, capacity):
    """Number of sequences of (sequence_id, offset, length) rows that lie in them without gaps."""
    held = defaultdict(list)
    for s, o, n in pieces:
        held[s].append((o, n))
    for rows in held.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)
