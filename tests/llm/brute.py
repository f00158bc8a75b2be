"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed_repeats(rows, window=20):
    """{(doc_id, text): (n_words, n_removed, sha256 of the kept words)} for rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def simhash(text):
    import xxhash
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [w[i:i + 4] for i in range(len(w) - 3)] or [w]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """{id: smallest id reachable} for the pairs ``linked``."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(rows, distance=4):
    fps = {i: simhash(t) for i, t in rows}
    ids = sorted(fps)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= distance]
    label = components(ids, linked)
    return {i: (f"{fps[i]:016x}", label[i]) for i in ids}
