"""Plain Python versions of the operators, written from their contracts, for small inputs."""

from __future__ import annotations

import hashlib

import xxhash

SPACES = b" \t\n\x0b\x0c\r"


def tokens(text):
    out, now = [], b""
    for ch in (text or "").encode():
        if ch in SPACES:
            if now:
                out.append(now)
            now = b""
        else:
            now += bytes([ch])
    return [*out, now] if now else out


def simhash(text):
    w = tokens("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}."""
    fp = {d: simhash(t) for d, t in rows}
    ids, up = sorted(fp), {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def substring_dedup(rows, size=13):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    words = {d: tokens(t) for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def mix(rows, weights=(5, 2, 1)):
    """rows: (doc_id, source, text) -> (doc_id, size, source_size, target, taken) per row, by water-filling and one sorted pass per source."""
    sized = [(d, s, len(tokens(t))) for d, s, t in rows]
    total = {}
    for _, s, n in sized:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in order if x not in full)) for s in order if s not in full}
        over = {s for s in share if share[s] >= 3 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * total[s] if s in full else share[s] for s in order}
    out = []
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        f = rest / total[s] if total[s] else 0.0
        ranked = []
        for i, (d, x, n) in enumerate(sized):
            if x == s and n:
                u = (int(hashlib.md5(f"{'null' if d is None else d}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                if 0 < f < 1:
                    ranked.append(((u / (1 - u)) / (n / (n + 32.0) * f / (1 - f)), -1 if d is None else d, n, i))
        more, so_far = set(), 0
        for _, _, n, i in sorted(ranked):
            if so_far + n > rest:
                if so_far + n - rest <= rest - so_far:
                    more.add(i)
                break
            so_far += n
            more.add(i)
        out += [(d, n, total[s], target[s], n * (whole + (i in more)) if n else 0) for i, (d, x, n) in enumerate(sized) if x == s]
    return out
