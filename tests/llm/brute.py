"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked(n: int, link) -> list[int]:
    """The smallest index of each index's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [shingles(t) for _, t in docs]
    alike = lambda i, j: docs[i][0] is not None and docs[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    roots = linked(len(docs), alike)
    smallest = {}
    for (doc_id, _), r in zip(docs, roots):
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return [(doc_id, len(s), smallest[r] if doc_id is not None else None) for (doc_id, _), s, r in zip(docs, sets, roots)]


def targets(sizes: dict, budget=1.5, repeats=2) -> dict:
    """Shares by weight, what exceeds a cap dealt out again until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = budget * sum(sizes.values()), set()
    while True:
        left = goal - sum(repeats * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        share = {s: repeats * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and share[s] > repeats * sizes[s]}
        if not over:
            return share
        full |= over


def taken(docs: list[tuple]) -> list[int]:
    """Words the mix takes of (doc_id, source, text), in the order given."""
    size = [len(WORD.findall(t or "")) for _, _, t in docs]
    sizes = {}
    for (_, s, _), n in zip(docs, size):
        sizes[s] = sizes.get(s, 0) + n
    goal = {s: int(t + 0.5) for s, t in targets(sizes).items()} if docs else {}
    out, used = [0] * len(docs), {}
    order = sorted(range(len(docs)), key=lambda i: (hashlib.md5(str(docs[i][0]).encode()).hexdigest(), docs[i][0], size[i]))
    for _ in range(2):
        for i in order:
            s = docs[i][1]
            more = min(size[i], goal[s] - used.get(s, 0))
            out[i] += more
            used[s] = used.get(s, 0) + more
    return out
