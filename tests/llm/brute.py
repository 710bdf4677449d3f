"""Plain Python counterparts of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def shingle_set(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


def classes(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(id, n_shingles, component_id) by comparing every two texts."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    holders: dict[tuple[str, ...], list[int]] = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = set()
    for group in holders.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)
