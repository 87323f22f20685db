"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    own, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    runs = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if runs[tuple(own[i : i + 3])] > 1 for k in range(3)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    own = words((text or "").translate(LOWER))
    if not own:
        return set()
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def near_duplicates(docs: list[tuple], width: int, percent: int) -> set[tuple]:
    sets = [shingles(text, width) for _, text in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for k in range(i):
            a, b = sets[i], sets[k]
            linked = a and b and 100 * len(a & b) >= percent * len(a | b)
            if docs[i][0] is not None and docs[k][0] is not None and (linked or docs[i][0] == docs[k][0] and a and b):
                parent[root(i)] = root(k)
    least = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[root(i)].append(key)
    return {(key, len(sets[i]), None if key is None else min(least[root(i)])) for i, (key, _) in enumerate(docs)}


def clean(docs: list[tuple], items: list[str | None], width: int = 13, percent: int = 5) -> list[tuple]:
    """Documents of which benchmark windows cover less than the share, or nothing."""
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    windows = defaultdict(set)
    for own in map(cut, items):
        size = min(width, len(own))
        windows[size] |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1) if size}
    out = []
    for key, text in docs:
        own = cut(text)
        hit = {i + k for size, found in windows.items() for i in range(len(own) - size + 1)
               if tuple(own[i : i + size]) in found for k in range(size)}
        if not hit or 100 * len(hit) < percent * len(own):
            out.append((key, text))
    return out


def removals(docs: list[tuple], width: int) -> list[tuple]:
    first = {}
    for key, text in docs:
        own = words(text)
        for i in range(len(own) - width + 1):
            if key is not None:
                run = tuple(own[i : i + width])
                first[run] = min(first.get(run, key), key)
    out = []
    for key, text in docs:
        own, gone = words(text), set()
        for i in range(len(own) - width + 1):
            if key is not None and first[tuple(own[i : i + width])] < key:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((key, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
