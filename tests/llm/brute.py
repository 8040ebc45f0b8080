"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE_WORD.findall(text or "")


def measures(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)] if t else []
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(rows, threshold=0.8):
    """[(class as smallest index, links)] of texts, in order."""
    sets = [shingles(t) for t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(root(i), n) for i, n in enumerate(links)]


def overlaps(texts, items, window=10):
    """[(n_words, n_hit, sorted item ids)] by comparing every place with every window."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def low(t):
        return find.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    queries = []
    for item, text in items:
        w = low(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            queries.append((item, w[i : i + window]))
    out = []
    for text in texts:
        w = low(text)
        hit, found = set(), set()
        for item, q in queries:
            for i in range(len(w) - len(q) + 1):
                if w[i : i + len(q)] == q:
                    hit.update(range(i, i + len(q)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def dedup(rows, size=3):
    """Texts after removal of later windows; rows are (id, text) with distinct ids."""
    first, gone = {}, defaultdict(set)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            continue
        lines = text.split("\n")
        for i in range(max(len(lines) - size, 0) + 1):
            w = tuple(lines[i : i + size])
            if not SPACE_WORD.search("\n".join(w)):
                continue
            if first.setdefault(w, (doc, i)) != (doc, i):
                gone[doc].update(range(i, i + len(w)))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(r.random() ** 2 * vocabulary)}" for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)
