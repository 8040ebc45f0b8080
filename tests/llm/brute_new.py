"""Plain Python versions of periodic runs, shared strings and conversation repair, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

_INK = re.compile(r"[^\x20\x09-\x0D]")


def runs(w, exponent=4, least=6):
    """(start, length, period) of the maximal runs of a list of words."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            s = w[i : i + n]
            if j > i and n >= max(least, exponent * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def tails(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def removed(rows, size=50):
    """Per (doc_id, bytes): which bytes are covered by strings that also start in a document of smaller id."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            first[s] = min(first.get(s, key(d)), key(d))
    out = []
    for d, t in rows:
        gone = set()
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < key(d):
                gone.update(range(i, i + size))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(t), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in gone)).hexdigest()))
    return out


def faults(rows):
    """Letters of a conversation's rows (turn, role, text), with its counts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, letters, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for _, role, text in rows:
        ink = _INK.findall(text)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not ink:
            n["blank"] += 1
            letter = "x"
        elif (role, text) in seen:
            n["duplicate"] += 1
            letter = "x"
        elif ink[-1] not in ".!?":
            n["truncated"] += 1
            letter = letter.upper()
        seen.add((role, text))
        letters.append(letter)
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return rows, letters, n


def repair(rows):
    """Counts, cost, audit and text of the cheapest repair, by trying all edits up to a cost."""
    rows, letters, n = faults(rows)
    best = None

    def walk(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        roles = "".join(r[:1] for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(x for x in (best, (cost, audit, out)) if x is not None)
        else:
            _, role, text = rows[i]
            letter = letters[i]
            walk(i + 1, cost + 2, audit + "D", out)
            if letter != "x":
                more = 5 * letter.isupper()
                if letter.lower() != "o":
                    walk(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, cost + more + 1, audit + "R", [*out, (new, text)])
        if not audit.endswith("II"):
            for new in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*out, (new, "")])

    best = (2 * len(rows), "D" * len(rows), [])
    walk(0, 0, "", [])
    return n, best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2])


def damaged(conv, turn, role, text):
    spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
    h = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
    _, _, role, text = spaced
    if h == 0:
        return []
    if h in (1, 2):
        text = "" if h == 1 else re.sub("[.!?]", "", text)
    return [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
