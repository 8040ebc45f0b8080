"""External induced sorting of all suffixes of a byte string, with common-prefix values.

Suffixes are sorted as in induced sorting: those that begin a valley of the string (LMS suffixes)
are put in order first; they induce the L suffixes in one ascending sweep, and these the S
suffixes in one descending sweep. To order the LMS suffixes, the stretches between them are
sorted by the same two sweeps, named by rank, and the string of names, at most half as long, is
sorted recursively where names repeat; once it is small it is sorted in memory.

A sweep is driven by a priority queue of tuples (key, position, common prefix): the key is the
bucket of a suffix's first symbol, and within a bucket the order of arrival decides. Tuples wait
in sorted runs in a scratch folder and in an inbox of bounded size; buckets are loaded in ranges
of known size. As many tuples are taken at a time as no tuple they induce can precede.

Common-prefix values: a suffix shares with the one that arrived before it in its bucket one
symbol more than their sources share, which is the least value met between the sources. These
minima come from a table of the last place of each value, since values are capped at ``width``.
Values of LMS neighbours and at the seam of L and S suffixes of one bucket are compared directly.

In memory stand a few numbers for each distinct symbol, the inbox and the loaded range; the
string, its names and the runs are files mapped into memory once they exceed ``memory`` bytes.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

EQUAL = 255  # common-prefix value of stretches without a difference
PIECE = 65_536
_NEVER, _END = -2, -1


class Scratch:
    """Arrays of one task: in memory up to ``memory`` bytes each, else in files that go with the task."""

    def __init__(self, folder: str | None = None, memory: int = 32_000_000):
        self.memory, self.files = memory, 0
        self.folder = f"{folder.rstrip('/')}/induced-{uuid.uuid4().hex}" if folder else None

    def array(self, n: int, dtype) -> np.ndarray:
        if not self.folder or n * np.dtype(dtype).itemsize <= self.memory:
            return np.empty(n, dtype)
        os.makedirs(self.folder, exist_ok=True)
        self.files += 1
        return np.memmap(f"{self.folder}/{self.files}", dtype, "w+", shape=(n,))

    def kept(self, values: np.ndarray) -> np.ndarray:
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out

    def joined(self, parts: Iterator[bytes], padding: int) -> np.ndarray:
        """Pieces of bytes end to end, and zeros behind; beyond ``memory`` they go to a file as they come."""
        held, size, file = [], 0, None
        for part in parts:
            held.append(part)
            size += len(part)
            if self.folder and size > self.memory:
                if file is None:
                    os.makedirs(self.folder, exist_ok=True)
                    self.files += 1
                    file = open(f"{self.folder}/{self.files}", "wb")  # noqa: SIM115
                file.write(b"".join(held))
                held, size = [], 0
        held.append(bytes(padding))
        if file is None:
            return np.frombuffer(b"".join(held), np.uint8)
        with file:
            file.write(b"".join(held))
        return np.memmap(file.name, np.uint8, "r")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def whole(n: int) -> type:
    """The narrowest type here for whole numbers up to ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


class TupleQueue:
    """Tuples (key, position, value) by key, then order of arrival; keys below ``low`` are done."""

    def __init__(self, scratch: Scratch, keys: int, positions: int):
        self.scratch, self.runs, self.inbox, self.waiting, self.low = scratch, [], [], 0, 0
        self.kinds = (whole(keys), whole(positions), np.uint8)
        self.bytes = sum(np.dtype(k).itemsize for k in self.kinds)

    def push(self, tuples: tuple) -> None:
        """Takes tuples that are sorted by key. Parts of the inbox at least halve in size, so they are few."""
        self.waiting += len(tuples[0])
        recent = [tuple(x.astype(k, copy=False) for x, k in zip(tuples, self.kinds, strict=True))]
        while self.inbox and len(self.inbox[-1][0]) < 2 * sum(len(t[0]) for t in recent):
            recent.insert(0, self.inbox.pop())
        self.inbox.append(self._ahead(recent))
        if self.waiting * self.bytes > self.scratch.memory:
            merged = self._ahead(self.inbox)
            self.inbox, self.waiting = [merged], len(merged[0])
            if self.scratch.folder and 2 * self.waiting * self.bytes > self.scratch.memory:
                self.runs.append(tuple(map(self.scratch.kept, merged)))
                self.inbox, self.waiting = [], 0

    def _ahead(self, parts: list[tuple]) -> tuple:
        """Parts as one, without what is done."""
        merged = self._sorted(parts) if len(parts) > 1 else parts[0]
        left = merged[0].searchsorted(self.low)
        return tuple(x[left:] for x in merged) if left else merged

    @staticmethod
    def _sorted(parts: list[tuple]) -> tuple:
        key, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        return key[order], *(x[order] for x in rest)

    def between(self, low: int, high: int) -> Iterator[tuple]:
        """What has arrived with low <= key < high, in order of arrival."""
        for part in (*self.runs, *self.inbox):
            a, b = part[0].searchsorted((low, high)).tolist()
            for at in range(a, b, PIECE):
                yield tuple(np.array(x[at : min(at + PIECE, b)]) for x in part)


def _ranges(counts: np.ndarray, load: int) -> Iterator[tuple[int, int]]:
    """Ranges of keys that hold at most about ``load`` tuples, or one key."""
    keys = np.flatnonzero(counts)
    if not len(keys):
        return
    sizes = counts[keys]
    big = sizes > load // 2
    part = np.cumsum(np.where(big, 0, sizes)) // load
    new = np.r_[True, (np.diff(part) != 0) | big[1:] | big[:-1]]
    starts = keys[new]
    ends = np.r_[starts[1:], keys[-1] + 1]
    ends = np.where(big[new], starts + 1, ends)
    yield from zip(starts.tolist(), ends.tolist(), strict=True)


class _Least:
    """Least value between two places of a sequence that arrives in pieces; values are at most ``cap``."""

    def __init__(self, cap: int):
        self.cap, self.recent, self.passed = cap, np.full(cap + 1, -1), 0

    def since(self, places: np.ndarray) -> np.ndarray:
        """Least value behind each place up to the last piece; ``cap`` where nothing came."""
        return np.minimum(np.searchsorted(np.maximum.accumulate(self.recent), places, "right"), self.cap)

    def add(self, values: np.ndarray) -> None:
        self.recent[values] = self.passed + np.arange(len(values))  # the last of equals stays
        self.passed += len(values)

    @staticmethod
    def inside(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first..last] for pairs of places of one piece."""
        table = [values]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), values.dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << k) + 1])
        return out


class Sweep:
    """One sweep: yields tuples in order of their keys and queues those that they induce.

    Even keys are induced, odd ones given. ``target`` gives the key that each tuple induces (-1:
    none). ``cap`` 0 carries no values; ``seam`` compares the last induced tuple of a bucket to
    the first given one of it.
    """

    def __init__(self, queue: TupleQueue, given: Callable, counts: np.ndarray, target: Callable, cap: int, seam: Callable | None):
        self.queue, self.given, self.counts, self.target, self.cap, self.seam = queue, given, counts, target, cap, seam
        self.last = np.full(len(counts) // 2 + 1, _NEVER) if cap else None
        self.least = _Least(cap) if cap else None
        self.before = (-1, -1)

    def _values(self, key: np.ndarray, pos: np.ndarray, v: np.ndarray) -> None:
        """Sets the values of the first tuples of buckets and of their given part."""
        new = key[1:] != key[:-1]
        v[1:][new] = 0
        if key[0] != self.before[0]:
            v[0] = 0
        if self.seam:
            old = np.concatenate(([self.before[0]], key[:-1]))
            for k in np.flatnonzero((key & 1 == 1) & (old == key - 1)).tolist():
                v[k] = self.seam(pos[k - 1] if k else self.before[1], pos[k])
        self.before = (int(key[-1]), int(pos[-1]))

    def _induced(self, made: np.ndarray, pos: np.ndarray, v: np.ndarray) -> tuple:
        source = np.flatnonzero(made >= 0)
        order = np.argsort(made[source], kind="stable")
        source = source[order]
        key = made[source]
        if not self.cap:
            return key, pos[source] - 1, np.zeros(len(key), np.uint8)
        value = np.zeros(len(key), np.int64)
        if len(key):
            first = np.r_[True, key[1:] != key[:-1]]
            again = np.flatnonzero(~first)
            value[again] = _Least.inside(v, source[again - 1] + 1, source[again])
            at = self.last[key[first] >> 1]
            value[first] = np.minimum(self.least.since(at), np.minimum.accumulate(v)[source[first]])
            capped = np.minimum(value + 1, self.cap)
            if self.cap == EQUAL:
                capped = np.where(value == EQUAL, EQUAL, np.minimum(capped, EQUAL - 1))
            capped[np.flatnonzero(first)[at == _NEVER]] = 0
            ends = np.r_[np.flatnonzero(first)[1:] - 1, len(key) - 1]
            self.last[key[ends] >> 1] = self.least.passed + source[ends]
            value = capped
        self.least.add(v)
        return key, pos[source] - 1, value.astype(np.uint8)

    def run(self) -> Iterator[tuple]:
        load = int(min(max(2 * np.sqrt(max(self.counts.sum(), 1)), 1024), PIECE))
        for low, high in _ranges(self.counts, load):
            self.queue.low = low
            parts = deque(self.given(low, high))
            parts.extend(self.queue.between(low, high))
            while parts:
                if high - low > 1:
                    key, pos, v = TupleQueue._sorted(parts) if len(parts) > 1 else parts[0]
                    parts.clear()
                else:
                    key, pos, v = parts.popleft()
                made = self.target(key, pos)
                if high - low > 1:
                    ahead = np.minimum.accumulate(np.where(made >= 0, made, np.iinfo(np.int64).max))
                    late = np.flatnonzero(key[1:] > ahead[:-1])
                    if len(late):
                        cut = int(late[0]) + 1
                        parts.append((key[cut:], pos[cut:], v[cut:]))
                        key, pos, v, made = key[:cut], pos[:cut], v[:cut], made[:cut]
                if self.cap:
                    self._values(key, pos, v)
                yield key, pos, v
                induced = self._induced(made, pos, v)
                here = int(induced[0].searchsorted(high))
                if here:
                    parts.append(tuple(x[:here] for x in induced))
                if here < len(induced[0]):
                    self.queue.push(tuple(x[here:] for x in induced))


def _s_type(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it, from the end in pieces."""
    n, behind = len(x), False
    for stop in range(n, 0, -PIECE):
        start = max(stop - PIECE, 0)
        piece = x[start : min(stop + 1, n)].astype(np.int64)
        step = np.sign(np.diff(piece))
        if stop == n:
            step = np.r_[step, -1]  # the end is smaller than any symbol
        step = np.r_[step, 1 if behind else -1]
        at = np.where(step != 0, np.arange(len(step)), len(step))
        next_step = np.minimum.accumulate(at[::-1])[::-1]
        out[start:stop] = step[next_step[:-1]] > 0
        behind = bool(out[start])
    return out


def _valleys(s: np.ndarray) -> np.ndarray:
    """Positions of LMS suffixes, in order of the string."""
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(whole(len(s)))


def _given(keys: np.ndarray, read: Callable) -> Callable:
    """Access to given tuples, sorted by odd keys: ``keys`` has the number of them below each key."""

    def between(low: int, high: int):
        a, b = int(keys[low]), int(keys[high])
        for at in range(a, b, PIECE):
            yield read(at, min(at + PIECE, b))

    return between


def _induce(x, symbols: int, s: np.ndarray, seeds: np.ndarray, values: np.ndarray, cap: int, seam, scratch: Scratch):
    """(key, position, value) of all suffixes from the largest to the smallest, from LMS suffixes in order."""
    n = len(x)
    lows = np.bincount(x[seeds], minlength=symbols)
    l_counts = sum((np.bincount(x[a : a + PIECE][~s[a : a + PIECE]], minlength=symbols) for a in range(0, n, PIECE)), np.zeros(symbols, int))
    s_counts = sum((np.bincount(x[a : a + PIECE][s[a : a + PIECE]], minlength=symbols) for a in range(0, n, PIECE)), np.zeros(symbols, int))

    def both(even, odd):
        out = np.zeros(2 * symbols, np.int64)
        out[::2], out[1::2] = even, odd
        return out

    def below(odd):
        return np.r_[0, np.cumsum(both(np.zeros(symbols, int), odd))]

    def seed(a, b):
        pos = np.array(seeds[a:b], np.int64)
        return 2 * x[pos].astype(np.int64) + 1, pos, np.array(values[a:b], np.uint8)

    def ascending(key, pos):
        front = x[np.maximum(pos - 1, 0)].astype(np.int64)
        return np.where((pos > 0) & (front >= key >> 1), 2 * front, -1)

    queue = TupleQueue(scratch, 2 * symbols, n)
    up = Sweep(queue, _given(below(lows), seed), both(l_counts, lows), ascending, cap, seam)
    queue.push((np.array([2 * int(x[n - 1])]), np.array([n - 1]), np.zeros(1, np.uint8)))
    if cap:
        up.last[int(x[n - 1])] = _END
    total = int(l_counts.sum())
    l_pos, l_value, at = scratch.array(total, whole(n)), scratch.array(total, np.uint8), 0
    for key, pos, v in up.run():
        mine = key & 1 == 0
        m = int(mine.sum())
        l_pos[at : at + m], l_value[at : at + m] = pos[mine], v[mine]
        at += m

    def downwards(a, b):
        """L tuples from the largest; each shares with the one before what that shared with it."""
        pos = np.array(l_pos[total - b : total - a][::-1], np.int64)
        shifted = np.r_[0, l_value[total - b + 1 : total - a][::-1]] if a == 0 else l_value[total - b + 1 : total - a + 1][::-1]
        return 2 * (symbols - 1 - x[pos].astype(np.int64)) + 1, pos, shifted.astype(np.uint8)

    def descending(key, pos):
        front = x[np.maximum(pos - 1, 0)].astype(np.int64)
        own = symbols - 1 - (key >> 1)
        return np.where((pos > 0) & (front < own + (key & 1 == 0)), 2 * (symbols - 1 - front), -1)

    down = Sweep(TupleQueue(scratch, 2 * symbols, n), _given(below(l_counts[::-1]), downwards), both(s_counts[::-1], l_counts[::-1]), descending, cap, seam)
    yield from down.run()


def _valley_order(x, symbols: int, s: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The LMS positions in order of their suffixes."""
    valleys = _valleys(s)
    m = len(valleys)
    if m < 2:
        return valleys
    first = x[valleys]
    order = np.argsort(first, kind="stable")
    values = np.where(np.r_[False, np.diff(first[order]) == 0], EQUAL, 0).astype(np.uint8)
    kind = whole(len(x))
    found, name, at, known = scratch.array(m, kind), scratch.array(m, kind), 0, 0
    for key, pos, v in _induce(x, symbols, s, valleys[order], values, EQUAL, None, scratch):
        ranks = known + np.cumsum(v < EQUAL)
        known = int(ranks[-1])
        mine = (key & 1 == 0) & (pos > 0)
        mine[mine] = ~s[pos[mine] - 1]
        k = int(mine.sum())
        found[at : at + k], name[at : at + k] = pos[mine], ranks[mine]
        at += k
    new = np.r_[True, np.diff(name) != 0]
    names = int(new.sum())
    if names == m:
        return found[::-1]
    string = scratch.array(m, whole(names))
    string[np.searchsorted(valleys, found)] = names - np.cumsum(new)
    if 48 * m <= scratch.memory:
        return valleys[_doubled(string)]
    out, stop = scratch.array(m, kind), m
    for _, pos, _ in suffixes_descending(string, names, scratch):
        out[stop - len(pos) : stop] = valleys[pos[::-1]]
        stop -= len(pos)
    return out


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Positions of a string's suffixes in order, in memory: ranks by 1, 2, 4, ... symbols."""
    n, rank, step = len(rank), rank.astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if new[-1] == n - 1:
            return order
        rank[order] = new
        step *= 2


def suffixes_descending(x: np.ndarray, symbols: int, scratch: Scratch, width: int = 0, agree: Callable | None = None):
    """(key, position, value) of all suffixes from the largest to the smallest, in pieces.

    The value is the number of symbols, up to ``width``, shared with the suffix given before;
    ``agree`` compares suffixes of two arrays of positions.
    """
    if not len(x):
        return
    s = _s_type(x, scratch.array(len(x), bool))
    seeds = _valley_order(x, symbols, s, scratch)
    values = np.zeros(len(seeds), np.uint8)
    if width:
        for at in range(1, len(seeds), PIECE):
            stop = min(at + PIECE, len(seeds))
            values[at:stop] = agree(seeds[at - 1 : stop - 1], seeds[at:stop])
    seam = (lambda i, j: agree(np.array([i]), np.array([j]))[0]) if width else None
    yield from _induce(x, symbols, s, seeds, values, width, seam, scratch)


def comparer(text: np.ndarray, width: int) -> Callable:
    """Number of equal bytes, up to ``width``, of suffixes of ``text``, which has ``width`` + 8 bytes of padding."""
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        for at in range(0, width, 8):
            differs = words[i[open_] + at] ^ words[j[open_] + at]
            low = differs & (~differs + np.uint64(1))  # lowest set bit: the first differing byte
            equal = np.where(differs == 0, 8, (np.frexp(low.astype(float))[1] - 1) // 8)
            out[open_] += equal
            open_ = open_[equal == 8]
        return np.minimum(out, width)

    return agree
