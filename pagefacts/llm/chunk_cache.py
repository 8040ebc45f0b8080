"""Tokenising by cached white-space chunks, inside a Python worker."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

#: Characters with the Unicode property White_Space, as the tokenizers' patterns understand \s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Entries of one generation of a worker's cache, and the longest chunk that is kept (characters).
CACHE_ENTRIES = 850_000
KEPT_CHUNK = 128

#: How long a worker without a task keeps its cache.
IDLE_SECONDS = 2

#: Texts that are cut into chunks at a time.
TEXTS = 250


def load_tokenizer(source: str):
    """A tokenizer from the text of its .json file, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class ChunkCache:
    """Chunk -> a value made of its token ids, in two generations of bounded size.

    What is missing in a group of texts is encoded in one call, which keeps no offsets. A full generation becomes the
    older one and what is still used moves on from there, so memory stays bounded and frequent
    chunks stay known. ``split`` may name smaller chunks whose values add up to a chunk's value.
    """

    def __init__(self, source: str, value: Callable, fixed: dict | None = None, split: Callable | None = None):
        self.tokenizer, self.value, self.fixed, self.split = load_tokenizer(source), value, fixed or {}, split
        self.young, self.old, self.passing = dict(self.fixed), {}, []

    def covering(self, chunks: list[list[str]]) -> Callable:
        """A lookup that knows every chunk of these lists, until the next call."""
        for chunk in self.passing:
            self.young.pop(chunk, None)
        if len(self.young) > CACHE_ENTRIES + len(self.fixed):
            self.old, self.young = self.young, dict(self.fixed)
        fresh, composed = set(), []
        for chunk in set().union(*chunks).difference(self.young):
            if (known := self.old.get(chunk)) is not None:
                self.young[chunk] = known
            elif self.split and (parts := self.split(chunk)):
                composed.append((chunk, parts))
                fresh.update(p for p in parts if p not in self.young)
            else:
                fresh.add(chunk)
        encoded = list(fresh)
        self.passing = [c for c in encoded if len(c) > KEPT_CHUNK]
        for chunk, e in zip(encoded, self.tokenizer.encode_batch_fast(encoded, add_special_tokens=False), strict=True):
            self.young[chunk] = self.value(e.ids)
        for chunk, parts in composed:
            first, *rest = (self.young[p] for p in parts)
            for value in rest:
                first = first + value
            self.young[chunk] = first
            if len(chunk) > KEPT_CHUNK:
                self.passing.append(chunk)
        return self.young.__getitem__

    def rest(self) -> None:
        """Lets the older generation go, at the end of a task, and soon all of it, unless another task comes.

        A worker that waits while other stages run holds nothing after ``IDLE_SECONDS``.
        """
        self.old = {}
        timer = threading.Timer(IDLE_SECONDS, _leave, (_uses,))
        timer.daemon = True
        timer.start()


_kept: dict = {}
_uses = 0


def _leave(uses: int) -> None:
    """Empties the worker's cache if no task has asked for it since."""
    if uses == _uses:
        _kept.clear()


def worker_cache(name: str, source: str, value: Callable, fixed: dict | None = None, split: Callable | None = None) -> ChunkCache:
    """The cache of this worker process for a tokenizer; it outlives a task where the next one follows soon."""
    global _uses
    _uses += 1
    key = (name, hash(source), id(fixed) if fixed else 0)
    if key not in _kept:
        _kept.clear()
        _kept[key] = ChunkCache(source, value, fixed, split)
    return _kept[key]
