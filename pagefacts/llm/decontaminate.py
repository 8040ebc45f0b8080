"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each Arrow batch of documents is one shard. Its words become numbers of the benchmark's
vocabulary (0 for any other word, and between documents). A suffix is entered in the shard's
array only where a match of some window can start at all: where a run of benchmark words of
the least window length begins. The entered suffixes are sorted by their first ``window``
words. Every benchmark suffix is looked up by binary search, which gives the range of places
where its window occurs; from each place the match is followed to its end for the longest
verbatim match.

The benchmark is a stated query set. It is cut by size into blocks of at most ``BLOCK_BYTES``
(measured, not assumed), each block is broadcast and all documents meet each block once, in a
chain of narrow steps: no shuffle and no join between texts.

Words: ASCII-lower-cased runs of letters, digits and non-ASCII characters. A window is
``window`` words; an item with fewer words, but not none, is one window of all its words.

Defined cases: null and empty texts have no words; an item without words gives no window; items
with a null id mark hits but are not listed; repeated rows are judged alike; no benchmark rows
means nothing is hit; extra columns are ignored or kept, as the function says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import bytes_of

WINDOW = 10
BLOCK_BYTES = 16_000_000

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of ASCII-lower-cased UTF-8: every other byte separates


class _Vocabulary(dict):
    def __missing__(self, _word: bytes) -> int:
        return 0


class QueryBlock:
    """One block of the benchmark: its vocabulary and the sorted set of its windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary = _Vocabulary()
        windows: dict[bytes, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for k, (_, text) in enumerate(items):
            ids = np.array(
                [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _WORDS.findall(text.lower())], "u4"
            )
            self.words.append(ids)
            n = len(ids)
            for start in range(max(1, n - window + 1) if n else 0):
                key = ids[start : start + window].astype(">u4").tobytes()
                windows.setdefault(key, []).append((k, start))
        self.keys = sorted(windows)
        self.owners = [windows[k] for k in self.keys]
        self.lengths = np.array([len(k) // 4 for k in self.keys], int)
        self.least = int(self.lengths.min()) if self.keys else 0
        width = 4 * window
        self.low = np.array([k.ljust(width, b"\0") for k in self.keys], f"S{width}")
        self.high = np.array([k.ljust(width, b"\xff") for k in self.keys], f"S{width}")


def _shard(texts: list[bytes], block: QueryBlock):
    """The shard's word numbers with a 0 after each document, the starts, and its suffix array."""
    get = block.vocabulary.__getitem__
    parts, starts, at = [], [], 0
    for text in texts:
        words = _WORDS.findall(text.lower())
        starts.append(at)
        parts.append(np.fromiter(map(get, words), "u4", len(words)))
        parts.append(np.zeros(1, "u4"))
        at += len(words) + 1
    starts.append(at)
    ids = np.concatenate([*parts, np.zeros(block.window, "u4")])
    stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
    run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))  # words until the next foreign one
    places = np.flatnonzero(run[:at] >= block.least) if block.least else np.zeros(0, int)
    keys = ids[places[:, None] + np.arange(block.window)].astype(">u4")
    # what follows a foreign word is not part of the suffix
    keys[np.arange(block.window) >= run[places][:, None]] = 0
    keys = np.ascontiguousarray(keys).view(f"S{4 * block.window}").ravel()
    order = np.argsort(keys, kind="stable")
    return ids, np.array(starts), places[order], keys[order]


def _longest(ids: np.ndarray, place: int, item: np.ndarray, at: int) -> int:
    n = min(len(item) - at, len(ids) - place)
    differs = np.flatnonzero(ids[place : place + n] != item[at : at + n])
    return int(differs[0]) if len(differs) else n


def search(texts: list[bytes], block: QueryBlock):
    """(document, first word, word behind, item, item word, longest match) of every window's occurrence."""
    ids, starts, places, keys = _shard(texts, block)
    if not len(places):
        return [], starts
    low, high = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    out = []
    for q in np.flatnonzero(high > low):
        found = places[low[q] : high[q]]
        docs = np.searchsorted(starts, found, "right") - 1
        for place, doc in zip(found.tolist(), docs.tolist(), strict=True):
            first = place - int(starts[doc])
            for k, at in block.owners[q]:
                out.append((doc, first, first + int(block.lengths[q]), k, at, place))
    return [(d, a, b, k, at, _longest(ids, p, block.words[k], at)) for d, a, b, k, at, p in out], starts


_STATE = "row struct<{}>, t binary, n_words long, spans array<long>, items array<string>, longest int"


def _step(block, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            texts = columns["t"].to_pylist()
            hits, starts = search(texts, block.value)
            n = len(texts)
            if first:
                spans, items, longest = [[] for _ in range(n)], [set() for _ in range(n)], [0] * n
            else:
                spans = columns["spans"].to_pylist()
                items = [set(x) for x in columns["items"].to_pylist()]
                longest = columns["longest"].to_pylist()
            for doc, a, b, k, _, far in hits:
                if not spans[doc] or spans[doc][-1] != (a << 31 | b):
                    spans[doc].append(a << 31 | b)
                if block.value.ids[k] is not None:
                    items[doc].add(block.value.ids[k])
                longest[doc] = max(longest[doc], far)
            out = [
                columns["row"],
                columns["t"],
                pa.array((np.diff(starts) - 1).tolist(), pa.int64()),
                pa.array([sorted(set(x)) for x in spans], pa.list_(pa.int64())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(longest, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["row", "t", "n_words", "spans", "items", "longest"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        hit = []
        for spans in columns["spans"].to_pylist():
            n, end = 0, 0
            for span in spans:  # in order of their first word
                a, b = span >> 31, span & 0x7FFFFFFF
                n, end = n + max(0, b - max(a, end)), max(end, b)
            hit.append(n)
        items = columns["items"].to_pylist()
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [
                columns["row"],
                columns["n_words"],
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array(sha, pa.string()),
                columns["longest"],
                columns["spans"],
            ],
            ["row", "n_words", "n_hit", "n_items", "items_sha256", "longest", "spans"],
        )


def blocks_of(benchmark: DataFrame, item_id: str, text: str, size: int = BLOCK_BYTES) -> Iterator[list]:
    """The benchmark's (id, text) rows in blocks of about ``size`` bytes, one at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), bytes_of(text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // size)
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else items
        yield [(r.i, bytes(r.t)) for r in part.collect()]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: ``row`` (the packed input), n_words, n_hit, n_items, items_sha256,
    ``longest`` verbatim match in words, and ``spans`` (first word << 31 | word behind) of all occurrences.
    """
    spark = docs.sparkSession
    now = docs.select(F.struct("*").alias("row"), bytes_of(text).alias("t"))
    fields = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    state = _STATE.format("").replace("struct<>", fields)
    first = True
    for items in blocks_of(benchmark, item_id, item_text, block_bytes) or ():
        block = spark.sparkContext.broadcast(QueryBlock(items, window))
        now = now.mapInArrow(_step(block, first), state)
        first = False
    if first:
        now = now.mapInArrow(_step(spark.sparkContext.broadcast(QueryBlock([], window)), True), state)
    return now.mapInArrow(
        _digest,
        f"row {fields}, n_words long, n_hit long, n_items long, items_sha256 string, longest int, spans array<long>",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns."""
    return overlaps(docs, benchmark, **options).filter("n_hit = 0").select("row.*")
