"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q that holds at least ``EXPONENT`` times q and
``LEAST`` words and that no neighbouring word extends. Words are maximal stretches of characters
other than space, tab, LF, VT, FF and CR, numbered from 0.

Dictionary: at every length L = 1, 2, 4, ... each stretch of L words of a document has a number,
made of the numbers of its two halves. The successor of a stretch is its next occurrence. Where
successors follow at one distance d <= L, occurrences form an arithmetic progression and propose
the period d; consecutive starts with one d are extended to the stretch they cover, which is the
whole run: were the word before or behind also in step, its start would have the same successor
distance. A distance is looked at on one level only, L/2 < d <= L, so no run is found twice.

A stretch goes up a level only while its number occurs EXPONENT - 1 times in its document, as
every stretch of a run does whose period is longer; so in ordinary prose few words reach four.

Texts are rows and never move: a narrow step, many documents at a time in arrays of at most
``GROUP_WORDS`` words (or one document). Work on a document is words x levels at most.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; ids may be
null or repeated, each row is taken by itself; extra columns are kept in ``row``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import SPACES, bytes_of, settled

EXPONENT, LEAST = 4, 6
GROUP_WORDS = 400_000

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _spans(starts: np.ndarray, distance: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of maximal blocks of consecutive starts with one successor distance."""
    if not len(starts):
        return starts, starts, starts
    order = np.argsort(starts)
    starts, distance = starts[order], distance[order]
    new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(distance) != 0)])
    last = np.r_[new[1:], len(starts)] - 1
    return starts[new], starts[last] - starts[new] + distance[new] + level, distance[new]


def find_runs(number: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Runs (start, length, period) of documents laid end to end, by start and period.

    ``number`` has equal values for equal words of one document and for no others; ``ends`` gives
    the end of the document of every position.
    """
    if exponent < 3:
        raise ValueError("periods are proposed from exponent 3 on")
    begins = np.arange(len(number))
    length_of = ends - np.searchsorted(ends, ends)  # words of the document
    at, key, level, out = begins, number, 1, []
    needed = exponent
    while len(at):
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(new)
        times = np.diff(np.r_[heads, len(at)])
        gap = np.diff(at)
        near = np.flatnonzero(~new[1:] & (2 * gap > level) & (gap <= level))
        start, length, period = _spans(at[near], gap[near], level)
        long = (length >= least) & (length >= exponent * period)
        out.append(np.stack([start[long], length[long], period[long]], 1))
        kept = np.repeat(times >= needed, times)
        rank = np.repeat(np.arange(len(heads)), times)
        here = np.full(len(number) + level, -1)
        here[at[kept]] = rank[kept]
        at = np.sort(at[kept])
        behind = here[at + level]
        fits = (behind >= 0) & (at + 2 * level <= ends[at]) & (exponent * (level + 1) <= length_of[at])
        at = at[fits]
        key = here[at] * len(heads) + behind[fits]
        level, needed = 2 * level, exponent - 1
    found = np.concatenate(out) if out else np.zeros((0, 3), int)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _group(texts: list[list[bytes]], exponent: int, least: int) -> Iterator[tuple[list[dict], bytes]]:
    """(runs, collapsed text) of each document of a group."""
    sizes = np.array([len(w) for w in texts])
    stops = np.cumsum(sizes)
    parts, base = [], 0
    for words in texts:
        numbers = defaultdict(count(base).__next__)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        base += len(numbers)
    number = np.concatenate(parts) if parts else np.zeros(0, int)
    runs = find_runs(number, np.repeat(stops, sizes), exponent, least)
    cover = np.zeros(len(number) + 1, int)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cover)[:-1] == 0
    own = np.searchsorted(runs[:, 0], np.r_[0, stops])
    for k, words in enumerate(texts):
        first = int(stops[k] - sizes[k])
        mine = runs[own[k] : own[k + 1]]
        if len(mine):
            words = [words[i] for i in np.flatnonzero(kept[first : first + len(words)]).tolist()]
        yield [dict(zip(("start", "length", "period"), r, strict=True)) for r in (mine - [first, 0, 0]).tolist()], b" ".join(words)


def _runs(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, runs, collapsed = [], [], []
            waiting, words = [], 0
            texts = batch.column(1)
            for i in range(n):
                waiting.append(texts[i].as_py().split())  # bytes are split at the six white-space characters
                words += len(waiting[-1])
                sizes.append(len(waiting[-1]))
                if words >= GROUP_WORDS or i == n - 1:
                    for r, c in _group(waiting, exponent, least):
                        runs.append(r)
                        collapsed.append(c)
                    waiting, words = [], 0
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "runs", "collapsed"])

    return run


def collapse(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Per document row: ``row`` (the packed input), n_words, ``runs`` (start, length, period; by start, then
    period), and ``collapsed``: the words that no run holds behind its first period, joined by a space (UTF-8).
    """
    kind = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row")).schema["row"].dataType.simpleString()
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), bytes_of(text).alias("t"))
    return packed.mapInArrow(
        _runs(exponent, least),
        f"row {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary",
    )


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, by crc32 of the id, repeats a stretch up to its end (a null id counts as empty).

    With h the crc32 and g = h / 10: of n words those from a = g % n on repeat with period
    1 + (n - a) / (3 + g % 8), where h % 10 = 0; they are then joined by one space.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    trimmed = F.regexp_replace(text, f"^{SPACES}|{SPACES}\\z", "")
    words = F.when((h % 10 == 0) & (F.length(trimmed) > 0), F.split(trimmed, SPACES))
    others = [c for c in docs.columns if c != text]
    full = docs.select(
        F.struct(*others).alias("row"), F.col(text).alias("t"), words.alias("w"), F.floor(h / 10).alias("g")
    )
    full = settled(full, "w", "g")
    full = full.withColumn("a", F.col("g") % F.size("w")).withColumn(
        "p", F.expr("1 + (size(w) - a) div (3 + g % 8)")
    )
    full = settled(full, "w", "a", "p")
    made = "array_join(transform(sequence(0L, size(w) - 1L), i -> get(w, int(if(i < a, i, a + (i - a) % p)))), ' ')"
    new = F.when(F.col("w").isNull(), F.col("t")).otherwise(F.expr(made))
    return full.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of ``collapse``: the number of runs, the run of greatest length / period, and hashes of the results."""
    best = F.expr(
        "aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    )  # the first of equals is the one of smallest start, then period
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    out = settled(found.select(F.col("row")[id_col].alias(id_col), "runs", "collapsed", best.alias("best")), "best")
    return out.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
