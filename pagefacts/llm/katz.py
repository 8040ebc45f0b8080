"""Katz backoff language model over word pairs, with Good-Turing discounts.

P(w | h) is the discounted relative frequency of (h, w) where that pair was seen, and else
alpha(h) P(w), with P(w) = (c + 1) / (N + V + 1) over the training tokens, one share being left
for unknown words. The discounts of counts up to ``GT_MAX`` follow Good-Turing from the numbers
of pairs of each count; pairs seen at least ``MIN_COUNT`` times, which is all of them, are kept.
alpha(h) is the freed mass over the mass P leaves to the words not kept after h, summed exactly,
so that each context's probabilities add up to one.

Counting: a map task hashes its words, counts words or pairs over runs of ``RUN_TOKENS`` and
sends arrays to buckets. A pair goes by its context; contexts among the ``HEAD_WORDS`` most
frequent words are dealt to as many buckets as their share of the corpus asks for, so that no
context fills one. Tables of words, pairs and contexts are written in the shared folder, a row of numbers each:
a bucket's pairs as one row would be held whole by every task that reads them.

Scoring adds up log P(w) + log alpha(h) over all tokens and, for each kept pair, the difference
(gain) to its own probability: the recursion, summed in another order. The most frequent words
and pairs (a fixed number) are broadcast and looked up in the map task, which also keeps any key
from filling a bucket. The rest is sent to the buckets of the tables as arrays; per portion of
documents and bucket one row of sums comes back. No token is a row there.

Words are compared by 64-bit hashes. Defined cases: null and empty texts are the end token
alone; repeated rows count as often in training and each get the score; without training rows
every token is unknown; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import bytes_of
from pagefacts.session import cut_lineage

GT_MAX = 5
MIN_COUNT = 1
RUN_TOKENS = 1_000_000
BUCKET_BYTES = 16_000_000
HEAD_WORDS = 131_072
HEAD_PAIRS = 524_288

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the tokens that are no words: before the first word, and the end.
BEGIN, END = 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(h.view("u8") * _MIX + w.view("u8")).view("i8")


class _WordHashes(dict):
    """Word -> signed 64-bit hash, in a table that is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        if len(self) > 300_000:
            self.clear()
        if len(word) < 256:
            self[word] = h
        return h


_hashes = _WordHashes()


def tokens_of(text: bytes) -> np.ndarray:
    """The hashes of a text's words, between the begin and the end mark."""
    words = text.lower().split()  # of bytes: at the six ASCII spaces, and only A-Z are lower-cased
    out = np.empty(len(words) + 2, "i8")
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.fromiter(map(_hashes.__getitem__, words), "i8", len(words))
    return out


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(keys.view("u8")) % np.uint64(n)).astype(int)


class Table:
    """Numbers by distinct 64-bit keys: open addressing over arrays, built and searched in rounds."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = np.asarray(keys, "i8"), [np.asarray(v) for v in values]
        bits = max(4, int(2 * len(self.keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, "i4")
        waiting, at = np.arange(len(self.keys)), self._place(self.keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # of several for one slot the last stays
            left = self.slots[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * _MIX) >> self.shift).astype("i8")

    def replace_keys(self, keys: np.ndarray) -> None:
        """The same values under other distinct keys."""
        self.__init__(keys, *self.values)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys among the table's, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), int), np.zeros(len(keys), bool)
        at = self._place(keys)
        found = self.slots[at]
        there = self.keys[found] == keys
        there &= found >= 0
        open_ = np.flatnonzero(~there & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            now = self.slots[at]
            hit = (now >= 0) & (self.keys[now] == keys[open_])
            found[open_[hit]], there[open_[hit]] = now[hit], True
            go = (now >= 0) & ~hit
            open_, at = open_[go], at[go]
        return found, there


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): ``order`` sorts the keys, ``starts`` are where new keys begin in it, and the end."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, int)
    return order, np.r_[new, len(keys)]


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """A stable order by bucket number."""
    return np.argsort(bucket.astype("u2") if len(bucket) and bucket.max() < 65_536 else bucket, kind="stable")


def parts_of(h: np.ndarray, frequent: Table, share: float) -> np.ndarray:
    """The number of parts a context is dealt to: one more for each ``share`` of its occurrences."""
    at, there = frequent.find(h)
    out = np.ones(len(h), "i8")
    out[there] += (frequent.values[0][at[there]] // share).astype("i8")
    return out


def pair_bucket(h: np.ndarray, w: np.ndarray, frequent: Table, share: float, n: int) -> np.ndarray:
    """By the context; a frequent context is dealt to one bucket for each ``share`` of its occurrences."""
    parts = parts_of(h, frequent, share)
    return _bucket(h + _mixed(w.view("u8") ^ _MIX).view("i8") % parts, n)


def _portions(order: np.ndarray, bucket: np.ndarray, n: int):
    """For each bucket that occurs: its number and the positions that belong to it, as sorted by ``order``."""
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(tokens_of(text))
            size += len(held[-1])
            if size >= RUN_TOKENS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LONGS = pa.list_(pa.int64())
_INTS = pa.list_(pa.int32())
_WORD_COUNTS = pa.schema([("bucket", pa.int32()), ("w", _LONGS), ("c", _INTS)])
_PAIR_COUNTS = pa.schema([("bucket", pa.int32()), ("h", _LONGS), ("n", _INTS), ("w", _LONGS), ("c", _INTS)])


def _count_words(buckets: int):
    def run(batches):
        for flat in _runs(batches):
            words, counts = np.unique(flat[flat != BEGIN], return_counts=True)
            bucket = _bucket(words, buckets)
            rows = [(b, words[at], counts[at]) for b, at in _portions(by_bucket(bucket), bucket, buckets)]
            yield _batch(rows, _WORD_COUNTS)

    return run


def _sum_words(group: pd.DataFrame) -> pd.DataFrame:
    words, counts = np.concatenate(group["w"].to_list()), np.concatenate(group["c"].to_list())
    order, starts = distinct(words)
    return pd.DataFrame({"w": words[order[starts[:-1]]], "c": np.add.reduceat(counts[order].astype("i8"), starts[:-1])})


def _count_pairs(frequent, share: float, buckets: int):
    def run(batches):
        for flat in _runs(batches):
            first, second = flat[:-1], flat[1:]
            within = first != END
            first, second = first[within], second[within]
            order, starts = distinct(pair_key(first, second))
            first, second, counts = first[order[starts[:-1]]], second[order[starts[:-1]]], np.diff(starts)
            order = np.argsort(first)
            first, second, counts = first[order], second[order], counts[order]
            bucket = pair_bucket(first, second, frequent.value, share, buckets)
            rows = []
            for b, at in _portions(by_bucket(bucket), bucket, buckets):
                h, n = np.unique(first[at], return_counts=True)  # the portion is in the order of h
                rows.append((b, h, n, second[at], counts[at]))
            yield _batch(rows, _PAIR_COUNTS)

    return run


_BOXES = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("h", _LONGS), ("n", _INTS), ("w", _LONGS), ("at", _INTS), ("c", _LONGS), ("cw", _LONGS), ("x", pa.list_(pa.float64()))]
)
_TABLES = "bucket int, kind int, h array<long>, n array<int>, w array<long>, at array<int>, c array<long>, cw array<long>, x array<double>"


#: Rows of the table of pairs by kind.
COUNTS, KNOWN, ASKED = 0, 1, 2
_PAIR_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("w", pa.int64()), ("at", pa.int32()), ("c", pa.int64()), ("cw", pa.int64())])

#: Rows that cross to or from a Python worker as one piece, where they are rows of numbers.
PIECE = 262_144


def _sum_pairs(frequent):
    def run(group: pa.Table) -> pa.Table:
        """A row for each kept pair of one bucket, and the histogram of all counts.

        A frequent second word stands as its place among the frequent ones, with its count; the others' counts are not known here.
        """
        h, n, w, c = (np.concatenate([x.flatten().to_numpy() for x in group.column(name).chunks]) for name in ("h", "n", "w", "c"))
        h = np.repeat(h, n)
        order, starts = distinct(pair_key(h, w))
        total = np.add.reduceat(c[order].astype("i8"), starts[:-1]) if len(c) else np.zeros(0, "i8")
        h, w = h[order[starts[:-1]]], w[order[starts[:-1]]]
        values, times = np.unique(total, return_counts=True)
        kept = np.flatnonzero(total >= MIN_COUNT)
        kept = kept[np.argsort(h[kept], kind="stable")]
        at, there = frequent.value.find(w[kept])
        known, asked = kept[there], kept[~there]
        number = group.column("bucket")[0].as_py()

        def pieces(kind, **columns):
            for k in range(0, len(columns["h"]), PIECE):
                part = {name: x[k : k + PIECE] for name, x in columns.items()}
                size = len(part["h"])
                part |= {"bucket": np.full(size, number, "i4"), "kind": np.full(size, kind, "i4")}
                arrays = [pa.array(part[f.name], f.type) if f.name in part else pa.nulls(size, f.type) for f in _PAIR_ROWS]
                yield pa.RecordBatch.from_arrays(arrays, schema=_PAIR_ROWS)

        places = at[there]
        counts = frequent.value.values[0][places] if len(known) else np.zeros(0, "i8")
        batches = [
            *pieces(KNOWN, h=h[known], at=places, c=total[known], cw=counts), *pieces(ASKED, h=h[asked], w=w[asked], c=total[asked]),
            *pieces(COUNTS, h=values, c=times),
        ]
        return pa.Table.from_batches(batches, _PAIR_ROWS)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of as many batches as make up a piece."""
    held, size = [], 0

    def columns():
        return [np.concatenate([x.to_numpy() for x in parts]) for parts in zip(*(b.columns for b in held), strict=True)]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            yield columns()
            held, size = [], 0
    if size:
        yield columns()


def _runs_of_contexts(buckets: int):
    """Pairs (bucket, h, w, at, c, cw) as arrays for their buckets, each context once with the number of its words.

    A frequent word goes as its place alone, which is half of what is sent otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, h, w, at, c, cw in _gathered(batches):
            rows = []
            for kind, chosen in ((2, np.flatnonzero(at < 0)), (4, np.flatnonzero(at >= 0))):
                order = chosen[np.lexsort((h[chosen], bucket[chosen]))]
                for b, mine in _portions(order, bucket, buckets):
                    own, n = np.unique(h[mine], return_counts=True)  # the portion is in the order of h
                    rows.append((b, kind, own, n, w[mine], None, c[mine], cw[mine], None) if kind == 2 else (b, kind, own, n, None, at[mine], c[mine], None, None))
            yield _batch(rows, _BOXES)

    return run


def discounts(pairs_with: dict[int, int], most: int = GT_MAX) -> list[float]:
    """d_r for r = 0 .. most; absolute discounting by a half where Good-Turing gives no proper value."""
    n = [pairs_with.get(r, 0) for r in range(most + 2)]
    common = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    out = [1.0]
    for r in range(1, most + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


@dataclass
class Fitted:
    """The tables and numbers of a model; logarithms are to base 10.

    words: (w, c, alpha). pairs: (bucket, h, w, at, c, cw), with
    the place ``at`` among the frequent words instead of w where it has one. contexts: (h, total, alpha).
    """

    words: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    tokens: int
    vocabulary: int
    discount: list[float]
    begin_alpha: float
    frequent: Table
    share: float
    buckets: int


def _high_count(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach, from a histogram of about 16 classes for each doubling."""
    classes = F.floor(F.log2("c") * 16).alias("class")
    total, least = 0, 1 << 62
    rows = counts.groupBy(classes).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    for row in sorted(rows, key=lambda r: -r.c):
        total += row.n
        if total > most:
            break
        least = row.c
    return least


def _arrays(rows: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of bounded size, on the driver."""
    return [c.to_numpy() for c in rows.toArrow().columns]


def fit(docs: DataFrame, learn: Column, text: str = "text") -> Fitted:
    """Count the texts of the rows with ``learn`` and build the tables."""
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(1 + size // BUCKET_BYTES)
    texts = docs.filter(learn).select(bytes_of(text).alias("t"))
    words = cut_lineage(
        texts.mapInArrow(_count_words(buckets), "bucket int, w array<long>, c array<int>")
        .groupBy("bucket")
        .applyInPandas(_sum_words, "w long, c long"),
        "katz-words",
    )
    ends = F.sum(F.when(F.col("w") == END, F.col("c"))).alias("texts")
    totals = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), ends).first()
    n, v = totals.n or 0, totals.v or 0
    high = _high_count(words, HEAD_WORDS)
    head = _arrays(words.filter(F.col("c") >= high).select("w", "c"))  # at most HEAD_WORDS rows of two numbers
    frequent = Table(np.r_[head[0], BEGIN].astype("i8"), np.r_[head[1], totals.texts or 0].astype("i8"))
    sent, share = context.broadcast(frequent), max(1.0, n / buckets)
    summed = cut_lineage(
        texts.mapInArrow(
            _count_pairs(sent, share, buckets), "bucket int, h array<long>, n array<int>, w array<long>, c array<int>"
        )
        .groupBy("bucket")
        .applyInArrow(_sum_pairs(sent), "bucket int, kind int, h long, w long, at int, c long, cw long"),
        "katz-pairs",
    )
    context._jvm.System.gc()  # lets Spark's cleaner drop the shuffle of the pair counts

    def rows(kind: int, *names: str | Column) -> DataFrame:
        return summed.filter(F.col("kind") == kind).select("bucket", *names)

    histogram = rows(COUNTS, "h", "c").filter(f"h <= {GT_MAX + 1}").groupBy("h").agg(F.sum("c").alias("c")).collect()
    d = discounts({r.h: r.c for r in histogram})
    # P(w) of second words: frequent ones were known in the buckets, the rest comes by a join
    rare = words.filter((F.col("c") < high) & (F.col("c") >= MIN_COUNT)).select("w", F.col("c").alias("cw"))
    joined = cut_lineage(rows(ASKED, "h", "w", "c").join(rare, "w").select("bucket", "h", "w", "c", "cw"), "katz-rare")
    every = rows(KNOWN, "h", "c", "cw").select("h", "c", "cw").unionByName(joined.select("h", "c", "cw"))
    factor = F.coalesce(*[F.when(F.col("c") == r, F.lit(d[r])) for r in range(1, GT_MAX + 1)], F.lit(1.0))
    sums = every.groupBy("h").agg(F.sum(factor * F.col("c")).alias("kept"), (F.sum(F.col("cw") + 1) / F.lit(float(n + v + 1))).alias("p"))
    begin = docs.sparkSession.range(1).select(F.lit(BEGIN).cast("long").alias("w"), F.lit(totals.texts or 0).cast("long").alias("c"))
    total = F.when(F.col("kept") >= F.col("c"), F.col("c") + 1).otherwise(F.col("c"))
    contexts = cut_lineage(
        words.filter(F.col("w") != END).union(begin)
        .join(sums, F.col("w") == F.col("h"))
        .select("h", total.alias("total"), F.log10((1 - F.col("kept") / total) / (1 - F.col("p"))).alias("alpha")),
        "katz-contexts",
    )
    alphas = contexts.select(F.col("h").alias("w"), "alpha")
    table = cut_lineage(words.join(alphas, "w", "left").select("w", "c", F.coalesce("alpha", F.lit(0.0)).alias("alpha")), "katz-word-table")
    pairs = rows(KNOWN, "h", F.lit(0).cast("long").alias("w"), F.coalesce("at", F.lit(-1)).alias("at"), "c", "cw").unionByName(
        joined.withColumn("at", F.lit(-1))
    )
    start = contexts.filter(F.col("h") == BEGIN).first()
    context._jvm.System.gc()
    return Fitted(table, pairs, contexts, n, v, d, start.alpha if start else 0.0, frequent, share, buckets)


def _gains(h, w, c, cw, contexts, discount: list[float], norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, gains) of kept pairs; contexts has (total, alpha) by h."""
    at, there = contexts.find(h)
    assert there.all(), "a kept pair without its context"
    factor = np.ones(len(c))
    for r in range(1, len(discount)):
        factor[c == r] = discount[r]
    total, alpha = (v[at] for v in contexts.values) if len(h) else (np.ones(0), np.zeros(0))
    gain = np.log10(factor * c / total) - alpha - np.log10((cw + 1) / norm)
    return pair_key(h, w), gain


def _frequent_pairs(model: Fitted, most: int) -> Table:
    """The gains of at most ``most`` pairs with the highest counts."""
    rows = model.pairs
    top = rows.filter(F.col("c") >= _high_count(rows.select("c"), most)).join(model.contexts, "h")
    h, w, at, c, cw, total, alpha = _arrays(top.select("h", "w", "at", "c", "cw", "total", "alpha"))
    w = np.where(at < 0, w, model.frequent.keys[at])
    _, one = np.unique(h, return_index=True)
    contexts = Table(h[one], total[one], alpha[one])
    return Table(*_gains(h, w, c, cw, contexts, model.discount, model.tokens + model.vocabulary + 1.0))


#: Bytes of a key that is sent: its bucket and 56 bits tell it from every key of the bucket's table.
KEY_BYTES = 7

#: level 0: sums of a batch of documents as far as the map task knows them; 1 and 2: words and pairs to look up,
#: with the places of their documents in the batch and how many keys each has.
_SHORTS = pa.list_(pa.int16())
_REQUESTS = pa.schema(
    [("bucket", pa.int32()), ("level", pa.int32()), ("base", pa.int64()), ("who", _SHORTS), ("n", _INTS), ("key", pa.binary()),
     ("own", pa.list_(pa.float64())), ("doc", pa.list_(pa.string()))]
)
_REQUEST_COLUMNS = "bucket int, level int, base long, who array<smallint>, n array<int>, key binary, own array<double>, doc array<string>"


def short_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<i8").view("u1").reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def shortened(keys: np.ndarray) -> np.ndarray:
    """The keys as :func:`long_keys` gives them back."""
    return keys & ((1 << 8 * KEY_BYTES) - 1)


def long_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), "u1")
    out[:, :KEY_BYTES] = np.frombuffer(data, "u1").reshape(-1, KEY_BYTES)
    return out.view("<i8").ravel()


#: Documents of one portion; their places fit 16 bits.
BATCH = 4096


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _request(head, share: float, begin_alpha: float, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, frequent = head.value
        logs, alpha, gain = np.log10(words.values[0] + 1.0), words.values[1], pairs.values[0]
        part, seen = TaskContext.get().partitionId() << 40, 0  # rows are numbered by task and place
        for batch in portions(batches):
            docs = batch.column(0).to_pylist()
            tokens = [tokens_of(t) for t in batch.column(1).to_pylist()]
            ids, base, seen = np.arange(len(docs)), part + seen, seen + len(docs)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, "i8")
            owner = np.repeat(np.arange(len(ids)), [len(t) for t in tokens])
            own, rows = np.zeros((len(ids), 4)), []

            def send(level, keys, owners, bucket):
                for b, at in _portions(by_bucket(bucket), bucket, buckets):
                    mine = owners[at]  # ascending
                    new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    who, n = mine[new], np.diff(np.r_[new, len(mine)])
                    rows.append((b, level, base, who, n, short_keys(keys[at]), None, None))

            w, o = flat[flat != BEGIN], owner[flat != BEGIN]
            at, there = words.find(w)
            own[:, 0] = np.bincount(o, minlength=len(ids))
            own[:, 1] = np.bincount(o[there], minlength=len(ids))
            own[:, 2] = np.bincount(o[there], logs[at[there]], len(ids))
            own[:, 3] = np.bincount(o[there], alpha[at[there]], len(ids)) + begin_alpha
            send(1, w[~there], o[~there], _bucket(w[~there], buckets))
            inner = flat[:-1] != END
            first, second, o = flat[:-1][inner], flat[1:][inner], owner[:-1][inner]
            keys = pair_key(first, second)
            at, there = pairs.find(keys)
            own[:, 3] += np.bincount(o[there], gain[at[there]], len(ids))
            rest = ~there
            send(2, keys[rest], o[rest], pair_bucket(first[rest], second[rest], frequent, share, buckets))
            rows.append((base // BATCH % buckets, 0, base, ids, np.ones(len(ids), int), None, own.ravel(), docs))
            yield _batch(rows, _REQUESTS)

    return run


def _lookup(discount: list[float], norm: float, frequent):
    def joined(column) -> np.ndarray:
        parts = [x for x in column if x is not None and len(x)]
        return np.concatenate(parts) if parts else np.zeros(0, "i8")

    def run(asked: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        """Sums per document of what one bucket knows about the keys asked for."""
        words = tables[tables["kind"] == 1]
        table = Table(*[joined(words[x]) for x in ("h", "c", "x")])
        table.replace_keys(shortened(table.keys))
        contexts, pairs, placed = (tables[tables["kind"] == k] for k in (3, 2, 4))
        known = Table(*[joined(contexts[x]) for x in ("h", "c", "x")])
        h = np.concatenate([np.repeat(joined(x["h"]), joined(x["n"])) for x in (pairs, placed)])
        at = joined(placed["at"])
        w = np.concatenate([joined(pairs["w"]), frequent.value.keys[at]])
        c = np.concatenate([joined(pairs["c"]), joined(placed["c"])])
        cw = np.concatenate([joined(pairs["cw"]), frequent.value.values[0][at]])
        keys, gain = _gains(h, w, c, cw, known, discount, norm)
        del h, at, w, c, cw, contexts, pairs, placed
        kept = Table(shortened(keys), gain)
        rows = []
        for base, portion in asked.groupby("base", sort=False):
            sums, docs = np.zeros((BATCH, 4)), None
            columns = (portion[x] for x in ("level", "who", "n", "key", "own", "doc"))
            for level, who, n, key, own, doc in zip(*columns, strict=True):
                if level == 0:
                    sums[: len(who)] += np.asarray(own).reshape(-1, 4)
                    docs = doc
                    continue
                at, there = (table if level == 1 else kept).find(long_keys(key))
                owner, at = np.repeat(who, n)[there], at[there]
                if level == 1 and len(at):
                    sums[:, 1] += np.bincount(owner, minlength=BATCH)
                    sums[:, 2] += np.bincount(owner, np.log10(table.values[0][at] + 1.0), BATCH)
                    sums[:, 3] += np.bincount(owner, table.values[1][at], BATCH)
                elif len(at):
                    sums[:, 3] += np.bincount(owner, gain[at], BATCH)
            who = np.flatnonzero(sums.any(1))
            rows.append((base, who.astype("i2"), sums[who].ravel(), docs))
        return pd.DataFrame(rows, columns=["base", "who", "sums", "doc"])

    return run


def _merged(portion: pd.DataFrame) -> pd.DataFrame:
    """The documents of one portion with their sums over all buckets."""
    total, docs = np.zeros((BATCH, 4)), None
    for who, sums, doc in zip(portion["who"], portion["sums"], portion["doc"], strict=True):
        total[who] += np.asarray(sums).reshape(-1, 4)
        docs = doc if doc is not None else docs
    out = pd.DataFrame(total[: len(docs)], columns=["tokens", "known", "base", "more"])
    out.insert(0, "doc", list(docs))
    return out


def _boxed(kind: int, buckets: int, contexts, share: float = 1.0):
    """Rows (key, number, logarithm) as arrays for their buckets; a dealt context goes to each of its own."""

    def run(batches):
        for key, c, x in _gathered(batches):
            part = np.zeros(len(key), "i8")
            if contexts is not None:
                parts = parts_of(key, contexts.value, share)
                row = np.repeat(np.arange(len(key)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                key, c, x = key[row], c[row], x[row]
            bucket = _bucket(key + part, buckets)
            rows = []
            for b, at in _portions(np.lexsort((key, bucket)), bucket, buckets):
                at = at[np.r_[True, key[at][1:] != key[at][:-1]]]  # two parts of a context may share a bucket
                rows.append((b, kind, key[at], None, None, None, c[at], None, x[at]))
            yield _batch(rows, _BOXES)

    return run


def score(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    norm = model.tokens + model.vocabulary + 1.0
    top = model.words.filter(F.col("c") >= _high_count(model.words, HEAD_WORDS))
    words = Table(*_arrays(top.select("w", "c", "alpha")))
    head = spark.sparkContext.broadcast((words, _frequent_pairs(model, HEAD_PAIRS), model.frequent))
    frequent = spark.sparkContext.broadcast(model.frequent)
    asked = docs.select(F.col(id_col).cast("string").alias("doc"), bytes_of(text).alias("t")).mapInArrow(
        _request(head, model.share, model.begin_alpha, model.buckets), _REQUEST_COLUMNS
    )
    tables = (
        model.words.select("w", "c", "alpha").mapInArrow(_boxed(1, model.buckets, None), _TABLES)
        .unionByName(model.contexts.select("h", "total", "alpha").mapInArrow(_boxed(3, model.buckets, frequent, model.share), _TABLES))
        .unionByName(model.pairs.select("bucket", "h", "w", "at", "c", "cw").mapInArrow(_runs_of_contexts(model.buckets), _TABLES))
    )
    sums = (
        asked.groupBy("bucket").cogroup(tables.groupBy("bucket"))
        .applyInPandas(_lookup(model.discount, norm, frequent), "base long, who array<smallint>, sums array<double>, doc array<string>")
        .groupBy("base")
        .applyInPandas(_merged, "doc string, tokens double, known double, base double, more double")
    )
    # unknown tokens have log10(1) in base
    base = F.col("base") - F.col("tokens") * F.log10(F.lit(norm))
    return sums.select(
        F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("tokens").cast("long").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("more")).alias("score"),
    )
