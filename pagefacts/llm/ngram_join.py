"""Near-duplicate join: word n-gram Jaccard with Bayesian pruning of MinHash candidates.

1. Each text becomes its set of five-word shingles (64-bit hashes; a shorter text is one shingle
   of its words). Texts with the same set are one class member: the smallest row of them stands
   for all, and their number is kept, so copies never meet each other.
2. Each representative gets ``HASHES`` MinHash values of 16 bits. Bands of ``ROWS`` values make
   buckets; with 32 bands of 4 a pair at 0.8 shares no bucket with probability 5e-8.
3. Pairs of a bucket are compared value by value, ``STEP`` at a time. After each step the
   posterior (uniform prior) that the similarity reaches the threshold is a binomial tail of the
   matches so far; below ``TOLERANCE`` the pair is dropped. Surviving pairs connect candidates.
4. The candidates of one connected piece meet once more, pruned in the same way, and what is left
   is verified exactly on the shingle sets.

Buckets and pieces may be of any size: a large one is cut into blocks by hash, and every pair of
blocks is a task of bounded size that works on arrays. Only a row for each document and block
leaves a task - its number of links and one edge to its class - never a row for each pair.

Defined cases: texts without words (null, empty, blank) have no shingles, no links and are a
class of their own; ids may be null or repeated, every row is a document; ties go to the smallest
id; extra columns are kept or ignored as the function says; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import bytes_of
from pagefacts.llm.components import components
from pagefacts.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
ROWS = 4
STEP = 32
TOLERANCE = 1e-9

#: Documents of one block of a bucket or piece; shingles of one block of a piece.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1_000_000
#: Rows that small buckets are gathered to.
CELL_ROWS = 4096
#: Pairs that are compared at a time.
PAIRS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * n + 1, dtype="u8") * _MIX)
    return (x[:n] | np.uint64(1)).astype("u4"), x[n:].astype("u4")


class _WordHashes(dict):
    """Word -> 64-bit hash, in a table that is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 200_000:
            self.clear()
        if len(word) < 256:
            self[word] = h
        return h


_words = _WordHashes()


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.split()  # of bytes: at the six ASCII spaces
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(size, len(h))):
        out = out * _MIX + h[k : k + n]
    return np.unique(_mixed(out))


def minhash(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value under each of the permutations x -> a x + b (mod 2^32)."""
    low = np.full(len(a), 0xFFFFFFFF, "u4")
    x = (sets >> np.uint64(32)).astype("u4")
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024, None] * a + b).min(0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("u2")


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """Matches needed after each step so that P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior after m matches of k is Beta(m + 1, k - m + 1), whose upper
    tail is the probability of at most m successes in k + 1 trials.
    """
    out = []
    for k in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def surviving(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int], step: int = STEP) -> np.ndarray:
    """Whether each pair (left[i], right[i]) of signatures survives all steps."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), int)
    for k, need in enumerate(least):
        part = slice(k * step, (k + 1) * step)
        matches = matches + (sigs[left[alive], part] == sigs[right[alive], part]).sum(1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def group_pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within equal groups, in portions: side 0 with side 1 in cross groups, else each with each."""
    order = np.lexsort((side, group))
    g, s, x = group[order], side[order], cross[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(g)]
    partner_from = np.arange(len(g)) + 1
    partner_to = np.repeat(ends, ends - starts)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if x[a]:
            middle = a + int(np.searchsorted(s[a:b], 1))
            partner_from[a:middle], partner_to[middle:b] = middle, 0
    count = np.maximum(partner_to - partner_from, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(g):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        n = count[at:to]
        left = np.repeat(np.arange(at, to), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield order[left], order[np.repeat(partner_from[at:to], n) + offset]
        at = to


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, left, right) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients(HASHES)
    for batch in batches:
        digests, sizes, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sizes.append(len(s))
            sigs.append(minhash(s, a, b).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
            ["key", "digest", "size", "sig"],
        )


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), HASHES)


def _cells(rows: DataFrame, group: list[str], weight: str | None) -> DataFrame:
    """Deals groups of two and more rows to cells: small groups share one, large ones are cut into blocks.

    Adds cell, part and side. In a group of B > 1 blocks every row goes to B parts, one for each
    pair of its block with a block; other rows have one part. ``rows`` needs ``key`` and ``group``.
    """
    sizes = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(weight if weight else F.lit(0)).alias("_w")
    ).filter("_n > 1")
    blocks = F.ceil(F.greatest(F.col("_n") / BLOCK_DOCS, F.col("_w") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select(*group, blocks.alias("_b"))
    dealt = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.select(
        *rows.columns,
        (F.col("_b") > 1).alias("large"),
        F.least("_own", "_other").alias("part_a"),
        F.greatest("_own", "_other").alias("part_b"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )


def _cell_key(group: list[str], cells: int):
    """Large groups are a cell for each pair of blocks; the others are gathered by hash."""
    return F.when(F.col("large"), F.xxhash64(*group, "part_a", "part_b")).otherwise(
        F.pmod(F.xxhash64(*group), F.lit(cells))
    )


def _candidates(least: list[int]):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        """One edge for each row that has a surviving pair in this cell."""
        sigs = _sigs(cell["sig"])
        group = cell.groupby(["bucket", "part_a", "part_b"], sort=False).ngroup().to_numpy()
        forest = Forest(len(cell))
        for left, right in group_pairs(group, cell["side"].to_numpy(), (cell["part_a"] != cell["part_b"]).to_numpy()):
            ok = surviving(sigs, left, right, least)
            forest.join(left[ok], right[ok])
        key = cell["key"].to_numpy()
        root = np.array([forest.root(i) for i in range(len(cell))], int)
        moved = root != np.arange(len(cell))
        return pd.DataFrame({"a": key[moved], "b": key[root[moved]]}).drop_duplicates()

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets, by looking up the smaller in the larger."""
    out = np.zeros(len(left), int)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[i] = np.count_nonzero(y[at] == x)
    return out


def _shared_matrix(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same by products of 0/1 matrices over the shingles that occur more than once."""
    rows = sorted(set(left.tolist()) | set(right.tolist()))
    at = {r: i for i, r in enumerate(rows)}
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[wanted] = np.arange(len(wanted))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    total = np.zeros((len(rows), len(rows)), "f4")
    for begin in range(0, len(wanted), 4096):
        part = (column >= begin) & (column < begin + 4096)
        m = np.zeros((len(rows), min(4096, len(wanted) - begin)), "f4")
        m[owner[part], column[part] - begin] = 1
        total += m @ m.T
    return total[[at[x] for x in left.tolist()], [at[x] for x in right.tolist()]].astype(int)


def _verified(least: list[int], threshold: float):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        """For each row with a link in this cell: the linked documents, and one edge to its class."""
        sigs = _sigs(cell["sig"])
        sets = [np.frombuffer(x, "<u8") for x in cell["sets"]]
        sizes = np.array([len(x) for x in sets])
        copies = cell["copies"].to_numpy()
        group = cell.groupby(["piece", "part_a", "part_b"], sort=False).ngroup().to_numpy()
        forest, links = Forest(len(cell)), np.zeros(len(cell), np.int64)
        for left, right in group_pairs(group, cell["side"].to_numpy(), (cell["part_a"] != cell["part_b"]).to_numpy()):
            ok = surviving(sigs, left, right, least)
            # sets of too different sizes cannot reach the threshold
            ok &= np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right])
            left, right = left[ok], right[ok]
            if not len(left):
                continue
            dense = len(left) > 8 * len(np.union1d(left, right))
            both = (_shared_matrix if dense else _shared)(sets, left, right)
            ok = both >= threshold * (sizes[left] + sizes[right] - both)
            left, right = left[ok], right[ok]
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            forest.join(left, right)
        key = cell["key"].to_numpy()
        root = np.array([forest.root(i) for i in range(len(cell))], int)
        has = links > 0
        return pd.DataFrame({"a": key[has], "b": key[root[has]], "links": links[has]})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "sets"])


def _classes(keyed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(key, class_key, n_links) of every row of ``keyed`` (key, t); key is a unique long."""
    least = least_matches(threshold, tolerance)
    signed = cut_lineage(
        keyed.mapInArrow(_signatures, "key long, digest binary, size int, sig binary"), "ngram-signatures"
    )
    whole = signed.filter("digest is not null")
    reps = cut_lineage(whole.groupBy("digest").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "ngram-texts")
    named = reps.join(whole.select("key", "sig", "size"), "key")
    bands = F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), i -> xxhash64(i, substring(sig, 1 + i * {2 * ROWS}, {2 * ROWS})))")
    buckets = named.select("key", "sig", F.explode(bands).alias("bucket"))
    cells = 1 + reps.count() * 2 // CELL_ROWS
    narrow = _cells(buckets.select("key", "bucket"), ["bucket"], None)
    held = narrow.join(whole.select("key", "sig"), "key")
    edges = (
        held.withColumn("cell", _cell_key(["bucket"], 4 * cells))
        .groupBy("cell")
        .applyInPandas(_candidates(least), "a long, b long")
    )
    pieces = components(cut_lineage(edges, "ngram-candidates"))
    members = (
        pieces.withColumnRenamed("root", "piece").withColumnRenamed("v", "key")
        .join(named.select("key", "copies", "sig", "size"), "key")
    )
    members = cut_lineage(members, "ngram-members")
    # texts go by key at every size; the members grow with the input and are never broadcast
    sets = keyed.join(members.select("key").hint("merge"), "key", "left_semi").mapInArrow(_sets, "key long, sets binary")
    sets = cut_lineage(sets, "ngram-sets")
    dealt = _cells(members.select("key", "piece", "copies", "size"), ["piece"], "size")
    dealt = dealt.withColumn("cell", _cell_key(["piece"], cells)).join(members.select("key", "sig"), "key").join(sets, "key")
    found = dealt.groupBy("cell").applyInPandas(_verified(least, threshold), "a long, b long, links long")
    found = cut_lineage(found, "ngram-links")
    linked = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    return (
        signed.select("key", "digest")
        .join(reps.select("digest", F.col("key").alias("rep"), "copies"), "digest", "left")
        .join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left")
        .join(linked.select(F.col("key").alias("rep"), "links"), "rep", "left")
        .select(
            "key",
            F.coalesce("root", "rep", "key").alias("class_key"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        )
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``rows`` holds each input row as ``row`` under a unique ``key``; ``classes``
    gives each key its class_key and n_links, the number of other rows at or above the threshold.
    """
    rows = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "ngram-rows"
    )
    return rows, _classes(rows.select("key", bytes_of(F.col("row")[text]).alias("t")), threshold, tolerance)


def link_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document row: id, class_id (the smallest id of its class), n_links."""
    rows, classes = near_duplicates(docs.select(id_col, text), text, **options)
    named = cut_lineage(classes.join(rows.select("key", F.col(f"row.{id_col}").alias("id")), "key"), "ngram-classes")
    # written, so that the join back is between plain tables and a large class can be split
    least = cut_lineage(named.groupBy("class_key").agg(F.min("id").alias("class_id")), "ngram-class-ids")
    return named.join(least, "class_key").select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns."""
    rows, classes = near_duplicates(docs, text, **options)
    named = cut_lineage(classes.join(rows.select("key", F.col(f"row.{id_col}").alias("id")), "key"), "ngram-classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    kept = named.groupBy("class_key").agg(first).select("first.key")
    return rows.join(kept.hint("merge"), "key", "left_semi").select("row.*")
