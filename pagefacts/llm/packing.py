"""Best-fit packing of token sequences with a bounded number of open bins.

Each task packs the pieces it meets, online: the open bins stand in a bitset keyed by their free
space (one bit per free amount, with a short stack of bins behind each bit), so the tightest bin
that still fits a piece is the lowest set bit at or above its length. When the number of open
bins exceeds ``OPEN_BINS`` the fullest one closes. What a task leaves open, at most
``OPEN_BINS`` bins, is packed once more by the same method: whole bins are the pieces, longest
first, in few tasks, each of a bounded number of bins.

Only texts longer than a sequence are cut. Pieces are rows of numbers; texts are read once and
never shuffled.

Defined cases: a null or empty text is the end token alone; ids may be null or repeated, each
row is packed on its own; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.chunk_cache import TEXTS, WHITE, file_text, worker_cache
from pagefacts.session import cut_lineage

CAPACITY = 4096
OPEN_BINS = 128
SECOND_BINS = 20_000
END_ID = 1

_CHUNKS = re.compile(f"[^{WHITE}]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!]*)")


def plain_parts(chunk: str) -> list[str] | None:
    """A plain word in lower case and the marks after it, where a chunk is more than that.

    The tokenizer lower-cases, and parts letters from marks before it merges anything; the letters
    meant here are single code points that no mark combines with.
    """
    found = _PLAIN.fullmatch(chunk)
    if not found:
        return None
    parts = [p for p in (found[1].lower(), found[2]) if p]
    return parts if parts != [chunk] else None


class OpenBins:
    """Bins with room, keyed by free space in a bitset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count = 0, 0
        self.stacks: dict[int, list] = {}

    def take(self, length: int):
        """(free space, bin) of the tightest bin that holds ``length``, taken out; None if there is none."""
        fits = self.bits >> length
        if not fits:
            return None
        return self._pop(length + (fits & -fits).bit_length() - 1)

    def fullest(self):
        return self._pop((self.bits & -self.bits).bit_length() - 1)

    def put(self, free: int, item) -> None:
        self.stacks.setdefault(free, []).append(item)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int):
        stack = self.stacks[free]
        item = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return free, item

    def rest(self):
        while self.count:
            yield self.fullest()


def best_fit(lengths, capacity: int = CAPACITY, limit: int = OPEN_BINS):
    """Places lengths online: yields (bin, members as (index, offset), still open at the end)."""
    bins, made = OpenBins(capacity, limit), 0
    for index, length in enumerate(lengths):
        if got := bins.take(length):
            free, (number, members) = got
        else:
            free, number, members = capacity, made, []
            made += 1
        members.append((index, capacity - free))
        if free == length:
            yield number, members, False
            continue
        bins.put(free - length, (number, members))
        if bins.count > limit:
            _, (number, members) = bins.fullest()
            yield number, members, False
    for _, (number, members) in bins.rest():
        yield number, members, True


_PIECES = "id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _pack_texts(source, capacity: int, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("ids", source.value, _packed, split=plain_parts)
        end = _packed([end_id])
        base = TaskContext.get().partitionId() << 40
        pieces: dict[int, tuple] = {}
        seen = [None]

        def stream():
            index = 0
            for batch in batches:
                seen[0] = batch.schema.field(0).type
                docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for begin in range(0, len(docs), TEXTS):
                    chunks = [_CHUNKS.findall(t) if t else [] for t in texts[begin : begin + TEXTS]]
                    ids_of = cache.covering(chunks)
                    for doc, own in zip(docs[begin : begin + TEXTS], chunks, strict=True):
                        data = b"".join(map(ids_of, own)) + end
                        for k, at in enumerate(range(0, len(data), 4 * capacity)):
                            part = data[at : at + 4 * capacity]
                            pieces[index] = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                            yield len(part) // 4
                            index += 1

        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows, strict=True))
            kinds = [seen[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return out

        for number, members, left_open in best_fit(stream(), capacity, limit):
            for index, offset in members:
                rows.append((*pieces.pop(index), base + number, offset, left_open))
            if len(rows) >= 20_000:
                yield flush()
        if rows:
            yield flush()
        cache.rest()

    return run


def _pack_bins(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        lengths, numbers = table.column("used").to_pylist(), table.column("sequence_id").to_pylist()
        out = []
        for _, members, _ in best_fit(lengths, capacity, len(lengths)):
            target = numbers[members[0][0]]
            out += [(numbers[i], target, shift) for i, shift in members]
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["old", "target", "shift"]
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a .json file whose pre-tokenizer splits at white space.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(file_text(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()
    first = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(
        _pack_texts(source, capacity, open_bins, end_id), _PIECES.format(kind)
    )
    first = cut_lineage(first, "packed-pieces")
    left = first.filter("open").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    left = cut_lineage(left, "packed-open-bins")
    parts = -(-left.count() // SECOND_BINS) or 1
    merged = (
        left.repartition(parts, F.xxhash64("sequence_id"))
        .sortWithinPartitions(F.desc("used"), "sequence_id")
        .mapInArrow(_pack_bins(capacity), "old long, target long, shift long")
    )
    moved = (
        first.filter("open")
        .join(merged, F.col("sequence_id") == F.col("old"))
        .select("id", "piece", "start", "length", "ids_crc32", F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    )
    return (
        first.filter("not open").select(moved.columns).unionByName(moved).withColumnRenamed("id", id_col)
    )
