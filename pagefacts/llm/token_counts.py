"""Token counts of whole texts by a two-tier lookup on the map side.

A byte-level BPE never merges across the start of a white-space run, so a text splits into
chunks (a white-space run with the word after it) that are tokenised independently; a document's
count is the sum over its chunks. Tier one is a table of the corpus' most frequent chunks with
their token counts: at most ``FREQUENT`` entries of at most ``MAX_CHUNK`` bytes, so its size has
a fixed bound and it is broadcast, as one packed table that a worker opens once. Tier two is a
bounded cache per worker for what the library had to encode. No chunk is shuffled: every partition
leaves one packed summary of bounded size over its documents, and whole summaries are merged, up to
``FAN`` in a task, level by level until one is left.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); ids are passed through, null or
repeated; special strings inside a text are handled as the library does by default; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.chunk_cache import TEXTS, WHITE, file_text, load_tokenizer, worker_cache
from pagefacts.session import cut_lineage

FREQUENT = 65_536
MAX_CHUNK = 64
PER_PARTITION = 16_384
TOKEN_LIMIT = 1024

#: Summaries that one task merges, one after the other.
FAN = 64

CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def pack(chunks: list[str], numbers: list[int]) -> bytes:
    """Chunks with a number each as one compressed blob."""
    batch = pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.array(numbers, pa.int64())], ["chunk", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> tuple[list[str], list[int]]:
    table = pa.ipc.open_stream(blob).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def _top(seen: Counter, size: int) -> tuple[list[str], list[int]]:
    """The most frequent short chunks, ties by their text, so that a run repeated gives the same."""
    short = [(-n, c) for c, n in seen.items() if len(c.encode("utf-8", "replace")) <= MAX_CHUNK]
    top = heapq.nsmallest(size, short)
    return [c for _, c in top], [-n for n, _ in top]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's most frequent chunks as one blob; rare ones are let go when the table fills up."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(CHUNKS.findall(text))
        if len(seen) > 20 * PER_PARTITION:
            seen = Counter(dict(seen.most_common(10 * PER_PARTITION)))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([pack(*_top(seen, PER_PARTITION))], pa.binary())], ["summary"])


def _merged(size: int):
    def merge(batches):
        seen: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0):
                chunks, numbers = unpack(blob.as_py())
                for chunk, n in zip(chunks, numbers, strict=True):
                    seen[chunk] += n
                if len(seen) > 4 * size:
                    seen = Counter(dict(zip(*_top(seen, 2 * size), strict=True)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*_top(seen, size))], pa.binary())], ["summary"])

    return merge


def frequent_chunks(docs: DataFrame, text: str, source, size: int = FREQUENT, fan: int = FAN) -> bytes:
    """The packed table (chunk, token count) of the most frequent chunks of the corpus, at most ``size`` of them.

    What moves between tasks are summaries, at most ``size`` chunks each. The result is one value of bounded size.
    """
    left = cut_lineage(docs.select(F.col(text).alias("t")).mapInArrow(_summaries, "summary binary"), "chunk-summaries")
    merge, count = _merged(size), left.count()
    while count > fan:
        groups = -(-count // fan)
        left = cut_lineage(left.repartition(groups).mapInArrow(merge, "summary binary"), "chunk-summaries")
        count = left.count()

    def encode(batches):
        tokenizer = load_tokenizer(source.value)
        for batch in merge(batches):
            chunks, _ = unpack(batch.column(0)[0].as_py())
            n = [len(e.ids) for e in tokenizer.encode_batch(chunks, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array([pack(chunks, n)], pa.binary())], ["summary"])

    found = left.repartition(1).mapInArrow(encode, "summary binary").collect()  # one row, or none without any chunk
    return bytes(found[0].summary) if found else pack([], [])


_opened: dict = {}


def _lengths(blob: bytes) -> dict:
    """The table as a dictionary, opened once in a worker process."""
    key = hash(blob)
    if key not in _opened:
        _opened.clear()
        _opened[key] = dict(zip(*unpack(blob), strict=True))
    return _opened[key]


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. ``tokenizer`` is the path of a byte-level .json file."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(file_text(tokenizer))
    table = spark.sparkContext.broadcast(frequent_chunks(docs, text, source))  # at most FREQUENT short chunks

    def count(batches):
        cache = worker_cache("lengths", source.value, len, _lengths(table.value))
        for batch in batches:
            texts, n = batch.column(2).to_pylist(), []
            for at in range(0, len(texts), TEXTS):
                chunks = [CHUNKS.findall(t) if t else [] for t in texts[at : at + TEXTS]]
                length = cache.covering(chunks)
                n += [sum(map(length, c)) for c in chunks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )
        cache.rest()

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            F.col(text).alias("t"),
        )
        .mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
