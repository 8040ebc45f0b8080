"""Removal of byte strings that an earlier document has too, by suffix arrays of shards.

Every byte goes that is covered by a string of ``WIDTH`` bytes that also starts in a document of
smaller id. Texts are UTF-8 bytes, strings never cross documents, and all are judged on the input.

Shards. A string's anchor is the least hash of its ``GRAM``-byte stretches, so equal strings have
equal anchors, wherever they stand. Neighbouring strings of a text mostly share one anchor; they
make a snippet, and a snippet's shard is a range of anchor hashes: all occurrences of any string
meet in one shard. Anchors that only one document has cannot be shared and go no further: groups
of documents send 4 bytes an anchor and get a bit back. Equal snippets of a group of documents
travel once, so a passage that stands in a third of all documents is at most one row a group.

In a shard, equal snippets become one with their least document. An anchor with one snippet needs
no more. All others are sorted by suffix, by external induced sorting with common-prefix values
(``induced_sort``), which holds its tuples in files of the shared folder: suffixes next to each
other that share ``WIDTH`` bytes are one string, whose least document is the least of theirs. Each
group of documents then gets, per snippet, the strings that an earlier document has.

Texts are written once, in groups of at most ``GROUP_BYTES`` (or one document), bucketed by group,
and are read three times from there without being shuffled.

Snippets count as equal by a 64-bit hash of all their bytes next to the 40 bits of their anchor;
strings of different snippets are compared by their bytes.

Defined cases: null and empty texts have no strings; a null id is smaller than any other and equal
to other null ids; rows of equal id are parts of one document and do not remove each other's
strings; other columns are kept in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.llm.common import bytes_of
from pagefacts.llm.induced_sort import Scratch, comparer, suffixes_descending, whole
from pagefacts.session import cut_lineage, durable_dir

WIDTH, GRAM = 50, 24
GROUP_BYTES, GROUP_ROWS = 4_000_000, 4000
SHARD_BYTES = 8_000_000
MEMORY = 32_000_000
_SLAB = 1 << 16  # bytes that are hashed at a time, so that they stay in the processor's cache
_PLACE = np.uint64(24)  # bits of a place in a slab

_LEAST_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Snippets:
    """The snippets of some texts, by anchor: place and number of strings, hash, and text they are in."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join([*texts, bytes(width + 8)]), np.uint8)
        self.width, n = width, int(sizes.sum())
        change = np.zeros(n + 1, np.int8)
        some = sizes > 0
        np.add.at(change, np.maximum(self.starts, self.ends - width + 1)[some], -1)
        np.add.at(change, self.ends[some], 1)
        inside = np.cumsum(change[:n]) == 0  # a string that starts here ends in the same text
        found = [self._slab(inside, a, min(a + _SLAB, n), gram) for a in range(0, n, _SLAB)]
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        self.at, self.count, self.anchor, self.body = (
            np.concatenate(c) if found else np.zeros(0, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)
        )
        self.text = np.searchsorted(self.ends, self.at, "right")

    def _slab(self, starts: np.ndarray, a: int, b: int, gram: int) -> tuple:
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        grams = b - a + self.width - gram
        h = _mixed(words[a : a + grams])
        for k in range(8, gram, 8):
            h = _mixed(h ^ words[a + k : a + k + grams])
        least = (h >> _PLACE << _PLACE) | np.arange(grams, dtype=np.uint64)
        span, have = self.width - gram + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if span > have:
            least = np.minimum(least[: have - span], least[span - have :])
        inside = starts[a:b]
        edge = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]), True]
        at = np.flatnonzero(edge)
        count, at = np.diff(at), at[:-1]
        at, count = at[inside[at]], count[inside[at]]
        last = at + count - 1 + self.width - gram  # the last stretch of the snippet
        body = _mixed(h[at] + count.astype(np.uint64))
        for k in range(gram, 2 * self.width - gram, gram):
            body = _mixed(body ^ h[np.minimum(at + k, last)])
        return at + a, count, _mixed(least[at] >> _PLACE) >> _PLACE, body  # mixed again, as least hashes are small


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(8)) * np.uint64(buckets)) >> np.uint64(32)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the first of equal rows stands."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stops(heads: np.ndarray, n: int) -> np.ndarray:
    """Where each stretch that begins at a head ends, the last one at ``n``."""
    return np.r_[heads[1:], n][: len(heads)]


def _parts(values: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    return np.split(values, heads[1:])[: len(heads)]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes: first bytes of all, then second bytes, and so on."""
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, *kinds: str) -> list[np.ndarray]:
    sizes = [rows * np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd", asbytes=True), np.uint8)
    planes = np.split(raw, np.cumsum(sizes)[:-1])
    return [np.ascontiguousarray(p.reshape(np.dtype(k).itemsize, rows).T).view(k).ravel() for p, k in zip(planes, kinds, strict=True)]


def _texts(group: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    group = group.sort_by("no")
    return group, group.column("t").to_pylist(), group.column("d").to_numpy()


def _announce(width: int, gram: int, buckets: int):
    """Per group and bucket: the distinct anchors, and which of them several documents of the group have."""

    def run(group: pa.Table) -> pa.Table:
        _, texts, d = _texts(group)
        found = Snippets(texts, width, gram)
        order = np.lexsort((d[found.text], found.anchor))
        anchor, doc = found.anchor[order], d[found.text][order]
        heads = _heads(anchor)
        ends = _stops(heads, len(anchor)) - 1
        anchor, several = anchor[heads], doc[heads] != doc[ends]
        bucket = _bucket(anchor, buckets)
        first = _heads(bucket)
        columns = {
            "bucket": pa.array(bucket[first].astype(np.int32)),
            "src": pa.array(np.full(len(first), group.column("src")[0].as_py()), pa.int64()),
            "rows": pa.array(_stops(first, len(anchor)) - first, pa.int32()),
            # sorted, so differences are small
            "anchors": pa.array([_packed(np.diff(x.astype("<u4"), prepend=np.uint32(0))) for x in _parts(anchor, first)], pa.binary()),
            "several": pa.array([np.packbits(x).tobytes() for x in _parts(several, first)], pa.binary()),
        }
        return pa.table(columns)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Per group of documents: a bit for each of its anchors of a bucket, set if several documents have it."""
    sizes = group.column("rows").to_pylist()
    own = [np.cumsum(_unpacked(x, n, "<u4")[0], dtype=np.uint32) for x, n in zip(group.column("anchors").to_pylist(), sizes, strict=True)]
    values, inverse, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    again = np.split((times >= 2)[inverse], np.cumsum([len(x) for x in own])[:-1])
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)) for x, o in zip(group.column("several").to_pylist(), own, strict=True)]
    masks = [np.packbits(a | s.astype(bool)).tobytes() for a, s in zip(again, several, strict=True)]
    return pa.table({"src": group.column("src"), "bucket": group.column("bucket"), "mask": pa.array(masks, pa.binary())})


class Shared:
    """The snippets of a group of texts whose anchors several documents have, equal ones together."""

    def __init__(self, texts: list[bytes], masks: dict[int, bytes], width: int, gram: int, buckets: int):
        self.found = f = Snippets(texts, width, gram)
        order = np.lexsort((f.body, f.anchor))
        first = _heads(f.anchor[order])
        bucket = _bucket(f.anchor[order][first], buckets)
        kept = np.zeros(len(first), bool)
        for at, stop in zip(b := _heads(bucket), _stops(b, len(bucket)), strict=True):
            if (mask := masks.get(int(bucket[at]))) is not None:
                kept[at:stop] = np.unpackbits(np.frombuffer(mask, np.uint8), count=stop - at).astype(bool)
        keep = np.repeat(kept, _stops(first, len(order)) - first)
        #: Snippets in order of anchor and body; ``heads`` are the first of equal ones.
        self.order = order[keep]
        self.anchor = f.anchor[self.order]
        self.heads = _heads(self.anchor, f.body[self.order])
        self.times = _stops(self.heads, len(self.order)) - self.heads
        self.bucket = _bucket(self.anchor[self.heads], buckets)
        self.first_of_bucket = _heads(self.bucket)


def _masks(group: pa.Table) -> dict[int, bytes]:
    return {b: m for b, m in zip(group.column("bucket").to_pylist(), group.column("mask").to_pylist(), strict=True) if m is not None}


_SNIPPETS = "shard int, src long, rows int, snippets binary, size int, bytes binary"
_SNIPPET = ("<u8", "<i8", "<u4", "<u2", "?")  # body, least document, anchor, size, whether several documents have it


def _send(width: int, gram: int, buckets: int):
    """Per group and shard: its distinct shared snippets with their least document."""

    def run(group: pa.Table, marks: pa.Table) -> pa.Table:
        _, texts, d = _texts(group)
        own = Shared(texts, _masks(marks), width, gram, buckets)
        f, heads = own.found, own.heads
        doc = d[f.text[own.order]]
        least = np.minimum.reduceat(doc, heads) if len(heads) else doc
        several = np.maximum.reduceat(doc, heads) > least if len(heads) else doc > 0
        one = own.order[heads]
        sizes = f.count[one] + width - 1
        columns = [x.astype(k) for x, k in zip((f.body[one], least, own.anchor[heads], sizes, several), _SNIPPET, strict=True)]
        first = own.first_of_bucket
        rows, snippets, size, data = [], [], [], []
        for a, b in zip(first.tolist(), _stops(first, len(heads)).tolist(), strict=True):
            begin = np.cumsum(sizes[a:b]) - sizes[a:b]
            total = int(sizes[a:b].sum())
            text = f.data[np.repeat(f.at[one[a:b]] - begin, sizes[a:b]) + np.arange(total)]
            rows.append(b - a)
            snippets.append(_packed(*(c[a:b] for c in columns)))
            size.append(total)
            data.append(_packed(text))
        return pa.table(
            {
                "shard": pa.array(own.bucket[first].astype(np.int32)),
                "src": pa.array(np.full(len(first), group.column("src")[0].as_py()), pa.int64()),
                "rows": pa.array(rows, pa.int32()), "snippets": pa.array(snippets, pa.binary()),
                "size": pa.array(size, pa.int32()), "bytes": pa.array(data, pa.binary()),
            }
        )

    return run


def _least_documents(x: np.ndarray, n: int, ends: np.ndarray, doc: np.ndarray, width: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(documents, per place of the snippets laid end to end the number of the least that has the string there)."""
    known, doc = np.unique(doc, return_inverse=True)
    out = scratch.array(n, whole(len(known)))
    held_pos, held_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, pos, shared in suffixes_descending(x[:n], 256, scratch, width, comparer(x, width)):
        group = np.cumsum(shared < width)
        snippet = np.searchsorted(ends, pos, "right")
        fits = pos + width <= ends[snippet]
        pos, group, own = np.r_[held_pos, pos[fits]], np.r_[np.zeros(len(held_pos), np.int64), group[fits]], np.r_[held_doc, doc[snippet[fits]]]
        if not len(pos):
            continue
        heads = _heads(group)
        out[pos] = np.repeat(np.minimum.reduceat(own, heads), _stops(heads, len(pos)) - heads)
        # the last group may go on in the next piece
        held_pos, held_doc = pos[heads[-1] :], np.full(len(pos) - heads[-1], own[heads[-1] :].min())
    return known, out


_FOUND = "src long, bucket int, rows int, found binary"
_STRINGS = ("<i8", "<u4", "<u2", "<u2")  # least document, snippet, first string, strings


def _shard(rows: list[dict], width: int, scratch: Scratch) -> Iterator[tuple]:
    """Rows of ``_FOUND``: the strings of each group of documents that an earlier document has."""
    unpacked = zip(*(_unpacked(r.pop("snippets"), r["rows"], *_SNIPPET) for r in rows), strict=True)
    body, least, anchor, sizes, several = map(np.concatenate, unpacked)
    sizes = sizes.astype(np.int64)
    data = scratch.joined((_unpacked(r.pop("bytes"), r["size"], "u1")[0].tobytes() for r in rows), 0)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((body, anchor))
    heads = _heads(anchor[order], body[order])
    times = _stops(heads, len(order)) - heads
    doc = np.minimum.reduceat(least[order], heads)
    one = order[heads]
    same = _heads(anchor[one])
    together = _stops(same, len(one)) - same
    differ = np.repeat(together > 1, together)
    # anchors with several snippets: their suffixes are sorted
    mixed = one[differ]
    ends = np.cumsum(sizes[mixed])
    starts = ends - sizes[mixed]
    n = int(ends[-1]) if len(ends) else 0

    def pieces():
        for at in range(0, len(mixed), 10_000):
            part = slice(at, at + 10_000)
            total = int(sizes[mixed[part]].sum())
            yield data[np.repeat(begin[mixed[part]] - (starts[part] - starts[at]), sizes[mixed[part]]) + np.arange(total)].tobytes()

    text = scratch.joined(pieces(), width + 8)
    known, found = _least_documents(text, n, ends, doc[differ], width, scratch)
    # back to the snippets of each group of documents
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.repeat(np.arange(len(one)), times)
    place = np.full(len(one), -1)
    place[differ] = starts
    held = np.array([r["rows"] for r in rows])
    blob = np.repeat(np.arange(len(rows)), held)
    entry = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
    plain = np.flatnonzero(~differ[distinct] & ((doc[distinct] < least) | several))
    owner = [plain]
    offset, count, value = [np.zeros(len(plain), np.int64)], [sizes[plain] - width + 1], [doc[distinct[plain]]]
    rest = np.flatnonzero(differ[distinct])
    for at in range(0, len(rest), 50_000):
        part = rest[at : at + 50_000]
        strings = sizes[part] - width + 1
        who = np.repeat(part, strings)
        off = np.arange(len(who)) - np.repeat(np.cumsum(strings) - strings, strings)
        least_doc = known[found[place[distinct[who]] + off]]
        hit = (least_doc < least[who]) | several[who]
        edge = _heads(who, np.where(hit, least_doc, 0), hit)
        length = _stops(edge, len(who)) - edge
        edge, length = edge[hit[edge]], length[hit[edge]]
        for column_, v in zip((owner, offset, count, value), (who[edge], off[edge], length, least_doc[edge]), strict=True):
            column_.append(v)
    owner, offset, count, value = map(np.concatenate, (owner, offset, count, value))
    by = np.argsort(blob[owner], kind="stable")
    owner, offset, count, value = owner[by], offset[by], count[by], value[by]
    first = _heads(blob[owner])
    for at, stop in zip(first.tolist(), _stops(first, len(owner)).tolist(), strict=True):
        r = rows[int(blob[owner[at]])]
        s = slice(at, stop)
        strings = [x[s].astype(k) for x, k in zip((value, entry[owner], offset, count), _STRINGS, strict=True)]
        yield r["src"], r["shard"], stop - at, _packed(*strings)


def _shards(width: int, folder: str | None, memory: int):
    """The shards of a partition, which come sorted by shard."""

    def solved(rows):
        with Scratch(folder, memory) as scratch:
            out = list(zip(*_shard(rows, width, scratch), strict=True))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["src", "bucket", "rows", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["shard"] != row["shard"]:
                    yield from solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from solved(rows)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _remove(width: int, gram: int, buckets: int):
    """The rows of a group of documents with the spans that go and the bytes that stay."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        group, texts, d = _texts(group)
        own = Shared(texts, _masks(answers), width, gram, buckets)
        f = own.found
        first = dict(zip(own.bucket[own.first_of_bucket].tolist(), own.first_of_bucket.tolist(), strict=True))
        cover = np.zeros(len(f.data) + 1, np.int32)
        for r in answers.select(["bucket", "rows", "found"]).to_pylist():
            if r["found"] is None:
                continue
            least, entry, offset, count = (x.astype(np.int64) for x in _unpacked(r["found"], r["rows"], *_STRINGS))
            entry += first[r["bucket"]]
            times = own.times[entry]
            run_ = np.repeat(np.arange(len(entry)), times)
            which = own.order[own.heads[entry][run_] + np.arange(len(run_)) - np.repeat(np.cumsum(times) - times, times)]
            later = d[f.text[which]] > least[run_]
            begin = f.at[which[later]] + offset[run_[later]]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + count[run_[later]] + width - 1, -1)
        gone = np.cumsum(cover)[: len(f.data)] > 0
        spans, kept = [], []
        for text, a, b in zip(texts, f.starts.tolist(), f.ends.tolist(), strict=True):
            mine = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            spans.append([{"start": s, "length": e - s} for s, e in edge.reshape(-1, 2).tolist()])
            kept.append(f.data[a:b][~mine].tobytes() if len(edge) else text)
        return pa.table({"row": group.column("row"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers groups of documents of bounded size, and the documents in them."""
    base, group, size, no = TaskContext.get().partitionId() << 32, 0, 0, 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(2)).to_pylist()
        src, numbers = [], []
        for n in sizes:
            if no and (size + n > GROUP_BYTES or no >= GROUP_ROWS):
                group, size, no = group + 1, 0, 0
            src.append(base + group)
            numbers.append(no)
            size, no = size + n, no + 1
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(numbers, pa.int32()), *batch.columns], ["src", "no", "row", "d", "t"])


def _written(spark: SparkSession, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents in groups (src, no, row, d, t), as a table bucketed by group: later steps read it without an exchange."""
    rest = F.struct(*[c for c in docs.columns if c != text]).alias("row")
    kind = docs.select(rest).schema["row"].dataType.simpleString()
    packed = docs.select(rest, F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("d"), bytes_of(text).alias("t"))
    numbered = packed.select("row", "d", "t").mapInArrow(_grouped, f"src long, no int, row {kind}, d long, t binary")
    name = f"suffix_groups_{uuid.uuid4().hex}"
    writer = numbered.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").option("compression", "zstd")
    writer.option("path", f"{durable_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018  resolved now, as the name goes; its files stay
    spark.sql(f"DROP TABLE {name}")
    return found


def remove_shared(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
    memory: int = MEMORY,
) -> DataFrame:
    """Per document row: ``row`` (its other columns), n_bytes, ``spans`` (start, length) of removed bytes, ``kept`` bytes.

    ``gram`` is a multiple of 8 below ``width``; ``memory`` bytes of an array or queue of a shard are held in
    memory, the rest in files of the shared folder.
    """
    spark = docs.sparkSession
    if gram % 8 or not 8 <= gram < width or width > 200:
        raise ValueError("gram is a multiple of 8 below width, width at most 200")
    table = _written(spark, docs, id_col, text)
    total = table.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-total // shard_bytes))
    announced = table.groupBy("src").applyInArrow(_announce(width, gram, buckets), "bucket int, src long, rows int, anchors binary, several binary")
    masks = cut_lineage(announced.groupBy("bucket").applyInArrow(_answer, "src long, bucket int, mask binary"), "suffix-masks")
    snippets = table.groupBy("src").cogroup(masks.groupBy("src")).applyInArrow(_send(width, gram, buckets), _SNIPPETS)
    found = cut_lineage(
        snippets.repartition(buckets, "shard").sortWithinPartitions("shard").mapInArrow(_shards(width, _local(durable_dir(spark)), memory), _FOUND),
        "suffix-found",
    )
    answers = masks.unionByName(found, allowMissingColumns=True)
    kind = table.schema["row"].dataType.simpleString()
    return table.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(
        _remove(width, gram, buckets), f"row {kind}, n_bytes long, spans array<struct<start:bigint,length:bigint>>, kept binary"
    )


def _local(folder: str) -> str | None:
    """The shared folder as tasks see it, if it is a mounted one; else their arrays stay in memory."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    return None if "://" in folder else folder


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of ``remove_shared``: its id, n_bytes, n_removed, n_spans and the hash of what stays."""
    return found.select(
        F.col("row")[id_col].alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
