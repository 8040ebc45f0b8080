"""Removal of repeated passages, found as overlapping windows of three lines.

Every document is numbered by its lines (split at LF). A window is three consecutive lines; a
document of one or two lines is one window of what it has. Windows are compared by a 128-bit
hash. Of all places of a window the first, by (id, text hash, line number), stays; every line
covered by a later place of some window goes. The covered positions of a document are merged by
writing each removed place as its one to three lines and keeping each line once.

One window may fill a third of the corpus: the first place is a minimum, combined before the
shuffle, and the join back is an equi-join of narrow rows that adaptive execution splits. Only
(row key, line number) pairs travel; per document they are no more than its own lines.

Defined cases: a null text has no lines and stays null; an empty text is one empty line and is
never removed, nor is any window of blank lines only; rows with equal id and equal text are the
same document and are treated alike; null ids sort first and are otherwise ordinary; documents
keep all their columns, only the text changes; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import same, settled

WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))


def windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, h, at, n, w): each window of each document, by its first line, number of lines and hash."""
    lines = _keyed(docs, id_col, text).filter("t is not null").select("id", "h", F.split("t", "\n").alias("lines"))
    parts = F.expr(
        f"transform(sequence(0, greatest(size(lines) - {size}, 0)), "
        f"i -> named_struct('at', i, 'n', least(size(lines), {size}), 's', array_join(slice(lines, i + 1, {size}), '\n')))"
    )
    out = lines.select("id", "h", F.explode(parts).alias("p")).select("id", "h", "p.at", "p.n", "p.s")
    return out.filter(F.col("s").rlike(r"[^\x20\x09-\x0D]")).select("id", "h", "at", "n", F.md5("s").alias("w"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, h, gone): per document the sorted line numbers that later places of windows cover."""
    found = windows(docs, id_col, text, size)
    first = (
        found.groupBy("w")
        .agg(F.min(F.struct("id", "h", "at")).alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .select("w", "first")
    )
    later = found.join(first, "w").filter(~F.struct("id", "h", "at").eqNullSafe(F.col("first")))
    return (
        later.select("id", "h", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("line"))
        .groupBy("id", "h")
        .agg(F.sort_array(F.collect_set("line")).alias("gone"))
    )


def _cut(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(row, id, t, lines, gone, new): each document row with its removed lines and what remains."""
    gone = repeated_lines(docs, id_col, text, size).select(F.col("id").alias("id2"), F.col("h").alias("h2"), "gone")
    joined = _keyed(docs, id_col, text).join(gone, same([F.col("id"), F.col("h")], [F.col("id2"), F.col("h2")]), "left")
    split = joined.select("row", "id", "t", "gone", F.split("t", "\n").alias("lines"))
    left = "transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i))"
    new = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.expr(f"array_join({left}, '\n')"))
    return settled(split.withColumn("new", new), "lines", "new")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW, drop_emptied: bool = False
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; same columns.

    ``drop_emptied`` leaves out documents that consisted of repeated passages only.
    """
    out = _cut(docs, id_col, text, size)
    if drop_emptied:
        out = out.filter(F.col("gone").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document row: id, n_lines, n_removed and the text that remains."""
    return _cut(docs, id_col, text, size).select(
        F.col("id").alias(id_col),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.col("new").alias(text),
    )
