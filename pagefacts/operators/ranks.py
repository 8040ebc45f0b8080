"""Places of rows in an order, and pages of it that read only where they lie.

Rows are dealt to ranges of the order by sampled bounds and written, one folder a range. The
number of rows of each range is counted once; sums of these give every range its first place. A
page, however deep, reads the ranges it overlaps; the place of every row is its place in its
range plus that of the range. The order should end in a unique column: rows that tie have no
defined order among themselves, and many of them would fill one range.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefacts.session import durable_dir


class RankedRows:
    """Ordered rows in ranges; ``ranges`` lists (range, first place, rows), one entry a range."""

    def __init__(self, rows: DataFrame, order: tuple[Column | str, ...], ranges: list[tuple[int, int, int]]):
        self.rows, self.order, self.ranges = rows, order, ranges
        self.columns = [c for c in rows.columns if c != "_range"]

    def __len__(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows at places offset .. offset + size - 1, in order."""
        hit = [r for r in self.ranges if r[1] < offset + size and offset < r[1] + r[2]]
        rows = self.rows.filter(F.col("_range").isin([r[0] for r in hit])).select(self.columns)
        return rows.orderBy(*self.order).offset(max(offset - hit[0][1], 0) if hit else 0).limit(size)

    def page(self, number: int, size: int) -> DataFrame:
        """one page; numbers start at 1."""
        return self.slice((number - 1) * size, size)

    def places(self, name: str = "place") -> DataFrame:
        """All rows with their place, from 1."""
        starts = self.rows.sparkSession.createDataFrame([(r, s) for r, s, _ in self.ranges], "_range int, _start long")
        own = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order))
        return self.rows.join(starts, "_range").withColumn(name, own + F.col("_start")).select(*self.columns, name)


def rank_rows(df: DataFrame, *order: Column | str, ranges: int | None = None) -> RankedRows:
    """``df`` laid out by an order, for pages and places."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{durable_dir(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = sorted((r[0], r[1]) for r in rows.groupBy("_range").count().collect())  # a number a range
    starts = itertools.accumulate((n for _, n in counts), initial=0)
    return RankedRows(rows, order, [(r, s, n) for (r, n), s in zip(counts, starts, strict=False)])
