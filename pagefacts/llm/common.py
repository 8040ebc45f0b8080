"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.session import tune

#: One batch of rows handed to a Python worker; keeps a batch of ordinary texts at a few MB.
BATCH_ROWS = 2000

#: White space as the word definitions of the operators have it: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for the operators: adaptive plans and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(text: str | Column) -> Column:
    """UTF-8 bytes of a text, null as empty; Python then gets bytes without decoding."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of several columns, usable as an equi-join condition."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns computed once a row, whatever is built on them.

    A filter above would otherwise be moved below the projections and carry their expressions
    along, into lambdas that would then evaluate them for every element. Filters stop at a
    generator, here of one row.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
