"""Structured Streaming: captures into statements, messages, and change windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from pagefacts.operators.changes import refresh
from pagefacts.session import cut_lineage, discard
from pagefacts.sources import schemas
from pagefacts.sources.statement_log import BUCKETS, COLUMNS, LIMIT, StatementLog
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, Vocabulary

CAPTURED = (
    "source_id BIGINT, webpage_id BIGINT, value STRING, is_blank BOOLEAN, error STRING, captured_at TIMESTAMP_NTZ"
)


MESSAGE_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"

#: A stream keeps at least so many versions of its statements.
KEPT_VERSIONS = 16


def latest_captures(log: DataFrame) -> DataFrame:
    """Newest capture per rule and page. The top-1 filter runs before the shuffle too."""
    newest = Window.partitionBy("source_id", "webpage_id").orderBy(F.col("captured_at").desc(), "value")
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def refresh_stream(
    store: Store, captures: DataFrame, root: str, as_of: str, vocab: Vocabulary = DEFAULT, buckets: int = BUCKETS, limit: int = LIMIT
) -> StreamingQuery:
    """K1: each micro-batch of captures refreshes the statements it touches.

    The statements are a log (``StatementLog``): a batch reads the buckets of its captures, at most
    ``limit`` runs of each, and appends the statements it changed as a new version. Its cost does not
    depend on the number of batches before it. A replayed batch writes the same version again, so
    results are exactly-once.
    """
    # a stream's own session plans without adaptive execution; what a batch does to the statements is a job
    # of the session the stream was made in, with partitions that follow its size
    spark = captures.sparkSession
    log = StatementLog(spark, f"{root.rstrip('/')}/statements", buckets, limit)
    log.start(store.statements)

    def apply(batch: DataFrame, number: int) -> None:
        latest = cut_lineage(latest_captures(batch), "captures", spark)
        own = StatementLog(spark, log.root, log.buckets, limit)
        near = own.buckets_of(latest)
        # read several times by the refresh and once more for what is stored, so looked for once
        touched = cut_lineage(own.touched_rows(latest, number, near), "touched")
        changed = refresh(store.with_(statements=touched.select(*COLUMNS)), latest, as_of, vocab)
        own.append(number + 1, changed, near, touched)
        discard(latest, touched)
        if number % KEPT_VERSIONS == KEPT_VERSIONS - 1:
            own.vacuum(KEPT_VERSIONS)

    return (
        captures.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def streamed_statements(spark: SparkSession, root: str) -> DataFrame:
    """The statements after all batches so far."""
    return StatementLog(spark, f"{root.rstrip('/')}/statements").read()


def read_captures(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CAPTURED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def messages_stream(spark: SparkSession, path: str) -> DataFrame:
    """Callback messages arriving as JSON files."""
    return spark.readStream.schema(schemas.MESSAGES).option("timestampNTZFormat", MESSAGE_TIME).json(path)


def append_messages(messages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """K2: append messages to their table."""
    return (
        messages.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def messages(store: Store) -> DataFrame:
    """Newest first."""
    return store.messages.orderBy(F.col("created_at").desc())


def change_windows(log: DataFrame, delay: str = "1 hour", width: str = "24 hours") -> DataFrame:
    """K3: refreshed, changed and error counts per site and window of a change log.

    ``log``: site, at (timestamp), changed, value. The watermark bounds the state; the
    delay is our choice.
    """
    return (
        log.withWatermark("at", delay)
        .groupBy(F.window("at", width).alias("w"), "site")
        .agg(
            F.count(F.lit(1)).alias("refreshed"),
            F.count_if("changed").alias("changed"),
            F.count_if(F.contains("value", F.lit("error"))).alias("errors"),
        )
        .select(F.col("w.start").alias("window_start"), "site", "refreshed", "changed", "errors")
    )
