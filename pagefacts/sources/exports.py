"""Export folders, their listing, and the training-set extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.operators.rollups import nested_statements, webpage_index
from pagefacts.operators.star import star
from pagefacts.sources.store import Store


def write_export(docs: DataFrame, root: str, as_of: str, group: str = "pagefacts") -> str:
    """A5: one folder per site and day, one JSON object per line.

    ``docs`` has seedurl and json. Rows of a site are spread over writers by size, so a
    large site is written by many tasks; the day's folders of the given sites are replaced.
    """
    path = f"{root.rstrip('/')}/{group}"
    rows = docs.select(F.col("json").alias("value"), F.col("seedurl").alias("artifact"), F.lit(as_of[:10]).alias("version"))
    (
        rows.hint("rebalance", "artifact")
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("artifact", "version")
        .mode("overwrite")
        .text(path)
    )
    return path


def list_exports(spark: SparkSession, root: str, seedurl: str | None = None, limit: int | None = None, group: str = "pagefacts") -> DataFrame:
    """Exports by site and day; all of them, or the first ``limit`` that a listing shows."""
    rows = spark.read.text(f"{root.rstrip('/')}/{group}").select(
        F.col("artifact").cast("string").alias("artifact"), F.col("version").cast("string").alias("version")
    )
    if seedurl is not None:
        rows = rows.filter(F.col("artifact") == seedurl)
    listed = rows.distinct().orderBy("artifact", "version")
    return listed if limit is None else listed.limit(limit)


# Keys of the title, dates and place per language.
TRAINING_KEYS = {
    "en": ("title_en", "dates", "location"),
    "fr": ("title_fr", "dates_fr", "location_fr"),
}


def extract_training_set(store: Store, captures: DataFrame, lang: str, seedurl: str | None = None) -> DataFrame:
    """Publishable event pages of a language with their html, and per field the value
    and the rule that made it. A missing field is null."""
    title, dates, location = TRAINING_KEYS[lang]
    flat = star(store)
    chosen = nested_statements(flat).filter("role = 'selected'")
    ruled = chosen.join(flat.select("statement_id", "algorithm_value"), "statement_id")
    pair = F.struct("value", F.col("algorithm_value").alias("algorithm"))
    pick = lambda key, name: F.max(F.when(F.col("key") == key, pair)).alias(name)
    fields = (
        ruled.filter(F.col("key").isin(title, dates, location, "performed_by"))
        .groupBy("rdf_uri")
        .agg(pick(title, "title"), pick(dates, "dates"), pick(location, "location"), pick("performed_by", "performed_by"))
    )
    pages = (
        webpage_index(store, seedurl)
        .filter("publishable = 'Yes'")
        .select("webpage_id", "url", "rdf_uri")
        .join(store.webpages.filter(F.col("language") == lang).select(F.col("id").alias("webpage_id"), "language"), "webpage_id")
    )
    html = captures.select(V.normalize_url("url").alias("url"), "html")
    return (
        pages.withColumn("url", V.normalize_url("url"))
        .join(html, "url")
        .join(fields, "rdf_uri", "left")
        .select("webpage_id", "url", "language", "html", "title", "dates", "location", "performed_by")
    )


def write_training_set(rows: DataFrame, path: str) -> None:
    """One JSON object per page."""
    shaped = rows.select(
        "webpage_id",
        F.struct("url", "html", "language").alias("input"),
        F.struct("performed_by", "location", "dates", "title").alias("output"),
    )
    shaped.write.mode("errorifexists").json(path)
