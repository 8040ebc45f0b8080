"""The statement store: nine DataFrames with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.sources import schemas


class Store:
    """The nine tables as attributes. A table may be given as a function; it is then
    planned only when a query asks for it."""

    websites: DataFrame
    rdfs_classes: DataFrame
    properties: DataFrame
    sources: DataFrame
    webpages: DataFrame
    statements: DataFrame
    search_exceptions: DataFrame
    jsonld_outputs: DataFrame
    messages: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(schemas.TABLES)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self._tables = tables
        self._memo: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def with_(self, **tables: DataFrame | Callable[[], DataFrame]) -> "Store":
        """The same store with some tables replaced."""
        other = Store(**{**self._tables, **tables})
        if not {"properties", "rdfs_classes"} & set(tables):
            other._memo = self._memo
        return other

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small frame derived from classes and properties, made once per store."""
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]


def typed(statements: DataFrame) -> DataFrame:
    """Add the parsed shapes of ``cache``: ``values``, ``links`` and ``aborted``.

    Parsed once here; Catalyst drops the columns a query does not use.
    """
    return (
        statements.withColumn("values", V.to_array("cache"))
        .withColumn("links", V.parse_links("cache"))
        .withColumn("aborted", V.is_aborted("cache"))
    )


def load_store(spark: SparkSession, path: str) -> Store:
    """A1: read a store written as one parquet folder per table."""
    tables = {
        name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
        for name, schema in schemas.TABLES.items()
    }
    tables["statements"] = typed(tables["statements"])
    return Store(**tables)


def load_store_jdbc(spark: SparkSession, url: str, partitions: int = 200, **options: str) -> Store:
    """A1 from a relational database: the two large tables are read in parallel id ranges."""

    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if name in ("statements", "webpages"):
            low, high = (
                spark.read.format("jdbc")
                .options(url=url, query=f"select min(id) lo, max(id) hi from {name}", **options)
                .load()
                .first()
            )
            reader = reader.options(
                partitionColumn="id",
                lowerBound=str(low or 0),
                upperBound=str((high or 0) + 1),
                numPartitions=str(partitions),
            )
        wanted = spark.createDataFrame([], schemas.TABLES[name]).schema
        rows = reader.load()
        return rows.select([rows[f.name].cast(f.dataType).alias(f.name) for f in wanted])

    tables = {name: table(name) for name in schemas.TABLES}
    tables["statements"] = typed(tables["statements"])
    return Store(**tables)


#: Tables with a site column, and what they are sorted by in a snapshot.
_BY_SITE = {"sources": "website_id", "webpages": "website_id"}
SITE_BUCKETS = 64


def _site_bucket(site: Column, buckets: int = SITE_BUCKETS) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(site), F.lit(buckets)), F.lit(-1)).cast("int")


def save_snapshot(store: Store, path: str) -> None:
    """Write the store as a new snapshot, laid out for lists of one site.

    Statements lie in folders by a hash of their site, in order of page and rule; a folder is cut
    into files by page, so a large site has many. Rules and pages are in order of their site.
    Statements of unknown pages have a folder of their own.
    """
    root = path.rstrip("/")
    for name, schema in schemas.TABLES.items():
        columns = [part.split()[0] for part in schema.split(", ")]
        rows = getattr(store, name).select(columns)
        if name == "statements":
            sites = store.webpages.select(F.col("id").alias("webpage_id"), _site_bucket(F.col("website_id")).alias("site_bucket"))
            rows = rows.join(sites, "webpage_id", "left").select(*columns, F.coalesce("site_bucket", F.lit(-1)).alias("site_bucket"))
            rows = rows.repartitionByRange("site_bucket", "webpage_id", "source_id").sortWithinPartitions("site_bucket", "webpage_id", "source_id")
            rows.write.mode("errorifexists").partitionBy("site_bucket").parquet(f"{root}/{name}")
            continue
        if name in _BY_SITE:
            rows = rows.repartitionByRange(_BY_SITE[name], "id").sortWithinPartitions(_BY_SITE[name], "id")
        rows.write.mode("errorifexists").parquet(f"{root}/{name}")


def load_site(spark: SparkSession, path: str, seedurl: str) -> Store:
    """A1 for one site: its pages and their statements; of the statements only its folder is read."""
    store = load_store(spark, path)
    site = store.websites.filter(F.col("seedurl") == seedurl)
    found = [r[0] for r in site.select("id").collect()]
    pages = store.webpages.filter(F.col("website_id").isin(found))
    buckets = [r[0] for r in site.select(_site_bucket(F.col("id"))).distinct().collect()]
    placed = spark.read.schema(f"{schemas.STATEMENTS}, site_bucket INT").parquet(f"{path.rstrip('/')}/statements")
    own = placed.filter(F.col("site_bucket").isin(buckets))
    own = own.join(pages.select(F.col("id").alias("webpage_id")), "webpage_id", "left_semi")
    statements = typed(own.select([c for c in store.statements.columns if c in own.columns]))
    return store.with_(websites=site, webpages=pages, statements=statements)
