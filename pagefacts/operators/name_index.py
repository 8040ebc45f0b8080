"""An inverted index of the pieces of names, for substring search over many names.

The index maps every piece of one, two or three characters of a name in lower case to the name's
number. A search of three or more characters must meet names that have all of its three-character
pieces: the rarest few of these are intersected, and what is left is compared as a whole. A shorter
search is itself a piece. Postings are written in order of the piece, so a reader that knows its
pieces skips all other row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefacts.operators.star import rules, star
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, REVIEWED, Vocabulary

LONGEST = 3
#: So many of the rarest pieces of a search are intersected; the rest is left to the comparison.
RAREST = 4


def _pieces(text: Column, sizes: range) -> Column:
    """The distinct pieces of a text, of the given numbers of characters."""
    of = lambda n: F.transform(
        F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.substr(text, i, F.lit(n)),
    )
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def named_entities(store: Store, labels: tuple[str, ...], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Reviewed names of entities: class, name, webpage_id, id and the name's number."""
    rows = star(store).filter(F.col("selected") & F.col("status").isin(*REVIEWED) & F.col("label").isin(*labels))
    named = rows.select(
        F.col("rdfs_class_name").alias("class"), F.col("cache").alias("name"), "webpage_id",
        F.replace("rdf_uri", F.lit(vocab.mint_prefix), F.lit("")).alias("id"), F.lower("cache").alias("key"),
    ).filter(F.col("name").isNotNull())
    return named.distinct().withColumn("number", F.xxhash64("class", "key"))


class NameIndex:
    """Names (number, class, key, ...) and postings (piece, class, number); searches give (search, entity) rows."""

    def __init__(self, names: DataFrame, postings: DataFrame, sizes: DataFrame):
        self.names, self.postings, self.sizes = names, postings, sizes

    @staticmethod
    def save(names: DataFrame, path: str) -> NameIndex:
        """Writes the index of names; ``names`` is written too."""
        path = path.rstrip("/")
        names.write.parquet(f"{path}/names")
        spark = names.sparkSession
        known = spark.read.parquet(f"{path}/names")
        pieces = known.select("class", "number", "key").distinct().select("class", "number", F.explode(_pieces(F.col("key"), range(1, LONGEST + 1))).alias("piece"))
        pieces.distinct().repartitionByRange("piece", "class", "number").sortWithinPartitions("piece", "class").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("piece", "class").agg(F.count(F.lit(1)).alias("names")).write.parquet(f"{path}/sizes")
        return NameIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NameIndex:
        return NameIndex(*(spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in ("names", "postings", "sizes")))

    def candidates(self, searches: DataFrame) -> DataFrame:
        """(text, class, number) of names that have the rarest pieces of a search."""
        low = F.lower("text")
        asked = searches.select("text", "class").distinct().filter(F.length("text") > 0)
        pieces = F.when(F.length(low) >= LONGEST, _pieces(low, range(LONGEST, LONGEST + 1))).otherwise(F.array(low))
        wanted = asked.select("text", "class", F.size(pieces).alias("all"), F.explode(pieces).alias("piece"))
        by_size = Window.partitionBy("text", "class").orderBy("names", "piece")
        # a piece that no name has leaves the search without an answer
        known = wanted.join(self.sizes, ["piece", "class"]).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("text", "class")))
        rare = known.filter("known = all").withColumn("at", F.row_number().over(by_size)).filter(F.col("at") <= RAREST)
        needed = F.least("all", F.lit(RAREST))
        hits = rare.select("text", "class", "piece", needed.alias("needed")).join(self.postings, ["piece", "class"])
        return hits.groupBy("text", "class", "number", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n = needed").select("text", "class", "number")

    def search(self, searches: DataFrame) -> DataFrame:
        """Entities whose name contains a text, for many (text, class) at once: text, class, name, webpage_id, id."""
        found = self.candidates(searches).join(self.names, ["class", "number"]).filter(F.contains("key", F.lower("text")))
        every = searches.select("text", "class").distinct().filter(F.length("text") == 0).join(self.names, "class")
        columns = ("text", "class", "name", "webpage_id", "id")
        return found.select(*columns).unionByName(every.select(*columns)).distinct()

    def search_one(self, text: str, cls: str) -> DataFrame:
        """The same for one text, known here: its pieces are filters of the postings' scan."""
        low = text.lower()
        n = min(LONGEST, len(low))
        pieces = sorted({low[i : i + n] for i in range(len(low) - n + 1)}) if low else []
        names = self.names.filter(F.col("class") == cls)
        if pieces:
            postings = self.postings.filter(F.col("piece").isin(pieces) & (F.col("class") == cls))
            whole = postings.groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(pieces))
            names = names.join(whole, "number", "left_semi").filter(F.contains("key", F.lit(low)))
        return names.select("name", "webpage_id", "id").distinct()


def descriptions(store: Store) -> DataFrame:
    """(webpage_id, description): the disambiguating descriptions of pages."""
    described = rules(store).filter("label = 'Disambiguating Description'").select("source_id")
    return store.statements.join(described, "source_id").select("webpage_id", F.col("cache").alias("description"))
