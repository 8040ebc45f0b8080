"""Statements as a log of runs: buckets by (source, page), a manifest for each version, compaction.

A run is one folder, cut into buckets by a hash of (source, page). A version is a small manifest
that names, per bucket, the runs that hold its statements; the newest run wins for each
statement. Reading a bucket reads at most ``limit`` runs however many batches there were: when a
bucket has more, all of its runs are merged into one of the new version, and only that bucket is
rewritten. Run folders are never changed, so readers of an older version are not disturbed.

Every row carries the version that last changed it and a hash of its values. Rows that a batch
leaves as they were are not written, and ``changes`` gives what differs between two versions, from
the buckets that runs in between hold: roll-ups follow the statements without reading the rest.

Version n is made from version n - 1 and a batch. A batch that is played again writes new run
folders and the same manifest, so what a failed attempt left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefacts.sources import files, schemas

KEY = ("source_id", "webpage_id")
COLUMNS = tuple(part.split()[0] for part in schemas.STATEMENTS.split(", "))
BUCKETS, LIMIT = 64, 4
_STORED = f"{schemas.STATEMENTS}, changed_in BIGINT, row_hash BIGINT"


class StatementLog:
    """Versions of the statements under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, limit: int = LIMIT):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), limit
        found = self.versions()
        self.buckets = self._manifest(found[-1])["buckets"] if found else buckets

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.root}/versions/{version:012d}.json"))

    def runs(self, version: int | None = None) -> dict[str, list[int]]:
        """The runs of a version (the last one), oldest first, with the buckets that they hold."""
        return self._manifest(self.versions()[-1] if version is None else version)["runs"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _new(self, rows: DataFrame, version: int) -> DataFrame:
        return rows.select(*COLUMNS, F.lit(version).cast("long").alias("changed_in"), F.xxhash64(*COLUMNS).alias("row_hash"))

    def _write(self, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """A new run and the buckets it holds. A large bucket is written by several tasks, small ones by one."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket())
        path = f"{self.root}/runs/run={name}"
        placed.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return name, [int(n.removeprefix("bucket=")) for n in files.names(self.spark, path) if n.startswith("bucket=")]

    def _commit(self, version: int, runs: dict[str, list[int]]) -> None:
        whole = {"version": version, "buckets": self.buckets, "runs": {k: sorted(v) for k, v in sorted(runs.items()) if v}}
        files.write_text(self.spark, f"{self.root}/versions/{version:012d}.json", json.dumps(whole))

    def start(self, statements: DataFrame) -> None:
        """Version 0, from a snapshot, unless the log has begun."""
        if not self.versions():
            name, held = self._write(self._new(statements, 0), 0)
            self._commit(0, {name: held})

    def _read(self, runs: dict[str, list[int]], keys: DataFrame | None = None, since: int | None = None) -> DataFrame:
        """Newest rows, as stored, of the given buckets of runs; with ``keys`` those of these (source, page), with
        ``since`` those changed after that version. Both go before the newest is looked for, as neither can drop
        the newest row of a statement and keep an older one."""
        schema = f"{_STORED}, run STRING, bucket INT"
        paths = [f"{self.root}/runs/run={r}/bucket={b}" for r, held in runs.items() for b in held]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/runs").parquet(*paths)
        if since is not None:
            rows = rows.filter(F.col("changed_in") > since)
        if keys is not None:
            rows = rows.join(keys.select(*KEY), list(KEY), "left_semi")
        # the bucket follows from the key; without it rows stay where a join by the key has them
        newest = Window.partitionBy(*KEY).orderBy(F.col("run").desc())
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "run", "bucket")

    def _stored(self, version: int | None, buckets: list[int] | None, keys: DataFrame | None = None) -> DataFrame:
        runs = self.runs(version)
        if buckets is not None:
            asked = set(buckets)
            runs = {r: [b for b in held if b in asked] for r, held in runs.items()}
        return self._read(runs, keys)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The statements of a version (the last one), whole or of some buckets."""
        return self._stored(version, buckets).select(*COLUMNS)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self.bucket()).distinct().collect()]

    def touched(self, keys: DataFrame, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The statements with the given (source, page); only the buckets of these are read."""
        return self.touched_rows(keys, version, buckets).select(*COLUMNS)

    def touched_rows(self, keys: DataFrame, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The same as stored, with ``changed_in`` and ``row_hash``."""
        return self._stored(version, self.buckets_of(keys) if buckets is None else buckets, keys)

    def append(
        self, version: int, changed: DataFrame, buckets: list[int] | None = None, before: DataFrame | None = None
    ) -> None:
        """Version ``version``: the one before it with the changed statements, compacted where needed.

        ``buckets`` names those of the changed statements, if they are known; else all are compared.
        ``before`` holds the changed statements as they are stored, if they are at hand (``touched_rows``).
        """
        runs = self.runs(version - 1)
        old = self._stored(version - 1, buckets) if before is None else before
        old = old.select(*KEY, F.col("row_hash").alias("old_hash"))
        fresh = self._new(changed, version).join(old, list(KEY), "left").filter("old_hash is null or old_hash <> row_hash")
        name, held = self._write(fresh.drop("old_hash").select(*COLUMNS, "changed_in", "row_hash"), version)
        runs[name] = held
        depth = Counter(b for buckets in runs.values() for b in buckets)
        full = {b for b, n in depth.items() if n > self.limit}
        if full:
            merged, whole = self._write(self._read({r: [b for b in h if b in full] for r, h in runs.items()}), version)
            runs = {r: [b for b in h if b not in full] for r, h in runs.items()} | {merged: whole}
        self._commit(version, runs)

    def changes(self, since: int, until: int | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
        """Statements that differ between two versions: source_id, webpage_id, before (null: new) and after.

        Both sides hold the given ``columns``; whether a statement differs is decided by all of them. Later rows are
        in later runs only, so the runs that both versions have are read for ``before`` alone."""
        later = {r: held for r, held in self.runs(until).items() if int(r.split("-")[0]) > since}
        after = self._read(later, since=since)
        held = sorted({b for buckets in later.values() for b in buckets})
        before = self._stored(since, held).select(*KEY, F.struct(*columns).alias("before"), F.col("row_hash").alias("old_hash"))
        both = after.select(*KEY, F.struct(*columns).alias("after"), "row_hash").join(before, list(KEY), "left")
        return both.filter("old_hash is null or old_hash <> row_hash").select(*KEY, "before", "after")

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the last versions, and runs that none of the kept ones names."""
        versions = self.versions()
        used = {r for v in versions[-keep:] for r in self.runs(v)}
        for v in versions[:-keep]:
            files.remove(self.spark, f"{self.root}/versions/{v:012d}.json")
        for n in files.names(self.spark, f"{self.root}/runs"):
            if n.removeprefix("run=") not in used:
                files.remove(self.spark, f"{self.root}/runs/{n}")
