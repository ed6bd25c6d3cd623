"""A table of current rows in key buckets, which takes updates batch by batch.

Below its folder lie ``data/version=<n>/bucket=<b>``, the rows of a bucket as version ``n``
wrote them, and ``commits/version=<n>``, one file that names for every bucket the version
that holds it. A version writes only the buckets it touches, and counts from the moment its
commit file is there; what a killed one left behind is never read and is written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.session import is_there, remove

#: Version of the rows that the table starts with.
FIRST = -1
#: Commits that stay readable: a reader may still be on the one before the newest.
KEPT_COMMITS = 2
_SET = "_set_"


@dataclass(frozen=True)
class BucketTable:
    """Rows by ``key``; a null field is "not mentioned", the last value in ``order`` counts.

    Every field keeps the place in ``order`` of its value beside it, so an update that
    comes late, in whatever batch, sets just the fields that nothing newer has set. A
    bucket is read and written as a whole: choose ``buckets`` so that one has the size of a
    file.
    """

    spark: SparkSession
    path: str
    key: list[str]
    order: list[str]
    schema: T.StructType
    buckets: int = 32

    @property
    def fields(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.key]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Rows with the place of each value and their bucket."""
        place = F.struct(*self.order)
        places = [F.when(F.col(f).isNotNull(), place).alias(_SET + f) for f in self.fields]
        return rows.select(*self.schema.names, *places, self._bucket())

    def _data(self, version: int) -> str:
        return f"{self.path}/data/version={version}"

    def commits(self) -> dict[int, dict[int, int]]:
        """The versions that count, each with the version that holds each bucket."""
        folder = f"{self.path}/commits"
        if not is_there(self.spark, folder):
            return {}
        found: dict[int, dict[int, int]] = {}
        for row in self.spark.read.schema("bucket INT, held_by LONG, version LONG").parquet(folder).collect():
            held_by = found.setdefault(row["version"], {})
            if row["bucket"] is not None:
                held_by[row["bucket"]] = row["held_by"]
        return found

    def _commit(self, version: int, held_by: dict[int, int]) -> None:
        """One file, which the committer of the write moves into place at the end.

        A row without bucket stands for a table without rows.
        """
        rows = self.spark.createDataFrame([(None, None), *sorted(held_by.items())], "bucket INT, held_by LONG")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")

    def _clean(self) -> None:
        """Remove what no readable commit refers to."""
        commits = self.commits()
        *old, _ = [*sorted(commits)[:-KEPT_COMMITS], None]
        live = {pair for v, held_by in commits.items() if v not in old for pair in held_by.items()}
        for version in old:
            for bucket, holder in commits[version].items():
                if (bucket, holder) not in live:
                    remove(self.spark, f"{self._data(holder)}/bucket={bucket}")
            remove(self.spark, f"{self.path}/commits/version={version}")

    def _read(self, held_by: dict[int, int], like: DataFrame) -> DataFrame:
        schema = T.StructType([f for f in like.schema.fields if f.name != "bucket"])
        paths = [f"{self._data(v)}/bucket={b}" for b, v in sorted(held_by.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        """Write merged rows by bucket; returns the buckets there are."""
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(self._data(version))
        written = self.spark.read.schema("bucket INT").parquet(self._data(version))
        return [r["bucket"] for r in written.distinct().collect()]

    def _merged(self, rows: DataFrame) -> DataFrame:
        merged = [F.max_by(f, _SET + f).alias(f) for f in self.fields]
        places = [F.max(_SET + f).alias(_SET + f) for f in self.fields]
        return rows.groupBy("bucket", *self.key).agg(*merged, *places)

    def start(self, current: DataFrame) -> None:
        """Take ``current`` as the first rows, unless the table is there already."""
        if not self.commits():
            found = self._write(self._merged(self._stored(current)), FIRST)
            self._commit(FIRST, dict.fromkeys(found, FIRST))

    def apply(self, batch: DataFrame, version: int) -> None:
        """Apply updates as ``version``; one that counts already is left as it is."""
        commits = self.commits()
        newest = max(commits)
        if version <= newest:
            return
        held_by = commits[newest]
        batch = self._stored(batch).persist()
        try:
            touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
            before = self._read({b: held_by[b] for b in touched if b in held_by}, batch)
            rows = before.withColumn("bucket", self._bucket()).unionByName(batch)
            found = self._write(self._merged(rows), version) if touched else []
        finally:
            batch.unpersist()
        self._commit(version, held_by | dict.fromkeys(found, version))
        self._clean()

    def rows(self) -> DataFrame:
        """The rows as of the newest commit."""
        commits = self.commits()
        nothing = self.spark.createDataFrame([], self.schema)
        stored = self._read(commits[max(commits)], self._stored(nothing)) if commits else nothing
        return stored.select(*self.schema.names)
