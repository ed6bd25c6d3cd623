"""Reading resources and change feeds, and writing current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.functions.comparing import comparable
from musterroll.operators.relate import orphans
from musterroll.session import scratch_path
from musterroll.sources.schemas import schema_of

BYTES_PER_BATCH = 1 << 30


def read_snapshot(
    spark: SparkSession,
    path: str,
    kind: str,
    namespaces: list | None = None,
    namespace_col: str = "metadata.namespace",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """All objects of a kind, in some namespaces or in all.

    The namespace condition prunes partitions or is pushed into the scan. ``schema``
    replaces the kind's own for tables that store it flat.
    """
    objects = spark.read.schema(schema or schema_of(kind)).parquet(path)
    if namespaces is None:
        return objects
    return objects.where(F.col(namespace_col).isin(*namespaces))


def read_watch(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    ts: str = "ts",
    lateness: str = "0 seconds",
    files: str | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
    files_per_batch: int | None = None,
    closing: str | None = None,
) -> DataFrame:
    """The change feed as a stream with event time, from files that keep arriving.

    A backlog is taken in batches of about ``bytes_per_batch`` (or of ``files_per_batch``
    files, if given), which bounds what one key can bring into one task. The watermark
    follows every row of the feed; conditions that are to stay above it have to be
    ``timed`` ones. ``closing`` is a folder from
    ``closing_folder``: a row there, null but for its time, ends a backfill.

    Zone-less times become session-zone timestamps, which a watermark requires; keep
    the session in UTC.
    """
    bound = ("maxBytesPerTrigger", bytes_per_batch) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    reader = spark.readStream.schema(schema).option(*bound)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    feed = reader.parquet(path)
    if closing is not None:
        feed = feed.unionByName(spark.readStream.schema(schema).parquet(closing))
    return feed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def closing_folder(spark: SparkSession, schema: T.StructType | str) -> str:
    """A new folder for the row that ends a backfill."""
    path = scratch_path(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(path)
    return path


def close_feed(spark: SparkSession, closing: str, schema: T.StructType, ts: str, at: Column) -> None:
    """Let the feed's time be ``at``: all earlier rows are final from then on."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != ts]
    row = spark.range(1).select(*empty, at.cast(schema[ts].dataType).alias(ts))
    row.select(*schema.fieldNames()).write.mode("append").parquet(closing)


def timed(condition: Column, ts: str) -> Column:
    """The condition in a form that the optimizer does not push below the watermark.

    Rows that it drops there would not move the clock. It leaves conditions on the event
    time where they are; rows without a time have been dropped anyway.
    """
    return F.coalesce(condition, F.lit(False)) | F.col(ts).isNull()


def read_manifests(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """JSON documents as a typed ``manifest`` column; what does not parse stays in ``bad``.

    ``extra`` holds the top-level fields that the schema does not name, as JSON texts.
    """
    kept = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.withColumn("_parsed", F.from_json(json_col, kept, options))
    bad = F.col("_parsed")["_corrupt_record"]
    named = F.array(*[F.lit(f.name) for f in schema.fields])
    fields = F.from_json(json_col, "map<string,string>")
    extra = F.map_filter(fields, lambda name, _: ~F.array_contains(named, name))
    return parsed.withColumns({
        "manifest": F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields]),
        "bad": bad,
        "extra": F.when(bad.isNull() & (F.size(extra) > 0), extra),
    }).drop("_parsed")


def upsert_current(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Patch existing keys, create the others.

    ``changes`` has one row per key and some of the target's columns; a null or absent
    field is not mentioned by the patch and survives.
    """
    patched = [c for c in target.columns if c in changes.columns and c not in key]
    renamed = changes.withColumnsRenamed({c: f"_new_{c}" for c in patched})
    joined = target.join(renamed, key, "full_outer")
    return joined.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in patched else F.col(c)
        for c in target.columns
    ])


def create_missing(
    existing: DataFrame, desired: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """Existing rows, and the desired ones whose key is absent; running it twice adds none.

    Of several desired rows with one key the least in ``order`` is created; maps compare by
    their sorted entries.
    """
    rest = [c for c in desired.columns if c not in key]
    place = F.struct(*[comparable(F.col(c), desired.schema[c].dataType) for c in order or rest])
    first = desired.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("_row"))
    unique = first.select(*key, "_row.*").select(*desired.columns)
    return existing.unionByName(orphans(unique, existing, key))
