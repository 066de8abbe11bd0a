"""Tables of matches in bucket folders, published by one switch of a stored manifest.

Rows lie under ``data/version=V/bucket=N``; a manifest names the version that holds each bucket.
A writer stages whole new folders and then publishes the next manifest by one rename that fails
where another writer was faster.  Until then, and after any failure, readers see the old table;
afterwards the new one, never a mixture.  Old folders stay for readers that still use them until
``vacuum`` removes them.

The number of buckets is chosen once by the size of the table and stored in the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from phasegrid.functions.scan import block_of
from phasegrid.sources import storage

ROWS_PER_BUCKET = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16


class Conflict(RuntimeError):
    """Another writer has published this table in the meantime."""


def bucket_of(match_id: Column, buckets: int) -> Column:
    """Folder of a match in a table of so many buckets."""
    return F.pmod(F.xxhash64(match_id.cast("long")), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    """Bucket count of a table of so many rows."""
    return min(max(rows // ROWS_PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)


def buckets_in(table: DataFrame) -> int:
    """Bucket count of a table that ``read`` returned."""
    return table.schema["bucket"].metadata["buckets"]


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last published manifest; 0 where there is none."""
    numbers = [int(n[1:-5]) for n in _names(spark, f"{path}/manifest") if n.startswith("m") and n.endswith(".json")]
    if not numbers:
        return 0, {"buckets": 0, "slots": 1, "order": None, "schema": None, "folders": {}}
    text = spark.read.text(f"{path}/manifest/m{max(numbers):09d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Make the manifest the current one by a rename; a name that is taken is a conflict."""
    jvm = spark._jvm
    staged, fs = _files(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    final = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/m{number:09d}.json"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(staged), final, no_overwrite)
    except Exception as error:
        if fs.exists(final):
            raise Conflict(f"{path}: version {number} is already there") from error
        raise


def _stage(rows: DataFrame, path: str, manifest: dict) -> dict[str, str]:
    """Write rows as a new version; the buckets it has rows for.

    A task holds one slot of a bucket and one block of a match, so the tasks of a write grow with
    its rows, also where the bucket count is at its limit or one match is huge.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    keys = ["bucket", "match_id", *([manifest["order"]] if manifest["order"] else [])]
    slot = F.pmod(F.xxhash64(F.lit(3), F.col("match_id").cast("long")), F.lit(manifest["slots"]))
    blocks = [block_of(F.col(manifest["order"]))] if manifest["order"] else []
    placed = rows.withColumn("bucket", bucket_of(F.col("match_id"), manifest["buckets"]))
    (
        placed.repartition("bucket", slot, *blocks).sortWithinPartitions(*keys)
        .select(*[f["name"] for f in manifest["schema"]["fields"]], "bucket")
        .write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    )
    found = [n for n in _names(spark, f"{path}/data/version={version}") if n.startswith("bucket=")]
    return {n.removeprefix("bucket="): version for n in found}


def write(rows: DataFrame, path: str, order: str | None = None, size: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Publish ``rows`` (with a ``match_id``) as the whole table at ``path``; returns it as read back.

    ``order`` sorts the rows inside a match; ``keep`` names the stored columns (default: all).
    ``size`` is the number of rows where the caller knows it.  An older table at the same path is
    replaced.  Rows without a match lie in one bucket of their own.
    """
    spark = rows.sparkSession
    number, _ = _current(spark, path)
    if size is None:
        rows = storage.save(rows, storage.new_path(spark, "unlaid"))
        size = rows.count()
    buckets = buckets_for(size)
    schema = rows.select(*keep).schema if keep else rows.schema
    manifest = {
        "buckets": buckets, "slots": max(1, size // (buckets * ROWS_PER_BUCKET)),
        "order": order if order in schema.names else None, "schema": json.loads(schema.json()),
    }
    manifest["folders"] = _stage(rows, path, manifest | {"order": order})
    _publish(spark, path, number + 1, manifest)
    return read(spark, path)


def _load(spark: SparkSession, path: str, manifest: dict, folders: dict[str, str]) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    marked = F.col("bucket").alias("bucket", metadata={"buckets": manifest["buckets"]})
    full = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], full).select(*schema.names, marked)
    all_of = Counter(manifest["folders"].values())
    mine = Counter(folders.values())
    # A version of which every folder is wanted is one path to list; of the others, single folders.
    held = {v: sum(n.startswith("bucket=") for n in _names(spark, f"{path}/data/version={v}")) for v in mine if mine[v] == all_of[v]}
    whole = {v for v, n in held.items() if n == mine[v]}
    paths = [f"{path}/data/version={v}" for v in sorted(whole)]
    paths += [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(folders.items()) if v not in whole]
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*paths).select(*schema.names, marked)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as last published, with its ``bucket`` column."""
    number, manifest = _current(spark, path)
    if not number:
        raise FileNotFoundError(f"no published table at {path}")
    return _load(spark, path, manifest, manifest["folders"])


def replace_matches(spark: SparkSession, path: str, rows: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Put ``rows`` in the place of all rows of their matches and of ``matches`` (match_id).

    A match of ``matches`` without new rows is removed; a new match is added; every other match
    stays as it is.  Only the buckets of these matches are written, whole and to new folders.
    Raises ``Conflict`` where another writer publishes first.
    """
    number, manifest = _current(spark, path)
    if not number:
        raise FileNotFoundError(f"no published table at {path}")
    names = [f["name"] for f in manifest["schema"]["fields"]]
    fresh = storage.save(rows.select(*names), storage.new_path(spark, "fresh"))
    ids = fresh.select("match_id")
    if matches is not None:
        ids = ids.unionByName(matches.select("match_id"))
    ids = storage.save(ids.distinct(), storage.new_path(spark, "replaced"))
    bucket = bucket_of(F.col("match_id"), manifest["buckets"]).cast("string")
    touched = {r[0] for r in ids.select(bucket).distinct().collect()}  # at most MOST_BUCKETS
    old = _load(spark, path, manifest, {b: v for b, v in manifest["folders"].items() if b in touched})
    gone = ids.select(F.col("match_id").alias("_id"))
    others = old.join(gone, F.col("match_id").eqNullSafe(F.col("_id")), "left_anti").select(*names)
    folders = {b: v for b, v in manifest["folders"].items() if b not in touched}
    folders |= _stage(others.unionByName(fresh), path, manifest)
    _publish(spark, path, number + 1, manifest | {"folders": folders})
    return read(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all manifests but the last ``keep`` and the folders that none of those names; returns
    how many folders went.  Only for tables without a writer or an old reader at work."""
    manifests = [n for n in _names(spark, f"{path}/manifest") if n.startswith("m")]
    kept = {n: json.loads(spark.read.text(f"{path}/manifest/{n}", wholetext=True).first()[0]) for n in manifests[-keep:]}
    used = {(v, b) for m in kept.values() for b, v in m["folders"].items()}
    went = 0
    for version in _names(spark, f"{path}/data"):
        for folder in _names(spark, f"{path}/data/{version}"):
            if folder.startswith("bucket=") and (version.removeprefix("version="), folder.removeprefix("bucket=")) not in used:
                at, fs = _files(spark, f"{path}/data/{version}/{folder}")
                fs.delete(at, True)
                went += 1
    for name in manifests[:-keep]:
        at, fs = _files(spark, f"{path}/manifest/{name}")
        fs.delete(at, False)
    return went
