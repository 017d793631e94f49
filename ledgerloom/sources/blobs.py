"""Byte contents named by their SHA-256, kept in versions of two tables: none is half there, none is there twice.

A file for each small image would drown a cluster's file system, so contents are
rows of Parquet. A batch's files appear with the manifest that lists them (see
snapshots.py); a batch that is run again, or beside another with the same
contents, finds them there and adds nothing. Names are digests: nothing that a
caller writes becomes a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshots import Snapshots

BLOB = "sha256 string, bytes bigint, content binary, stored bigint"
REMOVED = "sha256 string, removed bigint"


def _live(store: Snapshots, version: int) -> DataFrame:
    """Contents as of a version, without those that were removed after they were stored."""
    gone = store.read("removed", REMOVED, version).groupBy(F.col("sha256").alias("g")).agg(F.max("removed").alias("removed"))
    return store.read("blobs", BLOB, version).join(gone, (F.col("sha256") == F.col("g")) & (F.col("stored") <= F.col("removed")), "left_anti")


def put(store: Snapshots, rows: DataFrame, content: str) -> int:
    """Stores the distinct contents of a column, and returns the version that has them all; null contents are left out, empty ones are kept.

    Equal contents of a partition meet before the shuffle. rows are read again
    after a conflict with another writer: hand over a table, or what is cheap.
    """
    each = rows.select(F.col(content).cast("binary").alias("content")).where("content is not null").withColumn("sha256", F.sha2("content", 256))
    new = each.groupBy("sha256").agg(F.any_value("content").alias("content"))

    def step(version: int) -> dict:
        there = _live(store, version).select(F.col("sha256").alias("h"))
        fresh = new.join(there, F.col("sha256") == F.col("h"), "left_anti")
        return {"append": {"blobs": fresh.select("sha256", F.length("content").cast("long").alias("bytes"), "content", F.lit(version + 1).cast("long").alias("stored"))}}

    return store.update(step)


def get(store: Snapshots, keys: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """keys with bytes and content of the digest in a column; null where none is stored under it."""
    live = _live(store, store.latest() if version is None else version).select(F.col("sha256").alias("_blob"), F.col("bytes").alias("_bytes"), F.col("content").alias("_content"))
    kept = keys.drop("bytes", "content").join(live, F.col(key) == F.col("_blob"), "left")
    return kept.withColumnsRenamed({"_bytes": "bytes", "_content": "content"}).drop("_blob")


def listing(store: Snapshots, version: int | None = None) -> DataFrame:
    """sha256, bytes of every content; the contents themselves are not read."""
    return _live(store, store.latest() if version is None else version).select("sha256", "bytes")


def remove(store: Snapshots, keys: DataFrame, key: str) -> int:
    """Removes contents by digest; one that is not there is no error. What is put later is there again."""
    digests = keys.select(F.col(key).alias("sha256")).where("sha256 is not null").distinct()
    return store.update(lambda version: {"append": {"removed": digests.withColumn("removed", F.lit(version).cast("long"))}})


def damaged(store: Snapshots, version: int | None = None) -> DataFrame:
    """sha256 of contents that no longer have their digest or length."""
    live = _live(store, store.latest() if version is None else version)
    return live.where((F.sha2("content", 256) != F.col("sha256")) | (F.length("content") != F.col("bytes"))).select("sha256")
