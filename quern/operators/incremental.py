"""Deltas between snapshots, document changes, embedding caches, generations to keep."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import identity
from quern.operators.common import require


def plan_delta(current: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(path, status, content_hash, stale_ids): what became of each path.

    ``current`` is (path, content_hash, skip_reason), ``checkpoint`` (path,
    content_hash, document_ids).  Status is new, changed, unchanged, filtered or
    removed; a path left out now and unknown before is ``skipped``.  Stale are the
    old ids of what isn't unchanged.
    """
    now = current.select("path", F.col("content_hash").alias("__new"), F.col("skip_reason").alias("__skip"), F.lit(True).alias("__now"))
    old = checkpoint.select("path", F.col("content_hash").alias("__old"), F.col("document_ids").alias("__ids"), F.lit(True).alias("__before"))
    both = now.join(old, "path", "full_outer")
    status = (
        F.when(F.col("__now").isNull(), "removed")
        .when(F.col("__skip").isNotNull(), F.when(F.col("__before"), "filtered").otherwise("skipped"))
        .when(F.col("__before").isNull(), "new")
        .when(F.col("__new") == F.col("__old"), "unchanged")
        .otherwise("changed")
    )
    stale = F.when((status == "unchanged") | F.col("__ids").isNull(), F.array().cast("array<string>")).otherwise(F.col("__ids"))
    return both.select("path", status.alias("status"), F.coalesce("__new", "__old").alias("content_hash"), stale.alias("stale_ids"))


def stale_ids(delta: DataFrame) -> DataFrame:
    """(document_id) of everything that a delta deletes."""
    return delta.select(F.explode("stale_ids").alias("document_id")).distinct()


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the ids; unknown ids are ignored."""
    return docs.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``new`` in place of those with their ids."""
    return delete(docs, new).unionByName(new)


def duplicate_ids(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, copies) of ids that occur more than once."""
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def cache_hits(docs: DataFrame, cache: DataFrame, dimensions: int) -> DataFrame:
    """``docs`` with cache_key and the cached embedding, null on a miss; a vector of another length is an error."""
    keyed = docs.withColumn("cache_key", identity.cache_key(F.col("document_id"), F.col("content")))
    joined = keyed.join(cache.select("cache_key", "embedding"), "cache_key", "left")
    return require(joined, F.col("embedding").isNull() | (F.size("embedding") == dimensions), F.concat(F.lit("corrupt cache entry "), F.col("cache_key")))


def cache_conflicts(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose new vector isn't the cached one."""
    joined = cache.select("cache_key", F.col("embedding").alias("__a")).join(new.select("cache_key", F.col("embedding").alias("__b")), "cache_key")
    return joined.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("cache_key").distinct()


def cache_append(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries whose key the cache lacks, once each."""
    return new.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")


_GENERATION = re.compile(r"gen-([0-9]{1,19})-([0-9]{1,9})\Z")


def generation_key(name: str) -> tuple[int, int] | None:
    m = _GENERATION.match(name)
    return (int(m[1]), int(m[2])) if m else None


def generations_to_remove(names: list[str], active: str | None, retention: int = 2) -> list[str]:
    """Generations that may go, newest first: none unless one is active; one place is kept for the next build."""
    if not 2 <= retention <= 32:
        raise ValueError("retention must lie between 2 and 32")
    if active not in names:
        return []
    orphans = sorted((n for n in names if n != active and generation_key(n)), key=generation_key, reverse=True)
    return orphans[max(0, retention - 2) :]


def retention(listing: DataFrame, keep: int = 2) -> DataFrame:
    """(name) to remove of a listing (alias, name, seconds, nanos, active), each alias by itself."""
    from pyspark.sql import Window

    w = Window.partitionBy("alias")
    actives = listing.withColumn("__active", F.sum(F.col("active").cast("int")).over(w)).where("NOT active AND __active > 0")
    nth = F.row_number().over(w.orderBy(F.desc("seconds"), F.desc("nanos"), "name"))
    return actives.withColumn("__nth", nth).where(F.col("__nth") > F.greatest(F.lit(0), F.lit(keep) - F.col("__active") - 1)).select("alias", "name")
