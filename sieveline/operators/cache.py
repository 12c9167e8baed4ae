"""Derived results kept by content: a key over what a result depends on, hits by join, first put wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_key(content_hash: Column, handler_id: Column, version: Column, operation: Column, params: Column, capabilities: Column) -> Column:
    """SHA-256 over content, handler and its version, operation, its parameters with defaults (a map, in key order) and
    the revisions of the capabilities that the operation needs, and no others."""
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\x1f")
    return F.sha2(F.concat_ws("\x1e", content_hash, handler_id, version.cast("string"), operation, flat(params), flat(capabilities)), 256)


def with_defaults(params: Column, defaults: Column) -> Column:
    """Given parameters over defaults, so that leaving one out and giving its default are the same."""
    given = F.coalesce(params, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(F.coalesce(defaults, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(given, rest)


def hits(requests: DataFrame, artifacts: DataFrame, key: str = "artifact_key") -> DataFrame:
    return requests.join(artifacts, key)


def misses(requests: DataFrame, artifacts: DataFrame, key: str = "artifact_key") -> DataFrame:
    return requests.join(artifacts.select(key), key, "left_anti")


def put(artifacts: DataFrame, made: DataFrame, key: str = "artifact_key") -> DataFrame:
    """artifacts and, of what was made, one row for each key that isn't there yet."""
    return artifacts.unionByName(made.dropDuplicates([key]).join(artifacts.select(key), key, "left_anti"))


def dedupe_by_content(sources: DataFrame, content: Column, uri: str = "uri") -> DataFrame:
    """(content_hash, first_uri, n_sources): sources of equal content once, under their first uri."""
    return sources.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(uri).alias("first_uri"), F.count(F.lit(1)).alias("n_sources"))


def changed(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Of a listing (path, length, modificationTime) what was not seen in this state."""
    return listing.join(seen, ["path", "length", "modificationTime"], "left_anti")
