"""Submission manifests and per-job scopes: JSON of mixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.sources.lines import read_documents

LATEST = "submission_latest.json"


def _member(settings: Column, suffix: str) -> Column:
    """Value whose key ends in `suffix`, whatever tool-specific prefix stands before it."""
    found = F.map_filter(settings, lambda key, _: key.endswith(suffix))
    return F.get(F.map_values(found), 0)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as (file, text). A folder stands for its latest manifest."""
    if not path.endswith(".json"):
        path = f"{path.rstrip('/')}/{LATEST}"
    return read_documents(spark, path)


def parse_manifests(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per manifest: submission_timestamp, njobsmax, cli, submitted (variant), bad_document.

    A text that is not JSON, or whose `submitted` is no list, is flagged and has null fields.
    """
    doc = F.col("_doc")
    # A projection of its own, so that each document is parsed once.
    return documents.withColumn("_doc", F.try_parse_json(text)).select(
        *[c for c in documents.columns if c != text],
        F.try_variant_get(doc, "$.submission_timestamp", "string").alias("submission_timestamp"),
        F.try_variant_get(doc, "$.njobsmax", "bigint").alias("njobsmax"),
        F.try_variant_get(doc, "$.cli", "boolean").alias("cli"),
        F.try_variant_get(doc, "$.submitted", "array<variant>").alias("submitted"),
        F.try_variant_get(doc, "$.submitted", "array<variant>").isNull().alias("bad_document"),
    )


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """One row per submitted entry, in the order of the manifest.

    An entry is [settings, cluster_id, njobs, proc_ids]; the cluster id may be number or text.
    """
    # The outer form and the filter behind it keep the planner from parsing the documents a
    # second time just to test for empty arrays.
    rows = manifests.select(
        *[c for c in manifests.columns if c != "submitted"],
        F.posexplode_outer("submitted").alias("entry_no", "_e"),
    ).filter(F.col("entry_no").isNotNull())
    e = F.col("_e")
    settings = F.try_variant_get(e, "$[0]", "map<string,variant>")
    plain = F.map_filter(settings, lambda key, _: key != "environment")
    parsed = rows.withColumns(
        {
            "settings": F.transform_values(plain, lambda _, v: v.cast("string")),
            "environment": F.coalesce(
                F.try_variant_get(e, "$[0].environment", "map<string,string>"),
                F.create_map().cast("map<string,string>"),
            ),
            "cluster_id": F.try_variant_get(e, "$[1]", "string").try_cast("bigint"),
            "njobs": F.try_variant_get(e, "$[2]", "bigint"),
            "proc_ids": F.try_variant_get(e, "$[3]", "array<int>"),
        }
    ).drop("_e")
    environment = F.col("environment")
    return parsed.withColumns(
        {
            "name": _member(environment, "CLUSTERNAME"),
            "i_cluster": _member(environment, "ICLUSTER").try_cast("int"),
        }
    )


def read_scopes(spark: SparkSession, path: str) -> DataFrame:
    """Scope files as (file, text)."""
    return read_documents(spark, path)


def parse_scopes(documents: DataFrame, schema: str | None = None, text: str = "text") -> DataFrame:
    """Scopes as `scope`: free-form (variant), or typed with a schema of the user."""
    scope = F.try_parse_json(text) if schema is None else F.from_json(text, schema)
    return documents.withColumn("scope", scope).drop(text)


def scope_value(scope: Column, path: str, kind: str = "string") -> Column:
    """One value of a free-form scope, null if it is absent or of another type."""
    return F.try_variant_get(scope, path, kind)


def scope_requirements(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """(package, mode) pairs a scope carries under `pips`."""
    pairs = F.try_variant_get(F.col("scope"), "$.pips", "array<array<string>>")
    rows = scopes.select(*keys, F.posexplode(pairs).alias("pos", "_p"))
    return rows.select(
        *keys, "pos", F.get("_p", 0).alias("package"), F.get("_p", 1).alias("mode")
    )


def scope_files(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """(key, path) of the files a scope carries under `transfer_files`."""
    files = F.try_variant_get(F.col("scope"), "$.transfer_files", "map<string,string>")
    return scopes.select(*keys, F.explode(files).alias("key", "path"))
