"""Directories, existence and deletion over an object inventory.

An inventory has ``key``, ``size``, ``last_modified`` and ``content_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import (
    DIRECTORY_TYPE,
    EMPTY_KEY,
    EMPTY_LOCATION,
    SCHEME,
    ancestors,
    dir_of,
    file_of,
    location_text,
    parent_key,
    path_key,
    uri_host,
    uri_path,
)
from tidemark.operators.ids import absent_from, present


def is_directory_type(content_type: str = "content_type") -> Column:
    return F.lower(F.col(content_type)) == DIRECTORY_TYPE


def location_uris(rows: DataFrame, location: str = "location") -> DataFrame:
    """Add scheme, host, path and key of each location, or why it has none.

    The key puts the host in front of the path.
    """
    text = F.col("_text")
    read = rows.withColumn("_text", location_text(F.col(location))).select(
        *rows.columns,
        F.when(text.isNotNull(), SCHEME).alias("scheme"),
        uri_host(text).alias("host"),
        uri_path(text).alias("path"),
        F.when(text.isNull(), EMPTY_LOCATION).alias("error"),
    )
    return read.withColumn("key", F.concat(F.coalesce("host", F.lit("")), "path"))


def directory_prefix(path: str) -> str:
    """What the keys below a directory start with; nothing for the root."""
    bare = path.strip().removeprefix("/").strip()
    return "" if bare in ("", "/") else bare.removesuffix("/") + "/"


def normalize_keys(rows: DataFrame, raw: str = "raw_key") -> DataFrame:
    """Add the three normal forms of a key: path, file (null with a reason if empty) and directory.

    Built in steps, so that each form is computed once per row.
    """
    forms = rows.withColumn("path", path_key(F.col(raw))).withColumn("_bare", file_of(F.col("path")))
    return forms.select(
        *rows.columns,
        "path",
        F.nullif("_bare", F.lit("")).alias("file"),
        F.when(F.col("_bare") == "", EMPTY_KEY).alias("file_error"),
        dir_of(F.col("path")).alias("dir"),
    )


def list_children(inventory: DataFrame, path: str) -> DataFrame:
    """Names directly below a directory, each once; the root lists the top level."""
    prefix = directory_prefix(path)
    rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
    below = inventory.filter(F.col("key").startswith(prefix)).select(rest.alias("rest")).filter("rest <> ''")
    first = F.split_part("rest", F.lit("/"), F.lit(1))
    return below.select(first.alias("name")).filter("name <> ''").distinct()


FORMS = ("_dir", "_file", "_path")


def _forms(rows: DataFrame, raw: str) -> DataFrame:
    """Rows with the directory, file and path form of a key."""
    named = {"dir": "_dir", "file": "_file", "path": "_path"}
    forms = normalize_keys(rows, raw)
    return forms.select(*rows.columns, *[F.col(form).alias(name) for form, name in named.items()])


def key_status(requested: DataFrame, inventory: DataFrame, raw: str = "raw_key") -> DataFrame:
    """Existence, path type and length of each requested key.

    A key is a directory if its form with a slash, or else the one without, is
    stored with the directory content type. The root always exists. A directory
    has no length, and neither has a key that does not exist.
    """
    asked = _forms(requested.select(raw).distinct(), raw)
    # A key's (at most three) forms mostly differ by one slash at their end, so forms and stored keys meet without it, and
    # only the key as it was written travels: its forms are made of it again where they are compared.
    bare = lambda key: F.regexp_replace(key, "/$", "")
    forms = asked.select(raw, F.explode(F.array_distinct(F.array(*[bare(F.col(c)) for c in FORMS]))).alias("_bare"))
    stored = inventory.select("key", "size", is_directory_type().alias("is_dir")).withColumn("_bare", bare(F.col("key")))
    met = forms.filter(F.col("_bare").isNotNull()).join(stored, "_bare", "left").select(raw, "key", "size", "is_dir")
    hits = _forms(met, raw).groupBy(raw).agg(
        F.max(F.when(F.col("key") == F.col("_dir"), F.col("is_dir"))).alias("_as_dir"),
        F.max(F.when(F.col("key") == F.col("_file"), F.col("is_dir"))).alias("_as_file"),
        F.max(F.when(F.col("key") == F.col("_file"), F.col("size"))).alias("_size"),
        F.max(F.when((F.col("key") == F.col("_path")) & F.col("size").isNotNull(), True)).alias("_stored"),
    )
    hits = _forms(hits, raw)
    is_dir = F.coalesce("_as_dir", "_as_file", F.lit(False))
    root = F.col("_path").isin("", "/")
    exists = is_dir | root | F.coalesce("_stored", F.lit(False))
    file_is_dir = F.coalesce("_as_file", F.lit(False))
    return hits.select(
        raw,
        exists.alias("exists"),
        F.when(is_dir, "directory").when(exists, "file").otherwise("none").alias("path_type"),
        F.when(~file_is_dir, F.col("_size")).alias("length"),
        F.when(file_is_dir, "is a directory").when(F.col("_size").isNull(), "not found").alias("length_error"),
    )


def delete_plan(
    requested: DataFrame, inventory: DataFrame, raw: str = "raw_key", ignore_missing: bool = False
) -> DataFrame:
    """Requested files as keys, each once, to delete or to report as missing.

    Only the keys that really are missing are reported.
    """
    keys = normalize_keys(requested.select(raw), raw).select(F.col("file").alias("key"))
    keys = keys.filter("key is not null").distinct()
    stored = present(keys, inventory, "key").distinct().withColumn("_stored", F.lit(True))
    plan = keys.join(stored, "key", "left").select(
        "key", F.when(F.col("_stored"), "delete").otherwise("missing").alias("action")
    )
    return plan.filter("action = 'delete'") if ignore_missing else plan


def delete_directory(inventory: DataFrame, path: str) -> DataFrame:
    """The directory's marker and everything below it."""
    return inventory.filter(F.col("key").startswith(directory_prefix(path))).select("key")


def missing_parents(inventory: DataFrame) -> DataFrame:
    """Directory markers to create so that every ancestor of every key exists."""
    above = inventory.select(F.explode(ancestors(F.col("key"))).alias("key")).distinct()
    return absent_from(above, inventory, "key")


def parents(keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.withColumn("parent", parent_key(F.col(key)))
