"""Tar archives as DataFrames: one Arrow function for archives, packing as an ordered aggregation, unpacking as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codecs


def ancestors(df: DataFrame, group: str, name: str) -> DataFrame:
    """group, name: the distinct ancestor directories of the names of each group, with a trailing slash."""
    parts = F.split(F.col(name), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    rows = df.filter(F.size(parts) > 1).select(group, F.explode(prefixes).alias("name"))
    return rows.filter("name != '/'").distinct()


def pack(df: DataFrame, group: str, order: str, name: str, data: str, mtime: int = 0) -> DataFrame:
    """group, archive: ancestor directories sorted by name, then files in their order, padded, and two zero blocks.

    An archive is one cell, so one archive must fit a task, as it must fit one file. Only names and data are shuffled; directories and
    headers are made where the files of a group are.
    """
    file = F.struct(F.col(order).cast("long").alias("at"), F.col(name).alias("name"), F.col(data).cast("binary").alias("data"))
    files = df.select(group, file.alias("f")).groupBy(group).agg(F.array_sort(F.collect_list("f")).alias("files"))
    named = F.transform("files", lambda f: F.struct(f["name"].alias("name"), f["data"].alias("data")))
    return files.select(group, named.alias("files")).select(group, codecs.tar_archive(F.col("files"), mtime).alias("archive"))


def archive_names(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """group, archive_name: the top folder of the first name of each group, or archive, with .tar.lz4."""
    first = F.min_by(name, order)
    top = F.when(first.contains("/"), F.substring_index(first, "/", 1))
    return df.groupBy(group).agg(F.concat(F.coalesce(F.nullif(top, F.lit("")), F.lit("archive")), F.lit(".tar.lz4")).alias("archive_name"))


def unpack(df: DataFrame, key: str, archive: str) -> DataFrame:
    """key, entry_index, name, type, size, mtime, checksum_valid, data of each entry."""
    rows = df.select(key, F.posexplode(codecs.tar_entries(archive)).alias("entry_index", "e"))
    return rows.select(key, "entry_index", "e.*")


def summary(entries: DataFrame, key: str) -> DataFrame:
    """key, n_files, n_dirs, total_bytes of unpack()."""
    return entries.groupBy(key).agg(
        F.count_if(F.col("type") == "0").alias("n_files"), F.count_if(F.col("type") == "5").alias("n_dirs"), F.sum("size").alias("total_bytes")
    )
