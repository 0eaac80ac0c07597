"""Probe joins: captures whose path is on a list of well-known paths.

The capture table already holds the target, so a probe is an equality on the
path below the target.  Lists are constants of at most 114 rows; they are
broadcast, and bodies are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions.net import join_path, path_of
from seepage.operators.joins import salted_join
from seepage.operators.matching import literal_map
from seepage.rules import api, files, git, listing, metadata

SENSITIVE = files.PATHS
GIT = [*git.PATHS, git.DIRECTORY]
API = api.PATHS
DIRECTORIES = [f"{name}/" for name in listing.DIRECTORIES]
DOCUMENTS = metadata.PATHS

PROBES = {"sensitive": SENSITIVE, "git": GIT, "api": API, "directory": DIRECTORIES, "document": DOCUMENTS}
# a list is a constant; anything much larger belongs in a table, not here
MAX_BROADCAST_PATHS = 10_000


def path_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, path_pos) dimension."""
    return spark.createDataFrame([(p.lstrip("/"), i) for i, p in enumerate(paths)], "path string, path_pos int")


def path_position(path: Column, paths: Sequence[str]) -> Column:
    """Position on the list, null when the path is not on it."""
    return literal_map({p: i for i, p in enumerate(paths)})[path]


def probe(responses: DataFrame, paths: Sequence[str], targets: DataFrame | None = None) -> DataFrame:
    """Captures of listed paths, with ``path`` and ``path_pos``.

    With ``targets`` the rest is dropped by a salted semi-join; select what is
    needed from ``responses`` first, so that no body is carried through it.
    """
    table = path_table(responses.sparkSession, paths)
    if len(paths) <= MAX_BROADCAST_PATHS:
        table = F.broadcast(table)
    found = responses.withColumn("path", path_of(F.col("url"), F.col("target"))).join(table, "path")
    if targets is not None:
        found = salted_join(found, targets.select("target").distinct(), "target", "left_semi")
    return found


def coverage(responses: DataFrame, targets: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Listed URLs of each target that were never captured.

    The captured positions of a target are at most as many as the list is
    long, so they fit in one small array; no target x path product is formed.
    """
    path = path_of(F.col("url"), F.col("target"))
    # status and url only; a set per target, combined before the shuffle
    captured = (
        responses.filter(F.col("status") > 0)
        .select("target", path_position(path, paths).alias("pos"))
        .filter("pos is not null")
        .groupBy("target")
        .agg(F.collect_set("pos").alias("seen"))
    )
    positions = F.sequence(F.lit(0), F.lit(len(paths) - 1))
    names = F.split(F.lit("\n".join(paths)), "\n")
    return (
        targets.select("target").distinct()
        .join(captured, "target", "left")
        .select(
            "target",
            F.explode(F.array_except(positions, F.coalesce("seen", F.array().cast("array<int>")))).alias("path_pos"),
        )
        .select("target", "path_pos", F.element_at(names, F.col("path_pos") + 1).alias("path"))
        .withColumn("url", join_path(F.col("target"), F.col("path")))
    )


def uncaptured_targets(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets without any successful fetch."""
    fetched = responses.filter(F.col("status") > 0).select("target")
    return targets.select("target").distinct().join(fetched.distinct(), "target", "left_anti")
