"""What a commit touches: differences of file manifests, importers of changed modules, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import columns as C


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of two manifests (path, hash): added, removed or modified; a rename gives both of its paths."""
    both = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def importers(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """path: files, not changed themselves, that import a changed module by its full name or its last part.

    imports(path, module), changed(path). Imports are extracted once, so one equality join does what a pattern for each
    pair of file and module would.
    """
    module = C.module_of(F.col("path"))
    names = changed.select(F.explode(F.array_distinct(F.array(module, F.substring_index(module, ".", -1)))).alias("module")).distinct()
    own = imports.select("path", F.ltrim(F.col("module"), F.lit(".")).alias("module"))
    return own.join(names, "module", "left_semi").select("path").distinct().join(changed, "path", "left_anti")


def affected(changed: DataFrame, more: DataFrame) -> DataFrame:
    """path, kind of changed files and their importers; files of no kind are left out."""
    return changed.select("path").union(more.select("path")).distinct().withColumn("kind", C.change_kind(F.col("path"))).where("kind is not null")
