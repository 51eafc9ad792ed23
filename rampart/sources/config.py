"""Configuration and secrets in files: line scans of texts, and the files that are scanned."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.sources.code import texts_of

#: Endings of scanned files, and folders that are left out.
ENDINGS = (".py", ".cfg", ".ini", ".yaml", ".yml", ".json", ".toml", "")
SKIPPED = ("venv", ".venv", "env", "node_modules", ".git", "__pycache__", "build", "dist", ".tox")
#: Severities by kind of issue; all kinds of hard-coded secrets are HIGH.
SEVERITY = {"cors": "MEDIUM", "debug_mode_enabled": "MEDIUM"}


def scan_lines(lines: DataFrame) -> DataFrame:
    """lines with kind, severity, evidence: at most one secret, one open CORS and one debug switch of each line.

    Lines that refer to the environment have none. lines needs a column line; its other columns stay.
    """
    kinds = F.array(
        C.secret_kind(F.col("line")), F.when(F.col("line").rlike(C.CORS), "cors"), F.when(F.col("line").rlike(C.DEBUG), "debug_mode_enabled")
    )
    likely = F.col("line").contains("=") | F.col("line").contains("*")  # every pattern needs one of them
    found = lines.where(likely & ~F.col("line").rlike(C.ENVIRONMENT)).withColumn("kind", F.explode(F.array_compact(kinds)))
    severity = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in SEVERITY.items()), F.lit("HIGH"))
    return found.withColumns({"severity": severity, "evidence": F.substring(F.trim("line"), 1, 200)}).drop("line")


def scan_environment(lines: DataFrame) -> DataFrame:
    """lines with masked evidence, where a line sets a key that means a secret to more than four characters."""
    kv = F.split("line", "=", 2)
    own = lines.where(F.col("line").contains("=")).withColumns({"key": F.trim(kv[0]), "value": F.trim(kv[1])})
    own = own.where(F.upper("key").rlike("SECRET|PASSWORD|TOKEN|KEY|PRIVATE") & (F.length("value") > 4) & ~F.col("value").startswith("$"))
    return own.withColumn("evidence", F.concat("key", F.lit("=***"))).drop("line", "key", "value")


def numbered(files: DataFrame) -> DataFrame:
    """path, n, line of files(path, text); lines count from 1."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    return lines.select("path", (F.col("i") + 1).alias("n"), "line")


def config_issues(files: DataFrame) -> DataFrame:
    """path, n, kind, severity, evidence of files(path, text); files named .env are scanned as settings."""
    name = F.substring_index("path", "/", -1)
    lines = numbered(files)
    code = scan_lines(lines.where(name != ".env"))
    env = scan_environment(lines.where(name == ".env")).select("path", "n", F.lit("hardcoded_secret").alias("kind"), F.lit("HIGH").alias("severity"), "evidence")
    return code.select("path", "n", "kind", "severity", "evidence").union(env)


def read_config(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the scanned files below a folder that all executors can read."""
    found = []
    for d, dirs, names in os.walk(root):
        dirs[:] = sorted(x for x in dirs if x not in SKIPPED and not x.endswith(".egg-info"))
        found += [os.path.join(d, n) for n in sorted(names) if n.startswith(".env") or os.path.splitext(n)[1] in ENDINGS]
    return texts_of(spark, root, found)
