"""Detection against known truth: what a scanner and the engine find of a small set of known findings and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import match

#: The known findings of the vulnerable test application: id, weakness, title, file, severity raw and in context,
#: whether static tools can see it, and the scanner's tests that do.
FINDINGS = (
    ("F1", "CWE-89", "SQL Injection via f-string in get_user_by_name", "db.py", "HIGH", "CRITICAL", True, ["B608"]),
    ("F2", "CWE-306", "Missing Authentication on /admin/users endpoint", "app.py", "HIGH", "CRITICAL", False, []),
    ("F3", "CWE-918", "Server-Side Request Forgery in fetch_external", "app.py", "HIGH", "CRITICAL", True, ["B310"]),
    ("F4", "CWE-798", "Hardcoded Secret Key", "config.py", "CRITICAL", "CRITICAL", True, ["B105", "B106"]),
    ("F5", "CWE-94", "Debug Mode Enabled in Production", "config.py", "MEDIUM", "HIGH", True, ["B104"]),
    ("F6", None, "Outdated Dependencies with Known CVEs (werkzeug, requests, jinja2)", "requirements.txt", "HIGH", "HIGH", True, []),
)
#: The known chains, their findings, and words of which one stands in the text of an edge that means them.
CHAINS = (
    ("Chain-A", ["F6"], ["supply", "cve", "dependency"]),
    ("Chain-B", ["F1"], ["sql", "injection", "pii", "login"]),
    ("Chain-C", ["F2"], ["auth", "admin", "pii"]),
)


def known_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINDINGS, "gid string, cwe_id string, title string, file string, raw string, contextual string, by_static boolean, tests array<string>")


def known_chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAINS, "cid string, findings array<string>, words array<string>")


def rank(severity: Column) -> Column:
    """LOW to CRITICAL from 0; anything else counts as LOW."""
    return F.greatest(F.when(severity.isin(*C.WEIGHTS), C.severity_index(severity)).otherwise(1), F.lit(1)) - 1


def scanner(scans: DataFrame, known: DataFrame) -> DataFrame:
    """gid, detected, severity, underrated: the first scanner row (rule_id, severity, seq) of a known finding's tests, tests in
    their order; underrated if it ranks below the raw severity."""
    least = scans.groupBy("rule_id").agg(F.min(F.struct("seq", "severity")).alias("s"))  # one row a test, before tests are dealt out
    asked = known.select("gid", "raw", F.posexplode("tests").alias("place", "rule_id"))
    first = asked.join(least, "rule_id").groupBy("gid").agg(F.min_by("s.severity", F.struct("place", "s")).alias("severity"))
    told = known.select("gid", "raw").join(first, "gid", "left")
    return told.select("gid", F.col("severity").isNotNull().alias("detected"), "severity", (F.col("severity").isNotNull() & (rank(F.col("severity")) < rank(F.col("raw")))).alias("underrated"))


def engine(findings: DataFrame, known: DataFrame) -> DataFrame:
    """gid, detected, contextual, correct, upgraded: the first finding(f, cwe_id, file, title, raw_severity, contextual_severity)
    that means each known one."""
    said = findings.groupBy("cwe_id", "file", "title").agg(F.min(F.struct("f", "raw_severity", "contextual_severity")).alias("h")).select("cwe_id", "file", "title", "h.*")
    hits = match.truth(said, known, "raw_severity", "contextual_severity")
    first = hits.groupBy("gid").agg(F.min_by(F.struct("raw_severity", "contextual_severity"), "f").alias("h"))
    told = known.select("gid", F.col("contextual").alias("due")).join(first, "gid", "left")
    return told.select(
        "gid", F.col("h").isNotNull().alias("detected"), F.col("h.contextual_severity").alias("contextual"), F.coalesce(F.col("h.contextual_severity") == F.col("due"), F.lit(False)).alias("correct"),
        F.coalesce(F.col("h.contextual_severity") != F.col("h.raw_severity"), F.lit(False)).alias("upgraded"),
    )


def chains_found(edges: DataFrame, known: DataFrame) -> DataFrame:
    """cid, detected: whether an edge's text (of edges(text)) has one of a known chain's words."""
    words = known.select("cid", F.explode("words").alias("word"))
    there = edges.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    hit = words.join(there, "word").select("cid").distinct().withColumn("detected", F.lit(True))
    return known.select("cid").join(hit, "cid", "left").select("cid", F.coalesce("detected", F.lit(False)).alias("detected"))


def rates(results: DataFrame, chains: DataFrame) -> DataFrame:
    """total, detected, correct, upgraded, detection_rate, severity_accuracy, chains, chain_rate: one row."""
    a = results.agg(F.count("*").alias("total"), F.count_if("detected").alias("detected"), F.count_if("correct").alias("correct"), F.count_if("upgraded").alias("upgraded"))
    b = chains.agg(F.count_if("detected").alias("chains"), F.count("*").alias("all_chains"))
    rate = lambda x, y: F.coalesce(F.expr(f"try_divide({x}, {y})"), F.lit(0.0))
    return a.crossJoin(b).select("total", "detected", "correct", "upgraded", rate("detected", "total").alias("detection_rate"), rate("correct", "detected").alias("severity_accuracy"), "chains", rate("chains", "all_chains").alias("chain_rate"))  # one row each
