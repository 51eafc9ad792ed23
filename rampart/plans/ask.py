"""Ad hoc questions: guarded SQL over the graph's views, and plans that answer named questions with their parameters."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import rules, severity
from rampart.plans import guard
from rampart.plans.projection import Graph

MOST_ROWS = 20
VIEWS = tuple(f.name for f in fields(Graph) if f.name != "memo")


def register(g: Graph) -> None:
    """The graph's tables as temporary views."""
    for name, df in g.tables().items():
        df.createOrReplaceTempView(name)


def ask_sql(spark: SparkSession, text: str, args: dict | None = None, most: int | None = None) -> DataFrame:
    """The rows of a statement that reads the graph's views, `most` of them if that is given; any other raises ValueError.

    What Spark's parser and analyser make of the text is held against lists of what may stand in it (guard.py), before it runs.
    """
    out = guard.reading(spark, text.rstrip().rstrip(";"), VIEWS, args)
    return out if most is None else out.limit(most)


def worst_findings(g: Graph) -> DataFrame:
    rank = C.severity_index(F.col("contextual_severity"))
    return severity.rated(g).orderBy(rank.desc_nulls_last(), "f").limit(10).select("f", "title", "contextual_severity", "cwe_id")


def open_endpoints(g: Graph) -> DataFrame:
    """Public endpoints that ask for no authentication; where a graph doesn't know, those that a missing-authentication finding stands at."""
    public = g.endpoints.where("is_public")
    if "auth_required" in g.endpoints.columns:
        found = public.where(~F.coalesce("auth_required", F.lit(False)))
    else:
        flawed = g.findings.where("cwe_id = 'CWE-306' and status = 'open'").join(g.affects, "f").join(g.handled_by, "fn").select("ep")
        found = public.join(flawed, "ep", "left_semi")
    return found.select("ep", "path").orderBy("path", "ep")


def chains(g: Graph) -> DataFrame:
    return rules.chain_edges(g).select("rule", "f", "target", "target_name", "evidence", "confidence").orderBy(F.desc("confidence"), "rule", "f", "target")


def exposed_personal_stores(g: Graph) -> DataFrame:
    """Stores of personal data that public endpoints reach over five calls or fewer."""
    public = g.endpoints.where("is_public").select("ep", "path")
    reached = rules.endpoint_reach(g, 5).join(public, "ep").join(rules.personal_access(g), "fn")
    return reached.select("path", "ds", "name").distinct().orderBy("path", "name")


def blast(g: Graph, dependency: str) -> DataFrame:
    """The functions that use a dependency and the endpoints that they handle; no rows for an unknown one."""
    own = g.uses.select("dep").union(g.affects_dep.select("dep")).distinct()
    named = g.dependencies.select("dep", "name") if g.dependencies is not None else own.select("dep", F.col("dep").cast("string").alias("name"))
    named = named.where(F.lower("name") == dependency.lower())
    told = named.join(g.uses, "dep", "left").join(g.handled_by, "fn", "left").groupBy("dep", "name")
    return told.agg(F.countDistinct("fn").alias("functions"), F.countDistinct("ep").alias("endpoints")).orderBy("dep")


def recent_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("day"), "commit_sha").limit(10).select("commit_sha", "day", "score")


def input_functions_at_stores(g: Graph) -> DataFrame:
    at = g.access.join(g.stores.select("ds", "name"), "ds").groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("stores"))
    return g.functions.where("source").join(at, "fn").select("fn", "name", "stores").orderBy("fn")


def sql_injections(g: Graph) -> DataFrame:
    said = (F.col("cwe_id") == "CWE-89") | F.col("title").contains("SQL")
    found = severity.rated(g).where(F.coalesce(said, F.lit(False))).join(g.affects, "f", "left")
    return found.select("f", "title", "contextual_severity", "fn").orderBy("f", "fn")


Plan = Callable[[Graph, DataFrame | None, re.Match], DataFrame | None]
#: Questions by what they say, the surest first, and the plans that answer them.
QUESTIONS: tuple[tuple[str, str, Plan], ...] = (
    ("blast radius", r"blast\s+radius\s+of\s+(?:the\s+|package\s+|dependency\s+)*[\"'`]?(?P<name>[\w.#-]+)", lambda g, s, m: blast(g, m["name"])),
    ("posture trend", r"posture|\btrend|improv\w+|degrad\w+|score\s+over", lambda g, s, m: s if s is None else recent_snapshots(s)),
    ("personal data", r"(?=.*(personal|\bpii\b))(?=.*(reach|public|endpoint|expos))", lambda g, s, m: exposed_personal_stores(g)),
    ("input at stores", r"(?=.*\binput)(?=.*(database|store|db\b))", lambda g, s, m: input_functions_at_stores(g)),
    ("open endpoints", r"(?=.*endpoint)(?=.*(\bno\b|without|missing|lack|unauthenticated))(?=.*auth)", lambda g, s, m: open_endpoints(g)),
    ("chains", r"\bchain", lambda g, s, m: chains(g)),
    ("sql injection", r"\bsqli\b|\bsql\s+injection", lambda g, s, m: sql_injections(g)),
    ("worst findings", r"(?=.*(critical|worst|severe|top|serious))(?=.*(finding|vulnerab|issue|risk))", lambda g, s, m: worst_findings(g)),
)


def understood(question: str) -> tuple[str, re.Match, Plan] | None:
    """The named question that a text asks, or None. A text has from 1 to 1000 characters."""
    if not 1 <= len(question.strip()) <= 1000:
        raise ValueError("a question has from 1 to 1000 characters")
    for name, pattern, plan in QUESTIONS:
        if found := re.search(pattern, question, re.I | re.S):
            return name, found, plan
    return None


def answer(g: Graph, question: str, snapshots: DataFrame | None = None) -> DataFrame | None:
    """The first rows that answer a question, or None if it isn't one of the named ones or needs snapshots that aren't given."""
    found = understood(question)
    rows = found and found[2](g, snapshots, found[1])
    return None if rows is None else rows.limit(MOST_ROWS)
