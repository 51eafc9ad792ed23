"""python -m rampart FOLDER [text|json|markdown]: what the sources in a folder expose, its chains, severities and score."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.operators import build, deliver, rules, severity, update
from rampart.sources import code, config, reports


def repository(spark: SparkSession, root: str) -> tuple[build.Graph, dict[str, DataFrame]]:
    """The graph of a folder, and tables about its parse."""
    facts = code.facts(code.read_files(spark, root)).cache()
    wanted = os.path.join(root, "requirements.txt")
    requirements = reports.read_requirements(spark, f"file://{os.path.abspath(wanted)}") if os.path.isfile(wanted) else None
    g = build.graph(facts, requirements, issues=config.config_issues(config.read_config(spark, root)), service=os.path.basename(os.path.abspath(root)), repo=root)
    return g, {"taint": build.taint_marks(facts).orderBy("fn"), "unreadable": facts.where("kind = 'error'").select("file", "detail")}


def missing_authentication(g: build.Graph) -> DataFrame:
    """path, handler, raw_severity of handlers that lack authentication."""
    found = g.findings.where("rule_id = 'missing-auth'").join(g.affects, "f").join(g.handled_by, "fn").join(g.endpoints.select("ep", "path"), "ep")
    return found.select("path", F.col("fn").alias("handler"), "raw_severity").distinct().orderBy("path")


def analyse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables about a folder by name."""
    g, more = repository(spark, root)
    return {
        "score": severity.scores(severity.rated(g)),
        "summary": update.self_summary(g).orderBy("measure"),
        "endpoints": g.endpoints.select("method", "path", "zone_level", "is_public", "auth_type").orderBy("is_public", "path", ascending=[False, True]),
        "chains": rules.chain_edges(g).orderBy("confidence", ascending=False),
        "severities": severity.contextual_severity(g).orderBy("f"),
        "configuration": g.findings.where("type = 'config'").select("file", "line", "rule_id", "raw_severity").orderBy("file", "line"),
        "missing authentication": missing_authentication(g),
        "stores": g.stores.orderBy("ds"),
        **more,
    }


if __name__ == "__main__":
    if len(sys.argv) not in (2, 3) or sys.argv[2:] not in ([], ["text"], ["json"], ["markdown"]):
        sys.exit(__doc__)
    session = SparkSession.builder.getOrCreate()
    for title, df in analyse(session, sys.argv[1]).items():
        if sys.argv[2:] == ["json"]:
            lines = [r[0] for r in df.toJSON().collect()] if hasattr(df, "toJSON") else []
            print(f'{{"table": "{title}", "rows": [{", ".join(lines)}]}}')
        elif sys.argv[2:] == ["markdown"]:
            print("\n".join(r.value for r in deliver.markdown(df, title).collect()))
        else:
            print(f"\n{title}")
            df.show(200, truncate=False)
