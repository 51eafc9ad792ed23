"""Reviews: parsing what a model wrote, statuses, and the comment that is posted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of risk levels in a comment.
MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "NONE": "✅"}
#: Characters of an analysis, issues, and characters of an issue that a comment shows.
LONGEST, ISSUES, ISSUE_CHARS = 2000, 5, 140


def commit_status(risk: Column, block: Column) -> Column:
    return F.when(block | risk.isin("CRITICAL", "HIGH"), "failure").when(risk == "MEDIUM", "pending").otherwise("success")


def check_conclusion(risk: Column, block: Column) -> Column:
    return F.when(block, "failure").when(risk.isin("CRITICAL", "HIGH"), "action_required").otherwise("success")


def parse_review(texts: DataFrame) -> DataFrame:
    """id, risk_level, requires_block, top_issues of texts(id, text): what a review says in its marked lines, in any case.

    Without a level the review is UNKNOWN; without a word on blocking it doesn't block; issues are divided by commas.
    """
    said = lambda pattern: F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 1)
    level = F.upper(F.nullif(said(r"(?i)RISK_LEVEL:\s*(CRITICAL|HIGH|MEDIUM|LOW|NONE)"), F.lit("")))
    block = F.upper(said(r"(?i)REQUIRES_BLOCK:\s*(YES|NO)")) == "YES"
    issues = F.filter(F.transform(F.split(said(r"(?i)TOP_ISSUES:\s*(.+)"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select("id", F.coalesce(level, F.lit("UNKNOWN")).alias("risk_level"), block.alias("requires_block"), issues.alias("top_issues"))


def comment(reviews: DataFrame) -> DataFrame:
    """reviews with a markdown comment, from commit_sha, risk_level, requires_block, top_issues, finding_count, delta, analysis.

    A table of facts stands first, then up to ISSUES issues as a numbered list, then the analysis as a quotation.
    """
    mark = F.lit("⚪")
    for name, sign in MARKS.items():
        mark = F.when(F.col("risk_level") == name, sign).otherwise(mark)
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    score = F.when(F.col("delta") > 0, F.concat(F.lit("worse by "), F.format_number("delta", 1))).when(F.col("delta") < 0, F.concat(F.lit("better by "), F.format_number(-F.col("delta"), 1)))
    table = [
        F.lit("| Review | |\n|---|---|"),
        row("Commit", F.substring("commit_sha", 1, 8)),
        row("Risk", F.concat(mark, F.lit(" "), "risk_level")),
        row("Findings", F.col("finding_count").cast("string")),
        row("Merge", F.when(F.col("requires_block"), "held until mended").otherwise("open")),
        F.when(score.isNotNull(), row("Score", score)),
    ]
    some = F.slice("top_issues", 1, ISSUES)
    issues = F.when(F.size("top_issues") > 0, F.concat(F.lit("\n"), F.array_join(F.transform(some, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x, 1, ISSUE_CHARS))), "\n")))
    text = F.concat(F.substring("analysis", 1, LONGEST), F.when(F.length("analysis") > LONGEST, " …").otherwise(""))
    quoted = F.when(F.length("analysis") > 0, F.concat(F.lit("\n> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
    return reviews.withColumn("comment", F.concat_ws("\n", *table, issues, quoted))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """value: a report's lines, a heading and a table with a line for each row; rows keep their order within partitions."""
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\||\n", " "), F.lit("")) for c in rows.columns]
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return rows.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1).union(body)


def write_reports(rows: DataFrame, folder: str, title: str) -> None:
    """The rows as markdown and as JSON lines, below folder/markdown and folder/json."""
    markdown(rows, title).write.mode("overwrite").text(f"{folder}/markdown")
    rows.write.mode("overwrite").json(f"{folder}/json")


def remediation_prompt(findings: DataFrame) -> DataFrame:
    """f, prompt of rows (f, cwe_id, severity, function, endpoints, advice): what a model is asked; the model is the caller's."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")))
    lines = [part(n, c) for n, c in (("Weakness", "cwe_id"), ("Severity", "severity"), ("Function", "function"), ("Exposed at", "endpoints"), ("Guidance", "advice"))]
    return findings.select("f", F.concat_ws("\n", F.lit("Suggest a fix for this finding."), *lines).alias("prompt"))
