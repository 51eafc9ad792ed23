"""Sources other than tables: scanner reports, dependency audits, catalogues, requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities by what a scanner calls them.
SEMGREP = {"ERROR": "CRITICAL", "WARNING": "HIGH", "INFO": "MEDIUM", "LOW": "LOW"}
KNOWN = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def parse_requirement(line: Column) -> tuple[Column, Column, Column]:
    """name, version, pinned of a line of a requirements file; comments go."""
    own = F.trim(F.regexp_replace(line, r"\s*#.*$", ""))
    name = F.regexp_extract(own, r"^([A-Za-z0-9_.\-]+)", 1)
    version = F.nullif(F.trim(F.regexp_extract(own, r"(?:==|>=|~=)\s*([^,;\s]+)", 1)), F.lit(""))
    return name.alias("name"), version.alias("version"), own.contains("==").alias("pinned")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """name, version, pinned of each requirement of a file; blank lines, comments and options are left out."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^(#|-|$)"))
    return lines.select(*parse_requirement(F.col("value")))


_SEMGREP_SCHEMA = """results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,
extra:struct<severity:string,message:string,lines:string,metadata:struct<cwe:variant>>>>"""
_BANDIT_SCHEMA = """results array<struct<issue_severity:string,issue_cwe:struct<id:int>,filename:string,test_id:string,test_name:string,
issue_text:string,line_number:int,line_range:array<int>,code:string>>"""
_AUDIT_SCHEMA = """dependencies array<struct<name:string,version:string,vulns array<struct<id:string,description:string,fix_versions:array<string>,severity:string>>>>"""


def _mapped(c: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(F.upper(c) == k, v).otherwise(out)
    return out


def parse_semgrep(reports: DataFrame) -> DataFrame:
    """Findings of reports(value: JSON); broken JSON has none. A weakness may be a string or a list of them."""
    r = F.explode(F.from_json("value", _SEMGREP_SCHEMA)["results"])
    cwe = F.coalesce(F.try_variant_get("r.extra.metadata.cwe", "$[0]", "string"), F.try_variant_get("r.extra.metadata.cwe", "$", "string"))
    return reports.select(r.alias("r")).select(
        F.lit("semgrep").alias("tool"),
        F.col("r.check_id").alias("rule_id"),
        F.col("r.extra.message").alias("description"),
        _mapped(F.col("r.extra.severity"), SEMGREP, "INFO").alias("severity"),
        F.nullif(F.regexp_extract(cwe, r"(CWE-\d+)", 1), F.lit("")).alias("cwe_id"),
        F.col("r.path").alias("file"),
        F.col("r.start.line").alias("line"),
        F.col("r.end.line").alias("end_line"),
        F.col("r.extra.lines").alias("snippet"),
    )


def parse_bandit(reports: DataFrame) -> DataFrame:
    """Findings of reports(value: JSON) of the other scanner."""
    r = F.explode(F.from_json("value", _BANDIT_SCHEMA)["results"])
    return reports.select(r.alias("r")).select(
        F.lit("bandit").alias("tool"),
        F.col("r.test_id").alias("rule_id"),
        F.col("r.issue_text").alias("description"),
        _mapped(F.col("r.issue_severity"), {k: k for k in KNOWN}, "LOW").alias("severity"),
        F.when(F.col("r.issue_cwe.id").isNotNull(), F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id"))).alias("cwe_id"),
        F.col("r.filename").alias("file"),
        F.col("r.line_number").alias("line"),
        F.coalesce(F.array_max("r.line_range"), "r.line_number").alias("end_line"),
        F.col("r.code").alias("snippet"),
    )


def parse_audit(reports: DataFrame) -> DataFrame:
    """Vulnerabilities of a dependency audit: a row for each package and entry, the first fixed version."""
    schema = _AUDIT_SCHEMA.replace("vulns array", "vulns:array")
    d = reports.select(F.explode(F.from_json("value", schema)["dependencies"]).alias("d")).select("d", F.explode("d.vulns").alias("v"))
    return d.select(
        F.col("d.name").alias("package"),
        F.col("d.version").alias("version"),
        F.try_element_at("v.fix_versions", F.lit(1)).alias("fixed"),
        F.col("v.id").alias("cve_id"),
        _mapped(F.col("v.severity"), {k: k for k in KNOWN}, "HIGH").alias("severity"),
        F.col("v.description").alias("description"),
    )


_WEAKNESS_SCHEMA = """_ID string, _Name string, _Abstraction string, _Status string, _Likelihood_Of_Exploit string, Description string, Extended_Description string,
Common_Consequences struct<Consequence:array<struct<Scope:array<string>,Impact:array<string>>>>,
Potential_Mitigations struct<Mitigation:array<struct<Phase:array<string>,Description:string>>>,
Related_Weaknesses struct<Related_Weakness:array<struct<_CWE_ID:string>>>"""


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """id, name, abstraction, status, likelihood, description, extended, consequences, mitigations, related of a weakness catalogue in XML."""
    rows = spark.read.format("xml").option("rowTag", "Weakness").schema(_WEAKNESS_SCHEMA).load(path)
    first = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    consequences = F.transform("Common_Consequences.Consequence", lambda c: F.trim(F.concat(first(c["Scope"]), F.lit(": "), first(c["Impact"])), F.lit(": ")))
    mitigations = F.transform("Potential_Mitigations.Mitigation", lambda m: F.when(first(m["Phase"]) != "", F.concat(F.lit("["), first(m["Phase"]), F.lit("] "), m["Description"])).otherwise(m["Description"]))
    return rows.where("_ID is not null and _Name is not null").select(
        F.concat(F.lit("CWE-"), "_ID").alias("id"),
        F.col("_Name").alias("name"),
        F.col("_Abstraction").alias("abstraction"),
        F.col("_Status").alias("status"),
        F.col("_Likelihood_Of_Exploit").alias("likelihood"),
        F.col("Description").alias("description"),
        F.col("Extended_Description").alias("extended"),
        consequences.alias("consequences"),
        mitigations.alias("mitigations"),
        F.col("Related_Weaknesses.Related_Weakness._CWE_ID").alias("related"),
    )


def parse_vulnerability_feed(pages: DataFrame) -> DataFrame:
    """cve_id, score, severity, published, description, affected of feed pages(value: JSON[, package]); newer score versions come first.

    affected: where a version range of the pages' package ends, for criteria that name it; pages without a package have none.
    """
    metric = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>"
    schema = f"vulnerabilities array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{metric},cvssMetricV30:{metric},cvssMetricV2:{metric}>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>>>>"
    package = (F.col("package") if "package" in pages.columns else F.lit(None).cast("string")).alias("package")
    c = pages.select(package, F.explode(F.from_json("value", schema)["vulnerabilities"]).alias("x")).select("package", "x.cve.*")
    matches = F.flatten(F.flatten(F.transform("configurations", lambda x: F.transform(x["nodes"], lambda n: n["cpeMatch"]))))
    ends = F.transform(
        F.filter(F.coalesce(matches, F.array().cast("array<struct<criteria:string,versionEndIncluding:string,versionEndExcluding:string>>")), lambda m: F.contains(F.lower(m["criteria"]), F.lower(F.coalesce("package", F.lit("\x00"))))),
        lambda m: F.concat(F.lit("<= "), F.coalesce(F.nullif(m["versionEndIncluding"], F.lit("")), F.nullif(m["versionEndExcluding"], F.lit("")))),
    )
    first = [F.try_element_at(f"metrics.{m}", F.lit(1))["cvssData"] for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")]
    english = F.try_element_at(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(1))["value"]
    return c.select(
        F.col("id").alias("cve_id"),
        F.coalesce(*(x["baseScore"] for x in first)).alias("score"),
        F.coalesce(*(x["baseSeverity"] for x in first)).alias("severity"),
        F.substring("published", 1, 10).alias("published"),
        english.alias("description"),
        "package",
        F.array_compact(ends).alias("affected"),
    )
