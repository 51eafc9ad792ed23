"""Security knowledge: catalogues as documents with metadata, and questions routed to a lookup or a search."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.operators import history, retrieval

SOURCES = ("cwe", "cve", "owasp")
#: How many consequences, mitigations, related weaknesses and versions a document names.
CONSEQUENCES, MITIGATIONS, RELATED, VERSIONS = 3, 2, 10, 5
#: The ten categories of web risks of 2021 and the weaknesses related to each. What they are is in short words of our own.
OWASP = (
    ("A01:2021", "Broken Access Control", "CWE-200 CWE-201 CWE-276 CWE-284 CWE-285 CWE-352 CWE-359 CWE-732 CWE-862 CWE-863", "Users act outside their permissions.", "Deny by default; check on the server."),
    ("A02:2021", "Cryptographic Failures", "CWE-261 CWE-296 CWE-310 CWE-319 CWE-321 CWE-322 CWE-323 CWE-324 CWE-325 CWE-326 CWE-327 CWE-328 CWE-329", "Data is exposed by weak or missing encryption.", "Encrypt in transit and at rest; salt passwords."),
    ("A03:2021", "Injection", "CWE-20 CWE-74 CWE-75 CWE-77 CWE-78 CWE-79 CWE-80 CWE-83 CWE-87 CWE-88 CWE-89 CWE-90 CWE-91 CWE-93 CWE-94 CWE-95", "Input is run as part of a command or query.", "Bind parameters; validate input."),
    ("A04:2021", "Insecure Design", "CWE-73 CWE-183 CWE-209 CWE-213 CWE-235 CWE-256 CWE-257 CWE-266 CWE-269 CWE-280 CWE-311 CWE-312 CWE-313 CWE-316 CWE-419 CWE-434 CWE-444", "Controls are missing from the design.", "Model threats early; reuse proven patterns."),
    ("A05:2021", "Security Misconfiguration", "CWE-2 CWE-11 CWE-13 CWE-15 CWE-16 CWE-260 CWE-315 CWE-266 CWE-520 CWE-526 CWE-537 CWE-538 CWE-547 CWE-611 CWE-614 CWE-756 CWE-776 CWE-942 CWE-1021 CWE-1173", "Defaults and open settings are left on.", "Harden by script; remove what isn't used."),
    ("A06:2021", "Vulnerable and Outdated Components", "CWE-1104", "Libraries with known flaws are in use.", "Keep an inventory; update."),
    ("A07:2021", "Identification and Authentication Failures", "CWE-255 CWE-259 CWE-287 CWE-288 CWE-290 CWE-294 CWE-295 CWE-297 CWE-300 CWE-302 CWE-304 CWE-306 CWE-307 CWE-346 CWE-384 CWE-521 CWE-613 CWE-620 CWE-640 CWE-798 CWE-940 CWE-1216", "Identities can be guessed, stolen or skipped.", "Second factors; limits on attempts."),
    ("A08:2021", "Software and Data Integrity Failures", "CWE-345 CWE-353 CWE-426 CWE-494 CWE-502 CWE-565 CWE-784 CWE-829 CWE-830 CWE-915", "Code or data is trusted without checking its origin.", "Sign and verify; review the build chain."),
    ("A09:2021", "Security Logging and Monitoring Failures", "CWE-117 CWE-223 CWE-532 CWE-778", "Attacks go unseen.", "Log decisions; alert on them."),
    ("A10:2021", "Server-Side Request Forgery (SSRF)", "CWE-918", "The server fetches what an attacker names.", "Allow-list targets; separate networks."),
)


def _document(*lines) -> Column:
    """Lines that aren't null, one below the other."""
    return F.concat_ws("\n", *lines).alias("document")


def _line(name: str, value) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))


def _metadata(**columns) -> Column:
    """A map of text by name; missing values are empty."""
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit(""))))).alias("metadata")


def owasp(spark: SparkSession) -> DataFrame:
    """id, title, cwe_ids, description, mitigations of the ten categories."""
    rows = spark.createDataFrame(OWASP, "id string, title string, cwes string, description string, mitigations string")
    return rows.select("id", "title", F.split("cwes", " ").alias("cwe_ids"), "description", "mitigations")


def owasp_documents(rows: DataFrame) -> DataFrame:
    """id, document, metadata of the categories: four lines each."""
    text = _document(F.concat_ws(": ", "id", "title"), _line("Related CWEs", F.array_join("cwe_ids", ", ")), _line("Description", F.col("description")), _line("Mitigations", F.col("mitigations")))
    return rows.select("id", text, _metadata(source=F.lit("owasp"), owasp_id=F.col("id"), title=F.col("title"), cwe_ids=F.array_join("cwe_ids", ",")))


def cwe_documents(rows: DataFrame) -> DataFrame:
    """id, document, metadata of weaknesses as sources.reports.read_weaknesses gives them."""
    some = lambda c, n: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), "; ")
    text = _document(
        F.concat_ws(": ", "id", "name"), F.concat(F.lit("Abstraction: "), F.coalesce("abstraction", F.lit(""))), _line("Description", F.col("description")), _line("Extended", F.col("extended")),
        _line("Consequences", some("consequences", CONSEQUENCES)), _line("Mitigations", some("mitigations", MITIGATIONS)), _line("Likelihood", F.col("likelihood")),
    )
    related = F.array_join(F.slice(F.coalesce("related", F.array().cast("array<string>")), 1, RELATED), ",")
    return rows.select("id", text, _metadata(source=F.lit("cwe"), cwe_id=F.col("id"), name=F.col("name"), abstraction=F.col("abstraction"), status=F.col("status"), likelihood=F.col("likelihood"), related_cwe_ids=related))


def cve_documents(rows: DataFrame) -> DataFrame:
    """id, document, metadata of feed entries(cve_id, package, ...); a vulnerability has one document for each package."""
    versions = F.array_join(F.slice("affected", 1, VERSIONS), "; ")
    text = _document(
        F.concat_ws(": ", "cve_id", F.coalesce("description", F.lit(""))), _line("Package", F.col("package")),
        F.concat(F.lit("Severity: "), F.coalesce("severity", F.lit("UNKNOWN")), F.lit(" (CVSS: "), F.coalesce(F.col("score").cast("string"), F.lit("None")), F.lit(")")),
        _line("Published", F.col("published")), _line("Affected versions", versions),
    )
    own = rows.select(F.concat_ws(":", "cve_id", "package").alias("id"), text, _metadata(source=F.lit("cve"), cve_id=F.col("cve_id"), package_name=F.col("package"), severity=F.col("severity"), cvss_score=F.col("score"), published=F.col("published")))
    return own.dropDuplicates(["id"])


def load(spark: SparkSession, folder: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The documents in a folder; made and written there if it has none, or by force."""
    kind = "id string, document string, metadata map<string,string>"
    try:
        there = spark.read.schema(kind).parquet(folder)
        if not force and not there.isEmpty():
            return there
    except Exception as e:  # no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    made = make().select("id", "document", "metadata")
    made.write.mode("overwrite").parquet(folder)
    return spark.read.schema(kind).parquet(folder)


def store(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by id: new ones replace old ones of their id."""
    return history.upsert(old, new, ["id"], "document")


def routed(queries: DataFrame, docs: DataFrame, k: int = 5, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """query_id, id, score of queries(query_id, text): a query that names a weakness gets that document, score 1; every other
    the best by words. Unknown sources are left out; without any known one there are no results. k is held to 1..20.

    docs(id, document, metadata).
    """
    k, known = retrieval.clamp(k), [s for s in sources if s in SOURCES]
    docs = docs.where(F.col("metadata")["source"].isin(*known)) if known else docs.limit(0)
    number = F.regexp_extract(F.trim("text"), r"(?i)^(?:CWE-?)?(\d+)$", 1)
    keys = queries.where(number != "").select("query_id", F.concat(F.lit("CWE-"), number).alias("key"))
    keys = keys if "cwe" in known else keys.limit(0)
    texts = docs.select("id", F.col("document").alias("text"))
    found = retrieval.bm25(texts, queries.select("query_id", "text"), k)
    return retrieval.exact_or_fused(keys, texts, found).select("query_id", "id", "score")


def is_weakness(text: str) -> bool:
    return bool(re.fullmatch(r"(?i)(CWE-?)?\d+", text.strip()))
