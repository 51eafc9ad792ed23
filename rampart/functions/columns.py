"""Column expressions of the posture model: severities, zones, names, paths, SQL text and line scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities by rank, and the weight of an open finding in the scores.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
WEIGHTS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}
#: Words in the name of a store that mean personal data.
PERSONAL = (
    "user", "users", "account", "accounts", "profile", "profiles", "email", "emails", "password", "passwords",
    "credentials", "payment", "payments", "card", "cards", "ssn", "address", "addresses", "phone", "personal", "pii",
    "customer", "customers",
)
#: Paths that need no authentication, by their beginning.
OPEN_PATHS = r"(?i)^/(health|ping|status|metrics|favicon|api/auth/|auth/|login|logout|register|signup|reset-password|verify)"
#: Decorators that make a function an entry point.
ENTRY = r"(route|get|post|put|delete|patch)"
#: Line patterns of hard-coded secrets, in order of precedence.
SECRETS = (
    ("hardcoded_secret", r"""(?i)(secret[_\-]?key|SECRET_KEY)\s*=\s*["']([^"']{6,})["']"""),
    ("hardcoded_password", r"""(?i)(password|passwd|pwd)\s*=\s*["']([^"']{4,})["']"""),
    ("hardcoded_api_key", r"""(?i)(api[_\-]?key|apikey)\s*=\s*["']([^"']{8,})["']"""),
    ("hardcoded_token", r"""(?i)(token)\s*=\s*["']([^"']{8,})["']"""),
    ("hardcoded_aws_key", r"""(?i)(aws[_\-]?access[_\-]?key[_\-]?id)\s*=\s*["']([A-Z0-9]{16,})["']"""),
    ("hardcoded_private_key", r"""(?i)(private[_\-]?key)\s*=\s*["']([^"']{8,})["']"""),
)
#: Lines that refer to the environment, open CORS and debug switches.
ENVIRONMENT = r"os\.environ|os\.getenv|getenv\(|environ\[|settings\.|config\."
CORS = r"""CORS\s*\([^)]*origins\s*=\s*["']?\*["']?|Access-Control-Allow-Origin.*\*|allow_origins\s*=\s*\[\s*["']?\*["']?\s*\]"""
DEBUG = r"(?i)DEBUG\s*=\s*True"
#: Dependency manifests, and names that mean configuration or security.
MANIFESTS = ("requirements.txt", "pyproject.toml", "setup.cfg", "setup.py", "Pipfile", "Pipfile.lock", "poetry.lock")
CONFIG_NAME = r"(?i)(config|settings|\.env|secrets|credentials)"
SENSITIVE = (
    "requirements", "pyproject.toml", "setup.cfg", "setup.py", "poetry.lock", ".env", "config", "auth", "security",
    "middleware", "settings", "secrets", "credentials",
)
#: Verbs of SQL text, and its clauses that name a table, in order of precedence.
SQL_READ = r"(?i)\b(SELECT|FETCH|GET)\b"
SQL_WRITE = r"(?i)\b(INSERT|UPDATE|DELETE|REPLACE|TRUNCATE|DROP|CREATE)\b"
SQL_TABLE = (
    r"""(?i)\bFROM\s+[`"']?(\w+)[`"']?""",
    r"""(?i)\bINTO\s+[`"']?(\w+)[`"']?""",
    r"""(?i)\bUPDATE\s+[`"']?(\w+)[`"']?""",
    r"""(?i)\bDELETE\s+FROM\s+[`"']?(\w+)[`"']?""",
)


def severity_index(severity: Column) -> Column:
    """Rank from 0, INFO, to 4, CRITICAL; other values and null count as MEDIUM."""
    out = F.lit(SEVERITIES.index("MEDIUM"))
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def moved(index: Column, by: Column) -> Column:
    """A severity rank moved up or down, held to the scale."""
    return F.greatest(F.least(index + by, F.lit(4)), F.lit(0))


def severity_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), index + 1)


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def personal(name: Column) -> Column:
    """Whether a store's name means personal data."""
    return F.lower(name).rlike("|".join(PERSONAL))


def trust_zone(path: Column, file: Column) -> Column:
    """The zone of an endpoint by its path and file."""
    p, f = F.lower(path), F.lower(file)
    return (
        F.when(p.contains("admin") | f.contains("admin"), "admin")
        .when(p.contains("auth") | f.contains("auth"), "authenticated")
        .when(p.contains("internal") | p.contains("system"), "system")
        .otherwise("public")
    )


def needs_auth(path: Column) -> Column:
    return ~path.rlike(OPEN_PATHS)


def module_of(path: Column) -> Column:
    """The module of a Python file's path; a package's own file is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def route_params(path: Column) -> Column:
    """Names in <converter:name> and {name}, without repetition, in order of kind."""
    return F.array_distinct(
        F.concat(F.regexp_extract_all(path, F.lit(r"<(?:\w+:)?(\w+)>"), F.lit(1)), F.regexp_extract_all(path, F.lit(r"\{(\w+)\}"), F.lit(1)))
    )


def change_kind(path: Column) -> Column:
    """dependency, config or code; null for other files."""
    return (
        F.when(F.substring_index(path, "/", -1).isin(*MANIFESTS), "dependency")
        .when(path.rlike(CONFIG_NAME), "config")
        .when(path.endswith(".py"), "code")
    )


def security_relevant(files: Column) -> Column:
    """Whether a list of paths has a Python file or a name that matters."""
    words = [lambda f, w=w: F.lower(f).contains(w) for w in SENSITIVE]
    return F.exists(files, lambda f: f.endswith(".py") | reduce(Column.__or__, (test(f) for test in words)))


def sql_access(sql: Column, default: Column) -> Column:
    return F.when(sql.rlike(SQL_READ), "read").when(sql.rlike(SQL_WRITE), "write").otherwise(default)


def sql_table(sql: Column, default: Column) -> Column:
    """The first table that a clause names; the default if none does."""
    found = [F.nullif(F.regexp_extract(sql, p, 1), F.lit("")) for p in SQL_TABLE]
    return F.coalesce(*found, default)


def secret_kind(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECRETS):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def uid(*parts) -> Column:
    """A node's id: its parts joined by colons."""
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def score_exp(total: Column, count: Column) -> Column:
    """100 for no findings, falling with their mean weight."""
    return F.when(count == 0, 100.0).otherwise(F.round(F.exp(-(total / count) / 5.0) * 100.0, 1))


def score_linear(total: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.coalesce(total, F.lit(0)))


def interpretation(score: Column) -> Column:
    return F.when(score >= 90, "GOOD").when(score >= 70, "FAIR").when(score >= 50, "POOR").otherwise("CRITICAL")


def change_label(delta: Column) -> Column:
    return F.when(delta > 0, "DEGRADED").when(delta < 0, "IMPROVED").otherwise("NEUTRAL")
