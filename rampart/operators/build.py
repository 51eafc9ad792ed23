"""The graph from facts: nodes and edges by joins, upserts by the last row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators.match import containing
from rampart.plans.projection import Graph
from rampart.sources.code import functions


def last(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the last by line, as a later definition replaces an earlier one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("line", "end_line")).alias("r")).select(*keys, "r.*").select(*df.columns)


def function_nodes(facts: DataFrame) -> DataFrame:
    own = functions(facts).withColumn("uid", C.uid("fn", C.module_of(F.col("file")), F.col("qualified")))
    return last(own, "uid")


def call_edges(facts: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, dst) by qualified name, and placeholder nodes of calls that nothing resolves.

    Callers must be known; callees known, here or among more(fn), or unresolved; calls into other packages are left out.
    """
    calls = facts.where("kind = 'call'").select(F.col("qualified").alias("src"), F.col("target").alias("dst"))
    known = facts.where("kind = 'function'").select(F.col("qualified").alias("dst"))
    known = (known if more is None else known.union(more.select("fn"))).distinct()
    lost = calls.where(F.col("dst").startswith("unresolved."))
    edges = calls.join(known, "dst", "left_semi").select("src", "dst").union(lost).distinct()
    return edges, lost.select(F.col("dst").alias("qualified")).distinct()


def endpoint_nodes(facts: DataFrame) -> DataFrame:
    """Endpoints with zone, exposure, handler and framework."""
    e = facts.where("kind = 'endpoint'").select(
        "file", "line", "end_line", F.col("name").alias("path"), F.col("target").alias("method"), F.col("qualified").alias("handler"), F.col("items").alias("params"),
        F.col("detail").alias("auth_type"), F.col("flag").alias("auth_required"),
    )
    frameworks = facts.where("kind = 'framework'").groupBy("file", F.col("name").alias("path"), F.col("target").alias("method"), F.col("qualified").alias("handler")).agg(F.max("detail").alias("framework"))
    e = e.join(frameworks, ["file", "path", "method", "handler"], "left").select(*e.columns, "framework")
    e = e.withColumns({"uid": C.uid("ep", F.col("method"), F.col("path")), "zone": C.trust_zone(F.col("path"), F.col("file")), "is_public": ~F.col("auth_required")})
    return last(e, "uid")


def missing_auth(endpoints: DataFrame) -> DataFrame:
    """A finding for each handler of a public endpoint that isn't meant to be public."""
    open_ = endpoints.where(F.col("is_public") & C.needs_auth(F.col("path")))
    uid = C.uid("find", "builtin", "missing-auth", F.col("file"), F.col("line"))
    return open_.select(uid.alias("uid"), F.lit("CWE-306").alias("cwe_id"), F.lit("HIGH").alias("raw_severity"), "handler", "file", "line", "path").dropDuplicates(["uid"])


def store_edges(facts: DataFrame) -> DataFrame:
    """fn, store, kind, pii, edge of store accesses: the table that SQL names, else the kind of store."""
    a = facts.where("kind = 'access'").select("qualified", F.col("name").alias("kind"), F.col("target").alias("default"), F.coalesce("detail", F.lit("")).alias("sql"), F.col("items")[0].alias("file"))
    a = a.withColumns({"store": F.coalesce("file", C.sql_table(F.col("sql"), F.col("kind"))), "access": C.sql_access(F.col("sql"), F.col("default"))})
    edge = F.when(F.col("access") == "read", "READS_FROM").otherwise("WRITES_TO")
    return a.select(F.col("qualified").alias("fn"), "store", "kind", C.personal(F.col("store")).alias("pii"), edge.alias("edge")).distinct()


def dependency_edges(facts: DataFrame, requirements: DataFrame) -> DataFrame:
    """fn, dep: every function of a file uses each required package that the file imports, case left out."""
    imports = facts.where("kind = 'imports'").select("file", F.explode("items").alias("package"))
    known = requirements.select(F.lower("name").alias("package"), F.col("name").alias("dep"))
    used = imports.select("file", F.lower("package").alias("package")).join(known, "package").select("file", "dep")
    return facts.where("kind = 'function'").select("file", F.col("qualified").alias("fn")).join(used, "file").select("fn", "dep").distinct()


def taint_marks(facts: DataFrame) -> DataFrame:
    """fn, sinks, sources: sorted kinds of sinks and tainted names of each function."""
    own = facts.where("kind = 'taint' and not flag").groupBy(F.col("qualified").alias("fn"))
    return own.agg(F.sort_array(F.collect_set("name")).alias("sinks"), F.sort_array(F.collect_set("target")).alias("sources"))


def taint_edges(facts: DataFrame) -> DataFrame:
    """fn, sink, source, source_kind, line: one edge of a function to itself for each kind of sink, the last flow's."""
    own = facts.where("kind = 'taint' and not flag")
    edge = F.max_by(F.struct(F.col("target").alias("source"), F.col("detail").alias("source_kind"), "line"), F.struct("line", "target")).alias("e")
    return own.groupBy(F.col("qualified").alias("fn"), F.col("name").alias("sink")).agg(edge).select("fn", "sink", "e.*")


#: Trust zones with their levels and what guards them.
ZONES = (("public", 0, "none"), ("authenticated", 1, "session/jwt"), ("admin", 2, "admin role check"), ("system", 3, "internal only"))


def zone_rows(spark: SparkSession) -> DataFrame:
    """zone, name, level, auth_mechanism."""
    rows = spark.createDataFrame(ZONES, "name string, level int, auth_mechanism string")
    return rows.select(C.uid("tz", F.col("name")).alias("zone"), "name", "level", "auth_mechanism")


def service_rows(spark: SparkSession, name: str, repo: str = "") -> DataFrame:
    """service, name, type, exposure_level, repo_path: one row."""
    return spark.createDataFrame([(f"svc:{name}", name, "monolith", "public", repo)], "service string, name string, type string, exposure_level string, repo_path string")


_FINDING = ("f", "type", "tool", "rule_id", "title", "description", "raw_severity", "status", "cwe_id", "file", "line")


def _findings(rows: DataFrame, type_: str, tool: Column) -> DataFrame:
    """Finding nodes of rows(rule_id, title, description, severity, cwe_id, file, line); of one id the first by description stays."""
    made = rows.select(
        C.uid("find", tool, F.col("rule_id"), F.col("file"), F.col("line").cast("string")).alias("f"), F.lit(type_).alias("type"), tool.alias("tool"), "rule_id", "title", "description",
        F.col("severity").alias("raw_severity"), F.lit("open").alias("status"), "cwe_id", "file", F.col("line").cast("int").alias("line"),
    )
    return made.groupBy("f").agg(F.min_by(F.struct(*_FINDING[1:]), F.coalesce("description", F.lit(""))).alias("r")).select("f", "r.*")


def scan_findings(scans: DataFrame) -> DataFrame:
    """Finding nodes of scanner rows (tool, rule_id, description, severity, cwe_id, file, line)."""
    return _findings(scans.withColumn("title", F.col("rule_id")), "sast", F.col("tool"))


def config_findings(issues: DataFrame) -> DataFrame:
    """Finding nodes of configuration issues (path, n, kind, severity, evidence); they affect no function."""
    title = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    rows = issues.select(F.col("kind").alias("rule_id"), title.alias("title"), F.col("evidence").alias("description"), "severity", F.lit(None).cast("string").alias("cwe_id"), F.col("path").alias("file"), F.col("n").alias("line"))
    return _findings(rows, "config", F.lit("config_analyzer"))


def dependency_nodes(requirements: DataFrame, audit: DataFrame, manifest: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dependencies, findings, affects) of requirements(name, version, pinned) and audit(package, cve_id, severity, description).

    Packages meet by name, case left out. Every requirement is a dependency with the list of its known vulnerabilities, empty
    if there are none; vulnerabilities of other packages are left out. A vulnerability stands in the manifest file, or, where
    none is named, under the package's name; its id goes by the package's name.
    """
    own = requirements.select("name", F.coalesce("version", F.lit("")).alias("version"), "pinned", F.lower("name").alias("key")).dropDuplicates(["name", "version"])
    own = own.withColumn("dep", C.uid("dep", F.col("name"), F.col("version")))
    known = audit.groupBy(F.lower("package").alias("key")).agg(F.sort_array(F.collect_set("cve_id")).alias("known_cves"))
    none = F.array().cast("array<string>")
    dependencies = own.join(known, "key", "left").select("dep", "name", "version", "pinned", F.lit(0).alias("depth"), F.coalesce("known_cves", none).alias("known_cves"))
    hit = own.join(audit.withColumn("key", F.lower("package")).drop("version"), "key")
    rows = hit.select(
        "dep", F.col("cve_id").alias("rule_id"), F.concat("cve_id", F.lit(" in "), "name").alias("title"), "description", "severity", F.lit(None).cast("string").alias("cwe_id"),
        F.col("name").alias("file"), F.lit(0).alias("line"),
    )
    affects = rows.select(C.uid("find", "pip-audit", F.col("rule_id"), F.col("file"), "0").alias("f"), "dep").distinct()
    found = _findings(rows, "dependency", F.lit("pip-audit"))
    return dependencies, found.withColumn("file", F.lit(manifest)) if manifest else found, affects


def graph(facts: DataFrame, requirements: DataFrame | None = None, scans: DataFrame | None = None, audit: DataFrame | None = None, issues: DataFrame | None = None, service: str = "app", repo: str = "", known: DataFrame | None = None, manifest: str = "") -> Graph:
    """The whole property graph of a repository's facts and reports; rules, severities and scores run on it.

    Functions, stores, endpoints and dependencies are named by their ids, functions by their qualified names. An endpoint
    has an edge to its handler only if that is known. Missing tables count as empty. known(fn): functions of other files that
    calls may lead to, where the facts are those of changed files alone. manifest: the requirements' file, which vulnerabilities
    of dependencies stand in, so that a change of it replaces them.
    """
    spark = facts.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    requirements = empty("name string, version string, pinned boolean") if requirements is None else requirements
    scans = empty("tool string, rule_id string, description string, severity string, cwe_id string, file string, line int") if scans is None else scans
    audit = empty("package string, cve_id string, severity string, description string") if audit is None else audit
    issues = empty("path string, n int, kind string, severity string, evidence string") if issues is None else issues

    nodes = function_nodes(facts)
    marks = taint_marks(facts)
    functions = nodes.join(marks.select(F.col("fn").alias("qualified"), "sinks", "sources"), "qualified", "left").select(
        F.col("qualified").alias("fn"), "uid", "name", C.module_of(F.col("file")).alias("module"), F.coalesce(F.size("sinks") > 0, F.lit(False)).alias("tainted"),
        (F.col("has_request") | (F.col("is_entry") & (F.size("params") > 0))).alias("source"), "file", F.col("line").alias("start_line"), "end_line",
    )
    ends = endpoint_nodes(facts)
    levels = zone_rows(spark).select(F.col("name").alias("zone"), F.col("level").alias("zone_level"), F.col("zone").alias("tz"))
    ends = ends.join(levels, "zone").withColumnRenamed("uid", "ep")
    handlers = functions.select(F.col("fn").alias("handler"))
    handled = ends.join(handlers, "handler", "left_semi").select("ep", F.col("handler").alias("fn"))
    stores = store_edges(facts).withColumn("ds", C.uid("ds", F.col("kind"), F.col("store")))
    dependencies, cves, affects_dep = dependency_nodes(requirements, audit, manifest)
    found = scan_findings(scans)
    spans = nodes.select(F.col("qualified").alias("fn"), "file", F.col("line").alias("start"), F.col("end_line").alias("end"))
    affects = containing(found.select(F.col("f").alias("find"), "file", "line"), spans).select(F.col("find").alias("f"), "fn")
    missing = missing_auth(endpoint_nodes(facts)).select(
        F.col("uid").alias("f"), F.lit("sast").alias("type"), F.lit("builtin").alias("tool"), F.lit("missing-auth").alias("rule_id"), F.lit("Missing authentication").alias("title"),
        F.concat(F.lit("No authentication on "), "path").alias("description"), "raw_severity", F.lit("open").alias("status"), "cwe_id", "file", "line", "handler",
    )
    names = list(_FINDING)
    findings = found.select(*names).unionByName(missing.select(*names)).unionByName(config_findings(issues).select(*names)).unionByName(cves.select(*names))
    affects = affects.union(missing.join(handlers, "handler", "left_semi").select("f", F.col("handler").alias("fn"))).distinct()
    used = dependency_edges(facts, requirements.select("name").distinct()).withColumnRenamed("dep", "name")
    services = service_rows(spark, service, repo)
    return Graph(
        functions=functions,
        calls=call_edges(facts, known)[0],
        endpoints=ends.select("ep", "path", "method", "is_public", "zone_level", "auth_type", "auth_required", "framework", "file", "line"),
        handled_by=handled,
        stores=stores.groupBy("ds").agg(F.first("store").alias("name"), F.first("kind").alias("kind"), F.max("pii").alias("contains_pii")),
        access=stores.select("fn", "ds", F.when(F.col("edge") == "READS_FROM", "read").otherwise("write").alias("access")).distinct(),
        findings=findings,
        affects=affects,
        uses=used.join(dependencies.select("name", "dep"), "name").select("fn", "dep"),
        affects_dep=affects_dep,
        services=services,
        zones=zone_rows(spark),
        dependencies=dependencies,
        belongs_to=ends.select("ep").withColumn("service", F.lit(f"svc:{service}")),
        in_zone=ends.select("ep", F.col("tz").alias("zone")),
    )


def nodes(g: Graph) -> DataFrame:
    """node, label: every node of a graph with its label."""
    kinds = (("functions", "fn", "Function"), ("endpoints", "ep", "Endpoint"), ("stores", "ds", "DataStore"), ("findings", "f", "Finding"), ("services", "service", "Service"), ("zones", "zone", "TrustZone"), ("dependencies", "dep", "Dependency"))
    out, tables = None, g.tables()
    for name, key, label in kinds:
        if name in tables:
            own = tables[name].select(F.col(key).cast("string").alias("node"), F.lit(label).alias("label"))
            out = own if out is None else out.union(own)
    return out
