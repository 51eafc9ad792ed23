"""Chains of vulnerabilities: rules over what public endpoints reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.operators.expand import reach
from rampart.plans.projection import Graph
from rampart.storage import written


#: The most calls that any rule follows from an endpoint.
MOST_HOPS = 6
#: Rows of rule 3 for each task, as long as there are no more than MOST_TASKS, and the findings that meet a use as one row at most.
TASK_ROWS, MOST_TASKS, MOST_FINDINGS = 1 << 22, 4096, 1 << 14


def once(g: Graph, name: str) -> DataFrame:
    """The graph's relation of that name, or one of the functions below by its name, written once for a graph: several steps read it."""
    if ("once", name) not in g.memo:
        g.memo["once", name] = written(getattr(g, name) if hasattr(g, name) else globals()[name](g))
    return g.memo["once", name]


def endpoint_reach(g: Graph, hops: int) -> DataFrame:
    """ep, fn, depth: what each endpoint's handler reaches over calls.

    It is walked once for a graph, to MOST_HOPS; all rules and the severity in context filter the same written table.
    """
    most = max(hops, MOST_HOPS)
    if ("reach", most) not in g.memo:
        starts = once(g, "handled_by").select(F.col("ep").alias("start"), F.col("fn").alias("node"))
        g.memo["reach", most] = reach(starts, once(g, "calls"), most).select(F.col("start").alias("ep"), F.col("node").alias("fn"), "depth")
    return g.memo["reach", most].where(F.col("depth") <= hops)


def personal_access(g: Graph) -> DataFrame:
    """fn, ds, name: functions that touch stores of personal data."""
    return g.access.join(g.stores.where("contains_pii"), "ds").select("fn", "ds", "name").distinct()


def taint_edges(g: Graph) -> DataFrame:
    """src, dst: calls from functions with request sources to tainted ones."""
    from_ = g.functions.where("source").select(F.col("fn").alias("src"))
    to = g.functions.where("tainted").select(F.col("fn").alias("dst"))
    return once(g, "calls").join(from_, "src", "left_semi").join(to, "dst", "left_semi").where("src <> dst").select("src", "dst")


def tainted_endpoints(g: Graph) -> DataFrame:
    """ep: endpoints whose handler reaches a tainted function over three taint edges or fewer."""
    if "taint" not in g.memo:
        starts = once(g, "handled_by").select(F.col("ep").alias("start"), F.col("fn").alias("node"))
        g.memo["taint"] = reach(starts, taint_edges(g), 3)
    hit = g.memo["taint"].join(g.functions.where("tainted"), F.col("node") == F.col("fn"), "left_semi")
    return hit.select(F.col("start").alias("ep")).distinct()


def _chains(pairs: DataFrame, rule: str, sure: float, likely: float) -> DataFrame:
    """One chain for each finding and store: the least path, confidence by taint."""
    chains = pairs.groupBy("f", "ds").agg(F.min("path").alias("ep_path"), F.max(F.coalesce("taint", F.lit(False))).alias("has_taint"))
    return chains.select(
        F.lit(rule).alias("rule"), "f", "ds", "ep_path", "has_taint", F.when(F.col("has_taint"), sure).otherwise(likely).alias("confidence")
    )


def sql_flaws(findings: DataFrame) -> DataFrame:
    """Findings that mean SQL injection: by weakness, or by what their rule, title or description says."""
    words = F.col("rule_id").contains("sql") | F.col("title").contains("SQL") | F.col("description").contains("SQL inject")
    return findings.where(F.coalesce(F.col("cwe_id").isin("CWE-89", "CWE-564"), F.lit(False)) | F.coalesce(words, F.lit(False)))


def _support1(g: Graph, reached: DataFrame, tainted: DataFrame) -> DataFrame:
    """SQL injection that a public endpoint reaches, whose calls also reach personal data.

    Findings and stores are brought to one row for each endpoint before they meet, so functions never multiply.
    """
    public = g.endpoints.where("is_public").select("ep", "path")
    reached = reached.where(F.col("depth") <= 6).join(public, "ep")
    flaws = sql_flaws(g.findings).join(g.affects, "f").select("f", "fn")
    holes = reached.join(flaws, "fn").select("ep", "path", "f").distinct()
    stores = reached.join(personal_access(g), "fn").select("ep", "ds").distinct()
    return holes.join(stores, "ep").join(tainted.withColumn("taint", F.lit(True)), "ep", "left").select(F.lit("sqli_pii").alias("rule"), "ep", "f", "ds", "path", "taint")


def _support2(g: Graph, reached: DataFrame, handled: DataFrame, tainted: DataFrame) -> DataFrame:
    """A handler without authentication whose calls reach personal data."""
    public = g.endpoints.where("is_public").select("ep", "path")
    flaws = g.findings.where("cwe_id = 'CWE-306'").join(g.affects, "f").select("f", "fn")
    open_ = public.join(handled, "ep").join(flaws, "fn").select("ep", "path", "f")
    stores = reached.where(F.col("depth") <= 5).join(personal_access(g), "fn").select("ep", "ds").distinct()
    return open_.join(stores, "ep").join(tainted.withColumn("taint", F.lit(True)), "ep", "left").select(F.lit("missing_auth_pii").alias("rule"), "ep", "f", "ds", "path", "taint")


def support(g: Graph, reached: DataFrame, handled: DataFrame, tainted: DataFrame) -> DataFrame:
    """rule, ep, f, ds, path, taint: what endpoints add to the chains, by what they reach(ep, fn, depth), handle and taint."""
    return _support1(g, reached, tainted).unionByName(_support2(g, reached, handled, tainted))


def chains_of(support: DataFrame) -> DataFrame:
    """The chains that support rows make up."""
    one = _chains(support.where("rule = 'sqli_pii'"), "sqli_pii", 1.0, 0.90)
    return one.unionByName(_chains(support.where("rule = 'missing_auth_pii'"), "missing_auth_pii", 1.0, 0.95))


def rule1_sqli_pii(g: Graph) -> DataFrame:
    """SQL injection and personal data behind one public endpoint."""
    return _chains(_support1(g, endpoint_reach(g, 6), tainted_endpoints(g)), "sqli_pii", 1.0, 0.90)


def rule2_missing_auth_pii(g: Graph) -> DataFrame:
    """Personal data behind a handler without authentication."""
    return _chains(_support2(g, endpoint_reach(g, 5), once(g, "handled_by"), tainted_endpoints(g)), "missing_auth_pii", 1.0, 0.95)


def rule3_supply_chain(g: Graph) -> DataFrame:
    """f, dep, path, fn, depth: a vulnerable dependency used by what a public endpoint reaches.

    The rows are findings times uses of each dependency, so they are dealt out by how many there will be, not by dependency: uses
    go to `across` parts of a dependency and findings to `down`, and each pair of parts is a cell. A cell has an eighth of a task's
    rows, with eight findings to a use, as uses are the wider rows. Its findings are one list, so the join carries a row for each use
    and cell, and findings come out of their list last, with nothing shuffled, sorted or looked up for each row of the result.
    """
    public = g.endpoints.where("is_public").select("ep", "path")
    flaws = written(g.findings.where("type = 'dependency'").join(g.affects_dep, "f").select("f", "dep").distinct())
    used = written(endpoint_reach(g, 5).join(public, "ep").join(g.uses, "fn").select("path", "fn", "depth", "dep").distinct())
    both = used.groupBy("dep").agg(F.count("*").cast("double").alias("n")).join(flaws.groupBy("dep").agg(F.count("*").cast("double").alias("m")), "dep")
    total = both.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks, rows = min(int(total // TASK_ROWS) + 1, MOST_TASKS), max(TASK_ROWS / 8, total / MOST_TASKS)
    most = F.least(F.lit(float(MOST_FINDINGS)), rows / F.least("n", F.lit((rows / 8) ** 0.5)))
    both = both.withColumn("down", F.ceil(F.col("m") / most)).withColumn("across", F.ceil(F.col("n") * F.col("m") / F.col("down") / rows))

    def part(parts: str, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.col(parts)).cast("int")

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1))

    lists = flaws.join(both, "dep").groupBy("dep", "across", part("down", "f").alias("j")).agg(F.collect_list("f").alias("fs"))
    lists = lists.select("dep", "j", "fs", each("across").alias("i")).repartition(tasks, "dep", "i", "j")
    used = used.join(both, "dep").withColumn("i", part("across", "fn", "path", "depth")).withColumn("j", each("down"))
    cells = used.drop("n", "m", "down", "across").repartition(tasks, "dep", "i", "j").join(lists.hint("merge"), ["dep", "i", "j"])
    return cells.select(F.explode("fs").alias("f"), "dep", "path", "fn", "depth")


def all_chains(g: Graph) -> DataFrame:
    """Chains of both rules, from support rows that a store has kept, if there are any."""
    if "support" in g.memo:
        return chains_of(g.memo["support"])
    return rule1_sqli_pii(g).unionByName(rule2_missing_auth_pii(g))


def chain_edges(g: Graph) -> DataFrame:
    """f, target, label, target_name, evidence, confidence: the chains as edges to the stores that they end in."""
    chains = all_chains(g).join(g.stores.select("ds", F.col("name").alias("target_name")), "ds")
    taint = F.when(F.col("has_taint"), " Tainted request data was followed to it.").otherwise("")
    what = F.when(F.col("rule") == "sqli_pii", "is reached from a public endpoint whose calls can be made to read personal data in").otherwise("leaves an endpoint without authentication whose calls touch personal data in")
    evidence = F.concat(F.lit("Finding "), what, F.lit(" "), "target_name", F.lit(" (first path: "), "ep_path", F.lit(")."), taint)
    return chains.select("rule", "f", F.col("ds").alias("target"), F.lit("DataStore").alias("label"), "target_name", evidence.alias("evidence"), "confidence")


def chain_counts(g: Graph) -> DataFrame:
    """rule, n: how many edges or rows each rule gives, in the order in which they run."""
    rules = (("taint", taint_edges(g)), ("sqli_pii", rule1_sqli_pii(g)), ("missing_auth_pii", rule2_missing_auth_pii(g)), ("supply_chain", rule3_supply_chain(g)))
    out = None
    for name, df in rules:
        own = df.agg(F.lit(name).alias("rule"), F.count("*").alias("n")).select("rule", "n")
        out = own if out is None else out.union(own)
    return out


def chained_findings(g: Graph) -> DataFrame:
    """f: the findings of all chains. Functions are brought to one row each before they meet findings, and no chain is made."""
    if "support" in g.memo:
        return g.memo["support"].select("f").distinct()
    public, touching = g.endpoints.where("is_public").select("ep"), once(g, "personal_access").select("fn").distinct()

    def flaws(found: DataFrame, at: DataFrame, hops: int) -> DataFrame:
        open_ = endpoint_reach(g, hops).join(touching, "fn", "left_semi").select("ep").distinct().join(public, "ep", "left_semi")
        fns = at.join(open_, "ep", "left_semi").select("fn").distinct()
        return found.join(once(g, "affects"), "f").join(fns, "fn", "left_semi").select("f")

    one = flaws(sql_flaws(g.findings), endpoint_reach(g, 6), 6)
    return one.union(flaws(g.findings.where("cwe_id = 'CWE-306'"), once(g, "handled_by"), 5)).distinct()


def supplied_findings(g: Graph) -> DataFrame:
    """f: the findings of rule 3: those in dependencies that a public endpoint reaches."""
    public = g.endpoints.where("is_public").select("ep")
    used = endpoint_reach(g, 5).join(public, "ep", "left_semi").select("fn").distinct().join(g.uses, "fn").select("dep").distinct()
    return g.findings.where("type = 'dependency'").join(g.affects_dep, "f").join(used, "dep", "left_semi").select("f").distinct()


def reachable_findings(g: Graph) -> DataFrame:
    """f: findings that some rule has met from a public endpoint."""
    return chained_findings(g).union(supplied_findings(g)).distinct()


def exposed_at(targets: DataFrame, g: Graph) -> DataFrame:
    """f, ep: endpoints of findings(f, label, node): the endpoint itself, or those that the function handles."""
    itself = targets.where("label = 'Endpoint'").select("f", F.col("node").alias("ep")).join(g.endpoints.select("ep"), "ep", "left_semi").select("f", "ep")
    handled = targets.where("label = 'Function'").join(g.handled_by, F.col("node") == F.col("fn")).select("f", "ep")
    return itself.union(handled).distinct()
