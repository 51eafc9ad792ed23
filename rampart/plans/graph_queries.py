"""Queries over the projected graph: scans, joins, traversals, scores, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import expand, rules, severity
from rampart.plans.projection import GRAPH_SQL, project, snapshots
from rampart.plans.registry import query


def _sql(body: str) -> str:
    return "with " + GRAPH_SQL.strip() + body


@query(_sql("select ep, path, zone_level from g_endpoint where is_public"))
def public_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public endpoints of every zone."""
    return project(spark, sf_dir).endpoints.where("is_public").select("ep", "path", "zone_level")


@query(_sql("select status, count(*) as n from g_finding group by 1"))
def findings_by_status(spark, sf_dir):
    return project(spark, sf_dir).findings.groupBy("status").agg(F.count("*").alias("n"))


@query(_sql("select f, raw_severity, cwe_id from g_finding where raw_severity in ('CRITICAL', 'HIGH') and contains(cwe_id, 'CWE-3')"))
def findings_by_severity(spark, sf_dir):
    """Membership, substring and equality predicates; they reach the scan of orders."""
    g = project(spark, sf_dir)
    return g.findings.where(F.col("raw_severity").isin("CRITICAL", "HIGH") & F.col("cwe_id").contains("CWE-3")).select("f", "raw_severity", "cwe_id")


@query(_sql("select ep, path, is_public, case when zone_level = 0 then 'public' when zone_level = 1 then 'authenticated' when zone_level = 2 then 'admin' else 'system' end as zone, h.fn from g_endpoint left join g_handled_by h using (ep)"))
def endpoints_with_zone(spark, sf_dir):
    """Zone lookup and the optional handler of each endpoint."""
    g = project(spark, sf_dir)
    zone = F.when(F.col("zone_level") == 0, "public").when(F.col("zone_level") == 1, "authenticated").when(F.col("zone_level") == 2, "admin").otherwise("system")
    return g.endpoints.join(g.handled_by, "ep", "left").select("ep", "path", "is_public", zone.alias("zone"), "fn")


_CONTEXT = """,
g_taint as (select src, dst from g_calls join g_function a on a.fn = src join g_function b on b.fn = dst where a.source and b.tainted and src <> dst),
g_treach as (with recursive r(ep, fn, depth) as (select ep, fn, 0 from g_handled_by union select ep, dst, depth + 1 from r join g_taint on fn = src where depth < 3)
  select distinct ep, fn from r),
g_tainted as (select distinct ep from g_treach join g_function using (fn) where tainted),
g_sqli as (select f.f, p.ds, min(e.path) as ep_path, bool_or(t.ep is not null) as has_taint
  from (select distinct ep, f from g_reach join g_affects using (fn) join g_finding using (f) where cwe_id in ('CWE-89', 'CWE-564') or contains(rule_id, 'sql') or contains(title, 'SQL') or contains(description, 'SQL inject')) f
  join (select distinct ep, ds from g_reach join g_pii using (fn)) p using (ep)
  join g_endpoint e on e.ep = f.ep and e.is_public left join g_tainted t on t.ep = f.ep group by 1, 2),
g_noauth as (select f.f, p.ds, min(e.path) as ep_path, bool_or(t.ep is not null) as has_taint
  from (select ep, f from g_handled_by join g_affects using (fn) join g_finding using (f) where cwe_id = 'CWE-306') f
  join (select distinct ep, ds from g_reach join g_pii using (fn) where depth <= 5) p using (ep)
  join g_endpoint e on e.ep = f.ep and e.is_public left join g_tainted t on t.ep = f.ep group by 1, 2),
g_chain as (select 'sqli_pii' as rule, f, ds, ep_path, has_taint, case when has_taint then 1.0 else 0.90 end::double as confidence from g_sqli
  union all select 'missing_auth_pii', f, ds, ep_path, has_taint, case when has_taint then 1.0 else 0.95 end::double from g_noauth),
g_near as (with recursive r(fn, depth) as (select distinct fn, 0 from g_pii union select dst, depth + 1 from r join g_calls on fn = src where depth < 3),
  b(fn, depth) as (select distinct fn, 0 from g_pii union select src, depth + 1 from b join g_calls on fn = dst where depth < 3)
  select fn from r union select fn from b),
g_level as (select fn, bool_or(is_public) as is_public, min(least(zone_level, 2)) as auth_level from g_reach join g_endpoint using (ep) where depth <= 5 group by fn),
g_context as (select f.f, raw_severity, coalesce(l.is_public, false) as is_public, cast(coalesce(auth_level, 0) as integer) as auth_level, n.fn is not null as pii,
    f.f in (select f from g_chain) as in_chain
  from g_finding f left join g_affects a using (f) left join g_level l on l.fn = a.fn left join g_near n on n.fn = a.fn where status = 'open'),
g_step as (select *, case raw_severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end
    + case when is_public and auth_level = 0 and pii then 2 when is_public and auth_level = 0 then 1 when auth_level >= 2 and not is_public then -1 else 0 end as i from g_context),
g_severity as (select f, raw_severity, is_public, auth_level, pii, in_chain,
    ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(least(greatest(i, 0), 4) + in_chain::int, 4) + 1] as contextual_severity from g_step)
"""


def _deep(body: str) -> str:
    return "with " + GRAPH_SQL.strip() + _CONTEXT + body


@query(_deep("select * from g_context"))
def finding_context(spark, sf_dir):
    """Exposure, zone, personal data and chains of every open finding."""
    return severity.finding_context(project(spark, sf_dir))


@query(_deep("select * from g_severity"))
def contextual_severity(spark, sf_dir):
    return severity.contextual_severity(project(spark, sf_dir))


@query(_sql("select distinct fn from (select src as fn from g_calls where dst % 50 = 0 union all select dst from g_calls where src % 50 = 0 union all select fn from g_function where fn % 50 = 0)"))
def affected_subgraph(spark, sf_dir):
    """Functions of changed modules and all that one call joins them with."""
    g = project(spark, sf_dir)
    return expand.neighbours(g.functions.where("fn % 50 = 0").select(F.col("fn").alias("node")), g.calls).select(F.col("node").alias("fn"))


_OPEN = "select distinct fn from g_reach join g_endpoint using (ep) where is_public"


def _openly(g):
    return rules.endpoint_reach(g, 6).join(g.endpoints.where("is_public"), "ep", "left_semi").select("fn").distinct()


@query(_sql(f"select f, fn from g_affects where fn in ({_OPEN})"))
def reachable_findings_semi(spark, sf_dir):
    g = project(spark, sf_dir)
    return g.affects.join(_openly(g), "fn", "left_semi").select("f", "fn")


@query(_sql(f"select f, fn from g_affects where fn not in ({_OPEN})"))
def unreachable_findings_anti(spark, sf_dir):
    g = project(spark, sf_dir)
    return g.affects.join(_openly(g), "fn", "left_anti").select("f", "fn")


@query(_sql("select fn, uid, count(distinct ds) as n_stores, string_agg(distinct access, ',' order by access) as kinds from g_function join g_access using (fn) where source group by 1, 2"))
def input_functions_touching_stores(spark, sf_dir):
    g = project(spark, sf_dir)
    own = g.functions.where("source").join(g.access, "fn").groupBy("fn", "uid")
    return own.agg(F.countDistinct("ds").alias("n_stores"), F.array_join(F.sort_array(F.collect_set("access")), ",").alias("kinds"))


@query(_sql("select ep, fn, cast(depth as integer) as depth from g_reach"))
def reach_depth6(spark, sf_dir):
    """What every endpoint reaches over six calls or fewer."""
    return rules.endpoint_reach(project(spark, sf_dir), 6)


_TRAILS = """,
g_trail as (with recursive t(ep, fn, path, used, n) as (
    select ep, fn, cast(fn as varchar), cast([] as varchar[]), 0 from g_handled_by join g_endpoint using (ep) where is_public
    union all select ep, dst, path || '>' || dst, list_append(used, src || '>' || dst), n + 1 from t join g_calls on fn = src
      where n < 5 and not list_contains(used, src || '>' || dst))
  select * from t)
"""


def _trails(g, hops: int, where: str = "is_public"):
    starts = g.endpoints.where(where).join(g.handled_by, "ep").select(F.col("ep").alias("start"), F.col("fn").alias("node"))
    return expand.trails(starts, g.calls, hops).select(F.col("start").alias("ep"), F.col("node").alias("fn"), "path")


@query("with " + GRAPH_SQL.strip() + _TRAILS + "select ep, name as store, path from g_trail join g_pii using (fn)")
def pii_paths_from_public(spark, sf_dir):
    """Every trail of calls from a public endpoint to a store of personal data."""
    g = project(spark, sf_dir)
    return _trails(g, 5).join(rules.personal_access(g), "fn").select("ep", F.col("name").alias("store"), F.array_join("path", ">").alias("path"))


@query("with " + GRAPH_SQL.strip() + _TRAILS + "select * from (select distinct ep, ds, path, n + 1 as hops from g_trail join g_access using (fn)) qualify row_number() over (partition by ep order by hops, ds, path) <= 20")
def trace_dataflow(spark, sf_dir):
    """The 20 shortest trails from each public endpoint to stores that are read or written."""
    g = project(spark, sf_dir)
    starts = g.endpoints.where("is_public").join(g.handled_by, "ep").select(F.col("ep").alias("start"), F.col("fn").alias("node"))
    access = g.access.select("fn", "ds").distinct()
    near = expand.nearest_trails(starts, g.calls, access.select(F.col("fn").alias("node")).distinct(), 5, 20)
    found = near.select(F.col("start").alias("ep"), F.col("node").alias("fn"), "path").join(access, "fn")
    found = found.select("ep", "ds", F.array_join("path", ">").alias("path"), F.size("path").alias("hops")).distinct()
    return found.selectExpr("*", "row_number() over (partition by ep order by hops, ds, path) as r").where("r <= 20").select("ep", "ds", "path", "hops")


@query("with " + GRAPH_SQL.strip() + """,
g_back as (with recursive r(dep, fn, depth) as (select dep, fn, 0 from g_uses union select dep, src, depth + 1 from r join g_calls on fn = dst where depth < 4)
  select distinct dep, fn from r),
hit as (select distinct dep, ep, path from g_back join g_handled_by using (fn) join g_endpoint using (ep)),
pii as (select distinct dep from g_back join g_pii using (fn))
select d.dep, count(ep) as n_endpoints, coalesce(string_agg(path, ',' order by path), '') as paths, d.dep in (select dep from pii) as reaches_pii
from (select distinct p_brand as dep from part) d left join hit using (dep) group by 1""")
def blast_radius(spark, sf_dir):
    """Endpoints exposed to each dependency over reversed calls, and whether personal data is near."""
    g = project(spark, sf_dir)
    starts = g.uses.select(F.col("dep").alias("start"), F.col("fn").alias("node"))
    back = expand.reach(starts, expand.reverse(g.calls), 4).select(F.col("start").alias("dep"), F.col("node").alias("fn"))
    hit = back.join(g.handled_by, "fn").join(g.endpoints, "ep").select("dep", "ep", "path").distinct()
    hit = hit.groupBy("dep").agg(F.count("ep").alias("n_endpoints"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
    pii = back.join(rules.personal_access(g), "fn", "left_semi").select("dep").distinct().withColumn("reaches_pii", F.lit(True))
    deps = g.functions.select(F.col("module").alias("dep")).distinct()
    return deps.join(hit, "dep", "left").join(pii, "dep", "left").select(
        "dep", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"), F.coalesce("paths", F.lit("")).alias("paths"), F.coalesce("reaches_pii", F.lit(False)).alias("reaches_pii")
    )


@query("with " + GRAPH_SQL.strip() + _TRAILS + """
select f, path, hops from (select f, t.path, n + 1 as hops, row_number() over (partition by f order by n, t.path, ep) as r
  from g_trail t join g_affects using (fn)) where r <= 5""")
def public_paths_to_finding_topk(spark, sf_dir):
    """The five shortest trails from public endpoints into each finding's function.

    They are walked backwards, from the functions that have findings, and ranked once a function, before they meet its findings.
    """
    g = project(spark, sf_dir)
    public = g.endpoints.where("is_public").join(g.handled_by, "ep").select("ep", "fn")
    starts = g.affects.select(F.col("fn").alias("start"), F.col("fn").alias("node")).distinct()
    near = expand.nearest_trails(starts, expand.reverse(g.calls), public.select(F.col("fn").alias("node")).distinct(), 5, 5)
    found = near.join(public, near["node"] == public["fn"]).select(F.col("start").alias("fn"), "ep", F.array_join(F.reverse("path"), ">").alias("path"), F.size("path").alias("hops"))
    best = found.selectExpr("*", "row_number() over (partition by fn order by hops, path, ep) as r").where("r <= 5")
    return g.affects.join(best, "fn").select("f", "path", "hops")


@query(_deep("select src, dst, 0.9::double as confidence from g_taint"))
def taint_hop(spark, sf_dir):
    """Calls that carry request data into a tainted function."""
    return rules.taint_edges(project(spark, sf_dir)).withColumn("confidence", F.lit(0.9))


@query(_deep("select contextual_severity as severity, count(*) as n from g_severity group by 1"))
def severity_distribution(spark, sf_dir):
    """Open findings by severity in context."""
    return severity.severity_distribution(severity.rated(project(spark, sf_dir)))


_WEIGHT = "case contextual_severity when 'CRITICAL' then 10 when 'HIGH' then 5 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
_SCORES = f""", w as (select count(*) as n_open, cast(coalesce(sum({_WEIGHT}), 0) as bigint) as total from g_severity),
s as (select *, case when n_open = 0 then 100.0 else round(exp(-(cast(total as double) / n_open) / 5.0) * 100.0, 1) end as score_exp, greatest(0, 100 - total) as score_linear from w)
"""


@query(_deep(_SCORES + "select n_open, total, score_exp from s"))
def posture_score_exp(spark, sf_dir):
    return severity.scores(severity.rated(project(spark, sf_dir))).select("n_open", "total", "score_exp")


@query(_deep(_SCORES + "select total, score_linear from s"))
def posture_score_linear(spark, sf_dir):
    return severity.scores(severity.rated(project(spark, sf_dir))).select("total", "score_linear")


@query(_deep(f""", w as (select module, count(*) as n_open, sum({_WEIGHT}) as total from g_severity join g_affects using (f) join g_function using (fn) group by 1),
s as (select module, n_open, round(exp(-(cast(total as double) / n_open) / 5.0) * 100.0, 1) as score from w)
select *, case when score >= 90 then 'GOOD' when score >= 70 then 'FAIR' when score >= 50 then 'POOR' else 'CRITICAL' end as reading from s"""))
def score_interpretation(spark, sf_dir):
    """The score of each module and what it means."""
    g = project(spark, sf_dir)
    own = severity.rated(g).join(g.affects, "f").join(g.functions.select("fn", "module"), "fn")
    own = own.groupBy("module").agg(F.count("*").alias("n_open"), F.sum(C.weight(F.col("contextual_severity"))).cast("double").alias("total"))
    own = own.select("module", "n_open", C.score_exp(F.col("total"), F.col("n_open")).alias("score"))
    return own.withColumn("reading", C.interpretation(F.col("score")))


_MET = """, g_met as (select f from g_chain union select distinct f from g_finding join g_affects_dep using (f) join g_uses using (dep) join g_reach using (fn) join g_endpoint using (ep)
  where type = 'dependency' and is_public and depth <= 5)
"""


_RANKED = """, g_ranked as (select *, row_number() over (order by case contextual_severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, reachable desc nulls first, f) as r
  from (select f, contextual_severity, cwe_id, case when f in (select f from g_met) then true end as reachable from g_severity join g_finding using (f)))
"""


@query(_deep(_MET + _RANKED + """select f, contextual_severity, cwe_id, reachable, coalesce((select string_agg(distinct path, ',' order by path) from g_affects a join g_handled_by h using (fn) join g_endpoint e using (ep) where a.f = x.f), '') as endpoints
from g_ranked x where r <= 10"""))
def top_risks(spark, sf_dir):
    """The ten worst open findings by severity in context."""
    return severity.top_risks(project(spark, sf_dir))


@query(_deep(_MET + _RANKED + _SCORES.rstrip() + """, c as (select count(*) filter (contextual_severity = 'CRITICAL') as critical, count(*) filter (contextual_severity = 'HIGH') as high,
    count(*) filter (contextual_severity = 'MEDIUM') as medium, count(*) filter (contextual_severity = 'LOW') as low from g_severity),
newest as (select *, row_number() over (order by day desc, commit_sha) as r from g_snapshot order by r limit 10),
ends as (select arg_min(score, r) as a, arg_max(score, r) as b from newest),
t as (select a as current_score, coalesce(nullif(b, 0.0), a) as previous_score, round(a - coalesce(nullif(b, 0.0), a), 1) as delta from ends)
select score_exp as score, case when score_exp >= 90 then 'GOOD' when score_exp >= 70 then 'FAIR' when score_exp >= 50 then 'POOR' else 'CRITICAL' end as reading, n_open, critical, high, medium, low,
  case when delta > 2 then 'improving' when delta < -2 then 'degrading' else 'stable' end as direction, delta, current_score, previous_score,
  (select string_agg(cast(f as varchar), ',' order by cast(f as varchar)) from g_ranked where r <= 5) as top_risks, (select count(*) from g_chain) as chain_count,
  (select count(*) from g_endpoint where is_public) as public_endpoints, (select count(*) from g_endpoint) as endpoints from s, c, t"""))
def dashboard(spark, sf_dir):
    """One row: score, findings by severity, trend, worst findings, chains, endpoints."""
    return severity.dashboard(project(spark, sf_dir), snapshots(spark, sf_dir))


@query(_deep("select * from g_chain where rule = 'sqli_pii'"))
def rule1_sqli_pii(spark, sf_dir):
    return rules.rule1_sqli_pii(project(spark, sf_dir))


@query(_deep("select * from g_chain where rule = 'missing_auth_pii'"))
def rule2_missing_auth_pii(spark, sf_dir):
    return rules.rule2_missing_auth_pii(project(spark, sf_dir))


@query(_sql("""select distinct f, dep, path, fn, cast(depth as integer) as depth from g_finding join g_affects_dep using (f) join g_uses using (dep) join g_reach using (fn) join g_endpoint using (ep)
where type = 'dependency' and is_public and depth <= 5"""))
def rule3_supply_chain(spark, sf_dir):
    return rules.rule3_supply_chain(project(spark, sf_dir))


@query(_deep("select * from g_chain"))
def all_chains(spark, sf_dir):
    return rules.all_chains(project(spark, sf_dir))


@query(_deep("select f, count(*) as n_chains, string_agg(distinct s.name, ',' order by s.name) as stores, max(confidence) as confidence from g_chain join g_datastore s using (ds) group by 1"))
def chains_for_finding(spark, sf_dir):
    """Each finding's chains and the stores that they end in."""
    g = project(spark, sf_dir)
    named = rules.all_chains(g).join(g.stores, "ds").groupBy("f")
    return named.agg(F.count("*").alias("n_chains"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("stores"), F.max("confidence").alias("confidence"))


@query(_deep("""select s.f, contextual_severity, (select count(*) from g_chain c where c.f = s.f) as n_chains,
  coalesce((select min(depth) from g_affects a join g_reach r using (fn) join g_endpoint e using (ep) where a.f = s.f and is_public), -1) as hops,
  coalesce((select string_agg(distinct name, ',' order by name) from g_affects a join g_pii p using (fn) where a.f = s.f), '') as stores from g_severity s"""))
def exploitability(spark, sf_dir):
    """For every open finding at once: severity in context, chains, the shortest public path, personal data touched."""
    g = project(spark, sf_dir)
    base = severity.contextual_severity(g).select("f", "contextual_severity")
    chains = rules.all_chains(g).groupBy("f").agg(F.count("*").alias("n_chains"))
    public = g.endpoints.where("is_public").select("ep")
    hops = rules.endpoint_reach(g, 6).join(public, "ep", "left_semi").groupBy("fn").agg(F.min("depth").alias("hops"))
    stores = rules.personal_access(g).groupBy("fn").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("stores"))
    by_fn = g.affects.join(hops, "fn", "left").join(stores, "fn", "left").select("f", "hops", "stores")
    return base.join(chains, "f", "left").join(by_fn, "f", "left").select(
        "f", "contextual_severity", F.coalesce("n_chains", F.lit(0)).alias("n_chains"), F.coalesce("hops", F.lit(-1)).alias("hops"), F.coalesce("stores", F.lit("")).alias("stores")
    )


_EDGES = """, g_edge as (select rule, f, c.ds as target, 'DataStore' as label, s.name as target_name, 'Finding ' || case rule
    when 'sqli_pii' then 'is reached from a public endpoint whose calls can be made to read personal data in' else 'leaves an endpoint without authentication whose calls touch personal data in' end
    || ' ' || s.name || ' (first path: ' || ep_path || ').' || case when has_taint then ' Tainted request data was followed to it.' else '' end as evidence, confidence
  from g_chain c join g_datastore s using (ds))
"""


@query(_deep(_EDGES + "select * from g_edge"))
def chain_edges(spark, sf_dir):
    """Chains as edges from findings to stores, with their evidence."""
    return rules.chain_edges(project(spark, sf_dir))


@query(_deep(_EDGES + "select rule, f, target, confidence from g_edge order by confidence desc, rule, f, target limit 50"))
def top_chains(spark, sf_dir):
    """The 50 surest chains."""
    edges = rules.chain_edges(project(spark, sf_dir))
    return edges.select("rule", "f", "target", "confidence").orderBy(F.desc_nulls_first("confidence"), "rule", "f", "target").limit(50)


@query(_deep("""select 'taint' as rule, count(*) as n from g_taint union all select 'sqli_pii', count(*) from g_sqli union all select 'missing_auth_pii', count(*) from g_noauth
union all select 'supply_chain', count(*) from (select distinct f, dep, path, fn, depth from g_finding join g_affects_dep using (f) join g_uses using (dep) join g_reach using (fn) join g_endpoint using (ep)
  where type = 'dependency' and is_public and depth <= 5)"""))
def chain_counts(spark, sf_dir):
    """How many edges each rule gives."""
    return rules.chain_counts(project(spark, sf_dir))


@query(_deep(_MET + "select f, coalesce(f in (select f from g_met), false) as reachable_from_public from g_finding"))
def reachable_marks(spark, sf_dir):
    """Findings with the mark that rules set on those they met."""
    from rampart.operators import history

    g = project(spark, sf_dir)
    marks = rules.reachable_findings(g).withColumn("reachable_from_public", F.lit(True))
    return history.set_properties(g.findings.select("f", F.lit(False).alias("reachable_from_public")), marks, "f")


@query(_sql("""select a.f, h.ep from g_affects a join g_handled_by h using (fn) where a.f % 3 <> 0 union select f, f % 97 as ep from g_affects where f % 3 = 0 and f % 97 in (select ep from g_endpoint)"""))
def finding_endpoints(spark, sf_dir):
    """Endpoints that findings stand at: their own, where they affect an endpoint, or those that their function handles."""
    g = project(spark, sf_dir)
    targets = g.affects.select("f", F.when(F.col("f") % 3 == 0, "Endpoint").otherwise("Function").alias("label"), F.when(F.col("f") % 3 == 0, F.col("f") % 97).otherwise(F.col("fn")).alias("node"))
    return rules.exposed_at(targets, g)


@query(_sql("select f, raw_severity, title from g_finding where status = 'open' order by raw_severity, f"))
def open_findings_by_severity_text(spark, sf_dir):
    """Open findings in the order of their severity's text."""
    return project(spark, sf_dir).findings.where("status = 'open'").select("f", "raw_severity", "title").orderBy(F.asc_nulls_last("raw_severity"), "f")


@query(_sql("select ep, path, is_public, zone_level from g_endpoint order by is_public desc, path"))
def endpoints_listed(spark, sf_dir):
    """Public endpoints first, then by path."""
    return project(spark, sf_dir).endpoints.orderBy(F.desc("is_public"), "path")


_LINKS = "with recursive " + GRAPH_SQL.strip() + """,
g_link as (select a.f as src, b.f as dst, 'E' || a.f || '-' || b.f as evidence from g_finding a join g_finding b on b.f = a.f + 3 where a.cwe_id in ('CWE-89', 'CWE-306') and b.cwe_id <> ''),
w(start, node, nodes, ev, n) as (select src, dst, src || '>' || dst, evidence, 1 from g_link union all select start, dst, nodes || '>' || dst, ev, n + 1 from w join g_link on src = node where n < 5)
"""


def _links(g):
    """Findings three numbers apart, as edges from one finding to another."""
    a = g.findings.where(F.col("cwe_id").isin("CWE-89", "CWE-306")).select(F.col("f").alias("src"))
    b = g.findings.where("cwe_id <> ''").select(F.col("f").alias("dst"))
    return a.join(b, F.col("dst") == F.col("src") + 3).withColumn("evidence", F.concat(F.lit("E"), F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string")))


@query(_LINKS + "select distinct f, nodes, n as length, ev as evidence from (select start as f, * from w union all select node, * from w)")
def chain_paths(spark, sf_dir):
    """Chains of one to five edges that begin or end at each finding: nodes, length, evidence of the first edge."""
    p = expand.paths(_links(project(spark, sf_dir)), 5)
    p = p.select(F.explode(F.array("start", "node")).alias("f"), F.array_join("nodes", ">").alias("nodes"), "length", F.col("first").alias("evidence"))
    return p.distinct()


@query(_LINKS + "select start, node, n as length, list_contains(string_split(nodes, '>'), '9') as by_nine from w")
def path_predicates(spark, sf_dir):
    """Chains with a test over all of their nodes."""
    p = expand.paths(_links(project(spark, sf_dir)), 5)
    return p.select("start", "node", "length", F.exists("nodes", lambda x: x == 9).alias("by_nine"))


@query(_sql("""select node, label from (select cast(fn as varchar) as node, 'Function' as label from g_function union all select cast(ep as varchar), 'Endpoint' from g_endpoint
  union all select cast(ds as varchar), 'DataStore' from g_datastore union all select cast(f as varchar), 'Finding' from g_finding)"""))
def node_labels(spark, sf_dir):
    """All nodes with their labels."""
    from rampart.operators import build

    return build.nodes(project(spark, sf_dir))
