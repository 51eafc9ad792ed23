"""Queries on source texts and webhook events, both derived by Spark from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rampart.operators import build, rules
from rampart.plans.registry import query
from rampart.sources import code
from rampart.storage import shared_dir, written
from rampart.streaming import events


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCE = """import sqlite3
from flask import request, Flask

@app.route("/p/%1$s/<int:item>", methods=[%2$s])
%3$sdef view_%1$s(item):
    name = request.args.get("q")
    return load_%1$s(name)

def load_%1$s(value):
    cursor.execute("SELECT * FROM %4$s WHERE a = " + value)
    return helper_%1$s.run(value)
"""


def _facts(spark, sf_dir, *kinds):
    """Facts of some kinds of one source file for each part; not yet written, for who reads them once."""
    verbs = F.when(F.col("p_size") % 2 == 0, '"GET"').otherwise('"GET", "POST"')
    guard = F.when(F.col("p_size") % 3 == 0, "@login_required\n").otherwise("")
    table = F.when(F.col("p_size") % 5 == 0, "users").otherwise("stock")
    text = F.format_string(_SOURCE, F.col("p_partkey").cast("string"), verbs, guard, table)
    return code.facts(_t(spark, sf_dir, "part").select(F.concat(F.lit("app/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text")), kinds)


_P = "with p as (select p_partkey as k, cast(p_partkey as varchar) as s, p_size, case when p_size % 3 = 0 then 1 else 0 end as g from part) "


@query(_P + """select 'app.m' || s || '.view_' || s as qualified, cast(5 + g as integer) as line, cast(7 + g as integer) as end_line, 'item' as params, true as is_entry, true as has_request from p
union all select 'app.m' || s || '.load_' || s, cast(9 + g as integer), cast(11 + g as integer), 'value', false, false from p""")
def parse_functions(spark, sf_dir):
    """Function nodes of the sources."""
    n = build.function_nodes(written(_facts(spark, sf_dir, "function")))
    return n.select("qualified", "line", "end_line", F.array_join("params", ",").alias("params"), "is_entry", "has_request")


@query(_P + """select 'app.m' || s || '.view_' || s as src, 'unresolved.load_' || s as dst from p union all select 'app.m' || s || '.load_' || s, 'unresolved.cursor.execute' from p
union all select 'app.m' || s || '.load_' || s, 'unresolved.helper_' || s || '.run' from p""")
def parse_calls(spark, sf_dir):
    """Call edges: a function defined below its caller isn't known yet when the call is met."""
    return build.call_edges(written(_facts(spark, sf_dir, "function", "call")))[0]


@query(_P + """select '/p/' || s || '/<int:item>' as path, m as method, 'app.m' || s || '.view_' || s as handler, p_size % 3 = 0 as auth_required, case when p_size % 3 = 0 then 'session' else 'none' end as auth_type, 'public' as zone
from p, (values ('GET'), ('POST')) v(m) where m = 'GET' or p_size % 2 = 1""")
def endpoint_extract(spark, sf_dir):
    return build.endpoint_nodes(written(_facts(spark, sf_dir, "endpoint"))).select("path", "method", "handler", "auth_required", "auth_type", "zone")


@query(_P + """select 'find:builtin:missing-auth:app/m' || s || '.py:5' as uid, 'app.m' || s || '.view_' || s as handler from p where p_size % 3 <> 0""")
def missing_auth_findings(spark, sf_dir):
    """Findings for public endpoints without authentication; both methods of a handler make one."""
    return build.missing_auth(build.endpoint_nodes(written(_facts(spark, sf_dir, "endpoint")))).select("uid", "handler")


@query(_P + """select 'app.m' || s || '.load_' || s as fn, case when p_size % 5 = 0 then 'users' else 'stock' end as store, p_size % 5 = 0 as pii, 'READS_FROM' as edge from p""")
def datastore_access(spark, sf_dir):
    """Store accesses: the table that the literal part of the SQL names."""
    return build.store_edges(_facts(spark, sf_dir, "access")).select("fn", "store", "pii", "edge")


@query(_P + """select 'app.m' || s || '.load_' || s as fn, 'sql_injection' as sinks, 'value' as sources from p""")
def taint_flows(spark, sf_dir):
    t = build.taint_marks(_facts(spark, sf_dir, "taint"))
    return t.select("fn", F.array_join("sinks", ",").alias("sinks"), F.array_join("sources", ",").alias("sources"))


@query(_P + """select 'app.m' || s || f || s as fn, dep from p, (values ('.view_'), ('.load_')) v(f), (values ('Flask'), ('SQLite3')) d(dep)""")
def uses_edges(spark, sf_dir):
    """Functions and the required packages that their file imports."""
    wanted = spark.sql("select * from values ('Flask'), ('SQLite3'), ('Requests') as t(name)")
    return build.dependency_edges(written(_facts(spark, sf_dir, "function", "imports")), wanted)


_APP = """import sqlite3
from flask import request, Flask

def load_%1$s(value):
    cursor.execute("SELECT * FROM %3$s WHERE a = " + value)
    return value

@app.route("/p/%1$s", methods=["GET"])
%2$sdef view_%1$s(item):
    name = request.args.get("q")
    return load_%1$s(name)
"""


def _repository(spark, sf_dir):
    """The graph of one file for each part, with scanner, audit and requirement rows."""
    p = _t(spark, sf_dir, "part")
    guard = F.when(F.col("p_size") % 3 == 0, "@login_required\n").otherwise("")
    table = F.when(F.col("p_size") % 5 == 0, "users").otherwise("stock")
    path = F.concat(F.lit("app/m"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = p.select(path.alias("path"), F.format_string(_APP, F.col("p_partkey").cast("string"), guard, table).alias("text"))
    scans = p.where("p_size % 4 = 0").select(
        F.lit("bandit").alias("tool"), F.lit("B608").alias("rule_id"), F.lit("Possible SQL injection").alias("description"), F.lit("MEDIUM").alias("severity"), F.lit("CWE-89").alias("cwe_id"), path.alias("file"), F.lit(5).alias("line"),
    )
    issues = p.where("p_size = 7").select(path.alias("path"), F.lit(1).alias("n"), F.lit("debug_mode_enabled").alias("kind"), F.lit("MEDIUM").alias("severity"), F.lit("DEBUG = True").alias("evidence"))
    wanted = spark.sql("select * from values ('Flask', '2.0', true), ('SQLite3', null, false), ('Requests', '1.0', true) as t(name, version, pinned)")
    audit = spark.sql("select * from values ('flask', 'CVE-1', 'HIGH', 'd'), ('other', 'CVE-2', 'HIGH', 'd') as t(package, cve_id, severity, description)")
    return build.graph(written(code.facts(files)), wanted, scans, audit, issues)


_R = "with p as (select cast(p_partkey as varchar) as s, p_size as z, p_size % 3 <> 0 as open, p_size % 4 = 0 as scanned, p_size % 5 = 0 as pii from part) "


@query(_R + """select label, cast(n as bigint) as n from (select 'Function' as label, 2 * count(*) as n from p union all select 'Endpoint', count(*) from p union all select 'DataStore', count(distinct pii) from p
  union all select 'Finding', count(*) filter (scanned) + count(*) filter (open) + count(*) filter (z = 7) + 1 from p union all select 'Service', 1 union all select 'TrustZone', 4 union all select 'Dependency', 3) where n > 0""")
def repository_nodes(spark, sf_dir):
    """Nodes of the graph that sources and reports give, by label."""
    return build.nodes(_repository(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(_R + """select 'find:bandit:B608:app/m' || s || '.py:5' as f, 'sast' as type, 'app.m' || s || '.load_' || s as at from p where scanned
union all select 'find:builtin:missing-auth:app/m' || s || '.py:9', 'sast', 'app.m' || s || '.view_' || s from p where open
union all select 'find:config_analyzer:debug_mode_enabled:app/m' || s || '.py:1', 'config', null from p where z = 7 union all select 'find:pip-audit:CVE-1:Flask:0', 'dependency', 'dep:Flask:2.0'""")
def repository_findings(spark, sf_dir):
    """Findings of all kinds with what they affect."""
    g = _repository(spark, sf_dir)
    at = g.affects.select("f", F.col("fn").alias("at")).union(g.affects_dep.select("f", "dep"))
    return g.findings.select("f", "type").join(at, "f", "left")


@query(_R + """select 'sqli_pii' as rule, 'find:bandit:B608:app/m' || s || '.py:5' as f, 'ds:sqlite:users' as target, cast(1.0 as double) as confidence from p where scanned and open and pii
union all select 'missing_auth_pii', 'find:builtin:missing-auth:app/m' || s || '.py:9', 'ds:sqlite:users', 1.0 from p where open and pii""")
def repository_chains(spark, sf_dir):
    """Chains of the graph that sources and reports give."""
    return rules.chain_edges(_repository(spark, sf_dir)).select("rule", "f", "target", "confidence")


@query(_R + """select 'ep:GET:/p/' || s as ep, 'svc:app' as service, 'tz:public' as zone, 'app.m' || s || '.view_' || s as fn, 'flask' as framework from p""")
def repository_endpoints(spark, sf_dir):
    """Endpoints with their service, zone, handler and framework."""
    g = _repository(spark, sf_dir)
    return g.endpoints.select("ep", "framework").join(g.belongs_to, "ep").join(g.in_zone, "ep").join(g.handled_by, "ep").select("ep", "service", "zone", "fn", "framework")


@query(_R + "select 'app.m' || s || '.load_' || s as fn, 'sql_injection' as sink, 'value' as source from p")
def taint_edges_by_sink(spark, sf_dir):
    """One edge for each function and kind of sink."""
    return build.taint_edges(_facts(spark, sf_dir, "taint")).select("fn", "sink", "source")


def _hooks(spark, sf_dir):
    """A webhook payload for each event."""
    e = _t(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'view' then 'push' when 'purchase' then 'pull_request' when 'click' then 'push' when 'signup' then 'pull_request' else 'ping' end")
    payload = F.expr(
        """case when event_type in ('view', 'click') then concat('{"after":"', if(event_id % 11 = 0, repeat('0', 40), sha1(cast(event_id as string))), '","ref":"refs/heads/b', user_id % 5,
        '","repository":{"full_name":"r/', user_id % 7, '"},"commits":', if(event_id % 13 = 0, '[]', concat('[{"id":"x","added":["src/a', event_id % 3, if(event_id % 2 = 0, '.py', '.md'),
        '"],"modified":["README.md"]},{"id":"y","removed":["README.md"]}]')), '}')
        else concat('{"action":"', if(event_id % 2 = 0, 'opened', 'closed'), '","number":', event_id % 1000, ',"repository":{"full_name":"r/', user_id % 7, '"},"pull_request":{"head":{"sha":"', sha1(cast(event_id as string)), '","ref":"f"}}}') end"""
    )
    return e.select(F.col("event_id").alias("id"), kind.alias("kind"), payload.alias("payload"))


_ROUTED = """with e as (select *, event_type in ('view', 'click') as push, event_type in ('purchase', 'signup') as pull from events),
r as (select event_id as id, case when push then 'push' else 'pull_request' end as kind, sha1(cast(event_id as varchar)) as sha, 'r/' || user_id % 7 as repo,
  case when push then 'b' || user_id % 5 else 'f' end as branch, case when push then 'README.md,src/a' || event_id % 3 || case when event_id % 2 = 0 then '.py' else '.md' end else '' end as files,
  case when pull then event_id % 1000 end as number, not push or event_id % 2 = 0 as relevant
  from e where (push and event_id % 13 <> 0 and event_id % 11 <> 0) or (pull and event_id % 2 = 0))
"""


@query(_ROUTED + "select id, kind, sha, repo, branch, files, cast(number as integer) as number, relevant from r")
def route_events(spark, sf_dir):
    """Pushes and pull requests among webhook events."""
    r = events.route(_hooks(spark, sf_dir))
    return r.select("id", "kind", "sha", "repo", "branch", F.array_join("files", ",").alias("files"), "number", "relevant")


@query(_ROUTED + "select repo, path, count(*) as n from (select repo, unnest(string_split(files, ',')) as path from r where kind = 'push') group by 1, 2")
def push_changed_files(spark, sf_dir):
    """How many pushes changed each file of a repository."""
    r = events.route(_hooks(spark, sf_dir)).where("kind = 'push'")
    return r.select("repo", F.explode("files").alias("path")).groupBy("repo", "path").agg(F.count("*").alias("n"))


@query("select event_type as repo, date_trunc('hour', ts) as start, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1, 2")
def stream_events_to_snapshots(spark, sf_dir):
    """The event stream by hour, through a checkpointed stream that takes all there is."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"  # all events are asked for, so nothing is resumed
    out = events.run_once(events.hourly(events.event_stream(spark, sf_dir)), folder)
    return out.select("repo", F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors")
