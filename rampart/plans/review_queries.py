"""Queries on commits, reviews, and matches with known truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import deliver, evaluate, history, match, scope
from rampart.plans import ask
from rampart.plans.projection import GRAPH_SQL, project
from rampart.plans.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""with b as (select p_partkey as k, 'm/' || lower(p_name) || p_partkey || '.py' as path, p_size as h from part where p_partkey % 7 <> 0),
a as (select p_partkey as k, 'm/' || lower(p_name) || p_partkey || '.py' as path, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as h from part where p_partkey % 11 <> 0)
select path, change from (select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' when a.h <> b.h then 'modified' end as change from a full join b using (path)) where change is not null""")
def manifest_diff(spark, sf_dir):
    """Changed files of two manifests."""
    p = _t(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat('m/', lower(p_name), p_partkey, '.py') as path", "p_size as s")
    before = p.where("k % 7 <> 0").select("path", F.col("s").alias("hash"))
    after = p.where("k % 11 <> 0").select("path", F.expr("if(k % 5 = 0, s + 1, s)").alias("hash"))
    return scope.manifest_diff(before, after)


@query("""with i as (select distinct 'app/m' || l_orderkey || '.py' as path, case when l_linenumber % 2 = 0 then 'lib.p' else 'p' end || l_partkey as m from lineitem),
c as (select 'lib/p' || p_partkey || '.py' as path, 'p' || p_partkey as s from part where p_size = 7 union all select 'app/m' || o_orderkey || '.py', 'm' || o_orderkey from orders where o_orderkey % 10 = 0)
select distinct path from i where (m in (select 'lib.' || s from c where starts_with(path, 'lib')) or m in (select s from c)) and path not in (select path from c)""")
def importers_one_hop(spark, sf_dir):
    """Files that import changed modules."""
    line, part, orders = (_t(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    imports = line.selectExpr("concat('app/m', l_orderkey, '.py') as path", "concat(if(l_linenumber % 2 = 0, 'lib.p', '.p'), l_partkey) as module").distinct()
    changed = part.where("p_size = 7").selectExpr("concat('lib/p', p_partkey, '.py') as path").union(orders.where("o_orderkey % 10 = 0").selectExpr("concat('app/m', o_orderkey, '.py')"))
    return scope.importers(imports, changed)


_REVIEWS = """with r as (select o_orderkey as id, case o_orderkey % 6 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'LOW' when 4 then 'NONE' else 'UNKNOWN' end as lvl, o_custkey % 4 = 0 as block,
  case o_custkey % 3 when 0 then '' when 1 then 'issue of ' || o_custkey else 'issue of ' || o_custkey || '|missing auth' end as issues from orders)
"""


def _reviews(spark, sf_dir):
    text = F.expr("""concat('Summary of ', o_orderkey, '\n', case when o_orderkey % 6 = 5 then '' else concat('RISK_LEVEL: ', element_at(array('critical', 'HIGH', 'Medium', 'LOW', 'NONE'), cast(o_orderkey % 6 + 1 as int)), '\n') end,
        'REQUIRES_BLOCK: ', if(o_custkey % 4 = 0, 'yes', 'No'), '\ntop_issues: ,', case o_custkey % 3 when 0 then ' ,' when 1 then concat('issue of ', o_custkey) else concat(' issue of ', o_custkey, ' , missing auth,') end, '\nend')""")
    return deliver.parse_review(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")))


@query(_REVIEWS + "select id, lvl as risk_level, block as requires_block, issues from r")
def review_parse(spark, sf_dir):
    """Levels, blocks and issues that review texts state."""
    return _reviews(spark, sf_dir).select("id", "risk_level", "requires_block", F.array_join("top_issues", "|").alias("issues"))


@query(_REVIEWS + """select case when block or lvl in ('CRITICAL', 'HIGH') then 'failure' when lvl = 'MEDIUM' then 'pending' else 'success' end as status,
  case when block then 'failure' when lvl in ('CRITICAL', 'HIGH') then 'action_required' else 'success' end as conclusion, count(*) as n from r group by 1, 2""")
def review_status(spark, sf_dir):
    """Commit statuses and check conclusions of reviews."""
    r = _reviews(spark, sf_dir)
    return r.groupBy(deliver.commit_status(F.col("risk_level"), F.col("requires_block")).alias("status"), deliver.check_conclusion(F.col("risk_level"), F.col("requires_block")).alias("conclusion")).agg(F.count("*").alias("n"))


@query("with " + GRAPH_SQL.strip() + "select f, fn from g_finding join g_affects using (f) where cwe_id = 'CWE-89' and raw_severity = 'CRITICAL'")
def guarded_sql(spark, sf_dir):
    """A reading statement with parameters over the graph's views."""
    ask.register(project(spark, sf_dir))
    return ask.ask_sql(spark, "select f, fn from findings join affects using (f) where cwe_id = :cwe and raw_severity = :level", {"cwe": "CWE-89", "level": "CRITICAL"})


@query("""with gt as (select p_partkey as gid, 'CWE-' || p_size as cwe, lower(p_name) as title, p_brand as file from part),
d as (select l_orderkey as did, l_linenumber as ln, 'CWE-' || (l_partkey % 60) as cwe, 'src/' || 'Brand#' || (l_suppkey % 5 + 1) || (l_suppkey % 5 + 1) as file, l_returnflag as flag from lineitem)
select gid, count(did) > 0 as found, min(did) as first_match from gt left join (select distinct cwe, did from d) using (cwe) group by gid""")
def truth_match(spark, sf_dir):
    """Known findings, whether the scan has their weakness, and the first row that does."""
    gt = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gid"), F.concat(F.lit("CWE-"), F.col("p_size").cast("string")).alias("cwe"))
    d = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("CWE-"), (F.col("l_partkey") % 60).cast("string")).alias("cwe"), F.col("l_orderkey").alias("did"))
    first = d.groupBy("cwe").agg(F.min("did").alias("first_match"))
    return gt.join(first, "cwe", "left").select("gid", F.col("first_match").isNotNull().alias("found"), "first_match")


_TRUTH = """with gt as (select p_partkey as gid, case when p_partkey % 3 = 0 then null else 'CWE-' || p_size end as cwe_id, 'm' || p_partkey % 50 || '.py' as file, 'Unsafe ' || lower(p_name) as title from part where p_size <= 5),
d as (select o_orderkey as f, 'CWE-' || (o_custkey % 300) as cwe_id, 'src/m' || o_custkey % 60 || '.py' as file, case when o_orderkey % 9 = 0 then 'unsafe call' else 'other' end as title from orders)
"""


@query(_TRUTH + """select gid, count(f) as hits, min(f) as first_match from gt left join (
  select distinct gid, f from gt join d on gt.cwe_id = d.cwe_id or (ends_with(d.file, gt.file) and list_bool_or(list_transform(list_filter(string_split(lower(gt.title), ' '), lambda w: length(w) > 4), lambda w: contains(lower(d.title), w)))))
  using (gid) group by gid""")
def truth_match_by_file(spark, sf_dir):
    """Known findings met by weakness, or by file and a word of the title."""
    known = _t(spark, sf_dir, "part").where("p_size <= 5").selectExpr("p_partkey as gid", "if(p_partkey % 3 = 0, null, concat('CWE-', p_size)) as cwe_id", "concat('m', p_partkey % 50, '.py') as file", "concat('Unsafe ', lower(p_name)) as title")
    found = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as f", "concat('CWE-', o_custkey % 300) as cwe_id", "concat('src/m', o_custkey % 60, '.py') as file", "if(o_orderkey % 9 = 0, 'unsafe call', 'other') as title")
    return known.select("gid").join(match.truth_counts(found, known), "gid", "left").select("gid", F.coalesce("hits", F.lit(0)).alias("hits"), "first_match")


_SCANNED = """with s as (select ['B608', 'B310', 'B106', 'B104', 'B999'][cast(l_linenumber % 5 as integer) + 1] as rule_id, ['LOW', 'MEDIUM', 'HIGH'][cast(l_partkey % 3 as integer) + 1] as severity, l_orderkey * 10 + l_linenumber as seq from lineitem),
k as (select * from (values ('F1', 'HIGH', 'B608'), ('F2', 'HIGH', null), ('F3', 'HIGH', 'B310'), ('F4', 'CRITICAL', 'B106'), ('F5', 'MEDIUM', 'B104'), ('F6', 'HIGH', null)) t(gid, raw, test)),
m as (select gid, raw, (select arg_min(severity, printf('%015d%s', seq, severity)) from s where rule_id = test) as severity from k)
"""


@query(_SCANNED + """select gid, severity is not null as detected, severity, coalesce(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) < list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], raw), false) as underrated from m""")
def scanner_baseline(spark, sf_dir):
    """What a scanner's rows detect of the known findings, and what it underrates."""
    scans = _t(spark, sf_dir, "lineitem").selectExpr("element_at(array('B608', 'B310', 'B106', 'B104', 'B999'), cast(l_linenumber % 5 as int) + 1) as rule_id", "element_at(array('LOW', 'MEDIUM', 'HIGH'), cast(l_partkey % 3 as int) + 1) as severity", "l_orderkey * 10 + l_linenumber as seq")
    return evaluate.scanner(scans, evaluate.known_findings(spark))


@query("""with f as (select o_orderkey as f, ['CWE-89', 'CWE-306', 'CWE-918', 'CWE-1', ''][cast(o_custkey % 5 as integer) + 1] as cwe_id, case when o_custkey % 11 = 0 then 'a/config.py' else 'a/b.py' end as file,
    case when o_custkey % 2 = 0 then 'hardcoded token' else 'debug flag' end as title, 'HIGH' as raw, case when o_orderkey % 2 = 0 then 'CRITICAL' else 'HIGH' end as ctx from orders),
g as (select * from (values ('F1', 'CWE-89', 'CRITICAL', '', ['x']), ('F2', 'CWE-306', 'CRITICAL', '', ['x']), ('F3', 'CWE-918', 'CRITICAL', '', ['x']), ('F4', 'CWE-798', 'CRITICAL', 'config.py', ['hardcoded', 'secret']), ('F5', 'CWE-94', 'HIGH', 'config.py', ['debug', 'enabled', 'production']), ('F6', '-', 'HIGH', 'requirements.txt', ['outdated'])) t(gid, cwe_id, due, file, words)),
h as (select gid, due, (select arg_min([raw, ctx], f) from f where f.cwe_id = g.cwe_id or (g.file <> '' and ends_with(f.file, g.file) and list_bool_or(list_transform(words, lambda w: contains(f.title, w))))) as r from g)
select cast(6 as bigint) as total, count(r) as detected, count(*) filter (r[2] = due) as correct, count(*) filter (r[1] <> r[2]) as upgraded, count(r) / 6 as detection_rate, coalesce(count(*) filter (r[2] = due) / nullif(count(r), 0), 0.0) as severity_accuracy,
  cast(2 as bigint) as chains, 2 / 3 as chain_rate from h""")
def engine_evaluation(spark, sf_dir):
    """What the engine's findings and chains detect of the known ones: rates."""
    o = _t(spark, sf_dir, "orders")
    found = o.selectExpr(
        "o_orderkey as f", "element_at(array('CWE-89', 'CWE-306', 'CWE-918', 'CWE-1', ''), cast(o_custkey % 5 as int) + 1) as cwe_id", "if(o_custkey % 11 = 0, 'a/config.py', 'a/b.py') as file",
        "if(o_custkey % 2 = 0, 'hardcoded token', 'debug flag') as title", "'HIGH' as raw_severity", "if(o_orderkey % 2 = 0, 'CRITICAL', 'HIGH') as contextual_severity",
    )
    edges = o.selectExpr("concat('SQL reached ', o_orderkey, ' holds PII') as text")
    return evaluate.rates(evaluate.engine(found, evaluate.known_findings(spark)), evaluate.chains_found(edges, evaluate.known_chains(spark)))


@query("""with r as (select ['LOW', 'MEDIUM', 'HIGH'][cast(o_custkey % 3 as integer) + 1] as raw, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][cast(o_orderkey % 4 as integer) + 1] as truth, ['LOW', 'HIGH', 'CRITICAL'][cast((o_orderkey + o_custkey) % 3 as integer) + 1] as guess from orders)
select count(*) as n, count(*) filter (truth = guess) as correct, count(*) filter (raw <> truth and raw <> guess) / count(*) filter (raw <> guess) as upgrade_precision, count(*) filter (raw <> truth and raw <> guess) / count(*) filter (raw <> truth) as upgrade_recall from r""")
def severity_upgrades(spark, sf_dir):
    """Precision and recall of raised severities."""
    rated = _t(spark, sf_dir, "orders").selectExpr(
        "element_at(array('LOW', 'MEDIUM', 'HIGH'), cast(o_custkey % 3 as int) + 1) as raw", "element_at(array('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), cast(o_orderkey % 4 as int) + 1) as truth",
        "element_at(array('LOW', 'HIGH', 'CRITICAL'), cast((o_orderkey + o_custkey) % 3 as int) + 1) as guess",
    )
    return match.upgrades(rated)


@query("""with e as (select o_orderkey as src, o_orderkey + 1 as dst, 'e' || o_orderkey as evidence, 0.5 as confidence from orders)
select 'new' as change, cast(src as varchar) as src, cast(dst as varchar) as dst, evidence, cast(confidence as double) as confidence from e where src % 8 = 0 or dst % 8 = 0
union all select 'broken', cast(o_orderkey as varchar), null, 'node_removed', null from orders where o_orderkey % 9 = 4""")
def graph_diff_chains(spark, sf_dir):
    """Chains that new nodes take part in, and those that removed nodes broke."""
    o = _t(spark, sf_dir, "orders")
    edges = o.selectExpr("o_orderkey as src", "o_orderkey + 1 as dst", "concat('e', o_orderkey) as evidence", "cast(0.5 as double) as confidence")
    ends = edges.select(F.col("src").alias("uid")).union(edges.select("dst")).distinct()
    return history.diff_chains(edges, ends.where("uid % 8 = 0"), o.where("o_orderkey % 9 = 4").select(F.col("o_orderkey").alias("uid")))


@query("""with d as (select o_orderkey as id, cast(o_custkey % 3 as integer) as n_new, cast(o_custkey % 4 as integer) as n_removed, cast(o_orderkey % 2 as integer) as n_chains, round((o_custkey % 7 - 3) * 1.5, 1) as delta, round(o_custkey % 100 + 0.5, 1) as score from orders),
t as (select *, case when delta > 0 then printf('DEGRADED by %.1f points', delta) when delta < 0 then printf('IMPROVED by %.1f points', -delta) else 'NEUTRAL' end as way,
  array_to_string(list_filter([case when n_new > 0 then n_new || ' new finding(s)' end, case when n_removed > 0 then n_removed || ' node(s) removed' end, case when n_chains > 0 then n_chains || ' new vulnerability chain(s)' end], lambda x: x is not null), ', ') as more from d)
select id, printf('Posture %s (score: %.1f/100).', way, score) || case when more <> '' then ' ' || more || '.' else '' end as summary from t""")
def diff_summary(spark, sf_dir):
    """A line of text on each difference; only findings count as such among new nodes."""
    d = _t(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "concat(array('function', 'chain-of'), array_repeat('sast', cast(o_custkey % 3 as int))) as types", "cast(o_custkey % 4 as int) as n_removed", "cast(o_orderkey % 2 as int) as n_chains",
        "cast((o_custkey % 7 - 3) * 1.5 as double) as delta", "cast(o_custkey % 100 + 0.5 as double) as score",
    )
    return history.summary(d).select("id", "summary")


@query("""with f as (select o_orderkey as uid, 'c' || o_custkey % 40 as i, case when o_orderstatus = 'F' then 'c' || o_custkey % 30 + 20 end as r from orders),
a as (select i as sha, count(*) as introduced, min(uid) as first_in from f group by 1), b as (select r as sha, count(*) as resolved, max(uid) as last_out from f where r is not null group by 1)
select sha, coalesce(introduced, 0) as introduced, coalesce(resolved, 0) as resolved, first_in, last_out from a full join b using (sha)""")
def findings_by_commit(spark, sf_dir):
    """What each commit introduced and resolved."""
    f = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as uid", "concat('c', o_custkey % 40) as introduced_in", "if(o_orderstatus = 'F', concat('c', o_custkey % 30 + 20), null) as resolved_in")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return history.by_commit(f).select("sha", size("introduced"), size("resolved"), F.col("introduced")[0].alias("first_in"), F.array_max("resolved").alias("last_out"))
