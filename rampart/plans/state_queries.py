"""Queries on generations, snapshots, text scans, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import history, inverted, knowledge, match, retrieval
from rampart.plans.projection import GRAPH_SQL, project, snapshots
from rampart.plans.registry import query
from rampart.sources import config


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SNAP = "with " + GRAPH_SQL.strip()

_GEN = """with old as (select o_orderkey as uid, o_orderstatus as raw, o_orderpriority as contextual, o_totalprice as price from orders where o_orderkey % 5 <> 0),
new as (select o_orderkey as uid, 'N' as raw, case when o_orderkey % 2 = 0 then 'N' else 'M' end as contextual, o_totalprice * 2 as price from orders where o_orderkey % 3 = 0)
"""


def _generations(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    old = o.where("uid % 5 <> 0").select("uid", F.col("o_orderstatus").alias("raw"), F.col("o_orderpriority").alias("contextual"), F.col("o_totalprice").alias("price"))
    new = o.where("uid % 3 = 0").select("uid", F.lit("N").alias("raw"), F.when(F.col("uid") % 2 == 0, "N").otherwise("M").alias("contextual"), (F.col("o_totalprice") * 2).alias("price"))
    return old, new


@query(_GEN + "select * from new union all select * from old where uid not in (select uid from new)")
def upsert_last_wins(spark, sf_dir):
    """A generation of findings over the one before."""
    old, new = _generations(spark, sf_dir)
    return history.upsert(old, new, ["uid"], "price")


@query(_GEN + """select uid, 'new' as change from new where uid not in (select uid from old) union all
select uid, 'removed' from old where uid not in (select uid from new) union all select uid, 'changed' from new where uid in (select uid from old) and contextual <> raw""")
def graph_diff_nodes(spark, sf_dir):
    old, new = _generations(spark, sf_dir)
    return history.diff(old.select("uid", "raw", "contextual"), new.select("uid", "raw", "contextual"))


@query(_SNAP + """, gone as (select fn from g_function where module in ('Brand#11', 'Brand#22', 'Brand#33') and fn % 4 <> 0)
select src, dst from g_calls where src not in (select fn from gone) and dst not in (select fn from gone)""")
def stale_delete(spark, sf_dir):
    """Calls that are left after changed modules were rebuilt without some of their functions."""
    g = project(spark, sf_dir)
    nodes = g.functions.select(F.col("fn").alias("uid"), F.col("module").alias("file"))
    changed = nodes.where(F.col("file").isin("Brand#11", "Brand#22", "Brand#33")).select("file").distinct()
    return history.delete_stale(nodes, g.calls, changed, nodes.where("uid % 4 = 0").select("uid"))[1]


@query(_SNAP + "select repo, commit_sha, score, chain_count from (select *, row_number() over (partition by repo order by day desc, commit_sha) as r from g_snapshot) where r <= 20")
def posture_history(spark, sf_dir):
    """The 20 newest snapshots of each repository."""
    return history.newest(snapshots(spark, sf_dir), 20).select("repo", "commit_sha", "score", "chain_count")


@query(_SNAP + """, n as (select *, row_number() over (partition by repo order by day desc, commit_sha) as r from g_snapshot qualify r <= 10)
select repo, arg_min(score, r) as newest, arg_max(score, r) as oldest, round(arg_min(score, r) - arg_max(score, r), 1) as delta,
  case when round(arg_min(score, r) - arg_max(score, r), 1) > 2 then 'improving' when round(arg_min(score, r) - arg_max(score, r), 1) < -2 then 'degrading' else 'stable' end as direction
from n group by repo""")
def posture_trend(spark, sf_dir):
    return history.trend(snapshots(spark, sf_dir), 10)


@query(_SNAP + """select repo, commit_sha, score, lag(score) over w - score as delta,
  case when lag(score) over w - score > 0 then 'DEGRADED' when lag(score) over w - score < 0 then 'IMPROVED' else 'NEUTRAL' end as change
from g_snapshot window w as (partition by repo order by day)""")
def snapshot_lag(spark, sf_dir):
    """Each snapshot against the one before: a positive delta is worse."""
    s = snapshots(spark, sf_dir).selectExpr("repo", "commit_sha", "score", "lag(score) over (partition by repo order by day) - score as delta")
    return s.withColumn("change", C.change_label(F.col("delta")))


@query(_SNAP + """, fns as (select fn, module || '/f' || fn % 7 || '.py' as file, cast(fn % 900 + 1 as integer) as lo, cast(fn % 900 + 1 + fn % 83 as integer) as hi from g_function),
found as (select o_orderkey as find, 'Brand#' || (o_orderkey % 5 + 1) || (o_orderkey % 5 + 1) || '/f' || o_orderkey % 7 || '.py' as file, cast(o_orderkey % 950 + 1 as integer) as line from orders)
select find, fn from (select find, fn, row_number() over (partition by find order by a.file <> f.file, hi - lo, lo, fn) as r
  from found a join fns f on split_part(a.file, '/', 2) = split_part(f.file, '/', 2) and line between lo and hi) where r = 1""")
def containing_function_interval_join(spark, sf_dir):
    """The innermost function around each finding's line."""
    g = project(spark, sf_dir)
    own = F.concat(F.lit("/f"), (F.col("fn") % 7).cast("string"), F.lit(".py"))
    fns = g.functions.select("fn", F.concat("module", own).alias("file"), (F.col("fn") % 900 + 1).cast("int").alias("start"), (F.col("fn") % 900 + 1 + F.col("fn") % 83).cast("int").alias("end"))
    d = (F.col("o_orderkey") % 5 + 1).cast("string")
    found = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("find"),
        F.concat(F.lit("Brand#"), d, d, F.lit("/f"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".py")).alias("file"),
        (F.col("o_orderkey") % 950 + 1).cast("int").alias("line"),
    )
    return match.containing(found, fns)


@query("""with s as (select l_partkey % 97 as file, l_suppkey % 40 as line, case when l_linenumber % 2 = 0 then '' else 'CWE-' || l_linenumber end as cwe_id, 'R' || l_linenumber as rule_id,
  repeat('d', cast(l_quantity as integer)) as description, l_returnflag as source, cast(l_orderkey * 1000000 + round(l_extendedprice * 100) as bigint) as seq from lineitem)
select file, line, kind, max_len, source from (select *, coalesce(nullif(cwe_id, ''), rule_id) as kind, length(description) as max_len,
  row_number() over (partition by file, line, coalesce(nullif(cwe_id, ''), rule_id) order by length(description) desc, source, seq) as r from s) where r = 1""")
def sast_dedupe(spark, sf_dir):
    """Scanner rows reduced to one for each place and weakness."""
    s = _t(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 97 as file", "l_suppkey % 40 as line", "if(l_linenumber % 2 = 0, '', concat('CWE-', l_linenumber)) as cwe_id", "concat('R', l_linenumber) as rule_id",
        "repeat('d', cast(l_quantity as int)) as description", "l_returnflag as source", "cast(l_orderkey * 1000000 + round(l_extendedprice * 100) as bigint) as seq",
    )
    kind = F.coalesce(F.nullif("cwe_id", F.lit("")), "rule_id").alias("kind")
    return match.dedupe_scans(s).select("file", "line", kind, F.length("description").cast("long").alias("max_len"), "source")


_LINES = """with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents)
"""


def _lines(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), "line")


_SECRET_SQL = " ".join(f"when regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in C.SECRETS)


@query(_LINES + f"""select doc_id, n, kind, evidence from (select doc_id, n, trim(line)[:200] as evidence, unnest([case {_SECRET_SQL} end,
    case when regexp_matches(line, '{C.CORS.replace(chr(39), chr(39) * 2)}') then 'cors' end, case when regexp_matches(line, '{C.DEBUG}') then 'debug_mode_enabled' end]) as kind
  from lines where not regexp_matches(line, '{C.ENVIRONMENT}')) where kind is not null""")
def config_secret_scan(spark, sf_dir):
    """Secrets, open CORS and debug switches by line; at most one of each on a line."""
    return config.scan_lines(_lines(spark, sf_dir)).select("doc_id", "n", "kind", "evidence")


@query(_LINES + """select doc_id, n, key || '=***' as evidence from (select doc_id, n, trim(substr(line, 1, strpos(line, '=') - 1)) as key, trim(substr(line, strpos(line, '=') + 1)) as value
  from lines where contains(line, '=')) where regexp_matches(upper(key), 'SECRET|PASSWORD|TOKEN|KEY|PRIVATE') and length(value) > 4 and not starts_with(value, '$')""")
def env_style_scan(spark, sf_dir):
    """KEY=value lines whose key means a secret; values are masked."""
    return config.scan_environment(_lines(spark, sf_dir)).select("doc_id", "n", "evidence")


_STATEMENTS = """with s as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'select a from ' || lower(o_orderstatus) || '_orders where k = 1' when 1 then 'INSERT INTO users (a) VALUES (1)'
  when 2 then 'UPDATE "accounts" SET b = 2' when 3 then 'DELETE FROM ' || chr(96) || 'cards' || chr(96) when 4 then 'PRAGMA x' end as sql from orders)
"""


@query(_STATEMENTS + """select id, case when regexp_matches(sql, '(?i)\\b(SELECT|FETCH|GET)\\b') then 'read' when regexp_matches(sql, '(?i)\\b(INSERT|UPDATE|DELETE|REPLACE|TRUNCATE|DROP|CREATE)\\b') then 'write' else 'none' end as access,
  case id % 5 when 0 then (select lower(o_orderstatus) from orders where o_orderkey = id) || '_orders' when 1 then 'users' when 2 then 'accounts' when 3 then 'cards' else 'sqlite' end as store,
  id % 5 in (1, 2, 3) as pii from s""")
def sql_access_classify(spark, sf_dir):
    """Access, table and personal data of SQL texts."""
    kinds = F.expr(
        "case o_orderkey % 5 when 0 then concat('select a from ', lower(o_orderstatus), '_orders where k = 1') when 1 then 'INSERT INTO users (a) VALUES (1)' "
        "when 2 then 'UPDATE \"accounts\" SET b = 2' when 3 then 'DELETE FROM `cards`' when 4 then 'PRAGMA x' end"
    )
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kinds.alias("sql"))
    s = s.select("id", C.sql_access(F.col("sql"), F.lit("none")).alias("access"), C.sql_table(F.col("sql"), F.lit("sqlite")).alias("store"))
    return s.withColumn("pii", C.personal(F.col("store")))


@query("select p_name as name, regexp_matches(lower(p_name || case when p_size % 5 = 0 then '_Card' else '' end), '" + "|".join(C.PERSONAL) + "') as pii, count(*) as n from part group by 1, 2")
def pii_name_flag(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_size") % 5 == 0, "_Card").otherwise(""))
    return _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), C.personal(name).alias("pii")).agg(F.count("*").alias("n"))


_PATHS = """with p as (select s_suppkey as id, '/' || case s_suppkey % 4 when 0 then 'Admin/<int:user_id>' when 1 then 'auth/{token}/x/{token}' when 2 then 'internal/<name>/{k}' else lower(n_name) end as path,
  case when s_nationkey % 6 = 0 then 'app/auth_views.py' else 'app/__init__.py' end as file from supplier join nation on s_nationkey = n_nationkey)
"""


def _paths(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey as id",
        "concat('/', case s_suppkey % 4 when 0 then 'Admin/<int:user_id>' when 1 then 'auth/{token}/x/{token}' when 2 then 'internal/<name>/{k}' else lower(n_name) end) as path",
        "if(s_nationkey % 6 = 0, 'app/auth_views.py', 'app/__init__.py') as file",
    )


@query(_PATHS + "select id, case id % 4 when 0 then 'user_id' when 1 then 'token' when 2 then 'name,k' else '' end as params from p")
def route_params(spark, sf_dir):
    """Parameters named in route paths."""
    return _paths(spark, sf_dir).select("id", F.array_join(C.route_params(F.col("path")), ",").alias("params"))


@query(_PATHS + """select id, case when contains(lower(path), 'admin') then 'admin' when contains(lower(path), 'auth') or contains(file, 'auth') then 'authenticated'
  when contains(lower(path), 'internal') then 'system' else 'public' end as zone, not starts_with(path, '/auth/') as needs_auth from p""")
def trust_zone_infer(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", C.trust_zone(F.col("path"), F.col("file")).alias("zone"), C.needs_auth(F.col("path")).alias("needs_auth"))


_FILES = """with f as (select p_partkey as id, case p_partkey % 6 when 0 then 'src/' || lower(p_name) || '/__init__.py' when 1 then 'app/requirements.txt' when 2 then 'conf/Settings.py'
  when 3 then 'web/main.js' when 4 then 'lib/m' || p_size || '.py' else '.env.local' end as path from part)
"""


def _files(spark, sf_dir):
    return _t(spark, sf_dir, "part").selectExpr(
        "p_partkey as id",
        "case p_partkey % 6 when 0 then concat('src/', lower(p_name), '/__init__.py') when 1 then 'app/requirements.txt' when 2 then 'conf/Settings.py' "
        "when 3 then 'web/main.js' when 4 then concat('lib/m', p_size, '.py') else '.env.local' end as path",
    )


@query(_FILES + "select id, path, case id % 6 when 1 then 'dependency' when 2 then 'config' when 5 then 'config' else case when regexp_matches(path, '(?i)(config|settings|\\.env|secrets|credentials)') then 'config' else 'code' end end as kind from f where id % 6 <> 3")
def change_categorise(spark, sf_dir):
    """Changed files as dependency, config or code; others are left out."""
    return _files(spark, sf_dir).withColumn("kind", C.change_kind(F.col("path"))).where("kind is not null")


@query(_FILES + "select id, replace(replace(regexp_replace(path, '\\.py$', ''), '/__init__', ''), '/', '.') as module from f where ends_with(path, '.py')")
def module_from_path(spark, sf_dir):
    return _files(spark, sf_dir).where(F.col("path").endswith(".py")).select("id", C.module_of(F.col("path")).alias("module"))


@query("""with r as (select p_partkey as id, lower(replace(p_brand, '#', '-')) as name, p_partkey % 4 as k, p_size || '.0' as v from part)
select id, name, case when k = 3 then null else v end as version, k = 0 as pinned from r""")
def requirements_parse(spark, sf_dir):
    """Lines of a requirements file, one for each part: pinned, lower bounds, bare names."""
    from rampart.sources.reports import parse_requirement

    line = F.expr(
        "concat(lower(replace(p_brand, '#', '-')), case p_partkey % 4 when 0 then concat('==', p_size, '.0') when 1 then concat(' >= ', p_size, '.0  # why') when 2 then concat('~=', p_size, '.0') else '' end)"
    )
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *parse_requirement(line))


_BM = """with d as (select doc_id as id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '') as w from documents),
q as (select item_id as query_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')) as word from benchmark),
a as (select query_id, word, count(*) as times from q group by 1, 2),
st as (select count(*) as n, avg(len(w)) as mean from d),
tf as (select id, len, word, count(*) as tf from (select id, len(w) as len, unnest(w) as word from d) where word in (select word from a) group by 1, 2, 3),
df as (select word, count(*) as df from tf group by 1),
sc as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * times), 9) as score
  from tf join df using (word) join a using (word), st group by 1, 2),
sparse as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from sc)
"""


def _sparse(spark, sf_dir, k):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query(_BM + "select query_id, rank, id, score from sparse where rank <= 5")
def bm25_topk(spark, sf_dir):
    """The five best documents of each benchmark item by BM25."""
    return _sparse(spark, sf_dir, 5)


@query(_BM + "select query_id, rank, id, score from sparse where rank <= 5")
def bm25_indexed_topk(spark, sf_dir):
    """The rows of bm25_topk from an inverted index of the words asked for, whose blocks are skipped by their largest gains."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_indexed(inverted.build(docs, inverted.asked(items)), docs, items, 5)


_DENSE = """vq as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0),
cs as (select query_id, vec_id as id, round(list_dot_product(embedding::double[], q::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q::double[], q::double[]))), 9) as score
  from embeddings, vq),
dense as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from cs)
"""


def _vectors(spark, sf_dir):
    """Vectors of documents by number."""
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("with " + _DENSE + "select query_id, rank, id, score from dense where rank <= 5")
def dense_topk(spark, sf_dir):
    """The five best vectors of every vector whose number 50 divides."""
    v = _vectors(spark, sf_dir)
    return retrieval.dense(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5)


_FUSE = _BM.strip() + "," + _DENSE.replace("vec_id % 50 = 0", "vec_id in (select item_id from benchmark)") + """,
fu as (select query_id, id, round(1 / (60 + coalesce(d.rank, 21)) + 1 / (60 + coalesce(s.rank, 21)), 9) as score
  from (select * from dense where rank <= 20) d full join (select * from sparse where rank <= 20) s using (query_id, id)),
fused as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from fu)
"""


def _fused(spark, sf_dir, k):
    """Each benchmark item's text and the vector of its number."""
    v, items = _vectors(spark, sf_dir), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    asked = v.withColumnsRenamed({"id": "query_id", "v": "q"}).join(items, "query_id", "left_semi")
    return retrieval.fuse(retrieval.dense(v, asked, 4 * k), _sparse(spark, sf_dir, 4 * k), k, 4 * k + 1)


@query(_FUSE + "select query_id, rank, id, score from fused where rank <= 5")
def rrf_fusion(spark, sf_dir):
    """Dense and sparse ranks fused."""
    return _fused(spark, sf_dir, 5)


@query(_FUSE + """, keys as (select item_id as query_id, item_id * 37 as key from benchmark),
hit as (select query_id, doc_id as id, cast(1.0 as double) as score from keys join documents on doc_id = key and doc_id % 2 = 0)
select * from hit union all select query_id, id, score from fused where rank <= 5 and query_id not in (select query_id from hit)""")
def exact_or_fallback_lookup(spark, sf_dir):
    """Documents named by a key, else fused results."""
    keys = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 37).alias("key"))
    known = _t(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return retrieval.exact_or_fused(keys, known, _fused(spark, sf_dir, 5))


@query("select coalesce(source, '') as collection, count(*) as n from documents group by 1")
def collection_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("collection")).agg(F.count("*").alias("n"))


_RATED = """with r as (select case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' when '4-NOT SPECIFIED' then 'LOW' else 'INFO' end as truth,
  case when o_totalprice > 400000 then 'CRITICAL' when o_totalprice > 250000 then 'HIGH' when o_totalprice > 150000 then 'MEDIUM' when o_totalprice > 50000 then 'LOW' else 'INFO' end as guess, o_custkey as c from orders)
"""


def _rated(spark, sf_dir):
    p = F.col("o_totalprice")
    guess = F.when(p > 400000, "CRITICAL").when(p > 250000, "HIGH").when(p > 150000, "MEDIUM").when(p > 50000, "LOW").otherwise("INFO")
    rated = project(spark, sf_dir).findings.select("f", F.col("raw_severity").alias("truth"))
    return rated.join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f"), guess.alias("guess")), "f")


@query(_RATED + """, n as (select count(*) as n, count(*) filter (truth = guess) as same from r),
e as (select sum(a * b) as chance from (select truth as k, count(*) as a from r group by 1) join (select guess as k, count(*) as b from r group by 1) using (k))
select n, same / n as agreement, cast(chance as double) / (n * n) as expected, (same / n - cast(chance as double) / (n * n)) / (1 - cast(chance as double) / (n * n)) as kappa from n, e""")
def cohen_kappa(spark, sf_dir):
    """Agreement of two severity ratings beyond chance."""
    return match.kappa(_rated(spark, sf_dir))


@query("""with r as (select quality = 1 as truth, toxic = 0 as guess from labels)
select count(*) filter (truth and guess) as tp, count(*) filter (not truth and guess) as fp, count(*) filter (truth and not guess) as fn, count(*) as n,
  count(*) filter (truth and guess) / count(*) filter (guess) as precision, count(*) filter (truth and guess) / count(*) filter (truth) as recall from r""")
def detection_metrics(spark, sf_dir):
    return match.detection(_t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("guess")))


@query(_RATED + """, i as (select *, list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], truth) as a, list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], guess) as b from r)
select truth, count(*) as n, count(*) filter (a = b) as same, count(*) filter (b < a) as underrated, count(*) filter (b > a) as overrated from i group by 1""")
def severity_compare(spark, sf_dir):
    """By true severity: how often the other rating agrees, is lower, is higher."""
    r = _rated(spark, sf_dir).select("truth", C.severity_index(F.col("truth")).alias("a"), C.severity_index(F.col("guess")).alias("b"))
    return r.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.expr("a = b")).alias("same"), F.count_if(F.expr("b < a")).alias("underrated"), F.count_if(F.expr("b > a")).alias("overrated"))


@query("""with old as (select l_orderkey as src, l_partkey as dst, l_returnflag as kind, max(l_quantity) as v, max(l_linenumber) as o from lineitem where l_linenumber <= 4 group by 1, 2, 3),
new as (select l_orderkey as src, l_partkey as dst, l_returnflag as kind, l_quantity + 1000 as v, l_linenumber as o from lineitem where l_linenumber > 3 qualify row_number() over (partition by l_orderkey, l_partkey, l_returnflag order by l_linenumber desc, l_quantity desc) = 1)
select src, dst, kind, v from new union all select src, dst, kind, v from old where not exists (select 1 from new where new.src = old.src and new.dst = old.dst and new.kind = old.kind)""")
def edge_upsert_by_kind(spark, sf_dir):
    """Edges of two generations, told apart by a property; the last properties win."""
    line = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey as src", "l_partkey as dst", "l_returnflag as kind", "l_quantity as v", "l_linenumber as o")
    old = history.dealt(line.where("o <= 4"), "src", "dst", "kind").groupBy("src", "dst", "kind").agg(F.max("v").alias("v"), F.max("o").alias("o"))
    return history.upsert_edges(old, line.where("o > 3").withColumn("v", F.col("v") + 1000), "o", "kind").select("src", "dst", "kind", "v")


_COMMITS = """with c as (select event_type || '-' || cast(cast(ts as date) as varchar) as commit_sha, event_type as repo, count(*) as n, count(distinct user_id) as users, max(ts) as ts from events group by 1, 2),
k as (select count(*) filter (raw_severity = 'CRITICAL') as critical, count(*) filter (raw_severity = 'HIGH') as high, count(*) filter (raw_severity = 'MEDIUM') as medium, count(*) filter (raw_severity = 'LOW') as low from g_finding where status = 'open')
"""


@query(_SNAP + ", " + _COMMITS.replace("with c as", "c as").strip() + """
select commit_sha, repo, critical, high, medium, low, case when length(commit_sha) % 2 = 0 then n + 1 else n end as chain_count from c, k""")
def snapshots_by_commit(spark, sf_dir):
    """Snapshots with a map of counts by severity; a commit that is analysed again replaces its own."""
    g = project(spark, sf_dir)
    c = snapshots(spark, sf_dir).select("commit_sha", "repo", "score", "chain_count", F.lit(1).alias("ts"), F.lit("NEUTRAL").alias("change"))
    found = g.findings.where("status = 'open'").select(F.col("raw_severity").alias("severity"))
    old = history.snapshot(found, c)
    again = history.snapshot(found, c.where("length(commit_sha) % 2 = 0").withColumns({"ts": F.lit(2), "chain_count": F.col("chain_count") + 1}))
    counts = [F.col("counts")[s].alias(s.lower()) for s in history.COUNTED]
    return history.record(old, again).select("commit_sha", "repo", *counts, "chain_count")


@query("""select repo, newest, oldest, round(newest - oldest, 1) as delta, case when newest is null then 'unknown' when round(newest - oldest, 1) > 2 then 'improving' when round(newest - oldest, 1) < -2 then 'degrading' else 'stable' end as direction
from (select distinct event_type as repo from events union select 'none') left join (select repo, arg_min(score, r) as newest, coalesce(nullif(arg_max(score, r), 0), arg_min(score, r)) as oldest
  from (select event_type as repo, cast(user_id % 3 * 7 as double) as score, row_number() over (partition by event_type order by ts desc, event_id) as r from events qualify r <= 5) group by repo) using (repo)""")
def trend_with_unknown(spark, sf_dir):
    """Trends where an oldest score of 0 counts as missing and repositories without snapshots are unknown."""
    e = _t(spark, sf_dir, "events").selectExpr("event_type as repo", "ts as day", "event_id as commit_sha", "cast(user_id % 3 * 7 as double) as score")
    return history.trend(e, 5, e.select("repo").union(spark.createDataFrame([("none",)], "repo string"))).select("repo", "newest", "oldest", "delta", "direction")


_KNOWN = """with w as (select p_partkey as k, 'CWE-' || p_partkey as id, p_name as name, lower(p_type) as description, p_size as s from part)
"""


def _weaknesses(spark, sf_dir):
    """Weakness entries derived from parts."""
    return _t(spark, sf_dir, "part").selectExpr(
        "concat('CWE-', p_partkey) as id", "p_name as name", "'Base' as abstraction", "'Draft' as status", "if(p_size % 2 = 0, 'High', '') as likelihood", "lower(p_type) as description", "cast(null as string) as extended",
        "array_repeat(concat('Scope: ', p_brand), cast(p_size % 5 as int)) as consequences", "array_repeat(concat('[Design] ', p_brand), cast(p_size % 4 as int)) as mitigations", "array_repeat('7', cast(p_size % 15 as int)) as related",
    )


@query("""select 'CWE-' || p_partkey as id, 'CWE-' || p_partkey || ': ' || p_name || chr(10) || 'Abstraction: Base' || chr(10) || 'Description: ' || lower(p_type)
  || case when p_size % 5 > 0 then chr(10) || 'Consequences: ' || array_to_string(list_transform(range(least(3, cast(p_size % 5 as integer))), lambda x: 'Scope: ' || p_brand), '; ') else '' end
  || case when p_size % 4 > 0 then chr(10) || 'Mitigations: ' || array_to_string(list_transform(range(least(2, cast(p_size % 4 as integer))), lambda x: '[Design] ' || p_brand), '; ') else '' end
  || case when p_size % 2 = 0 then chr(10) || 'Likelihood: High' else '' end as document, array_to_string(list_transform(range(least(10, cast(p_size % 15 as integer))), lambda x: '7'), ',') as related from part""")
def knowledge_documents(spark, sf_dir):
    """Weaknesses as documents: capped lists of consequences and mitigations."""
    d = knowledge.cwe_documents(_weaknesses(spark, sf_dir))
    return d.select("id", "document", F.col("metadata")["related_cwe_ids"].alias("related"))


@query("""with f as (select o_custkey % 500 as cve, lower(replace(o_orderpriority, ' ', '')) as package, o_orderkey from orders)
select 'CVE-' || cve || ':' || package as id, 'CVE-' || cve || ': text' || chr(10) || 'Package: ' || package || chr(10) || 'Severity: HIGH (CVSS: 7.5)' || chr(10) || 'Published: 2024-01-01' as document from f group by cve, package""")
def knowledge_cve_dedupe(spark, sf_dir):
    """Vulnerabilities as documents, one for each package that a feed names."""
    rows = _t(spark, sf_dir, "orders").selectExpr(
        "concat('CVE-', o_custkey % 500) as cve_id", "lower(replace(o_orderpriority, ' ', '')) as package", "'text' as description", "'HIGH' as severity", "cast(7.5 as double) as score", "'2024-01-01' as published", "cast(array() as array<string>) as affected"
    )
    return knowledge.cve_documents(rows).select("id", "document")


@query("""select p_partkey as query_id, 'CWE-' || p_partkey as id, cast(1.0 as double) as score from part where p_partkey % 2 = 0""")
def knowledge_route(spark, sf_dir):
    """Questions that name a weakness are looked up; here all do, with and without the prefix, and half of them are known."""
    docs = knowledge.cwe_documents(_weaknesses(spark, sf_dir)).where("cast(substring(id, 5) as int) % 2 = 0")
    asked = _t(spark, sf_dir, "part").selectExpr("p_partkey as query_id", "if(p_partkey % 3 = 0, concat('cwe', p_partkey), concat(' CWE-', p_partkey)) as text").where("query_id % 2 = 0")
    return knowledge.routed(asked, docs, 5, ("cwe", "nothing"))
