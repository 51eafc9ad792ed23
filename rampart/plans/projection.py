"""The property graph as DataFrames, and its projection from the star-schema tables.

Functions are parts, calls consecutive large lines of an order, endpoints suppliers, stores nations, findings orders,
dependencies brands, snapshots the events of a day.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Graph:
    """One DataFrame for each kind of node and edge."""

    functions: DataFrame  # fn, uid, name, module, tainted, source, start_line, end_line
    calls: DataFrame  # src, dst
    endpoints: DataFrame  # ep, path, is_public, zone_level
    handled_by: DataFrame  # ep, fn
    stores: DataFrame  # ds, name, contains_pii
    access: DataFrame  # fn, ds, access
    findings: DataFrame  # f, type, raw_severity, status, cwe_id, rule_id, title, description
    affects: DataFrame  # f, fn
    uses: DataFrame  # fn, dep
    affects_dep: DataFrame  # f, dep
    services: DataFrame | None = None  # service, name, type, exposure_level
    zones: DataFrame | None = None  # zone, name, level, auth_mechanism
    dependencies: DataFrame | None = None  # dep, name, version, pinned, known_cves
    belongs_to: DataFrame | None = None  # ep, service
    in_zone: DataFrame | None = None  # ep, zone
    memo: dict = field(default_factory=dict, compare=False, repr=False)  # what traversals have written already

    def tables(self) -> dict[str, DataFrame]:
        """The relations that the graph has, by name."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "memo" and getattr(self, f.name) is not None}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder of tables; nothing is read before a plan uses it."""
    part, line, supplier, nation, orders = (_table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier", "nation", "orders"))
    big = line.where("l_quantity >= 35").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = big.alias("a"), big.alias("b")
    calls = (
        a.join(b, F.expr("a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_partkey <> b.l_partkey"))
        .select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))
        .distinct()
    )
    first = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_partkey")
    severity = F.expr(
        "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' when '4-NOT SPECIFIED' then 'LOW' else 'INFO' end"
    )
    status = F.expr("case o_orderstatus when 'O' then 'open' when 'F' then 'resolved' else 'suppressed' end")
    cwe = F.expr("case o_custkey % 5 when 0 then 'CWE-89' when 1 then 'CWE-306' when 2 then 'CWE-918' when 3 then 'CWE-798' else '' end")
    affects = line.groupBy(F.col("l_orderkey").alias("f")).agg(F.min("l_partkey").alias("fn"))
    brands = part.select(F.col("p_partkey").alias("fn"), F.col("p_brand").alias("dep"))
    return Graph(
        functions=part.select(
            F.col("p_partkey").alias("fn"),
            F.concat_ws(":", F.lit("fn"), "p_brand", "p_partkey").alias("uid"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("module"),
            (F.col("p_size") >= 40).alias("tainted"),
            (F.col("p_size") % 2 == 0).alias("source"),
        ),
        calls=calls,
        endpoints=supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("ep"),
            F.concat(F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"),
            (F.col("s_acctbal") >= 0).alias("is_public"),
            (F.col("s_nationkey") % 4).alias("zone_level"),
        ),
        handled_by=line.withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("l_suppkey").alias("ep"), F.col("l_partkey").alias("fn")),
        stores=nation.select(F.col("n_nationkey").alias("ds"), F.col("n_name").alias("name"), F.col("n_regionkey").isin(0, 1).alias("contains_pii")),
        access=line.where("l_quantity >= 49")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_partkey").alias("fn"), F.col("s_nationkey").alias("ds"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("access"))
        .distinct(),
        findings=orders.select(
            F.col("o_orderkey").alias("f"),
            F.when(F.col("o_orderkey") % 10 == 0, "dependency").otherwise("sast").alias("type"),
            severity.alias("raw_severity"),
            status.alias("status"),
            cwe.alias("cwe_id"),
            F.expr("if(o_custkey % 31 = 0, 'py.sql-format', concat('rule-', o_custkey % 9))").alias("rule_id"),
            F.expr("if(o_custkey % 37 = 0, 'SQL built from parts', concat('Finding ', o_orderkey))").alias("title"),
            F.expr("if(o_custkey % 41 = 0, 'Possible SQL injection', '')").alias("description"),
        ),
        affects=affects,
        uses=part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("fn"), F.col("p_brand").alias("dep")),
        affects_dep=affects.where("f % 10 = 0").join(brands, "fn").select("f", "dep"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_sha, repo, ts, score, chain_count: a snapshot for each day and kind of event."""
    events = _table(spark, sf_dir, "events")
    return (
        events.groupBy(F.col("event_type").alias("repo"), F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
        .select(
            F.concat_ws("-", "repo", F.col("day").cast("string")).alias("commit_sha"),
            "repo",
            "day",
            (100 - (F.col("n") * 7 + F.col("users")) % 83).cast("double").alias("score"),
            F.col("n").alias("chain_count"),
        )
    )


#: The same projection in SQL, as the common table expressions of every oracle.
GRAPH_SQL = """
g_function as (select p_partkey as fn, 'fn:' || p_brand || ':' || p_partkey as uid, p_name as name, p_brand as module, p_size >= 40 as tainted, p_size % 2 = 0 as source from part),
g_calls as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_quantity >= 35 and b.l_quantity >= 35 and a.l_partkey <> b.l_partkey),
g_endpoint as (select s_suppkey as ep, '/' || lower(n_name) || '/' || s_suppkey as path, s_acctbal >= 0 as is_public, s_nationkey % 4 as zone_level from supplier join nation on s_nationkey = n_nationkey),
g_handled_by as (select ep, fn from (select l_suppkey as ep, l_partkey as fn, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_partkey) as r from lineitem) where r = 1),
g_datastore as (select n_nationkey as ds, n_name as name, n_regionkey in (0, 1) as contains_pii from nation),
g_access as (select distinct l_partkey as fn, s_nationkey as ds, case when l_returnflag = 'R' then 'write' else 'read' end as access from lineitem join supplier on l_suppkey = s_suppkey where l_quantity >= 49),
g_finding as (select o_orderkey as f, case when o_orderkey % 10 = 0 then 'dependency' else 'sast' end as type,
  case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' when '4-NOT SPECIFIED' then 'LOW' else 'INFO' end as raw_severity,
  case o_orderstatus when 'O' then 'open' when 'F' then 'resolved' else 'suppressed' end as status,
  case o_custkey % 5 when 0 then 'CWE-89' when 1 then 'CWE-306' when 2 then 'CWE-918' when 3 then 'CWE-798' else '' end as cwe_id,
  case when o_custkey % 31 = 0 then 'py.sql-format' else 'rule-' || o_custkey % 9 end as rule_id, case when o_custkey % 37 = 0 then 'SQL built from parts' else 'Finding ' || o_orderkey end as title,
  case when o_custkey % 41 = 0 then 'Possible SQL injection' else '' end as description from orders),
g_affects as (select l_orderkey as f, min(l_partkey) as fn from lineitem group by 1),
g_uses as (select p_partkey as fn, p_brand as dep from part where p_size % 3 = 0),
g_affects_dep as (select f, p_brand as dep from g_affects join part on fn = p_partkey where f % 10 = 0),
g_pii as (select distinct fn, ds, name from g_access join g_datastore using (ds) where contains_pii),
g_reach as (
  with recursive r(ep, fn, depth) as (
    select ep, fn, 0 from g_handled_by union select ep, dst, depth + 1 from r join g_calls on fn = src where depth < 6)
  select ep, fn, min(depth) as depth from r group by ep, fn),
g_snapshot as (select event_type || '-' || day as commit_sha, event_type as repo, day, cast(100 - (n * 7 + users) % 83 as double) as score, n as chain_count
  from (select event_type, cast(ts as date) as day, count(*) as n, count(distinct user_id) as users from events group by 1, 2))
"""
