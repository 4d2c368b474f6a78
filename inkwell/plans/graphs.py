"""Queries on roles and their graph; suppliers stand for roles and orders for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import graph as G
from inkwell.registry import query, table

MENTIONS = "mentions AS (SELECT l_orderkey AS document_id, l_suppkey AS role_id, count(*) AS mention_count FROM lineitem GROUP BY ALL)"
MENTIONS_A_TASK = 250_000
EDGES = "edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt by document in parts of about MENTIONS_A_TASK lines, so what one task counts does not grow with the table."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("role_id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // MENTIONS_A_TASK))
    return lines.repartition(parts, "document_id").groupBy("document_id", "role_id").agg(F.count("*").alias("mention_count"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, sf, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).unionByName(table(spark, sf, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")))


@query("g1_role_hierarchy", f"WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT parent AS node, 0 AS depth, parent AS root FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, w.depth + 1, w.root FROM w JOIN edges e ON e.parent = w.node) SELECT node, min(depth) AS depth, min(root) AS root FROM w GROUP BY node")
def role_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return G.role_hierarchy(edges(spark, sf))


@query("g2_consolidation_groups", "WITH RECURSIVE e AS (SELECT c_custkey AS a, -1 - (c_nationkey * 10 + length(c_mktsegment))::BIGINT AS b FROM customer), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, r.root FROM r JOIN n ON n.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) < node")
def consolidation_groups(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.lit(-1) - (F.col("c_nationkey") * 10 + F.length("c_mktsegment"))).cast("long").alias("b"))
    return G.components(pairs)


@query("g6_network_stats", f"WITH {EDGES}, n AS (SELECT child AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT parent, 0, 1 FROM edges) SELECT node, sum(o)::BIGINT AS out, sum(i)::BIGINT AS into, count(*) AS degree FROM n GROUP BY node".replace("AS into", 'AS "into"'))
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.network_stats(edges(spark, sf))


@query("j19_cooccurrence", f"WITH {MENTIONS} SELECT a.role_id AS a, b.role_id AS b, count(*) AS documents FROM mentions a JOIN mentions b ON a.document_id = b.document_id AND a.role_id < b.role_id GROUP BY ALL HAVING count(*) >= 2 ORDER BY documents DESC, a, b LIMIT 50")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return G.cooccurrence(mentions(spark, sf), 2, 50)


@query("a40_role_aggregate", f"WITH {MENTIONS} SELECT role_id, count(DISTINCT document_id) AS documents, sum(mention_count)::BIGINT AS mentions FROM mentions GROUP BY 1")
def role_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return G.role_aggregate(mentions(spark, sf))


@query("k3_top_roles", f"WITH {MENTIONS} SELECT role_id, count(DISTINCT document_id) AS documents, sum(mention_count)::BIGINT AS mentions FROM mentions GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15")
def top_roles(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_roles(mentions(spark, sf))


@query("k4_graph_nodes", f"WITH {MENTIONS}, d AS (SELECT document_id FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50), r AS (SELECT role_id FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) SELECT document_id, role_id, mention_count AS weight FROM mentions WHERE document_id IN (SELECT document_id FROM d) AND role_id IN (SELECT role_id FROM r)")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_nodes(mentions(spark, sf), 100, 1)


@query("a42_role_document_matrix", 'SELECT l_returnflag AS document_class, sum(1) FILTER (l_suppkey = 1)::BIGINT AS "1", sum(1) FILTER (l_suppkey = 2)::BIGINT AS "2", sum(1) FILTER (l_suppkey = 3)::BIGINT AS "3" FROM lineitem GROUP BY 1')
def role_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return G.role_matrix(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("document_class"), F.col("l_suppkey").alias("role_id"), F.lit(1).alias("mention_count")), [1, 2, 3])


ROLES = f"{MENTIONS}, agg AS (SELECT role_id, count(DISTINCT document_id) AS documents, sum(mention_count) AS mentions FROM mentions GROUP BY 1)"


@query("j22_auto_adjudicate", f"WITH {ROLES} SELECT role_id, CASE WHEN role_id % 4 = 0 THEN 0.99 ELSE least(0.99, round(0.85::DOUBLE + CASE WHEN documents >= 3 THEN 0.10 ELSE 0 END + CASE WHEN mentions >= 5 THEN 0.05 ELSE 0 END + CASE WHEN role_id % 3 >= 2 THEN 0.05 ELSE 0 END, 2)) END AS confidence FROM agg")
def auto_adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    roles = G.role_aggregate(mentions(spark, sf)).withColumn("responsibilities", F.col("role_id") % 3)
    return G.auto_adjudicate(roles, roles.where("role_id % 4 = 0"))


@query("a43_adjudication_summary", "SELECT c_mktsegment AS category, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'confirmed' END AS status, count(*) AS roles, count(*) FILTER (c_acctbal > 0) AS active FROM customer GROUP BY GROUPING SETS ((category), (status), ())")
def adjudication_summary(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("confirmed").alias("status"), (F.col("c_acctbal") > 0).alias("active"))
    return G.adjudication_summary(roles)


@query("a45_function_coverage", "SELECT n_name AS code, count(s_suppkey) AS tags FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def function_coverage(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    tags = table(spark, sf, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("code"))
    return G.function_coverage(nation.select(F.col("n_name").alias("code")), tags)


@query("a74_wbs_rollup", "SELECT r_name AS level1, n_name AS level2, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def wbs_rollup(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("level1"), F.col("n_name").alias("level2"))
    leaves = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("level2"))
    return G.rollup_counts(tree, leaves)


@query("j24_function_report", "SELECT n_name AS code, count(DISTINCT s_suppkey) AS roles, count(DISTINCT l_orderkey) AS documents FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def function_report(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    joined = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(m, F.col("role_id") == F.col("s_suppkey"), "left")
    return joined.groupBy(F.col("n_name").alias("code")).agg(F.countDistinct("s_suppkey").alias("roles"), F.countDistinct("document_id").alias("documents"))


@query("u2_merge_roles", f"WITH {MENTIONS}, c AS (SELECT document_id, CASE WHEN role_id % 5 = 1 THEN role_id - 1 ELSE role_id END AS role_id, mention_count FROM mentions) SELECT role_id, count(*) AS documents, sum(n)::BIGINT AS mentions FROM (SELECT document_id, role_id, sum(mention_count) AS n FROM c GROUP BY ALL) GROUP BY 1")
def merge_roles(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf)
    aliases = table(spark, sf, "supplier").where("s_suppkey % 5 = 1").select(F.col("s_suppkey").alias("role_id"), (F.col("s_suppkey") - 1).alias("canonical"))
    merged = G.merge_roles(m.where("document_id % 2 = 0"), m.where("document_id % 2 = 1"), aliases)
    return merged.groupBy("role_id").agg(F.count("*").alias("documents"), F.sum("mention_count").alias("mentions"))


@query("w16_proposal_ids", "WITH b AS (SELECT c_custkey AS proposal_id, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) > 1 THEN c_mktsegment || ' - ' || c_nationkey ELSE c_mktsegment END AS base FROM customer) SELECT proposal_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 AND row_number() OVER o > 1 THEN base || ' (' || row_number() OVER o || ')' ELSE base END AS name FROM b WINDOW o AS (PARTITION BY base ORDER BY proposal_id)")
def proposal_ids(spark: SparkSession, sf: str) -> DataFrame:
    return G.proposal_names(table(spark, sf, "customer").select(F.col("c_custkey").alias("proposal_id"), F.col("c_mktsegment").alias("company"), F.col("c_nationkey").cast("string").alias("term")))
