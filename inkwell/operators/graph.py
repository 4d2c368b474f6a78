"""Role graphs: hierarchies, components, co-occurrence, role statistics and network figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def role_hierarchy(edges: DataFrame) -> DataFrame:
    """(node, depth, root) of child-parent edges; roots are parents that are nobody's child, at depth 0.

    One join a level, over the frontier alone: nodes not reached before, or from a lesser root; it runs empty on circles
    too, and those without a root are not reached. A node that is reached by several ways keeps its least depth and its
    least root.
    """
    roots = edges.select(F.col("parent").alias("node")).join(edges.select(F.col("child").alias("node")), "node", "left_anti").distinct()
    out = level = roots.select("node", F.lit(0).alias("depth"), F.col("node").alias("root")).checkpoint()
    while level.limit(1).count():
        found = edges.join(level, edges["parent"] == level["node"]).groupBy(F.col("child").alias("node")).agg(F.min(F.col("depth") + 1).alias("depth"), F.min("root").alias("root"))
        known = out.select("node", F.col("depth").alias("was"), F.col("root").alias("was_root"))
        new = found.join(known, "node", "left").where("was_root is null or root < was_root")
        level = new.select("node", F.least("depth", "was").alias("depth"), "root").checkpoint()
        out = out.join(level.select("node"), "node", "left_anti").unionByName(level).checkpoint()
    return out


#: A key with more than one in so many rows of a join is joined by broadcast.
HUBS = 1_000


def with_hubs(many: DataFrame, one: DataFrame, key: list[str], count_col: str, total: int, how: str = "inner") -> DataFrame:
    """many joined to one, which has a row a key with the number of rows of `many` that have it; no key fills a task.

    At most HUBS keys can have over a HUBS-th of the `total` rows each, which bounds the broadcast; the others are
    joined as usual. In a left join, rows with a null key stay where they are.
    """
    hub = F.col(count_col) * HUBS > total
    hubs, rest = F.broadcast(one.where(hub)), one.where(~hub)
    others = many.join(hubs.select(*key), key, "left_anti")
    no_key = F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))
    out = many.join(hubs, key).unionByName(others.where(~no_key).join(rest, key, how))
    return out if how == "inner" else out.unionByName(others.where(no_key), allowMissingColumns=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node that has an edge. Edges: a, b (of one ordered type).

    Large-star and small-star steps in turn, until the edges are stars: no centre is another's leaf, no leaf has two
    centres. Each step is an aggregation and a join in which hubs are broadcast; no list of neighbours is ever held, and
    every turn's edges are checkpointed in the shared folder.
    """
    both_ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    while True:
        leaves = edges.groupBy(F.col("a").alias("b")).count()
        inner = edges.select("b").distinct().join(leaves.select("b"), "b", "left_semi")
        if not inner.limit(1).count() and not leaves.where("count > 1").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both, total = edges.select(F.inline(both_ways)), 2 * edges.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = with_hubs(both.where("v > u"), least, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("b")).where("u <> b").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_hubs(large, least, ["u"], "n", total)
        edges = small.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct().checkpoint()


def cooccurrence(mentions: DataFrame, least: int, top: int) -> DataFrame:
    """(a, b, documents): roles that share documents, by how many; mentions: (document_id, role_id)."""
    m = mentions.select("document_id", "role_id").distinct()
    a, b = m.withColumnRenamed("role_id", "a"), m.withColumnRenamed("role_id", "b")
    n = a.join(b, "document_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("documents"))
    return n.where(F.col("documents") >= least).orderBy(F.desc("documents"), "a", "b").limit(top)


def role_aggregate(mentions: DataFrame) -> DataFrame:
    """(role_id, documents, mentions); mentions: (document_id, role_id, mention_count)."""
    return mentions.groupBy("role_id").agg(F.countDistinct("document_id").alias("documents"), F.sum("mention_count").alias("mentions"))


def top_roles(mentions: DataFrame, n: int = 15) -> DataFrame:
    return role_aggregate(mentions).orderBy(F.desc("documents"), F.desc("mentions"), "role_id").limit(n)


def role_matrix(mentions: DataFrame, roles: list[int]) -> DataFrame:
    """One row a document class, one column a given role: mention counts."""
    return mentions.groupBy("document_class").pivot("role_id", roles).agg(F.sum("mention_count"))


def graph_nodes(mentions: DataFrame, most_nodes: int, least_weight: int) -> DataFrame:
    """(document_id, role_id, weight) among the documents with most roles and the roles with most documents."""
    half = most_nodes // 2
    per = mentions.groupBy("document_id", "role_id").agg(F.sum("mention_count").alias("weight"))
    docs = per.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(half)
    roles = per.groupBy("role_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role_id").limit(half)
    return per.where(F.col("weight") >= least_weight).join(docs.select("document_id"), "document_id", "left_semi").join(roles.select("role_id"), "role_id", "left_semi")


def network_stats(edges: DataFrame) -> DataFrame:
    """(node, out, into, degree) of directed edges (child, parent)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("child").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("parent").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("into"), F.count("*").alias("degree"))


def auto_adjudicate(roles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(role_id, confidence): .99 for known roles, else .85 and more for spread, mentions and responsibilities, .99 at most."""
    known = dictionary.select("role_id", F.lit(True).alias("known")).distinct()
    extra = F.when(F.col("documents") >= 3, 0.10).otherwise(0.0) + F.when(F.col("mentions") >= 5, 0.05).otherwise(0.0) + F.when(F.col("responsibilities") >= 2, 0.05).otherwise(0.0)
    return roles.join(known, "role_id", "left").select("role_id", F.when(F.col("known"), F.lit(0.99)).otherwise(F.least(F.lit(0.99), F.round(F.lit(0.85) + extra, 2))).alias("confidence"))


def function_coverage(codes: DataFrame, tags: DataFrame) -> DataFrame:
    """(code, tags) of every code, zeros kept."""
    n = tags.groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("tags"))


def adjudication_summary(roles: DataFrame) -> DataFrame:
    """Counts by category, by status, and of all, in one pass; nulls stand for all."""
    return roles.groupingSets([["category"], ["status"], []], "category", "status").agg(F.count("*").alias("roles"), F.count_if(F.col("active")).alias("active"))


def rollup_counts(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level1, level2, n) with subtotals of leaves under a two-level tree; nulls stand for all."""
    return leaves.join(F.broadcast(tree), "level2").rollup("level1", "level2").agg(F.count("*").alias("n"))


def merge_roles(a: DataFrame, b: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of both sides under the canonical role, added up; aliases: (role_id, canonical)."""
    both = a.unionByName(b).join(aliases, "role_id", "left").withColumn("role_id", F.coalesce("canonical", "role_id"))
    return both.groupBy("document_id", "role_id").agg(F.sum("mention_count").alias("mention_count"))


def proposal_names(proposals: DataFrame) -> DataFrame:
    """(proposal_id, name): the company's name; shared ones get the term, and a number if they still collide."""
    shared = F.count("*").over(Window.partitionBy("company")) > 1
    first = proposals.withColumn("base", F.when(shared, F.concat_ws(" - ", "company", "term")).otherwise(F.col("company")))
    w = Window.partitionBy("base")
    n = F.row_number().over(w.orderBy("proposal_id"))
    return first.withColumn("name", F.when((F.count("*").over(w) > 1) & (n > 1), F.concat(F.col("base"), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("base"))).select("proposal_id", "name")
