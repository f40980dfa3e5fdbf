"""Graph traversal over relation tables, level by level.

Edges are (id, source_id, target_id, type, weight, valid_at, invalid_at); direction does not matter for reachability.
Each level is one scan of the edges against a frontier: the frontier is written to the shared folder, so its size is known
and Spark sends a small one to the scans, which then shuffle only what they meet; lineage stays short and a lost executor
costs one level. Seeds are a short list of ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import link_blocks
from graphloom.operators.scans import active
from graphloom.sources.shared import cut

MAX_HOPS = 10
#: Fixed values of personalized PageRank.
ALPHA, ROUNDS, EPSILON = 0.15, 20, 1e-6


#: Seeds of a traversal: a short list of ids, or a table with a column node.
Seeds = Sequence[str] | DataFrame


def seeds_table(spark: SparkSession, seeds: Seeds) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select("node").distinct()
    return spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "node string")


def allowed(edges: DataFrame, types: Sequence[str] = (), at: Column | None = None, min_weight: float | None = None) -> DataFrame:
    """Edges of the types (none: all), valid at a time, of at least a weight."""
    if types:
        edges = edges.filter(F.col("type").isin(list(types)))
    if at is not None:
        edges = edges.filter(active(at))
    if min_weight is not None:
        edges = edges.filter(F.col("weight") >= min_weight)
    return edges


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(src, dst, ...): each edge in both directions, once per relation id if there is one."""
    if "id" in edges.columns:
        edges = edges.dropDuplicates(["id"])
    there = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), *more)
    return there.unionByName(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), *more))


def steps(edges: DataFrame, *more: str) -> DataFrame:
    """(src, dst, ...): each edge in both directions, in one scan and with repetitions."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select(F.inline(F.array(way("source_id", "target_id"), way("target_id", "source_id"))), *more)


def neighbours(edges: DataFrame, seeds: Seeds, hops: int, types: Sequence[str] = (), at: Column | None = None) -> DataFrame:
    """(node, hops): the fewest hops from any seed; seeds are at 0, in the graph or not."""
    links = steps(allowed(edges, types, at))
    frontier = cut(seeds_table(edges.sparkSession, seeds), "frontier")
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, min(hops, MAX_HOPS) + 1):
        met = links.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(reached, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def weighted(edges: DataFrame, seeds: Seeds, hops: int, min_weight: float = 0.0) -> DataFrame:
    """(node, weight): the best product of weights over walks of at most so many edges; seeds have 1, and walks may return."""
    links = steps(allowed(edges, min_weight=min_weight), "weight")
    level = cut(seeds_table(edges.sparkSession, seeds).withColumn("score", F.lit(1.0)), "level")
    found = level
    for _ in range(min(hops, MAX_HOPS)):
        level = cut(links.join(level.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight")).alias("score")), "level")
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.max("score").alias("weight"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The graph with more edges; one whose id is there already changes nothing, and of several new ones with an id the first by its ends is added."""
    order = F.struct("source_id", "target_id", "type")
    columns = [c for c in edges.columns if c != "id"]
    fresh = more.groupBy("id").agg(*[F.min_by(F.col(c), order).alias(c) for c in columns]).join(edges, "id", "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the edges that gone names by id."""
    return edges.join(gone.select("id"), "id", "left_anti").select(*edges.columns)


def has_entities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, held): whether any edge ends at a node."""
    met = steps(edges).join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node"), F.lit(True).alias("held")).distinct()
    return nodes.select("node").distinct().join(met, "node", "left").fillna(False, ["held"])


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at either end; a loop counts twice, parallel edges each."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def counts(edges: DataFrame) -> DataFrame:
    """(nodes, edges) of a graph, as one row."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node"), "id").agg(F.count_distinct("node").alias("nodes"), F.count_distinct("id").alias("edges"))


def pagerank(edges: DataFrame, seeds: Seeds, alpha: float = ALPHA, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """(node, rank) by personalized PageRank: undirected, without weights, from 1/n each.

    It stops after the first round in which no rank changes by epsilon. Links are written once, as blocks of numbers; a round
    moves ranks and sums, never links, and the links of a node lie in many blocks. Seeds outside the graph keep their share
    of the jump to themselves. No seeds give no rows.
    """
    spark = edges.sparkSession
    wanted = [r["node"] for r in seeds_table(spark, seeds).collect()]
    if not wanted:
        return spark.createDataFrame([], "node string, rank double")
    return link_blocks.pagerank(edges, [s for s in wanted if s is not None], len(wanted), alpha, rounds, epsilon)


def subgraph(edges: DataFrame, seeds: Seeds, hops: int, types: Sequence[str] = (), at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hops) within reach, and the allowed edges between them, once per relation."""
    nodes = neighbours(edges, seeds, hops, types, at)
    held = allowed(edges, types, at)
    for end in ("source_id", "target_id"):
        held = held.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return nodes, held.dropDuplicates(["id"]).select(*edges.columns)


def hydrate(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with name, type and summary; nodes without an entity stay, with blank fields."""
    about = entities.select(F.col("id").alias("node"), "name", "type", "summary")
    return nodes.join(about, "node", "left").fillna("", ["name", "type", "summary"])


def summarize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(text): one row that describes a hydrated subgraph for a reader. The subgraph is as small as a text should be."""
    names = nodes.select(F.col("node").alias("target_id"), F.col("name").alias("target_name"))
    since = F.when(F.col("valid_at").isNotNull(), F.concat(F.lit(", since "), F.date_format("valid_at", "yyyy-MM-dd"))).otherwise(F.lit(""))
    target = F.when(F.coalesce("target_name", F.lit("")) == "", F.col("target_id")).otherwise(F.col("target_name"))
    line = F.concat(F.lit("  - "), F.col("type"), F.lit(" "), target, F.lit(" [weight: "), F.format_string("%.2f", "weight"), since, F.lit("]\n"))
    lines = edges.join(names, "target_id", "left").select(F.col("source_id").alias("node"), F.struct((-F.col("weight")).alias("w"), F.col("id").alias("i"), line.alias("line")).alias("l"))
    lines = lines.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "").alias("lines"))
    far = F.when(F.col("hops") == 0, "seed").when(F.col("hops") == 1, "1 hop").otherwise(F.concat(F.col("hops").cast("string"), F.lit(" hops")))
    head = F.concat(F.lit("\n"), F.col("name"), F.lit(" ("), F.col("type"), F.lit(", "), far, F.lit(")"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), F.col("summary"))).otherwise(F.lit("")), F.lit("\n"))
    blocks = nodes.join(lines, "node", "left").select(F.struct("hops", "name", "node", F.concat(head, F.coalesce("lines", F.lit(""))).alias("block")).alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "")
    return blocks.agg(F.when(F.count("*") == 0, "No graph context available.").otherwise(F.concat(F.lit("Context from knowledge graph:\n"), text)).alias("text"))


def expand_communities(communities: DataFrame, seeds: Seeds) -> DataFrame:
    """(node): seeds, and the members of communities that hold one, in one pass from the oldest community: members that an earlier one added count for later ones, not for those before it.

    A community is met if it holds a seed, or a member of an older one that is met; rounds of joins find them all.
    """
    start = seeds_table(communities.sparkSession, seeds)
    # Age and id together order communities; the order is compared as a struct, so no rows are numbered in one task.
    members = cut(communities.select(F.struct("created_at", "id").alias("age"), F.explode("member_ids").alias("node")), "members")
    reached = cut(members.join(start, "node", "left_semi").select("age").distinct(), "met")
    while True:
        oldest = members.join(reached, "age").groupBy("node").agg(F.min("age").alias("since"))
        more = members.join(oldest, "node").filter(F.col("age") > F.col("since")).select("age").distinct().join(reached, "age", "left_anti")
        more = cut(more, "met")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
    return start.unionByName(members.join(reached, "age").select("node")).distinct()


def channel(edges: DataFrame, seeds: Seeds, scorer: str = "bfs", hops: int = 2, types: Sequence[str] = (), at: Column | None = None, min_weight: float = 0.0, compose: bool = False) -> DataFrame:
    """(node, score) by a scorer, without the seeds.

    Unless told to compose them, a time leaves the types out, PageRank looks at neither nor at hops, and weights only at
    min_weight.
    """
    spark = edges.sparkSession
    if compose:
        edges, types, at = allowed(edges, types, at, min_weight if scorer == "weighted" else None), (), None
    if scorer == "pagerank":
        scored = pagerank(edges, seeds).select("node", F.col("rank").alias("score"))
    elif scorer == "weighted":
        scored = weighted(edges, seeds, hops, min_weight).select("node", F.col("weight").alias("score"))
    elif scorer == "bfs":
        near = neighbours(edges, seeds, hops, () if at is not None else types, at)
        scored = near.filter("hops > 0").select("node", F.try_divide(F.lit(1.0), F.col("hops")).alias("score"))
    else:
        raise ValueError(f"no scorer {scorer!r}")
    return scored.join(seeds_table(spark, seeds), "node", "left_anti")
