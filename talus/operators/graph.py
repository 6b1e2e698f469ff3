"""Graphs as tables: nodes (graph, id), edges (graph, src, dst). graph may be one constant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def degree(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    """in_degree, out_degree and degree of each node."""
    ends = edges.select(by, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(by, F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    total = ends.groupBy(by, "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = nodes.select(by, "id").distinct().join(total, [by, "id"], "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def density(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    """nodes, edges and edges over n (n - 1), to 4 places."""
    n, e = nodes.groupBy(by).agg(F.countDistinct("id").alias("nodes")), edges.groupBy(by).agg(F.count("*").alias("edges"))
    out = n.join(e, by, "left").na.fill(0, ["edges"])
    return out.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)).otherwise(0.0))


def components(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    """component (least id of the connected part, directions aside) of each node: least labels spread along the edges,
    two hops a round, until none changes."""
    both = cut(edges.select(by, "src", "dst").unionByName(edges.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = cut(nodes.select(by, "id").distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "dst"), [by, "dst"]).groupBy(by, F.col("src").alias("id")).agg(F.min("component").alias("near"))
        new = label.join(near, [by, "id"], "left").withColumn("component_new", F.least("component", F.coalesce("near", "component")))
        # and on to the label of the label
        hop = label.select(by, F.col("id").alias("component_new"), F.col("component").alias("hop"))
        new = cut(new.join(hop, [by, "component_new"], "left").select(by, "id", F.least("component_new", F.coalesce("hop", "component_new")).alias("component"), F.col("component").alias("old")))
        changed = not new.where("component <> old").isEmpty()
        label = new.drop("old")
        if not changed:
            return label


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, by: str = "graph") -> DataFrame:
    """rank of each node after a fixed number of rounds; parallel edges count, what dangling nodes have is spread.

    A round reads the ranks twice, so each ends the lineage: plans would double otherwise.
    """
    known = nodes.select(by, "id").distinct()
    e = edges.join(known.withColumnRenamed("id", "src"), [by, "src"], "left_semi").join(known.withColumnRenamed("id", "dst"), [by, "dst"], "left_semi")
    e = e.groupBy(by, "src", "dst").agg(F.count("*").alias("k"))
    out = e.groupBy(by, "src").agg(F.sum("k").alias("all"))
    e = cut(e.join(out, [by, "src"]).select(by, "src", "dst", (F.col("k") / F.col("all")).alias("share")))
    size = known.groupBy(by).agg(F.count("*").alias("n"))
    base = cut(known.join(size, by).join(out.select(by, F.col("src").alias("id"), F.lit(1).alias("links")), [by, "id"], "left"))
    rank = cut(base.withColumn("rank", 1.0 / F.col("n")))
    for _ in range(rounds):
        came = e.join(rank.select(by, F.col("id").alias("src"), "rank"), [by, "src"]).groupBy(by, F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("came"))
        lost = rank.where("links is null").groupBy(by).agg(F.sum("rank").alias("lost"))
        rank = base.join(came, [by, "id"], "left").join(lost, by, "left")
        rank = cut(rank.select(by, "id", "n", "links", ((1 - damping) / F.col("n") + damping * (F.coalesce("came", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("rank")))
    return rank.select(by, "id", F.round("rank", 6).alias("rank"))


def small_pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, by: str = "graph") -> DataFrame:
    """The same where every graph fits a task (idea graphs have tens of nodes): one task a graph, no shuffle a round."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(left["id"]))
        if not ids:
            return pd.DataFrame({by: [], "id": [], "rank": []})
        at = {x: k for k, x in enumerate(ids)}
        keep = right[right.src.isin(at) & right.dst.isin(at)]
        src, dst = keep.src.map(at).to_numpy(int), keep.dst.map(at).to_numpy(int)
        n = len(ids)
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1 / n)
        for _ in range(rounds):
            new = np.bincount(dst, rank[src] / out[src], minlength=n)
            rank = (1 - damping) / n + damping * (new + rank[out == 0].sum() / n)
        return pd.DataFrame({by: left[by].iloc[0], "id": ids, "rank": rank.round(6)})

    kinds = dict(nodes.dtypes)
    return nodes.select(by, "id").groupBy(by).cogroup(edges.select(by, "src", "dst").groupBy(by)).applyInPandas(run, f"{by} {kinds[by]}, id {kinds['id']}, rank double")


def small_betweenness(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> DataFrame:
    """Betweenness (directed, unweighted, over (n - 1)(n - 2)) of each node; one task a graph."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(left["id"]))
        if not ids:
            return pd.DataFrame({by: [], "id": [], "betweenness": []})
        at = {x: k for k, x in enumerate(ids)}
        n = len(ids)
        near: list[set[int]] = [set() for _ in ids]
        for s, d in zip(right.src, right.dst, strict=True):
            if s in at and d in at and s != d:
                near[at[s]].add(at[d])
        total = np.zeros(n)
        for source in range(n):
            far, paths, order = {source: 0}, np.zeros(n), [source]
            paths[source] = 1
            for v in order:
                for w in near[v]:
                    if w not in far:
                        far[w] = far[v] + 1
                        order.append(w)
                    if far[w] == far[v] + 1:
                        paths[w] += paths[v]
            gain = np.zeros(n)
            for v in reversed(order):
                for w in near[v]:
                    if far.get(w) == far[v] + 1:
                        gain[v] += paths[v] / paths[w] * (1 + gain[w])
                if v != source:
                    total[v] += gain[v]
        scale = (n - 1) * (n - 2)
        return pd.DataFrame({by: left[by].iloc[0], "id": ids, "betweenness": (total / scale if scale > 0 else total).round(6)})

    kinds = dict(nodes.dtypes)
    return nodes.select(by, "id").groupBy(by).cogroup(edges.select(by, "src", "dst").groupBy(by)).applyInPandas(run, f"{by} {kinds[by]}, id {kinds['id']}, betweenness double")


def succession(nodes: DataFrame, by: str, order: list[str], node_id: str = "id") -> DataFrame:
    """An edge from each node to the next in order: src, dst."""
    return nodes.withColumn("src", F.lag(node_id).over(W.partitionBy(by).orderBy(*order))).where("src is not null").select(F.col(by).alias("graph"), "src", F.col(node_id).alias("dst"), F.lit("evolved").alias("type"))


def idea_graph(entries: DataFrame, observations: DataFrame | None = None, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from thread entries of over least characters, in order of category and message, and dense observations."""
    nodes = entries.where(F.length("content") > least).select(F.col("session_id").alias("graph"), F.concat_ws("_", F.lit("idea"), "category", F.col("msg_index").cast("string")).alias("id"), F.substring("content", 1, 80).alias("label"), F.col("content").alias("description"), F.col("msg_index").alias("message_index"), F.when(F.col("significance") == "high", "stable").otherwise("working").alias("confidence"), F.col("category").alias("source"))
    edges = succession(nodes, "graph", ["source", "message_index"])
    if observations is not None:
        dense = observations.where("density in ('high', 'very_high') and significance is not null")
        more = dense.select(F.col("session_id").alias("graph"), F.concat(F.lit("idea_geo_"), F.col("lo").cast("string")).alias("id"), F.substring("type", 1, 80).alias("label"), F.col("significance").alias("description"), F.col("lo").alias("message_index"), F.lit("working").alias("confidence"), F.lit("geology").alias("source"))
        nodes = nodes.unionByName(more.dropDuplicates(["graph", "id"]))
    return nodes, edges


def chain(edges: DataFrame, start: DataFrame, steps: int = 20, by: str = "graph") -> DataFrame:
    """graph, step, id: from each start node the first edge (least dst) forward, and the first back, at most steps each way."""
    first = lambda a, b: edges.groupBy(by, F.col(a).alias("id")).agg(F.min(b).alias("next"))
    out = start.select(by, F.col("id").alias("start"), "id", F.lit(0).alias("step"))
    for sign, links in ((1, cut(first("src", "dst"))), (-1, cut(first("dst", "src")))):
        now = start.select(by, F.col("id").alias("start"), "id", F.array("id").alias("seen"))
        for k in range(1, steps + 1):
            now = now.join(links, [by, "id"]).where(~F.array_contains("seen", F.col("next"))).select(by, "start", F.col("next").alias("id"), F.array_append("seen", F.col("next")).alias("seen"))
            if k % 5 == 0:
                now = cut(now)
            if k % 5 == 0 and now.isEmpty():
                break
            out = out.unionByName(now.select(by, "start", "id", F.lit(sign * k).alias("step")))
    return out


def combine(nodes: DataFrame, edges: DataFrame, by: str = "graph") -> tuple[DataFrame, DataFrame]:
    """All graphs as one, ids prefixed with their graph's."""
    own = lambda c: F.concat_ws("_", F.col(by).cast("string"), F.col(c).cast("string"))
    return nodes.withColumn("id", own("id")).withColumn(by, F.lit("all")), edges.withColumns({"src": own("src"), "dst": own("dst")}).withColumn(by, F.lit("all"))
