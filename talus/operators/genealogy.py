"""File genealogy: links between files by ideas, time and names, and the families that they join.

timelines has file, first, last, events (one row a file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G

GAP = 5
TRANSITIONS = ("evolved", "pivoted", "split", "merged", "concretized")


def timelines(events: DataFrame, file: str = "file", at: str = "idx") -> DataFrame:
    return events.groupBy(F.col(file).alias("file")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))


def idea_links(edges: DataFrame, node_files: DataFrame, kinds: tuple[str, ...] = TRANSITIONS) -> DataFrame:
    """Files of nodes that an edge of one of the kinds joins: from_file, to_file, source."""
    a = node_files.select("graph", F.col("id").alias("src"), F.col("file").alias("from_file"))
    b = node_files.select("graph", F.col("id").alias("dst"), F.col("file").alias("to_file"))
    return edges.where(F.col("type").isin(*kinds)).join(a, ["graph", "src"]).join(b, ["graph", "dst"]).where("from_file <> to_file").select("from_file", "to_file", F.lit("idea_graph").alias("source")).distinct()


def temporal_links(lines: DataFrame, gap: int = GAP) -> DataFrame:
    """Pairs a < b of which one starts 1 to gap positions after the other's last: an equi-join on each such position."""
    ends = lines.select(F.col("file").alias("x"), "last", F.explode(F.sequence(F.col("last") + 1, F.col("last") + gap)).alias("at"))
    begins = lines.select(F.col("file").alias("y"), F.col("first").alias("at"))
    met = ends.join(begins, "at").where("x <> y").select("x", "y", (F.col("at") - F.col("last")).alias("gap"))
    return met.groupBy(F.least("x", "y").alias("from_file"), F.greatest("x", "y").alias("to_file")).agg(F.min("gap").alias("gap")).withColumn("source", F.lit("temporal"))


def name_links(lines: DataFrame) -> DataFrame:
    """Pairs that share a run of two or more name parts, with the longest (of equal length the last in order)."""
    names = lines.select("file", F.explode(T.stems(F.col("file"))).alias("stem"))
    a, b = names.withColumnRenamed("file", "from_file"), names.withColumnRenamed("file", "to_file")
    return a.join(b, "stem").where("from_file < to_file").groupBy("from_file", "to_file").agg(F.max(F.struct(F.length("stem").alias("n"), "stem")).alias("s")).select("from_file", "to_file", F.col("s.stem").alias("shared_stem"), F.lit("name").alias("source"))


def _base(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def merges(links: DataFrame) -> DataFrame:
    """Pairs that make a family: joined by ideas, or by time and name, or by names of which one holds the other."""
    pair = links.groupBy(F.least("from_file", "to_file").alias("src"), F.greatest("from_file", "to_file").alias("dst")).agg(F.collect_set("source").alias("sources"))
    has = lambda k: F.array_contains("sources", k)
    inside = _base(F.col("dst")).contains(_base(F.col("src"))) | _base(F.col("src")).contains(_base(F.col("dst")))
    return pair.where(has("idea_graph") | (has("temporal") & has("name")) | (has("name") & inside)).select(F.lit(0).alias("graph"), "src", "dst")


def families(links: DataFrame, lines: DataFrame) -> DataFrame:
    """family (least file), file, rank by first touch, status (current: last touched), size; files alone have size 1."""
    nodes = lines.select(F.lit(0).alias("graph"), F.col("file").alias("id"))
    part = G.components(nodes, merges(links)).select(F.col("id").alias("file"), F.col("component").alias("family"))
    out = lines.join(part, "file")
    own = W.partitionBy("family")
    latest = F.max(F.struct("last", "file")).over(own)
    return out.select("family", "file", "first", "last", "events", F.row_number().over(own.orderBy("first", "file")).alias("rank"), F.when(latest["file"] == F.col("file"), "current").otherwise("superseded").alias("status"), F.count("*").over(own).alias("size"))


def all_links(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("from_file", "to_file", "source")
    for p in parts[1:]:
        out = out.unionByName(p.select("from_file", "to_file", "source"))
    return out
