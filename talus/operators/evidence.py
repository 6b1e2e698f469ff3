"""Evidence of a file inside a session: where it is mentioned, and what stands around the mentions.

Tables: entries (threads.entries), tags (tags.tag), observations (session_id, zoom, lo, hi, observation), nodes and
edges (graph.idea_graph), files (session_id, file).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import relational as R

WINDOW = 10


def targets(*tables: DataFrame) -> DataFrame:
    """session_id, file of all tables, once each."""
    return reduce(lambda a, b: a.unionByName(b), [t.select("session_id", "file") for t in tables]).distinct()


def mentions(files: DataFrame, entries: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """session_id, file, idx of every entry, and every position of an observation's range, that names the file."""
    named = files.join(entries, "session_id").where(R.mentions_file(F.col("content"), F.col("file"))).select("session_id", "file", F.col("msg_index").alias("idx"))
    if observations is not None:
        ranged = files.join(observations, "session_id").where(R.mentions_file(F.col("observation"), F.col("file")) & F.col("lo").isNotNull())
        named = named.unionByName(ranged.select("session_id", "file", F.explode(F.sequence("lo", "hi")).alias("idx")))
    return named.distinct()


def emotional_arc(found: DataFrame, tags: DataFrame, width: int = WINDOW) -> DataFrame:
    """Tags within width of a mention, whether at one, and what changed since the file's tag before."""
    near = R.window_indices(found, ["session_id", "file"], "idx", width).join(tags, ["session_id", "idx"])
    near = near.join(found.withColumn("is_direct_mention", F.lit(True)), ["session_id", "file", "idx"], "left").na.fill(False, ["is_direct_mention"])
    order = W.partitionBy("session_id", "file").orderBy("idx")
    changed = lambda c: F.coalesce(F.lag(c).over(order) != F.col(c), F.lit(False))
    return near.withColumns({"emotion_changed": changed("emotional_tenor"), "confidence_changed": changed("confidence_signal")})


def geology(found: DataFrame, observations: DataFrame, width: int = WINDOW) -> DataFrame:
    """Observations whose range meets a window around a mention (range) or that name the file (text)."""
    spots = R.window_indices(found, ["session_id", "file"], "idx", width)
    ranged = R.interval_join(spots, observations.where("lo is not null"), ["session_id"], "idx").select("session_id", "file", "zoom", "observation", F.lit("range").alias("match_reason"))
    named = found.select("session_id", "file").distinct().join(observations, "session_id").where(R.mentions_file(F.col("observation"), F.col("file"))).select("session_id", "file", "zoom", "observation", F.lit("text").alias("match_reason"))
    return ranged.unionByName(named).groupBy("session_id", "file", "zoom", "observation").agg(F.min("match_reason").alias("match_reason"))


def at_message(points: DataFrame, observations: DataFrame) -> DataFrame:
    """The first observation that holds each point: of the finest zoom, then the earliest."""
    zoom = F.when(F.col("zoom") == "micro", 0).when(F.col("zoom") == "meso", 1).otherwise(2)
    held = R.interval_join(points, observations.where("lo is not null"), ["session_id"], "idx")
    return held.groupBy("session_id", "idx").agg(F.min_by("observation", F.struct(zoom, "lo", "hi", "observation")).alias("observation"))


def graph_context(node_files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch a node of each file, once each."""
    src = edges.join(node_files.withColumnRenamed("id", "src"), ["graph", "src"])
    dst = edges.join(node_files.withColumnRenamed("id", "dst"), ["graph", "dst"])
    return src.select("graph", "file", "src", "dst", "type").unionByName(dst.select("graph", "file", "src", "dst", "type")).distinct()


def thread_markers(found: DataFrame, entries: DataFrame, width: int = WINDOW) -> DataFrame:
    """Entries within width of a mention."""
    return R.window_indices(found, ["session_id", "file"], "idx", width).join(entries.withColumnRenamed("msg_index", "idx"), ["session_id", "idx"])


def timeline(parts: list[DataFrame]) -> DataFrame:
    """session_id, file, idx, kind, content of several tables in order; of equal (idx, content) the first table's stays."""
    both = reduce(lambda a, b: a.unionByName(b), [p.withColumn("__p", F.lit(k)) for k, p in enumerate(parts)])
    rank = F.row_number().over(W.partitionBy("session_id", "file", "idx", "content").orderBy("__p", "kind"))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r", "__p").withColumn("position", F.row_number().over(W.partitionBy("session_id", "file").orderBy("idx", "kind", "content")))


# --- fixed values: the renderers and what they print a row as
RENDERERS = {"debug_sequence": "[%d] %s %s", "emotional_arc": "msg %d: %s / %s", "file_timeline": "%d %s: %s", "reaction_log": "msg %d -> %s (%s)", "idea_transition": "%d. %s (%s)", "geological_event": "%d %s: %s", "decision_trace": "%d %s: %s"}


def render(rows: DataFrame, by: list[str], kind: str, at: str, first: str, second: str) -> DataFrame:
    """text: the rows of each group in order, a line each, in the renderer's format."""
    line = F.format_string(RENDERERS[kind], F.col(at).cast("int"), F.coalesce(F.col(first).cast("string"), F.lit("-")), F.coalesce(F.col(second).cast("string"), F.lit("-")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("a"), line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def directives(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a row for each @evidence:kind(key=value, ...) directive: whole, kind, params."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(@evidence:\w+\([^)]*\))"), F.lit(1)))
    out = docs.withColumn("whole", found)
    params = F.expr("str_to_map(regexp_replace(regexp_extract(whole, '\\\\(([^)]*)\\\\)', 1), '\\\\s*,\\\\s*', ','), ',', '=')")
    return out.withColumns({"kind": F.regexp_extract("whole", r"@evidence:(\w+)", 1), "params": params})


def resolve(docs: DataFrame, rendered: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each directive replaced by its rendered text (key, whole, rendered), or by a note where it has none."""
    found = directives(docs, text).select(key, "whole").distinct().join(rendered, [key, "whole"], "left")
    note = F.coalesce("rendered", F.concat(F.lit("[no evidence for "), F.col("whole"), F.lit("]")))
    each = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("whole", note.alias("by")))).alias("r"))
    out = docs.join(each, key, "left")
    return out.withColumn(text, F.when(F.col("r").isNull(), F.col(text)).otherwise(F.aggregate("r", F.col(text), lambda t, x: F.replace(t, x["whole"], x["by"])))).drop("r")
