"""Briefs of a file over all sessions, what a writer selects for them, and how versions of a brief compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relational as R

# --- fixed values: kinds of data that each version of a brief holds
CORE = ["confidence_history", "merged_warnings", "code_similarity", "genealogy_family", "evidence_blocks"]
TRENDS = ["emotional_trend", "decision_trajectory"]
CROSS = ["emotional_arc", "geological", "explorer", "timeline", "graph_context", "synthesis", "geological_metaphors", "claude_md"]
VERSIONS = {"A": CORE, "B": CORE + TRENDS, "C": CORE + TRENDS + CROSS}


def family(files: DataFrame, families: DataFrame) -> DataFrame:
    """file, concept, version_count, members: the first family (position, concept, members: array<struct<file, status, session_count>>)
    with a member whose name contains the file's or its stem."""
    stem = F.regexp_replace(R.basename(F.col("file")), r"\.[^.]*$", "")
    needles = files.select("file", F.explode(F.array("file", stem)).alias("__needle"))
    names = families.select("position", F.explode("members.file").alias("__name"))
    found = R.contains_join(names, needles, "__name", "__needle").groupBy("file").agg(F.min("position").alias("position"))
    return found.join(families, "position").select("file", "concept", F.size("members").alias("version_count"), "members")


def most_similar(files: DataFrame, matches: DataFrame, k: int = 3) -> DataFrame:
    """file, similar_to, score, pattern, rank: the k best matches (file_a, file_b, score, pattern) with the file's base name in either name.

    A match counts once for a file: with the first of its names that has it.
    """
    base = files.select("file", R.basename(F.col("file")).alias("__base"))
    one = matches.withColumn("__id", F.struct("file_a", "file_b", "score", "pattern"))
    a = R.contains_join(one, base, "file_a", "__base").select("file", "__id", F.lit(0).alias("side"), F.col("file_b").alias("similar_to"), "score", "pattern")
    b = R.contains_join(one, base, "file_b", "__base").select("file", "__id", F.lit(1).alias("side"), F.col("file_a").alias("similar_to"), "score", "pattern")
    first = a.unionByName(b).groupBy("file", "__id").agg(F.min_by(F.struct("similar_to", "score", "pattern"), "side").alias("m"))
    rows = first.select("file", "m.similar_to", F.round("m.score", 3).alias("score"), "m.pattern")
    return R.top_k(rows, ["file"], [F.col("score").desc(), F.col("similar_to"), F.col("pattern")], k)


def directives(history: DataFrame, frustrations: DataFrame, width: int = 10) -> DataFrame:
    """file, rank, session_id, directive: the timelines of the first two sessions with a confidence (history: file, position,
    session_id), and the reactions around the message with most capitals (frustrations: file, session_id, idx, caps_ratio), unless of one of those."""
    seen = history.where("session_id is not null and session_id <> ''").groupBy("file", "session_id").agg(F.min("position").alias("position"))
    two = R.top_k(seen, ["file"], [F.col("position"), F.col("session_id")], 2)
    timeline = F.format_string('@evidence:file_timeline(file="%s") [session:%s]', F.col("file"), F.col("session_id"))
    peak = R.top_k(frustrations.where("session_id is not null"), ["file"], [F.col("caps_ratio").desc(), F.col("session_id"), F.col("idx")], 1)
    peak = peak.drop("rank").join(two.select("file", "session_id"), ["file", "session_id"], "left_anti")
    around = F.format_string("@evidence:reaction_log(range=[%d,%d]) [session:%s]", F.greatest(F.col("idx") - width, F.lit(0)).cast("long"), (F.col("idx") + width).cast("long"), F.col("session_id"))
    cols = ["file", "rank", "session_id", "directive"]
    return two.withColumn("directive", timeline).select(*cols).unionByName(peak.withColumn("rank", F.lit(3)).withColumn("directive", around).select(*cols))


def emotional_trend(arcs: DataFrame, stories: DataFrame, characters: int = 200) -> DataFrame:
    """file, session_id, dominant_emotion, session_arc, friction_episodes of each session: from its arc, else from a story."""
    told = stories.where("session_id is not null and session_id <> ''").groupBy("file", "session_id").agg(F.min_by("arc", "position").alias("arc"))
    told = told.join(arcs.select("file", "session_id"), ["file", "session_id"], "left_anti")
    told = told.select("file", "session_id", F.lit("inferred_from_arc").alias("dominant_emotion"), F.substring("arc", 1, characters).alias("session_arc"), F.lit(0).alias("friction_episodes"))
    own = arcs.select("file", "session_id", F.coalesce("dominant_emotion", F.lit("unknown")).alias("dominant_emotion"), F.coalesce("session_arc", F.lit("")).alias("session_arc"), F.coalesce("friction_episodes", F.lit(0)).alias("friction_episodes"))
    return own.unionByName(told)


def decision_trajectory(decisions: DataFrame, patterns: DataFrame) -> DataFrame:
    """file, session_id, decision, pattern_type: merged decisions, and patterns (pattern, session_id, value) that are about decisions."""
    none = F.lit(None).cast("string")
    of = patterns.where(F.lower("pattern").contains("decision"))
    return decisions.select("file", "session_id", "decision", none.alias("pattern_type")).unionByName(of.select("file", "session_id", F.col("value").alias("decision"), F.col("pattern").alias("pattern_type")))


def compare(points: DataFrame, families: DataFrame, versions: dict = VERSIONS) -> DataFrame:
    """file, version, bytes, data_points, sessions, family_depth, rendered_characters of each version of each file's brief.

    points (file, kind, session_id, content) has a row for each data point of any kind; families: family().
    """
    held = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.array(*(F.lit(k) for k in kinds)).alias("kinds")) for v, kinds in versions.items())))
    rows = points.withColumn("v", held).where(F.array_contains("v.kinds", F.col("kind"))).withColumn("version", F.col("v.version"))
    text = F.to_json(F.struct("kind", "session_id", "content"))
    rendered = F.when(F.col("kind") == "evidence_blocks", F.length("content")).otherwise(0)
    out = rows.groupBy("file", "version").agg(
        F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("data_points"), F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sessions"), F.sum(rendered).alias("rendered_characters")
    )
    return out.join(families.select("file", F.col("version_count").alias("family_depth")), "file", "left").na.fill(0, ["family_depth"])


def by_ids(markers: DataFrame, concerns: DataFrame, kind: str) -> DataFrame:
    """Markers of a session (session_id, id, ...) with the files whose dossiers (marker_files()) name them as that kind."""
    named = concerns.where(F.col("kind") == kind).select("session_id", "file", "id").distinct()
    return markers.join(named, ["session_id", "id"])


def ideas(graphs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """session_id, file and the nodes (session_id, id, ...) of the file's subgraphs (graphs: subgraph_files(), members: session_id, name, id)."""
    ids = graphs.select("session_id", "file", "name").distinct().join(members, ["session_id", "name"]).select("session_id", "file", "id").distinct()
    return nodes.join(ids, ["session_id", "id"])


def idea_edges(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, file and the edges (src, dst) that touch one of the file's ideas at either end, once each."""
    ids = chosen.select("session_id", "file", "id").distinct()
    parts = [edges.join(ids.withColumnRenamed("id", end), ["session_id", end]).select("session_id", "file", *(c for c in edges.columns if c != "session_id")) for end in ("src", "dst")]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def rules(registry: DataFrame, dossiers: DataFrame, general: tuple[int, ...] = (1, 2), marked: tuple[int, ...] = (4,), warned: tuple[int, ...] = (5, 7, 8), warning: str = "W12") -> DataFrame:
    """session_id, file, rule_number, rule: general rules of the session, those about markers for files about markers or cutting,
    and those of a warning for the files that have it (dossiers: session_id, file, story, warning_ids)."""
    n = F.col("rule_number")
    about = F.lower("file").contains("marker") | F.lower(F.coalesce("story", F.lit(""))).contains("truncat")
    holds = n.isin(*general) | (n.isin(*marked) & about) | (n.isin(*warned) & F.coalesce(F.array_contains("warning_ids", warning), F.lit(False)))
    return dossiers.join(registry, "session_id").where(holds).select("session_id", "file", "rule_number", "rule")
