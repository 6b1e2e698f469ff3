"""Six passes over a session, the markers that come of them, and the contexts that a file's evidence quotes.

stats is a row a session: total_messages, user_messages, assistant_messages, tier_1, errors, peaks, files, input_tokens,
output_tokens. The other tables have a session_id and a position that orders them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalize as N
from . import relational as R
from . import sessions as S

# --- fixed values: the passes by number: letter of their findings, names in documents, temperature, label
PASSES = {
    1: ("F", ["pass_1_factual", "pass_1_analytical"], 0.3, "FACTUAL"),
    2: ("P", ["pass_2_patterns", "pass_2_interpretive"], 0.5, "PATTERNS"),
    3: ("V", ["pass_3_vertical_structures", "pass_3_creative"], 0.7, "VERTICAL STRUCTURES"),
    4: ("C", ["pass_4_creative_synthesis", "pass_4_critical"], 0.9, "CREATIVE SYNTHESIS"),
    5: ("W", ["pass_5_wild_connections", "pass_5_integrative"], 1.0, "WILD CONNECTIONS"),
    6: ("G", ["pass_6_grounding"], 0.0, "GROUNDING"),
}
#: Members of a pass that say nothing about the session.
ABOUT = ["temperature", "label", "description", "focus"]
GUIDANCE = [
    "file_analyses", "key_findings_ranked", "aggregate_statistics", "session_overview", "gate_analysis", "framing_analysis", "claude_md_improvement_recommendations",
    "gate_activations", "gates_not_triggered", "overall_assessment", "behavior_profile", "tier2_security_analysis",
]
COUNTED = ["file_analyses", "key_findings_ranked", "gate_analysis", "gate_activations", "claude_md_improvement_recommendations"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _or_else(found: DataFrame, stats: DataFrame, title: str, description: Column) -> DataFrame:
    """found, and one finding for each session that has none."""
    rest = stats.join(found.select("session_id").distinct(), "session_id", "left_anti")
    return found.unionByName(rest.select("session_id", F.lit(0).cast("long").alias("position"), F.lit(title).alias("title"), description.alias("description")))


def _grouped(number: Column) -> Column:
    return F.format_number(number.cast("long"), 0)


def passes(
    stats: DataFrame, facts: DataFrame, arcs: DataFrame, observations: DataFrame, graph: DataFrame, top_files: DataFrame, score: int = 3, tool_share: float = 80, creative: int = 4, files: int = 5
) -> DataFrame:
    """session_id, pass, id, title, description: the findings of six passes, in each at least one.

    facts (filter_score, preview, action), arcs (arc, goal), observations (title, detail), graph (session_id, nodes,
    edges) and top_files (file, n).
    """
    rows = lambda df, title, description: df.select("session_id", F.col("position").cast("long").alias("position"), title.alias("title"), description.alias("description"))
    at = lambda df, position: df.withColumn("position", F.lit(position))
    total, peaks = F.col("total_messages"), F.col("peaks")
    factual = rows(facts.where(F.col("filter_score") >= score), F.substring("preview", 1, 200), F.coalesce("action", F.lit("processed")))
    factual = _or_else(factual, stats, "Session completed", _text("Session with ", total, " messages processed"))
    skipped = F.col("tier_1") / F.greatest(total, F.lit(1)) * 100
    upset = rows(at(stats.where(peaks > 0), 0), F.lit("Frustration Events"), _text(peaks, " frustration peaks detected across ", total, " messages"))
    heavy = rows(at(stats.where(skipped > tool_share), 1), F.lit("Tool-Heavy Session"), _text(F.format_string("%.0f", skipped), "% of messages are tier-1 tool operations with no visible text content"))
    plain = _text("Session with ", F.col("user_messages"), " user messages and ", F.col("assistant_messages"), " assistant messages")
    patterns = _or_else(upset.unionByName(heavy), stats, "Session Structure", plain)
    vertical = rows(arcs.where("arc is not null and arc <> ''"), F.col("arc"), F.coalesce("goal", F.lit("")))
    vertical = _or_else(vertical, stats, "Single-Task Execution", _text("Session focused on a single primary objective across ", total, " messages"))
    notable = observations.where("detail is not null and (title is not null and detail <> '' or length(detail) > 30)")
    notable = R.top_k(notable, ["session_id"], [F.col("position")], creative).drop("rank")
    notable = rows(notable, F.coalesce("title", F.lit("Explorer Observation")), F.substring("detail", 1, 300))
    notable = _or_else(notable, stats, "Session Character", _text("A ", total, "-message session with ", F.col("files"), " files referenced"))
    flow = rows(at(graph.where("nodes > 1"), 0), F.lit("Idea Flow"), _text(F.col("nodes"), " ideas connected by ", F.col("edges"), " transitions in this session"))
    flow = _or_else(flow, stats, "Token Economy", _text("Input: ", _grouped(F.col("input_tokens")), " tokens, Output: ", _grouped(F.col("output_tokens")), " tokens"))
    focus = R.top_k(top_files, ["session_id"], [F.col("n").desc(), F.col("file")], files)
    ground = rows(focus.withColumn("position", F.col("rank")), F.col("file"), _text("Referenced ", F.col("n"), " times in this session."))
    broken = rows(at(stats.where("errors > 0"), 1 << 30), F.lit("error_handling"), _text(F.col("errors"), " errors occurred during this session."))
    ratio = F.format_string("%.0f:1", F.rint(F.col("input_tokens") / F.greatest("output_tokens", F.lit(1))))
    ratio = rows(at(stats, 1 << 31), F.lit("Input/output token ratio"), ratio)
    found = [factual, patterns, vertical, notable, flow, _union([ground, broken, ratio])]
    each = [S.numbered(p, ["session_id"], ["position", "title", "description"], PASSES[n + 1][0], 2).withColumn("pass", F.lit(n + 1)) for n, p in enumerate(found)]
    return _union(each).select("session_id", "pass", "id", "title", "description")


def grounded_markers(stats: DataFrame, top_files: DataFrame, peaks: DataFrame, nodes: DataFrame, software: DataFrame, findings: DataFrame, files: int = 10, each: int = 5) -> DataFrame:
    """session_id, id (M001, ...), type, target, marker, context of the markers of a session.

    top_files (file, n), peaks (idx, caps_ratio, profanity, preview), nodes (position, label, description), software
    (kind: modified, created or function; position, name), findings: passes().
    """
    first = lambda df, order, k=each: R.top_k(df, ["session_id"], order, k)
    total = F.col("total_messages")
    none = F.lit(None).cast("string")

    def rows(df, section, kind, target, marker, context):
        return df.select("session_id", F.lit(section).alias("section"), F.col("rank").cast("long").alias("rank"), F.lit(kind).alias("type"), target.alias("target"), marker.alias("marker"), context.alias("context"))

    activity = first(top_files, [F.col("n").desc(), F.col("file")], files).join(stats.select("session_id", "total_messages"), "session_id")
    about = _text("This file was actively discussed/modified during session ", F.col("session_id"), " (", total, " messages)")
    parts = [rows(activity, 0, "file_activity", F.col("file"), _text("SESSION:", F.col("session_id"), " - Referenced ", F.col("n"), " times"), about)]
    upset = F.format_string("FRUSTRATION at msg %s: caps_ratio=%.2f, profanity=%s", F.col("idx").cast("string"), F.col("caps_ratio"), F.initcap(F.col("profanity").cast("string")))
    parts.append(rows(first(peaks, [F.col("idx")]), 1, "frustration_event", none, upset, F.substring("preview", 1, 150)))
    parts.append(rows(first(nodes, [F.col("position"), F.col("label")], 10), 2, "idea_marker", none, _text("IDEA: ", F.coalesce("label", F.lit("unnamed"))), F.substring("description", 1, 200)))
    made = {"modified": "modification_event", "created": "creation_event", "function": "function_added"}
    for n, (kind, name) in enumerate(made.items()):
        some = first(software.where(F.col("kind") == kind), [F.col("position"), F.col("name")])
        if kind == "function":
            marker, context = _text("FUNCTION ADDED: ", F.col("name")), _text("New function added during session ", F.col("session_id"))
        else:
            marker, context = _text(f"{kind.upper()} in session ", F.col("session_id")), F.lit(f"File was {kind} during this session")
        parts.append(rows(some, 3 + n, name, none if kind == "function" else F.col("name"), marker, context))
    warned = findings.where("pass = 6 and title = 'error_handling'").withColumn("rank", F.lit(1))
    parts.append(rows(warned, 6, "warning", F.col("title"), F.concat(F.lit("WARNING: "), F.substring("description", 1, 100)), F.lit("error_count")))
    counts = _text("SESSION PROFILE: ", total, " msgs, ", _grouped(F.col("input_tokens")), " input tokens, ", _grouped(F.col("output_tokens")), " output tokens")
    parts.append(rows(stats.withColumn("rank", F.lit(1)), 7, "session_metadata", none, counts, _text("Tier 1 messages: ", F.col("tier_1"))))
    numbered = S.numbered(_union(parts), ["session_id"], ["section", "rank", "marker"], "M", 3)
    return numbered.select("session_id", "id", "type", "target", "marker", "context")


def synthesis_context(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, pass, temperature, label, content (map of the members that hold something) of each pass of a synthesis document."""
    d = F.col(doc)
    nested = N.get(d, "passes")
    inside = F.size(F.filter(N.members(nested), lambda m: m["key"].startswith("pass_"))) > 0
    body = F.when(inside, nested).otherwise(d)
    full = lambda v: F.when((N.kind(v) == "object") & (N.kind(v) != "missing") & (F.size(N.members(v)) > 0), v)
    steps = [F.struct(F.lit(n).alias("pass"), F.lit(t).alias("temperature"), F.lit(label).alias("label"), F.coalesce(*(full(N.get(body, k)) for k in names)).alias("v")) for n, (_, names, t, label) in PASSES.items()]
    summary = F.coalesce(full(N.get(body, "summary")), full(N.get(nested, "summary")))
    steps.append(F.struct(F.lit(0).alias("pass"), F.lit(0.0).alias("temperature"), F.lit("SUMMARY").alias("label"), summary.alias("v")))
    rows = docs.select(key, F.inline(F.array(*steps))).where("v is not null")
    v, about = F.col("v"), F.col("pass") > 0
    held = F.filter(N.members(v), lambda m: ~(about & m["key"].isin(ABOUT)) & (~about | (N.classify_value(m["value"]) == "POPULATED")))
    rows = rows.withColumn("content", F.map_from_entries(held)).where(F.size("content") > 0)
    temperature = F.when(about, N.get(v, "temperature").cast("double"))
    label = F.when(about, F.coalesce(N.get(v, "label"), N.get(v, "focus")))
    return rows.select(key, "pass", F.coalesce(temperature, "temperature").alias("temperature"), F.coalesce(label, "label").alias("label"), "content")


def guidance_context(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, context (map of the known members that hold something, and of _extra), data_points of each analysis document."""
    d = F.col(doc)
    held = lambda k: F.when(N.classify_value(N.get(d, k)) == "POPULATED", F.struct(F.lit(k.strip("_")).alias("key"), N.get(d, k).alias("value")))
    context = F.map_from_entries(F.array_compact(F.array(*(held(k) for k in [*GUIDANCE, "_extra"]))))
    size = lambda v: F.when(N.kind(v) == "array", F.size(N.elements(v))).otherwise(F.size(N.members(v)))
    points = sum((size(N.get(d, k)) for k in [*COUNTED, "_extra"]), F.lit(0))
    return docs.select(key, context.alias("context"), points.alias("data_points"))


def session_context(stats: DataFrame) -> DataFrame:
    """The counts of a session that every file's evidence quotes; what isn't known is 0, empty or false."""
    numbers = ["total_messages", "user_messages", "assistant_messages", "errors", "tool_failures", "input_tokens", "output_tokens", "thinking_characters"]
    known = lambda c, kind: F.col(c) if c in stats.columns else F.lit(None).cast(kind)
    tiers = F.map_from_arrays(F.array(*(F.lit(str(k)) for k in range(1, 5))), F.array(*(F.coalesce(known(f"tier_{k}", "long"), F.lit(0)) for k in range(1, 5))))
    counts = [F.coalesce(known(c, "long"), F.lit(0)).alias(c) for c in numbers]
    return stats.select("session_id", *counts, tiers.alias("tier_distribution"), F.coalesce(known("is_subagent", "boolean"), F.lit(False)).alias("is_subagent"), F.lit(1).alias("data_points"))


def explorer_context(files: DataFrame, docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, file, kind (observation, anomaly, verification), section, content: what an explorer's notes say of each file."""
    d, o = F.col(doc), F.col("o")
    said = F.coalesce(N.get(o, "observation"), F.when(N.kind(o) != "object", o))
    notes = docs.select(key, F.explode(N.elements(N.get(d, "observations"))).alias("o")).select(key, N.get(o, "id").alias("note"), said.alias("content"))
    sections = docs.select(key, F.explode(N.members(N.get(d, "verification"))).alias("m")).select(key, F.col("m.key").alias("section"), F.col("m.value").alias("v"))
    v = F.col("v")
    flat = sections.where(N.kind(v) != "object").select(key, "section", F.explode(F.when(N.kind(v) == "array", N.elements(v)).otherwise(F.array("v"))).alias("content"))
    deep = sections.where(N.kind(v) == "object").select(key, "section", F.explode(N.members(v)).alias("m"))
    deep = deep.select(key, F.concat_ws(".", "section", "m.key").alias("section"), F.col("m.value").alias("content"))
    of = lambda rows, kind, section: files.join(rows, key).where(R.mentions_file(F.col("content"), F.col("file"))).select(key, "file", F.lit(kind).alias("kind"), section.alias("section"), "content")
    anomalies = notes.where(F.col("note").startswith("anomaly"))
    return _union([of(notes, "observation", F.col("note")), of(anomalies, "anomaly", F.col("note")), of(flat.unionByName(deep), "verification", F.col("section"))])
