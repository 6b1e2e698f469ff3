"""JSON documents of many shapes as canonical rows; contracts; repair of model output.

Documents are rows with an id and a JSON string; every alias list is tried in order and the first that is there wins.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: ordered aliases of canonical fields
ALIASES = {
    "node_id": ["id", "node_id", "name"], "node_label": ["label", "name", "title", "id"], "node_description": ["description", "summary", "text"], "node_index": ["message_index", "first_appearance", "msg_index", "index"], "node_confidence": ["confidence", "maturity", "state"],
    "edge_src": ["from", "from_id", "from_node", "source"], "edge_dst": ["to", "to_id", "to_node", "target"], "edge_type": ["type", "transition_type", "relation"],
    "marker_id": ["marker_id", "id", "warning_id"], "marker_claim": ["claim", "text", "description", "content", "warning", "recommendation"], "marker_category": ["category", "type", "kind"], "marker_severity": ["severity", "priority"],
    "marker_target": ["target", "target_file", "affected_files", "affected_components", "affected_component", "files_affected", "scope"],
    "marker_target_text": ["claim", "content", "detail", "description", "message", "warning"],
    "marker_warning": ["warning", "claim", "title", "content", "detail", "description", "message"],
    "marker_recommendation": ["recommendation", "actionable_guidance", "action", "action_required", "remediation", "resolution", "fix", "recommended_action", "verification_action"],
    "file": ["file", "file_path", "filename", "file_name", "name", "path"], "message_index": ["msg_index", "index", "message_index"], "observation": ["observation", "text", "description"],
    "action_vector": ["action_vector", "primitives.action_vector"], "confidence_signal": ["confidence_signal", "primitives.confidence_signal"], "emotional_tenor": ["emotional_tenor", "primitives.emotional_tenor"], "intent_marker": ["intent_marker", "primitives.intent_marker"],
}
DOSSIERS = [
    "dossiers", "data_file_dossiers", "file_dossiers", "files", "detailed_dossiers", "code_file_dossiers", "analysis_output_dossiers", "conceptual_entity_dossiers", "standard_dossiers", "peripheral_files",
]
GEOLOGY = {
    "micro": ["micro", "micro_observations", "micro_level"], "meso": ["meso", "meso_observations", "meso_level", "patterns"], "macro": ["macro", "macro_observations", "macro_level", "arcs"],
    None: [
        "observations", "strata", "layers", "geological_layers", "zoom_levels", "exploration_notes", "analysis_levels", "vertical_structures", "stratigraphy", "stratigraphic_column", "geological_features", "deep_time_observations",
        "cross_cutting_features", "fault_lines", "fossils", "session_character",
    ],
}
INNER = ["observations", "entries", "notes", "findings"]
EXPLORER = [
    "observations", "exploration_notes", "explorer_observations", "exploration_findings", "free_notes", "notes", "notable_observations", "surprising_observations", "overlooked_patterns", "explorer_findings", "explorations",
    "exploration_summary",
]
EXPLORER_SECTIONS = [
    "abandoned_ideas", "patterns", "warnings", "anomalies", "unanswered_questions", "open_questions", "what_matters_most", "emotional_dynamics", "cross_session_connections", "cross_session_links", "ideas_detected",
]
BEHAVIOR_PROFILES = ["claude_behavior_profile", "claude_behavior_patterns", "behavioral_timeline"]
RECOVERED = ["key_findings", "recommendations_for_future_sessions", "trust_calibration_assessment", "claude_capability_assessment"]
CANONICAL_KEYS = {
    "thread_extractions": ["threads"], "geological_notes": ["micro", "meso", "macro", "observations"], "semantic_primitives": ["tagged_messages", "distributions", "summary_statistics"],
    "explorer_notes": ["observations", "explorer_summary"], "idea_graph": ["nodes", "edges", "metadata"], "synthesis": ["passes", "key_findings", "session_character"],
    "grounded_markers": ["markers", "total_markers"], "file_dossiers": ["dossiers", "total_files_cataloged"], "claude_md_analysis": ["gate_activations", "overall_assessment"],
}
METADATA = ("session_id", "generated_at", "generator", "model", "source_files", "_schema_version", "_normalized_at")
CATEGORIES = ("ideas", "reactions", "software", "code", "plans", "behavior")
CONTRACTS = {
    "thread_extractions": {"required": ["threads"], "any_of": [], "types": {"threads": "object"}, "min_length": {}},
    "semantic_primitives": {"required": [], "any_of": ["tagged_messages", "primitives"], "types": {"tagged_messages": "array"}, "min_length": {}},
    "geological_notes": {"required": [], "any_of": ["micro", "meso", "macro", "observations"], "types": {"micro": "array", "meso": "array", "macro": "array"}, "min_length": {}},
    "idea_graph": {"required": ["nodes", "edges"], "any_of": [], "types": {"nodes": "array", "edges": "array"}, "min_length": {"nodes": 1}},
    "grounded_markers": {"required": ["markers"], "any_of": [], "types": {"markers": "array"}, "min_length": {}},
    "file_dossiers": {"required": ["dossiers"], "any_of": [], "types": {}, "min_length": {}},
}


def get(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, f"$.{path}")


def first_of(doc: Column, aliases: str | list[str]) -> Column:
    """The value of the first alias that is there and not empty."""
    names = ALIASES[aliases] if isinstance(aliases, str) else aliases
    return F.coalesce(*(F.nullif(get(doc, a), F.lit("")) for a in names))


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null or missing, by how the value begins."""
    c = F.substring(F.trim(value), 1, 1)
    return F.when(value.isNull(), "missing").when(c == "{", "object").when(c == "[", "array").when(F.trim(value).isin("true", "false"), "boolean").when(F.trim(value) == "null", "null").when(F.trim(value).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("string")


def elements(value: Column) -> Column:
    """The items of a JSON array as JSON strings; empty for anything else."""
    return F.coalesce(F.from_json(F.when(kind(value) == "array", value), "array<string>"), F.array().cast("array<string>"))


def members(value: Column) -> Column:
    """key and JSON value of a JSON object's members, in order of key; empty for anything else."""
    m = F.from_json(F.when(kind(value) == "object", value), "map<string,string>")
    return F.coalesce(F.array_sort(F.map_entries(m)), F.array().cast("array<struct<key:string,value:string>>"))


def extra(doc: Column, known: list[str]) -> Column:
    """The members outside the known keys, as a map."""
    return F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, v: ~k.isin(*known, *METADATA))


def metadata(doc: Column) -> Column:
    return F.struct(*(get(doc, k).alias(k) for k in METADATA))


def threads(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, category, msg_index, content, significance from the shapes that thread documents have: an object of
    categories (with entries, or lists), a list of extractions with a threads object each, or keys thread_N."""
    d = F.col(doc)
    t = F.coalesce(get(d, "threads"), d)
    category = lambda k: F.when(k.isin(*CATEGORIES), k).otherwise(F.coalesce(*(F.when(k.contains(c[:4]), c) for c in CATEGORIES), F.lit("ideas")))
    canonical = docs.where(kind(get(d, "threads")) == "object").select(key, F.explode(members(t)).alias("m")).select(key, F.col("m.key").alias("k"), F.col("m.value").alias("v"))
    loose = docs.where((kind(get(d, "threads")) == "missing") & (kind(get(d, "extractions")) == "missing")).select(key, F.explode(members(d)).alias("m")).where(F.col("m.key").rlike(r"^thread_\w+$")).select(key, F.col("m.key").alias("k"), F.col("m.value").alias("v"))
    listed = docs.where(kind(get(d, "threads")) == "array").select(key, F.explode(elements(get(d, "threads"))).alias("v")).select(key, F.coalesce(get(F.col("v"), "category"), get(F.col("v"), "name"), F.lit("ideas")).alias("k"), "v")
    named = canonical.unionByName(loose).unionByName(listed)
    entry = named.select(key, category(F.lower("k")).alias("category"), F.explode(F.concat(elements(get(F.col("v"), "entries")), elements(F.col("v")))).alias("e"))
    rows = entry.select(key, "category", first_of(F.col("e"), "message_index").cast("int").alias("msg_index"), F.coalesce(first_of(F.col("e"), ["content", "idea", "text", "description"]), F.when(kind(F.col("e")) == "string", F.col("e"))).alias("content"), F.coalesce(get(F.col("e"), "significance"), F.lit("medium")).alias("significance"))
    old = docs.select(key, F.explode(elements(get(d, "extractions"))).alias("e")).select(key, first_of(F.col("e"), "message_index").cast("int").alias("msg_index"), F.array(*(F.struct(F.lit(c).alias("category"), x.alias("content")) for c, x in (("ideas", get(F.col("e"), "threads.user_ideas.idea")), ("reactions", get(F.col("e"), "threads.reactions.type")), ("plans", get(F.col("e"), "threads.plans.content")), ("code", get(F.col("e"), "threads.code_blocks.action"))))).alias("x"))
    old = old.select(key, "msg_index", F.explode("x").alias("x")).select(key, "x.category", "msg_index", "x.content", F.lit("medium").alias("significance"))
    return rows.unionByName(old).where("content is not null and content <> ''")


def primitives(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """One row a tagged message from lists under several names, flat or nested in segments."""
    d = F.col(doc)
    lists = F.concat(*(elements(get(d, k)) for k in ("tagged_messages", "primitives", "messages", "tags")), elements(d), F.flatten(F.transform(elements(get(d, "segments")), lambda s: elements(F.get_json_object(s, "$.tagged_messages")))))
    e = F.col("e")
    cols = ("action_vector", "confidence_signal", "emotional_tenor", "intent_marker")
    out = docs.select(key, F.explode(lists).alias("e")).select(key, first_of(e, "message_index").cast("int").alias("msg_index"), *(first_of(e, c).alias(c) for c in cols), *(F.coalesce(get(e, c), get(e, f"primitives.{c}")).alias(c) for c in ("friction_log", "decision_trace")))
    return out.where("msg_index is not null")


def geology(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, zoom, lo, hi, observation, evidence from lists by zoom or one list with levels."""
    d, e = F.col(doc), F.col("e")
    # a section is a list, or an object with one inside, or an object that is an observation itself
    inside = lambda v: F.coalesce(*(F.when(kind(get(v, k)) == "array", elements(get(v, k))) for k in INNER))
    held = lambda v: F.when(kind(v) == "object", F.coalesce(inside(v), F.array(v))).otherwise(elements(v))
    parts = []
    for zoom, names in GEOLOGY.items():
        rows = docs.select(key, F.explode(F.concat(*(held(get(d, k)) for k in names))).alias("e"))
        parts.append(rows.select(key, (F.lit(zoom) if zoom else F.coalesce(get(e, "zoom"), get(e, "level"), F.lit("micro"))).alias("zoom"), "e"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    at = first_of(e, "message_index")
    return both.select(key, "zoom", F.coalesce(get(e, "message_range[0]"), at).cast("int").alias("lo"), F.coalesce(get(e, "message_range[1]"), at).cast("int").alias("hi"), first_of(e, "observation").alias("observation"), F.coalesce(get(e, "evidence"), get(e, "pattern")).alias("evidence"), get(e, "density").alias("density"), get(e, "type").alias("type"), get(e, "significance").alias("significance"))


def graph(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of idea graphs; the last state of a node's history overrides, the least of several indices counts."""
    d, e = F.col(doc), F.col("e")
    at = F.coalesce(first_of(e, "node_index").cast("int"), F.array_min(F.from_json(get(e, "message_indices"), "array<int>")))
    history = F.from_json(get(e, "state_history"), "array<string>")
    state = F.when(F.size(history) > 0, F.element_at(history, -1))
    nodes = docs.select(key, F.explode(F.concat(elements(get(d, "nodes")), elements(get(d, "ideas")))).alias("e")).select(F.col(key).alias("graph"), first_of(e, "node_id").alias("id"), first_of(e, "node_label").alias("label"), first_of(e, "node_description").alias("description"), at.alias("message_index"), F.coalesce(state, first_of(e, "node_confidence")).alias("confidence"), extra(e, sorted({a for k in ("node_id", "node_label", "node_description", "node_index", "node_confidence") for a in ALIASES[k]})).alias("extra"))
    edges = docs.select(key, F.explode(F.concat(elements(get(d, "edges")), elements(get(d, "transitions")))).alias("e")).select(F.col(key).alias("graph"), first_of(e, "edge_src").alias("src"), first_of(e, "edge_dst").alias("dst"), F.coalesce(first_of(e, "edge_type"), F.lit("evolved")).alias("type"))
    return nodes.where("id is not null"), edges.where("src is not null and dst is not null")


def _joined(value: Column) -> Column:
    """A list's items with spaces between them, anything else as it is; empty for what holds nothing."""
    text = F.when(kind(value) == "array", F.array_join(elements(value), " ")).otherwise(value)
    return F.when(classify_value(value) == "POPULATED", text)


def marker_target(marker: Column) -> Column:
    """What a marker is aimed at: the first target that holds something, else its first text."""
    texts = (F.when(kind(get(marker, k)) == "string", F.nullif(get(marker, k), F.lit(""))) for k in ALIASES["marker_target_text"])
    return F.coalesce(*(_joined(get(marker, k)) for k in ALIASES["marker_target"]), *texts, F.lit(""))


def marker_warning(marker: Column) -> Column:
    """A marker's text: the first that is one, or the title or description of the first that is an object."""
    text = lambda v: F.when(kind(v) == "object", F.coalesce(F.nullif(get(v, "title"), F.lit("")), F.nullif(get(v, "description"), F.lit("")), v)).when(kind(v) == "string", F.nullif(v, F.lit("")))
    return F.coalesce(*(text(get(marker, k)) for k in ALIASES["marker_warning"]), F.lit(""))


def marker_recommendation(marker: Column) -> Column:
    """What a marker says to do: the first text of its kinds."""
    return F.coalesce(*(F.when(kind(get(marker, k)) == "string", F.nullif(get(marker, k), F.lit(""))) for k in ALIASES["marker_recommendation"]), F.lit(""))


def markers(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """Markers as rows: kind, id, category, claim, target, severity, confidence, warning, recommendation.

    They are in `markers`; where that is missing, in lists by level; where there are none of either, warnings,
    recommendations and patterns are markers, and beside an empty list of markers the metrics are one.
    """
    d, e = F.col(doc), F.col("e")
    listed = lambda k: elements(get(d, k))
    level = ["session_level_markers", "file_level_markers", "function_level_markers"]
    some, missing = F.size(listed("markers")) > 0, kind(get(d, "markers")) == "missing"
    by_level = sum((F.size(listed(k)) for k in level), F.lit(0)) > 0
    rest = ~some & ~(missing & by_level)
    sources = [("markers", "marker", some), *((k, "marker", missing) for k in level), *((k, k[:-1], rest) for k in ("warnings", "recommendations", "patterns"))]
    both = None
    for name, what, cond in sources:
        part = docs.where(cond).select(key, F.lit(what).alias("kind"), F.explode(listed(name)).alias("e"))
        both = part if both is None else both.unionByName(part)
    fields = [first_of(e, f"marker_{c}").alias(c) for c in ("id", "category", "claim")]
    fields += [marker_target(e).alias("target"), F.coalesce(first_of(e, "marker_severity"), F.lit("unknown")).alias("severity"), get(e, "confidence").cast("double").alias("confidence")]
    out = both.select(key, "kind", *fields, marker_warning(e).alias("warning"), marker_recommendation(e).alias("recommendation"))
    metrics = docs.where(~some & ~missing & (kind(get(d, "metrics")) == "object")).select(key, F.lit("metrics").alias("kind"), get(d, "metrics").alias("m"))
    text = F.lit("").alias
    return out.unionByName(metrics.select(key, "kind", F.lit("GM-METRICS").alias("id"), F.lit("metrics").alias("category"), F.col("m").alias("claim"), text("target"), F.lit("unknown").alias("severity"), F.lit(0.5).alias("confidence"), F.col("m").alias("warning"), text("recommendation")))


def marker_kind(category: Column) -> Column:
    return F.when(category == "risk", "warnings").when(category == "decision", "recommendations").when(category == "architecture", "metrics").otherwise("patterns")


def dossiers(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, file, dossier (JSON) from an object by file or a list with a file in each; unnamed and odd entries go."""
    d = F.col(doc)
    body = F.coalesce(*(F.when(kind(get(d, k)).isin("object", "array"), get(d, k)) for k in DOSSIERS))
    keyed = docs.select(key, F.explode(members(body)).alias("m")).select(key, F.col("m.key").alias("file"), F.col("m.value").alias("dossier"))
    listed = docs.select(key, F.explode(elements(body)).alias("dossier")).select(key, first_of(F.col("dossier"), "file").alias("file"), "dossier")
    return keyed.unionByName(listed).where((kind(F.col("dossier")) == "object") & F.col("file").isNotNull() & (F.col("file") != "unknown"))


def synthesis(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, pass, finding from an object of passes, a list of passes, or keys pass_*."""
    d = F.col(doc)
    body = get(d, "passes")
    keyed = docs.select(key, F.explode(F.concat(members(body), F.filter(members(d), lambda m: m["key"].startswith("pass_")))).alias("m")).select(key, F.col("m.key").alias("pass"), F.col("m.value").alias("v"))
    listed = docs.select(key, F.posexplode(elements(body)).alias("n", "v")).select(key, F.coalesce(get(F.col("v"), "pass"), get(F.col("v"), "name"), F.concat(F.lit("pass_"), (F.col("n") + 1).cast("string"))).alias("pass"), "v")
    return keyed.unionByName(listed).select(key, "pass", F.explode(F.when(kind(F.col("v")) == "array", elements(F.col("v"))).when(F.size(elements(get(F.col("v"), "findings"))) > 0, elements(get(F.col("v"), "findings"))).otherwise(F.array("v"))).alias("finding"))


def explorer(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, section, id, observation: the notes of all lists that explorers use, in the lists' order."""
    d, o = F.col(doc), F.col("o")
    named = lambda k: F.transform(elements(get(d, k)), lambda x: F.struct(F.lit(k).alias("section"), x.alias("o")))
    held = [named(k) for k in [*EXPLORER, *EXPLORER_SECTIONS]]
    rows = docs.select(key, F.explode(F.concat(*held)).alias("x")).select(key, "x.section", "x.o")
    said = F.when(kind(o) == "object", F.coalesce(first_of(o, "observation"), o)).otherwise(o)
    return rows.where((~F.col("section").isin(EXPLORER_SECTIONS)) | kind(o).isin("object", "string")).select(key, "section", get(o, "id").alias("id"), said.alias("observation"))


def gates(docs: DataFrame, key: str = "session_id", doc: str = "doc") -> DataFrame:
    """session_id, gate_activations (array of JSON), gates_not_triggered, overall (JSON or text), behavior_profile, security of an analysis.

    One activation may stand without its list. Where there is neither an activation, an assessment nor a profile, what
    other findings there are become the assessment.
    """
    d = F.col(doc)
    active = get(d, "gate_activations")
    activations = F.when(kind(active) == "object", F.array(active)).otherwise(elements(active))
    said = F.when(kind(get(d, "overall_assessment")).isin("object", "string"), F.nullif(get(d, "overall_assessment"), F.lit("")))
    # the first of the names that is there counts, whatever it holds
    profile = F.coalesce(*(get(d, k) for k in BEHAVIOR_PROFILES))
    nothing = (F.size(activations) == 0) & (said.isNull() | (F.regexp_replace(said, r"\s", "") == "{}")) & (classify_value(profile) != "POPULATED")
    found = F.array_compact(F.array(*(F.when(get(d, k).isNotNull(), F.struct(F.lit(k).alias("key"), get(d, k).alias("value"))) for k in RECOVERED)))
    recovered = F.when(nothing & (F.size(found) > 0), F.to_json(F.map_from_entries(found)))
    objects = lambda v: F.when(kind(v) == "object", v)
    return docs.select(
        key, activations.alias("gate_activations"), elements(get(d, "gates_not_triggered")).alias("gates_not_triggered"), F.coalesce(recovered, said).alias("overall"), objects(profile).alias("behavior_profile"),
        objects(get(d, "tier2_security_analysis")).alias("security"),
    )


def validate(docs: DataFrame, canonical: dict = CANONICAL_KEYS, kind_col: str = "kind", doc: str = "doc") -> DataFrame:
    """docs with valid and missing_keys: which members of its kind's canonical form a document lacks (PARSE_ERROR: it is no object)."""
    d = F.col(doc)
    present = F.map_keys(F.from_json(d, "map<string,string>"))
    wanted = F.array().cast("array<string>")
    for name, names in canonical.items():
        wanted = F.when(F.col(kind_col) == name, F.array(*(F.lit(k) for k in names))).otherwise(wanted)
    missing = F.when(F.size(wanted) == 0, wanted).when(present.isNull(), F.array(F.lit("PARSE_ERROR"))).otherwise(F.filter(wanted, lambda k: ~F.array_contains(present, k)))
    return docs.withColumns({"missing_keys": missing, "valid": F.size(missing) == 0})


def normalization_status(docs: DataFrame, kind_col: str = "kind", doc: str = "doc") -> DataFrame:
    """validate() with status: already_normalized (stamped), valid, needs_normalization, or unreadable."""
    checked = validate(docs, kind_col=kind_col, doc=doc)
    broken = F.array_contains("missing_keys", "PARSE_ERROR")
    status = F.when(get(F.col(doc), "_normalized_at").isNotNull(), "already_normalized").when(broken, "unreadable").when(F.col("valid"), "valid").otherwise("needs_normalization")
    return checked.withColumn("status", status)


def stamp(docs: DataFrame, done: DataFrame, key: str = "session_id") -> DataFrame:
    """The documents that haven't been normalized yet: a second run finds none."""
    return docs.join(done.select(key), key, "left_anti")


def check_contracts(docs: DataFrame, contracts: dict = CONTRACTS, kind_col: str = "kind", doc: str = "doc") -> DataFrame:
    """docs with problems: what each document of a kind breaks (missing:k, none_of:a,b, type:k, short:k), in order."""
    d = F.col(doc)
    out = F.array().cast("array<string>")
    for name, rule in contracts.items():
        found = [F.when(kind(get(d, k)) == "missing", f"missing:{k}") for k in rule["required"]]
        if rule["any_of"]:
            found.append(F.when(F.coalesce(*(get(d, k) for k in rule["any_of"])).isNull(), f"none_of:{','.join(rule['any_of'])}"))
        found += [F.when(~kind(get(d, k)).isin(t, "missing"), f"type:{k}") for k, t in rule["types"].items()]
        found += [F.when((kind(get(d, k)) == "array") & (F.size(elements(get(d, k))) < n), f"short:{k}") for k, n in rule["min_length"].items()]
        out = F.when(F.col(kind_col) == name, F.array_compact(F.array(*found))).otherwise(out)
    return docs.withColumn("problems", F.when(F.from_json(d, "map<string,string>").isNull(), F.array(F.lit("not_an_object"))).otherwise(out))


def classify_value(value: Column) -> Column:
    """MISSING (null or not there), ZERO (empty, 0, false) or POPULATED."""
    v = F.trim(value)
    return F.when(value.isNull() | (v == "null"), "MISSING").when(v.isin("", "[]", "{}", "0", "0.0", "false", '""'), "ZERO").otherwise("POPULATED")


def parse_response(text: Column, schema: str) -> Column:
    """Rows of a model's answer: without its code fence, as an array, else the outermost [...] of it, else an object a line."""
    plain = F.trim(F.regexp_replace(text, r"(?s)^\s*```\w*\n?|\n?```\s*$", ""))
    array = f"array<{schema}>"
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.from_json(F.when(F.trim(x).startswith("{"), F.regexp_replace(F.trim(x), ",$", "")), schema)), lambda x: x.isNotNull())
    return F.coalesce(F.when(plain.startswith("["), F.from_json(plain, array)), F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)(\[.*\])", 1), F.lit("")), array), lines)


def repair(text: str | None) -> str | None:
    """JSON text as is, or its outermost braces, without trailing commas, with brackets closed: the first that parses."""
    if text is None:
        return None
    body = text[text.find("{") : text.rfind("}") + 1] if "{" in text and "}" in text else text
    no_commas = re.sub(r",\s*([}\]])", r"\1", body)
    start = no_commas if no_commas.strip() else text
    stack, quoted, escaped = [], False, False
    tail = text[text.find("{") :] if "{" in text else text
    tail = re.sub(r",\s*([}\]])", r"\1", tail)
    for c in tail:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
    closed = re.sub(r",\s*$", "", tail + '"' * quoted) + "".join(reversed(stack))
    for candidate in (text, body, start, closed, re.sub(r",\s*([}\]])", r"\1", closed)):
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            continue
    return None


def repaired(text: Column) -> Column:
    """text where it is JSON, else its repaired form, else null."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(repair)

    # only text that the JVM can't parse goes to Python
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid, text).otherwise(fix(F.when(~valid, text)))
