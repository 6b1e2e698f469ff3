"""Session selection, synthesis, dossiers and normalizers on hand-made rows."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from talus.functions import text as T
from talus.operators import aggregate, behavior, briefs, dossier, llm_passes, messages, normalize, relational, sessions, synthesis, tags, threads
from talus.streaming import operations

rows = lambda df, *cols: sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def docs(spark, *found, kind=None):
    return spark.createDataFrame([(f"s{n}", kind, json.dumps(x) if not isinstance(x, str) else x) for n, x in enumerate(found)], "session_id string, kind string, doc string")


@pytest.mark.parametrize(("text", "n"), [("no no no no stop", 4), ("What now? what now? What now! go", 3), ("fine text of words", 0), ("a a", 0), ("yes it is. yes it is. no.", 0)])
def test_repeats(spark, text, n):
    assert spark.range(1).select(T.repeats(F.lit(text)).alias("n")).first().n == n


def test_frustration_counts_repeats(spark):
    texts = ["plain words only here", "go go go now please", "go go go go now please"]
    df = messages.enrich(spark.createDataFrame([("s", k, "user", t) for k, t in enumerate(texts)], "session_id string, idx int, role string, content string"))
    got = [r.v for r in df.orderBy("idx").select(threads.frustration_level().alias("v")).collect()]
    # an intervention (a repeat) gives a point, three repeats one more, four two more
    assert got == [0, 2, 3]


def test_condensed_and_context_line(spark):
    at = datetime.datetime(2024, 1, 2, 9, 5)
    df = messages.enrich(spark.createDataFrame([("s", 3, "user", "WHAT IS THIS!! see app.py and other_name.py", at), ("s", 4, "assistant", "fine", at)], "session_id string, idx int, role string, content string, ts timestamp"))
    short = sessions.condensed(df)
    assert short.columns == ["session_id", "i", "r", "c", "cl", "t", "ts", "signals", "is_protocol", "protocol_type", "was_char_encoded", "content_ref", "meta"]
    line = [r.v for r in df.orderBy("idx").select(sessions.context_line().alias("v")).collect()]
    assert line[0].startswith("[3] | 09:05 | Tue | FILES:app.py,other_name.py | CAPS:") and line[0].endswith("% 2! | EMERGENCY:2!") and line[1] == "[4] | 09:05 | Tue"


def test_eligible_sessions(spark):
    stats = spark.createDataFrame([("a", 20), ("b", 19), ("c", 50), ("d", 30)], "session_id string, total_messages int")
    present = spark.createDataFrame([(s, f) for s in "abd" for f in ("x", "y", "z")] + [("c", "x"), ("c", "x")], "session_id string, file string")
    done = spark.createDataFrame([("d",)], "session_id string")
    assert rows(sessions.eligible(stats, present, ["x", "y"], done=done), "session_id") == [("a",)]
    assert rows(sessions.eligible(stats, present, ["x"]), "session_id") == [("a",), ("c",), ("d",)]


def test_duplicate_sessions(spark):
    names = ["/a/ce1dc2b6-ac7a.jsonl", "59d386aa_ce1dc2b6-ac7a.jsonl", "11111111_22222222-b.jsonl", "agent-1_ce1dc2b6-ac7a.jsonl", "33333333-c.jsonl", "33333333_33333333-c.jsonl"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(sessions.duplicates(files)) == [("59d386aa",)]
    all_ = spark.createDataFrame([("59d386aa-x",), ("ce1dc2b6",), ("33333333",)], "session_id string")
    assert rows(sessions.without_duplicates(all_, files)) == [("33333333",), ("ce1dc2b6",)]


def test_selected_messages(spark):
    said = [(0, "user", 4, False, 0, 0.0), (1, "assistant", 4, False, 0, 0.0), (2, "user", 2, False, 0, 0.0), (3, "user", 1, False, 5, 0.0), (4, "user", 1, False, 4, 0.31), (5, "user", 1, True, 9, 0.9), (6, "assistant", 1, False, 9, 0.9), (7, "user", 1, False, 4, 0.3)]
    df = spark.createDataFrame([("s", *x) for x in said], "session_id string, idx int, role string, filter_tier int, is_protocol boolean, exclamations int, caps_ratio double")
    assert rows(sessions.selected(df), "idx", "why") == [(0, "tier"), (1, "tier"), (2, "user"), (3, "intense"), (4, "intense")]
    assert rows(sessions.not_yet(df, df.where("idx < 6")), "idx") == [(6,), (7,)]
    assert rows(sessions.between(df, 2, 3), "idx") == [(2,), (3,)]


def test_previews(spark):
    df = spark.createDataFrame([("s", 1, 2, "long one"), ("s", 2, 3, "long two"), ("s", 3, 1, "low")], "session_id string, idx int, filter_tier int, content string")
    previews = spark.createDataFrame([("s", 1, "short"), ("s", 2, ""), ("s", 3, "x")], "session_id string, idx int, preview string")
    assert rows(sessions.with_previews(df, previews), "idx", "content") == [(1, "short"), (2, "long two")]


def test_recent_and_chronological(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("c", 3, 9)], "session_id string, idx int, ts int")
    assert [r.session_id for r in sessions.recent(df, 2, "ts").collect()] == ["b", "c"]
    assert [r.idx for r in sessions.chronological(df, 2).collect()] == [1, 2]
    assert sessions.chronological(df).count() == 3


def test_ledger(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    marks = spark.createDataFrame([], "file string, state string, at int")
    for n, (state, cond) in enumerate((("in_progress", "file < 'c'"), ("processed", "file = 'a'"), ("processed", "file = 'a'"))):
        marks = sessions.marked(marks, files.where(cond), state, F.lit(min(n, 1)))
    assert rows(sessions.ledger(files, marks)) == [("a", "processed"), ("b", "in_progress"), ("c", "pending")] and marks.count() == 3
    with pytest.raises(ValueError, match="no state"):
        sessions.marked(marks, files, "lost", F.lit(1))


def test_archived_runs(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    files = spark.createDataFrame([(1, "b", 5, "x"), (1, "a", 7, "y")], "run_id int, name string, bytes long, sha256 string")
    got = {r.run_id: r for r in sessions.archived(runs, files).collect()}
    assert got[1].files == 2 and got[1].bytes == 12 and [x.name for x in got[1].listing] == ["a", "b"] and got[2].files == 0


STATS = "session_id string, total_messages long, user_messages long, assistant_messages long, tier_1 long, errors long, peaks long, files long, input_tokens long, output_tokens long"


def synthesized(spark):
    stats = spark.createDataFrame([("a", 10, 4, 6, 9, 2, 1, 3, 1234567, 1000), ("b", 5, 2, 3, 0, 0, 0, 0, 30, 0)], STATS)
    facts = spark.createDataFrame([("a", 0, 3, "x" * 300, "edited"), ("a", 1, 2, "low", None), ("a", 2, 9, "second", None)], "session_id string, position int, filter_score int, preview string, action string")
    arcs = spark.createDataFrame([("a", 0, "Arc one", "goal"), ("a", 1, None, "x"), ("a", 2, "Arc two", None)], "session_id string, position int, arc string, goal string")
    notes = spark.createDataFrame([("a", k, "t" if k else None, "d" * (31 if k < 6 else 1)) for k in range(7)] + [("b", 0, None, "too short")], "session_id string, position int, title string, detail string")
    graph = spark.createDataFrame([("a", 12, 11), ("b", 1, 0)], "session_id string, nodes int, edges int")
    files = spark.createDataFrame([("a", f"f{k}.py", 10 - k // 2) for k in range(7)], "session_id string, file string, n int")
    return stats, files, synthesis.passes(stats, facts, arcs, notes, graph, files)


def test_six_passes(spark):
    _, _, found = synthesized(spark)
    a = {(r["pass"], r.id): (r.title, r.description) for r in found.where("session_id = 'a'").collect()}
    assert a[1, "F01"] == ("x" * 200, "edited") and a[1, "F02"] == ("second", "processed") and (1, "F03") not in a
    assert a[2, "P01"] == ("Frustration Events", "1 frustration peaks detected across 10 messages") and a[2, "P02"][1].startswith("90% of messages")
    assert a[3, "V01"] == ("Arc one", "goal") and a[3, "V02"] == ("Arc two", "")
    assert [a[4, f"C0{k}"][0] for k in range(1, 5)] == ["Explorer Observation", "t", "t", "t"] and (4, "C05") not in a
    assert a[5, "W01"] == ("Idea Flow", "12 ideas connected by 11 transitions in this session")
    assert [a[6, f"G0{k}"][0] for k in range(1, 8)] == ["f0.py", "f1.py", "f2.py", "f3.py", "f4.py", "error_handling", "Input/output token ratio"] and a[6, "G07"][1] == "1235:1"
    b = rows(found.where("session_id = 'b'"), "pass", "id", "title", "description")
    assert b == [
        (1, "F01", "Session completed", "Session with 5 messages processed"), (2, "P01", "Session Structure", "Session with 2 user messages and 3 assistant messages"),
        (3, "V01", "Single-Task Execution", "Session focused on a single primary objective across 5 messages"), (4, "C01", "Session Character", "A 5-message session with 0 files referenced"),
        (5, "W01", "Token Economy", "Input: 30 tokens, Output: 0 tokens"), (6, "G01", "Input/output token ratio", "30:1"),
    ]


def test_grounded_markers(spark):
    stats, files, found = synthesized(spark)
    peaks = spark.createDataFrame([("a", k, 0.5, k == 1, "p" * 200) for k in range(7)], "session_id string, idx int, caps_ratio double, profanity boolean, preview string")
    nodes = spark.createDataFrame([("a", 0, "idea", "about"), ("a", 1, None, "x")], "session_id string, position int, label string, description string")
    software = spark.createDataFrame([("a", "modified", 0, "m.py"), ("a", "created", 0, "c.py"), ("a", "function", 0, "run")], "session_id string, kind string, position int, name string")
    got = {r.id: r for r in synthesis.grounded_markers(stats, files, peaks, nodes, software, found).where("session_id = 'a'").collect()}
    assert [got[f"M{k:03d}"].type for k in range(1, 20)] == ["file_activity"] * 7 + ["frustration_event"] * 5 + ["idea_marker"] * 2 + ["modification_event", "creation_event", "function_added", "warning", "session_metadata"]
    assert got["M001"].marker == "SESSION:a - Referenced 10 times" and got["M009"].marker == "FRUSTRATION at msg 1: caps_ratio=0.50, profanity=True" and len(got["M009"].context) == 150
    assert got["M014"].marker == "IDEA: unnamed" and got["M018"].marker == "WARNING: 2 errors occurred during this session."
    assert got["M019"].marker == "SESSION PROFILE: 10 msgs, 1,234,567 input tokens, 1,000 output tokens" and len(got) == 19


def test_synthesis_context(spark):
    got = synthesis.synthesis_context(docs(spark,
        {"passes": {"pass_1_factual": {"temperature": 0.1, "focus": "f", "findings": [1], "empty": []}, "pass_2_interpretive": {"patterns": ["x"]}, "summary": {"k": "v"}}},
        {"pass_1_factual": {"focus": "only"}, "pass_6_grounding": {"label": "L", "g": {"a": 1}}},
        {},
    ))
    assert rows(got, "session_id", "pass", "temperature", "label") == [("s0", 0, 0.0, "SUMMARY"), ("s0", 1, 0.1, "f"), ("s0", 2, 0.5, "PATTERNS"), ("s1", 6, 0.0, "L")]
    assert {(r.session_id, r["pass"]): sorted(r.content) for r in got.collect()} == {("s0", 0): ["k"], ("s0", 1): ["findings"], ("s0", 2): ["patterns"], ("s1", 6): ["g"]}


def test_guidance_and_session_context(spark):
    got = {r.session_id: r for r in synthesis.guidance_context(docs(spark, {"file_analyses": {"a": 1, "b": 2}, "gate_activations": [1, 2, 3], "overall_assessment": "", "_extra": {"x": 1}}, {})).collect()}
    assert sorted(got["s0"].context) == ["extra", "file_analyses", "gate_activations"] and got["s0"].data_points == 6 and got["s1"].data_points == 0
    one = synthesis.session_context(spark.createDataFrame([("a", 3, 1)], "session_id string, total_messages int, tier_1 int")).first()
    assert one.total_messages == 3 and one.input_tokens == 0 and one.tier_distribution == {"1": 1, "2": 0, "3": 0, "4": 0} and not one.is_subagent


def test_explorer_context(spark):
    notes = {"observations": ["app.py breaks", {"id": "anomaly-1", "observation": "odd app.py"}, {"id": "o2", "observation": "other"}], "verification": {"one": "app.py ok", "two": ["x", "app.py"], "three": {"deep": "see app.py"}, "four": 3}}
    files = spark.createDataFrame([("s0", "app.py")], "session_id string, file string")
    got = synthesis.explorer_context(files, docs(spark, notes))
    assert rows(got, "kind", "section", "content") == sorted([("observation", None, "app.py breaks"), ("observation", "anomaly-1", "odd app.py"), ("anomaly", "anomaly-1", "odd app.py"), ("verification", "one", "app.py ok"), ("verification", "two", "app.py"), ("verification", "three.deep", "see app.py")], key=str)


def test_explorer_notes_and_gates(spark):
    got = normalize.explorer(docs(spark, {"notes": ["n"], "observations": [{"id": "o", "text": "said"}], "warnings": ["w"], "patterns": [3]}))
    assert rows(got, "section", "id", "observation") == [("notes", None, "n"), ("observations", "o", "said"), ("warnings", None, "w")]
    got = {r.session_id: r for r in normalize.gates(docs(spark, {"gate_activations": {"g": 1}, "overall_assessment": "fine"}, {"key_findings": ["k"]}, {"gate_activations": [1, 2], "claude_behavior_patterns": {"p": 1}, "gates_not_triggered": ["x"]})).collect()}
    assert got["s0"].gate_activations == ['{"g":1}'] and got["s0"].overall == "fine" and got["s1"].overall is not None and "key_findings" in got["s1"].overall
    assert len(got["s2"].gate_activations) == 2 and got["s2"].behavior_profile == '{"p":1}' and got["s2"].gates_not_triggered == ["x"] and got["s2"].overall is None


def test_validate(spark):
    got = normalize.normalization_status(docs(spark, {"nodes": [], "edges": [], "metadata": {}}, {"nodes": []}, "{broken", {"nodes": [], "_normalized_at": "now"}, kind="idea_graph"))
    assert rows(got, "session_id", "status", "valid", "missing_keys") == [("s0", "valid", True, []), ("s1", "needs_normalization", False, ["edges", "metadata"]), ("s2", "unreadable", False, ["PARSE_ERROR"]), ("s3", "already_normalized", False, ["edges", "metadata"])]
    assert normalize.validate(docs(spark, "x", kind="other")).first().valid


def test_markers_of_all_shapes(spark):
    found = normalize.markers(docs(spark,
        {"markers": [{"id": 1, "claim": "c", "affected_files": ["a.py", "b.py"], "priority": "P1"}], "warnings": [{"id": 2}]},
        {"markers": [], "warnings": [{"warning_id": "w", "title": "t"}], "metrics": {"n": 1}},
        {"session_level_markers": [{"id": "l", "content": {"title": "deep"}, "action": "do"}], "patterns": [{"id": "p"}]},
        {"patterns": [{"id": "p", "description": "d"}]},
    ))
    assert rows(found, "session_id", "kind", "id", "target", "severity", "warning", "recommendation") == [
        ("s0", "marker", "1", "a.py b.py", "P1", "c", ""), ("s1", "metrics", "GM-METRICS", "", "unknown", '{"n":1}', ""), ("s1", "warning", "w", "", "unknown", "t", ""),
        ("s2", "marker", "l", "", "unknown", "deep", "do"), ("s3", "pattern", "p", "d", "unknown", "d", ""),
    ]


def test_dossier_shapes(spark):
    got = normalize.dossiers(docs(spark, {"dossiers": [{"file_name": "a.py"}, {"name": "b.py"}, {"x": 1}]}, {"standard_dossiers": {"c.py": {"k": 1}, "odd": 3}}, {"dossiers": {"unknown": {}}}))
    assert rows(got, "session_id", "file") == [("s0", "a.py"), ("s0", "b.py"), ("s1", "c.py")]


def test_geology_shapes(spark):
    got = normalize.geology(docs(spark, {"micro": {"observations": [{"observation": "in"}]}, "macro": {"observation": "one"}, "strata": [{"observation": "st", "level": "meso"}], "fossils": [{"text": "old"}]}))
    assert rows(got, "zoom", "observation") == [("macro", "one"), ("meso", "st"), ("micro", "in"), ("micro", "old")]


def test_marker_files(spark):
    doc = {"warnings": [{"target": "see app.py", "severity": "high"}], "recommendations": [{"scope": ["app", "x"], "fix": "do"}], "markers": [{"claim": "app.py is slow", "action": "speed"}, {"claim": "none"}, "odd"]}
    files = spark.createDataFrame([("s0", "app.py"), ("s0", "other.py"), ("s1", "app.py")], "session_id string, file string")
    got = dossier.marker_files(files, docs(spark, doc, {"warnings": [{"target": "any file in V5 code directory", "warning": "w"}]}))
    assert rows(got, "session_id", "file", "kind", "severity", "content") == [
        ("s0", "app.py", "recommendation", "unknown", "do"), ("s0", "app.py", "recommendation", "unknown", "speed"), ("s0", "app.py", "warning", "high", ""), ("s0", "app.py", "warning", "unknown", "app.py is slow"),
        ("s1", "app.py", "warning", "unknown", "w"),
    ]


def test_subgraphs_lineage_and_assembly(spark):
    graphs = dossier.subgraphs(docs(spark, {"subgraphs": [{"name": "A", "node_ids": [1, 2], "summary": "s"}, {"label": "B", "description": "d"}, {"name": "A", "node_ids": [1]}, {"id": 1}]}))
    assert rows(graphs, "name", "nodes", "summary") == [("A", 1, ""), ("B", 0, "d")]
    concepts = spark.createDataFrame([("app.py", 0, "B"), ("app.py", 1, "missing")], "file string, position int, name string")
    linked = dossier.subgraph_files(concepts, graphs)
    assert rows(linked, "file", "name", "nodes") == [("app.py", "B", 0)]
    files = spark.createDataFrame([("s0", "app.py"), ("s0", "z.py")], "session_id string, file string")
    families = spark.createDataFrame([("s0", 1, "late", ["app.py"]), ("s0", 0, "early", ["old/app.py", "app2.py"])], "session_id string, position int, family string, members array<string>")
    nodes = spark.createDataFrame([("s0", "n1", "the app", None, "proven"), ("s0", "n2", "else", "nothing", "x")], "session_id string, id string, label string, description string, confidence string")
    mine = spark.createDataFrame([("s0", "src/app.py", '{"summary": "x", "key_insight": ""}')], "session_id string, file string, dossier string")
    got = {r.file: r for r in dossier.lineage(files, families, nodes, mine).collect()}
    assert got["app.py"].family == "early" and [n.id for n in got["app.py"].nodes] == ["n1"] and got["app.py"].extra == {"summary": "x"} and got["app.py"].data_points == 3 and got["z.py"].data_points == 0
    mentions = spark.createDataFrame([("s0", "app.py", 5), ("s0", "z.py", 5), ("s0", "low.py", 1)], "session_id string, file string, n int")
    touches = spark.createDataFrame([("s0", "app.py", a) for a in ("created", "modified", "modified", "read")], "session_id string, file string, action string")
    concerns = spark.createDataFrame([("s0", "app.py", "warning", "w1", "high", "x")], "session_id string, file string, kind string, id string, severity string, content string")
    whole = {r.file: r for r in dossier.assemble(mentions, touches, concerns, linked, 2).collect()}
    assert sorted(whole) == ["app.py", "z.py"] and (whole["app.py"].times_created, whole["app.py"].times_modified, whole["app.py"].total_references) == (1, 2, 4)
    assert [w.id for w in whole["app.py"].warnings] == ["w1"] and whole["app.py"].recommendations == [] and [g.name for g in whole["app.py"].subgraphs] == ["B"] and whole["z.py"].warnings == []


def test_related_nodes_and_similar_files(spark):
    marks = spark.createDataFrame([("s", "M1", "the parser drops rows that are long"), ("s", "M2", "short")], "session_id string, marker_id string, claim string")
    nodes = spark.createDataFrame([("s", 0, "n0", "parser", "drops rows", None), ("s", 1, "n1", "x", "from M2", None), ("s", 2, "n2", "y", None, "M1")], "session_id string, position int, id string, label string, description string, source string")
    assert rows(dossier.related_nodes(marks, nodes), "marker_id", "id", "rank") == [("M1", "n0", 1), ("M1", "n2", 2), ("M2", "n1", 1)]
    pairs = spark.createDataFrame([("a", "b", 0.9, "p"), ("a", "c", 0.3, "p"), ("c", "b", 0.31, "q")], "file_a string, file_b string, score double, pattern string")
    assert rows(dossier.similar_files(pairs, k=1), "file", "similar_to", "score") == [("a", "b", 0.9), ("b", "a", 0.9), ("c", "b", 0.31)]


def test_dashboard_and_arc(spark):
    files = spark.createDataFrame([("a.py", "py", "ok", True, False, False, False, 9.0, 1, 2, 3, 4, 5, 3, 4), ("b.md", "md", "ok", False, True, False, True, 50.0, 1, 0, 0, 0, 0, None, None)], "file string, ext string, state string, is_dead_code boolean, is_missing boolean, has_key_mismatch boolean, has_truncation boolean, size_kb double, annotations int, frictions int, decisions int, warnings int, failed_approaches int, verified int, claims int")
    some = spark.createDataFrame([("s", 50, 1, 3, 2, 0), ("t", 5001, 0, 2, 2, 1)], "session_id string, messages int, p0 int, p1 int, p2 int, p3 int")
    got = {(r.section, r.name): r.value for r in dossier.dashboard(files, some).collect()}
    assert got["ext", "py"] == 1 and got["session_size", "tiny_0_50"] == 1 and got["session_size", "mega_5000_plus"] == 1 and got["page_size", "under_10"] == 1 and got["page_size", "over_50"] == 1
    assert got["issue", "dead_code"] == 1 and got["issue", "key_mismatch"] == 0 and got["total", "avg_credibility"] == 75 and got["phase_rate", "p1"] == 50 and got["total", "total_messages"] == 5051
    arc = spark.createDataFrame([("f", "calm"), ("f", "calm"), ("f", None), ("f", "angry")], "file string, emotional_tenor string")
    assert dossier.arc_summary(arc, ["file"], "emotional_tenor", "v").first().v == "calm:2, angry:1, unknown:1"


def test_friction_names_all_flags_and_known_decisions(spark):
    texts = ["I'm not sure about it, I apologize", "we use unified_orchestrator as the pipeline", "chose a over b because c."]
    df = behavior.flags(messages.enrich(spark.createDataFrame([("s", k, "assistant", t) for k, t in enumerate(texts)], "session_id string, idx int, role string, content string")))
    df = df.withColumns({"rushes": F.lit(True), "contradicts_self": F.col("idx") == 0})
    got = {r.idx: r for r in tags.tag(df).collect()}
    assert got[0].friction_log == "Assistant exhibited: confusion, contradicts, apologizes, rushing"
    assert got[1].decision_trace.startswith("chose unified orchestrator over") and got[2].decision_trace == "chose a over b because c"


def test_repaired_leaves_valid_json_alone(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": [1, 2,]',), ("no json",), (None,)], "t string")
    got = [r.v for r in df.select(normalize.repaired(F.col("t")).alias("v")).collect()]
    assert got[0] == '{"a": 1}' and json.loads(got[1]) == {"a": [1, 2]} and got[2:] == [None, None]


@pytest.mark.parametrize("few", [1000, 0])
def test_contains_join(spark, few):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["abcdefgh", "xyz", "", None, "aab", "abcdef"])], "k int, t string")
    names = spark.createDataFrame([("abcdefg",), ("ab",), ("z",), ("",), (None,), ("bcdefghi",), ("abcdef",)], "n string")
    want = sorted((k, n) for k, t in texts.collect() for (n,) in names.collect() if t and n and n in t)
    assert rows(relational.contains_join(texts, names, "t", "n", few=few), "k", "n") == want
    assert rows(relational.contains_join(texts, names, "t", "n", how="left_semi", few=few), "k") == sorted({(k,) for k, _ in want})
    assert relational.contains_join(texts, names.limit(0), "t", "n", few=few).count() == 0


def test_generic_and_short_names_are_no_files(spark):
    said = [("s", 0, "user", "see main.py and io.py and my_io.py"), ("s", 1, "user", "io.py my_io.py a_long_file_name.py"), ("s", 2, "assistant", "my_io.py")]
    df = messages.enrich(spark.createDataFrame(said, "session_id string, idx int, role string, content string"))
    assert rows(messages.file_mentions(df), "file", "n") == [("a_long_file_name.py", 1), ("my_io.py", 3)]
    assert rows(messages.top_files(messages.file_mentions(df), 1), "file") == [("my_io.py",)]
    first = {r.filter_tier: r.examples for r in messages.tier_examples(df, 1, 8).collect()}
    assert first and all(x in (["see main"], ["io.py my"], ["my_io.py"]) for x in first.values())


def test_totals(spark):
    merged = spark.createDataFrame([("a", 1, None), ("a", None, None), ("a", 2, 3)], "session_id string, one int, two int")
    usage = spark.createDataFrame([("a", 0.5), ("a", 0.25)], "session_id string, cost double")
    assert rows(aggregate.merge_totals(merged, ["one", "two"], usage), "total_messages", "with_result", "without_result", "passes", "cost") == [(3, 2, 1, ["one", "two"], 0.75)]
    some = spark.createDataFrame([("2024-01-01", "small", 10, 5, 2, 3, False), ("2024-01-01", "big", 90, 50, 20, 30, True), (None, "big", 1, 1, 1, 0, False)], "date string, size_class string, size_bytes long, total_messages long, user_messages long, assistant_messages long, is_agent boolean")
    got = {(r.section, r.name): (r.n, r.bytes) for r in aggregate.session_totals(some).collect()}
    assert got["day", "2024-01-01"] == (2, 100) and got["size", "big"] == (2, 91) and got["total", "agent_sessions"] == (1, 101) and got["total", "total_messages"] == (56, 101)
    seen = spark.createDataFrame([("a", "f", {"p": "x", "q": ""}, ["g", "h"]), ("b", "f", {"p": "y"}, ["g"])], "session_id string, file string, behavior map<string,string>, related array<string>")
    assert [(r.pattern, [tuple(s) for s in r.seen]) for r in aggregate.behavior_patterns(seen).collect()] == [("p", [("a", "x"), ("b", "y")])]
    assert rows(aggregate.related_files(seen)) == [("f", ["g", "h"])]


def test_briefs(spark):
    files = spark.createDataFrame([("src/plan.py",), ("none.py",)], "file string")
    families = spark.createDataFrame([(1, "late", [("plan.py", "on", 1)]), (0, "early", [("old_plan_v1.py", "off", 2), ("x.py", "on", 1)])], "position int, concept string, members array<struct<file:string,status:string,session_count:int>>")
    own = briefs.family(files, families)
    assert rows(own, "file", "concept", "version_count") == [("src/plan.py", "early", 2)]
    pairs = spark.createDataFrame([("a/plan.py", "b.py", 0.51234, "p"), ("c.py", "plan.py", 0.9, "q"), ("plan.py", "plan.py2", 0.1, "r"), ("d.py", "e.py", 1.0, "s")], "file_a string, file_b string, score double, pattern string")
    assert rows(briefs.most_similar(files, pairs, 2), "file", "similar_to", "score", "rank") == [("src/plan.py", "b.py", 0.512, 2), ("src/plan.py", "c.py", 0.9, 1)]
    history = spark.createDataFrame([("f", 0, "s1"), ("f", 1, "s1"), ("f", 2, "s2"), ("f", 3, "s3"), ("g", 0, "s1")], "file string, position int, session_id string")
    upset = spark.createDataFrame([("f", "s3", 4, 0.9), ("f", "s1", 8, 0.5), ("g", "s1", 2, 0.7)], "file string, session_id string, idx int, caps_ratio double")
    got = rows(briefs.directives(history, upset), "file", "rank", "directive")
    assert got == [("f", 1, '@evidence:file_timeline(file="f") [session:s1]'), ("f", 2, '@evidence:file_timeline(file="f") [session:s2]'), ("f", 3, "@evidence:reaction_log(range=[0,14]) [session:s3]"), ("g", 1, '@evidence:file_timeline(file="g") [session:s1]')]
    arcs = spark.createDataFrame([("f", "s1", None, "up", 2)], "file string, session_id string, dominant_emotion string, session_arc string, friction_episodes int")
    stories = spark.createDataFrame([("f", 0, "s1", "told"), ("f", 1, "s2", "x" * 300)], "file string, position int, session_id string, arc string")
    assert rows(briefs.emotional_trend(arcs, stories)) == [("f", "s1", "unknown", "up", 2), ("f", "s2", "inferred_from_arc", "x" * 200, 0)]
    made = spark.createDataFrame([("f", "s1", "chose a")], "file string, session_id string, decision string")
    patterns = spark.createDataFrame([("f", "Decisions", "s2", "v"), ("f", "other", "s2", "w")], "file string, pattern string, session_id string, value string")
    assert rows(briefs.decision_trajectory(made, patterns)) == [("f", "s1", "chose a", None), ("f", "s2", "v", "Decisions")]
    points = spark.createDataFrame([("src/plan.py", "confidence_history", "s1", "c"), ("src/plan.py", "evidence_blocks", "s1", "12345"), ("src/plan.py", "emotional_trend", "s2", "e"), ("src/plan.py", "timeline", "s3", "t")], "file string, kind string, session_id string, content string")
    assert rows(briefs.compare(points, own), "version", "data_points", "sessions", "rendered_characters", "family_depth") == [("A", 2, 1, 5, 2), ("B", 3, 2, 5, 2), ("C", 4, 3, 5, 2)]


def test_writer_selections(spark):
    concerns = spark.createDataFrame([("s", "f.py", "warning", "W1"), ("s", "f.py", "recommendation", "R1")], "session_id string, file string, kind string, id string")
    marks = spark.createDataFrame([("s", "W1", "w"), ("s", "R1", "r"), ("t", "W1", "other")], "session_id string, id string, text string")
    assert rows(briefs.by_ids(marks, concerns, "warning"), "file", "text") == [("f.py", "w")]
    graphs = spark.createDataFrame([("s", "f.py", "A")], "session_id string, file string, name string")
    members = spark.createDataFrame([("s", "A", "n1"), ("s", "A", "n2"), ("s", "B", "n3")], "session_id string, name string, id string")
    nodes = spark.createDataFrame([("s", f"n{k}") for k in range(1, 5)], "session_id string, id string")
    chosen = briefs.ideas(graphs, members, nodes)
    assert rows(chosen, "file", "id") == [("f.py", "n1"), ("f.py", "n2")]
    edges = spark.createDataFrame([("s", "n1", "n2"), ("s", "n3", "n1"), ("s", "n3", "n4")], "session_id string, src string, dst string")
    assert rows(briefs.idea_edges(chosen, edges), "file", "src", "dst") == [("f.py", "n1", "n2"), ("f.py", "n3", "n1")]
    registry = spark.createDataFrame([("s", n, f"r{n}") for n in (1, 2, 3, 4, 5)], "session_id string, rule_number int, rule string")
    mine = spark.createDataFrame([("s", "marker.py", None, []), ("s", "f.py", "never", ["W12"])], "session_id string, file string, story string, warning_ids array<string>")
    assert rows(briefs.rules(registry, mine), "file", "rule_number") == [("f.py", 1), ("f.py", 2), ("f.py", 5), ("marker.py", 1), ("marker.py", 2), ("marker.py", 4)]


def test_flags_over_a_whole_session_are_those_of_a_wide_context(spark):
    said = [
        ("user", "please fix plan.py"), ("assistant", "error in plan.py, it failed"), ("assistant", "parser works now and the build is complete"), ("user", "hm"), ("user", "and?"), ("user", "well"), ("user", "go on"), ("user", "now"), ("user", "ok"),
        ("assistant", "I modified plan.py again"), ("assistant", "parser doesn't work"), ("assistant", "wrote new.py"), *[("assistant", f"step {k}") for k in range(5)], ("assistant", "parser does not work, updated plan.py"),
    ]
    df = spark.createDataFrame([("s", k, r, t) for k, (r, t) in enumerate(said)] + [("t", 0, "assistant", "modified plan.py")], "session_id string, idx int, role string, content string")
    wide, whole = (rows(behavior.flags(df, c), "session_id", "idx", "contradicts_self", "repeats_failed", "ignores_context", "upset_score") for c in (1000, None))
    assert wide == whole and {x[1] for x in whole if x[3]} == {9, 17} and {x[1] for x in whole if x[2]} == {10}


def test_answered_prompts_are_not_asked_again(spark, tmp_path):
    asked = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "one"), ("b", 1, "bad")], "session_id string, batch int, prompt string")
    log = tmp_path / "calls"
    log.mkdir()

    def client(prompt):
        (log / f"{prompt}-{time.time_ns()}").touch()
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    record = f"file:{tmp_path}/answers"
    first = llm_passes.run_recorded(asked, record, client, retries=1, parts=2)
    assert rows(first) == [("a", 0, "ONE", None), ("a", 1, "TWO", None), ("b", 0, "ONE", None), ("b", 1, None, "no")]
    llm_passes.run_recorded(asked, record, client, retries=1, parts=2).collect()
    assert sorted(f.name.split("-")[0] for f in log.iterdir()) == ["bad", "bad", "one", "two"]


def test_notices_of_every_multiple_and_alerts_by_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"session_id": "s", "ts": "2024-01-01T00:00:00Z", "tool_name": "Edit", "tool_input": {"file_path": "f.py"}}) for _ in range(23)))
    seen = []
    stream = operations.notices(operations.events(spark, str(src)), 10)
    operations.run_once(stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c1")))
    assert sorted(r.n for r in seen) == [10, 20]
    files = tmp_path / "files"
    files.mkdir()
    cache, alerts = str(tmp_path / "cache"), str(tmp_path / "alerts")
    source = "import os\nimport json\n\ndef load(x):\n    return json.load(x)\n\ndef save(x, y):\n    return json.dump(x, y)\n"
    for n, name in enumerate(("one.py", "two.py")):
        (files / f"{n}.json").write_text(json.dumps({"file": name, "source": source}))
        changed = spark.readStream.schema("file string, source string").json(str(files))
        operations.run_once(operations.similarity_alerts(changed, cache, alerts, str(tmp_path / "c2")))
    assert rows(operations.cached_fingerprints(spark, cache), "file") == [("one.py",), ("two.py",)] and operations.cached_fingerprints(spark, cache, 1).count() == 1
    found = spark.read.json(alerts)
    assert found.where("batch = 1").count() >= 1
