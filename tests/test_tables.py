"""Joins, graphs, similarity, genealogy, evidence, aggregates, normalizers, checks, sources, sinks, streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from talus.operators import aggregate, evidence, genealogy, graph, normalize, relational, similarity, verify
from talus.sources import logs, sinks
from talus.streaming import operations

rows = lambda df, *cols: sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_band_join(spark, how):
    a = [(k % 3, (k * 7) % 50) for k in range(40)]
    b = [(k % 3, (k * 11) % 60) for k in range(30)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    got = relational.band_join(left, right, ["k"], "x", "y", 2, 4, how)
    near = lambda p: [q for q in b if q[0] == p[0] and p[1] - 2 <= q[1] <= p[1] + 4]
    want = [(*p, q[1]) for p in a for q in near(p)] if how == "inner" else [p for p in a if bool(near(p)) == (how == "left_semi")]
    assert rows(got, *(("k", "x", "y") if how == "inner" else ("k", "x"))) == sorted(want, key=str)


def test_first_match_and_last_wins(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(relational.first_match([a, b], ["k"])) == [(1, "a"), (2, "b")]
    assert rows(relational.last_wins(spark.createDataFrame([(1, 0, "x"), (1, 2, "y")], "k int, seq int, v string"), ["k"], "seq")) == [(1, 2, "y")]


def test_mentions(spark):
    ask = lambda t, f: spark.range(1).select(relational.mentions_file(F.lit(t), F.lit(f)).alias("v")).first().v
    assert ask("see Idea_Graph.py", "idea_graph.py") and ask("the idea graph", "idea_graph.py") and not ask("graphs of ideas", "idea_graph.py")


EDGES = [("g", a, b) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "y"))]
NODES = [("g", n) for n in "abcdxy"]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(NODES, "graph string, id string"), spark.createDataFrame(EDGES, "graph string, src string, dst string")


def test_graph_measures(small):
    assert rows(graph.degree(*small), "id", "in_degree", "out_degree")[:4] == [("a", 0, 3), ("b", 1, 1), ("c", 3, 0), ("d", 0, 0)]
    assert graph.density(*small).first().density == round(5 / 30, 4)
    assert rows(graph.components(*small), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x"), ("y", "x")]
    assert dict(rows(graph.small_betweenness(*small), "id", "betweenness"))["b"] == 0.0  # a reaches c without it
    one, two = dict(rows(graph.small_pagerank(*small, rounds=5), "id", "rank")), dict(rows(graph.pagerank(*small, rounds=5), "id", "rank"))
    assert one == pytest.approx(two, abs=2e-6) and sum(one.values()) == pytest.approx(1, abs=1e-5) and max(one, key=one.get) == "c"


def test_betweenness_of_a_path(spark):
    n = spark.createDataFrame([("g", k) for k in range(4)], "graph string, id int")
    e = spark.createDataFrame([("g", k, k + 1) for k in range(3)], "graph string, src int, dst int")
    assert rows(graph.small_betweenness(n, e), "id", "betweenness") == [(0, 0.0), (1, round(2 / 6, 6)), (2, round(2 / 6, 6)), (3, 0.0)]
    c = graph.chain(e, n.where("id = 2"), 5)
    assert rows(c, "step", "id") == [(-1, 1), (-2, 0), (0, 2), (1, 3)]


SOURCES = [("a_reader.py", "import os\nLIMIT = 3\ndef read(x):\n    return os.path.join(x)\ndef load(y):\n    return read(y)\nclass R:\n    def run(self):\n        pass\n"), ("a_reader_v2.py", "import os\nLIMIT = 3\ndef read(x):\n    return os.path.join(x)\ndef load(y):\n    return read(y)\nclass R:\n    def run(self):\n        return 1\n"), ("other.py", "import json\ndef dump(z):\n    return json.dumps(z)\n"), ("broken.py", "import os\ndef read(x:\n")]


@pytest.fixture(scope="module")
def prints(spark):
    return similarity.fingerprints(spark.createDataFrame(SOURCES, "file string, source string")).cache()


def test_fingerprints(prints):
    r = {x.file: x for x in prints.collect()}
    assert r["a_reader.py"].functions == ["load", "read"] and r["a_reader.py"].callables == ["load", "read", "run"] and r["a_reader.py"].constants == ["LIMIT"] and r["a_reader.py"].stem_words == ["a", "reader"]
    assert not r["broken.py"].parsed and r["broken.py"].functions == ["read"] and r["broken.py"].imports == ["os"]


def test_similarity(prints):
    found = {(r.file_a, r.file_b): r for r in similarity.matches(similarity.pair_signals(prints)).collect()}
    twin = found["a_reader.py", "a_reader_v2.py"]
    assert twin.func_overlap == 1 and twin.text_similarity > 0.9 and twin.patterns == ["dead_copy"] and ("a_reader.py", "other.py") not in found
    stats = {r.file: r for r in similarity.file_statistics(similarity.matches(similarity.pair_signals(prints)), prints).collect()}
    assert stats["a_reader.py"].strongest_match == "a_reader_v2.py" and stats["other.py"].isolation == 1.0
    alerts = similarity.incremental(prints.where("file = 'a_reader_v2.py'"), prints)
    assert {r.file_a for r in alerts.collect()} == {"a_reader.py"} | ({"a_reader_v2.py"} if alerts.where("file_a = 'a_reader_v2.py'").count() else set())


def test_overlap_of_two_empty_sets(spark):
    none = F.array().cast("array<string>")
    assert spark.range(1).select(similarity.overlap(none, none).alias("v")).first().v == 0.0


def test_genealogy(spark):
    lines = spark.createDataFrame([("four_thread_extractor.py", 0, 10, 3), ("six_thread_extractor.py", 13, 30, 4), ("geo_reader.py", 2, 3, 1), ("geo_reader_v1.py", 50, 60, 1), ("lone.py", 36, 40, 1)], "file string, first int, last int, events int")
    temporal = genealogy.temporal_links(lines)
    assert rows(temporal, "from_file", "to_file", "gap") == [("four_thread_extractor.py", "six_thread_extractor.py", 3)]
    named = genealogy.name_links(lines)
    assert rows(named, "from_file", "to_file", "shared_stem") == [("four_thread_extractor.py", "six_thread_extractor.py", "thread_extractor"), ("geo_reader.py", "geo_reader_v1.py", "geo_reader")]
    got = {r.file: (r.family, r.status, r.size) for r in genealogy.families(genealogy.all_links(temporal, named), lines).collect()}
    assert got["six_thread_extractor.py"] == ("four_thread_extractor.py", "current", 2) and got["geo_reader.py"] == ("geo_reader.py", "superseded", 2) and got["lone.py"][2] == 1


def test_evidence(spark):
    files = spark.createDataFrame([("s", "loader.py")], "session_id string, file string")
    entries = spark.createDataFrame([("s", "ideas", 3, "the loader idea", "high"), ("s", "code", 40, "nothing", "low")], "session_id string, category string, msg_index int, content string, significance string")
    obs = spark.createDataFrame([("s", "micro", 12, 14, "odd"), ("s", "meso", 0, 50, "broad"), ("s", "macro", None, None, "on loader.py")], "session_id string, zoom string, lo int, hi int, observation string")
    found = evidence.mentions(files, entries, obs)
    assert rows(found, "idx") == [(3,)]
    assert rows(evidence.geology(found, obs), "observation", "match_reason") == [("broad", "range"), ("odd", "range"), ("on loader.py", "text")]
    assert rows(evidence.at_message(spark.createDataFrame([("s", 13), ("s", 20)], "session_id string, idx int"), obs), "idx", "observation") == [(13, "odd"), (20, "broad")]
    tags = spark.createDataFrame([("s", i, e, "working") for i, e in ((2, "confident"), (3, "frustrated"), (30, "curious"))], "session_id string, idx int, emotional_tenor string, confidence_signal string")
    assert rows(evidence.emotional_arc(found, tags), "idx", "is_direct_mention", "emotion_changed") == [(2, False, False), (3, True, True)]
    docs = spark.createDataFrame([(1, "see @evidence:emotional_arc(start=1, end=5) and @evidence:x(a=1)")], "doc_id int, text string")
    d = {r.kind: r.params for r in evidence.directives(docs).collect()}
    assert d == {"emotional_arc": {"start": "1", "end": "5"}, "x": {"a": "1"}}
    done = evidence.resolve(docs, spark.createDataFrame([(1, "@evidence:emotional_arc(start=1, end=5)", "ARC")], "doc_id int, whole string, rendered string")).first().text
    assert done == "see ARC and [no evidence for @evidence:x(a=1)]"


def test_aggregates(spark):
    d = spark.createDataFrame([("s1", "a.py", 2, ["w1", "w2"], [], "high"), ("s2", "a.py", 3, ["w2", "w3"], ["d"], "low"), ("s1", "b.py", 1, [], [], "low")], "session_id string, file string, mentions int, warnings array<string>, decisions array<string>, significance string")
    index = aggregate.file_index(d)
    a = index.where("file = 'a.py'").first()
    assert (a.session_count, a.mentions, a.warnings, a.decisions, a.significance_high) == (2, 5, ["w1", "w2", "w3"], ["d"], 1)
    assert tuple(aggregate.index_statistics(index).first()) == (2, 1, 1, 0)
    side = spark.createDataFrame([("x/a.py", 7)], "path string, score int")
    assert rows(aggregate.enrich_index(index, {"s": (side, "path", ["score"])}), "file", "score") == [("a.py", 7), ("b.py", None)]
    m = spark.createDataFrame([("k", {"x": 1, "y": 2}), ("k", {"x": 3})], "k string, c map<string,int>")
    assert aggregate.map_sums(m, ["k"], "c").first().c == {"x": 4, "y": 2}
    level = spark.createDataFrame([(1, 1, 0, 9, 9, 9), (1, 1, 1, 1, 1, 1), (0, 1, 1, 1, 1, 1)], "sessions int, files int, dossiers int, families int, index_files int, verified int").select(aggregate.app_level().alias("v"))
    assert sorted(r.v for r in level.collect()) == [0, 2, 6]


THREADS = {
    "canonical": {"threads": {"ideas": {"entries": [{"msg_index": 1, "content": "one"}]}}}, "list": {"threads": [{"category": "ideas", "entries": [{"index": 1, "content": "one"}]}]}, "old": {"extractions": [{"index": 1, "threads": {"user_ideas": {"idea": "one"}}}]}, "keys": {"thread_1_ideas": [{"msg_index": 1, "content": "one"}]},
}


@pytest.mark.parametrize("shape", THREADS)
def test_thread_shapes(spark, shape):
    got = normalize.threads(spark.createDataFrame([("s", json.dumps(THREADS[shape]))], "session_id string, doc string"))
    assert rows(got, "category", "msg_index", "content") == [("ideas", 1, "one")]


def test_normalizers(spark):
    one = lambda doc: spark.createDataFrame([("s", json.dumps(doc))], "session_id string, doc string")
    assert normalize.threads(one({})).count() == 0
    flat, nested = {"tagged_messages": [{"msg_index": 4, "action_vector": "created"}]}, {"primitives": [{"index": 4, "primitives": {"action_vector": "created"}}]}
    assert rows(normalize.primitives(one(flat)), "msg_index", "action_vector") == rows(normalize.primitives(one(nested)), "msg_index", "action_vector") == [(4, "created")]
    g = {"nodes": [{"name": "n", "message_indices": [5, 2], "state_history": ["x", "proven"], "odd": 1}], "transitions": [{"from_id": "n", "to_node": "m"}]}
    nodes, edges = normalize.graph(one(g))
    n = nodes.first()
    assert (n.id, n.message_index, n.confidence) == ("n", 2, "proven") and n.extra["odd"] == "1" and rows(edges, "src", "dst", "type") == [("n", "m", "evolved")]
    assert rows(normalize.geology(one({"micro": [{"observation": "o", "message_range": [1, 4]}], "observations": [{"level": "macro", "text": "t"}]})), "zoom", "lo", "hi", "observation") == [("macro", None, None, "t"), ("micro", 1, 4, "o")]
    assert rows(normalize.markers(one({"warnings": [{"id": "W1", "warning": "w", "target_file": "a.py"}]})), "kind", "id", "claim", "target") == [("warning", "W1", "w", "a.py")]
    assert rows(normalize.dossiers(one({"dossiers": [{"file_path": "a.py"}, {"filename": "unknown"}, "odd"]})), "file") == [("a.py",)] and rows(normalize.dossiers(one({"files": {"b.py": {"x": 1}}})), "file") == [("b.py",)]
    assert rows(normalize.synthesis(one({"passes": {"p1": {"findings": ["f"]}}, "pass_2": ["g"]})), "pass", "finding") == [("p1", "f"), ("pass_2", "g")]
    c = spark.createDataFrame([("idea_graph", '{"nodes": []}'), ("idea_graph", '{"nodes": [1], "edges": []}'), ("x", "[1]")], "kind string, doc string")
    assert sorted(r.problems for r in normalize.check_contracts(c).collect()) == [[], ["missing:edges", "short:nodes"], ["not_an_object"]]


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', {"a": 1}), ('x {"a": 1} y', {"a": 1}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ("nothing", None), (None, None)])
def test_repair(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(normalize.repaired(F.col("t")).alias("v")).first().v
    assert (json.loads(got) if got else None) == want


def test_source_checks(spark):
    files = spark.createDataFrame([("a.py", "try:\n    x()\nexcept:\n    pass\ny = text[:50]\nprint(z[:80])\nw = q[:5]\n# sample rows\nv = r[:99]\n"), ("b.py", "r = api()\nif r:\n    a = r.content[0]\n\n\n\n\nb = s.content[0]\nm = 'opus-1'\n\"\"\"\nopus in a docstring\n\"\"\"\n")], "file string, source string")
    assert rows(verify.excepts(files), "file", "bare", "broad") == [("a.py", [3], []), ("b.py", [], [])]
    lines = verify.lines(files)
    assert rows(verify.truncations(lines)) == [("a.py", 5, 50)] and rows(verify.unsafe_access(lines)) == [("b.py", 8)] and rows(verify.model_strings(lines)) == [("b.py", 9, "opus-1")]


def test_claims_and_gaps(spark):
    results = spark.createDataFrame([("a.py", "bare except gone", "failed"), ("a.py", "uses cache", "verified"), ("b.py", "has retry", "unverifiable")], "file string, claim string, status string")
    warnings = spark.createDataFrame([("a.py", "bare except"), ("a.py", "race"), ("c.py", "slow")], "file string, warning string")
    assert rows(verify.gaps(results, warnings), "file", "category", "detail") == [("a.py", "contradicted", "bare except gone"), ("a.py", "unresolved_warning", "race"), ("b.py", "unverifiable", "has retry"), ("c.py", "unchecked", None), ("c.py", "unresolved_warning", "slow")]
    assert rows(aggregate.credibility(results, ["file"]), "file", "credibility") == [("a.py", 0.5), ("b.py", 0.0)]
    e = verify.enum_coverage(spark.createDataFrame([("a",), ("b",), ("z",)], "v string"), "v", ["a", "b", "c", "d"]).first()
    assert (e.observed, e.missing, e.coverage, e.gap_type) == (["a", "b"], ["c", "d"], 0.5, "extraction")
    flow = spark.createDataFrame([("p1.py", "x.json", "writes"), ("p2.py", "x.json", "reads"), ("p2.py", "y.json", "writes")], "file string, artifact string, direction string")
    assert rows(verify.dead_ends(flow)) == [("y.json",)]
    assert rows(verify.earliest_phase(flow, spark.createDataFrame([("p1.py", 3), ("p2.py", 2)], "file string, phase int")), "file", "earliest", "misplaced") == [("p1.py", 0, False), ("p2.py", 4, True)]
    listing = spark.createDataFrame([("a.json", 5), ("a.json.bak", 3), ("odd", 0), ("x.lock", 1)], "name string, size long")
    assert rows(verify.lifecycle(listing, spark.createDataFrame([("a.json",)], "name string")), "issue", "files") == [("backup", 1), ("empty", 1), ("lock", 1), ("orphan", 1)]


LOG = [
    '{"type":"user","content":"plain","timestamp":"2025-01-01T10:00:00Z","sessionId":"S"}', "", "not json", '{"type":"summary","content":"skip"}',
    '{"type":"assistant","timestamp":1735725660000,"message":{"role":"assistant","model":"m","content":[{"type":"thinking","thinking":"t1"},{"type":"text","text":"a"},{"type":"thinking","thinking":"t2"},{"type":"text","text":"b"},{"type":"tool_use","name":"Edit","input":{"x":1}}],"usage":{"input_tokens":5,"output_tokens":7}}}',
    '{"type":"user","timestamp":"bad","message":{"role":"user","content":"string content"}}',
]


def test_session_logs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "S.jsonl").write_text("\n".join(LOG))
    got = logs.read_sessions(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.role, r.content) for r in got] == [(0, "user", "plain"), (1, "assistant", "a\nb"), (2, "user", "string content")]
    assert got[1].thinking == "t2" and got[1].usage.output_tokens == 7 and got[1].tool_calls[0].name == "Edit" and got[2].ts is None and got[0].session_id == "S"
    assert got[1].ts == datetime.datetime(2025, 1, 1, 10, 1)
    other = logs.read_sessions(spark, str(tmp_path), separator=" ", thinking="first").where("idx = 1").first()
    assert (other.content, other.thinking) == ("a b", "t1")
    p = logs.profile(logs.lines(spark, str(tmp_path))).first()
    assert (p.lines, p.user_lines, p.assistant_lines, p.has_thinking, p.size_class) == (5, 2, 1, True, "tiny")


def test_display_archive(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text(json.dumps({"display": "hello", "timestamp": 1735725600000, "project": "p", "pastedContents": {"1": {"content": "y" * 600}}}) + "\n" + json.dumps({"display": " ", "timestamp": 1}))
    r = logs.read_display(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].content == "hello\n" + "y" * 500 and r[0].pasted
    assert logs.archive_statistics(logs.read_display(spark, str(tmp_path))).first().projects == 1


def test_documents_and_sinks(spark, tmp_path):
    (tmp_path / "session_1").mkdir()
    (tmp_path / "session_1" / "a.json").write_text('{"x": 1}')
    (tmp_path / "session_1" / "b.json").write_text("{broken")
    assert rows(logs.documents(spark, str(tmp_path)), "session_id", "name") == [("session_1", "a.json")]
    with pytest.raises(Exception, match="not JSON"):
        logs.documents(spark, str(tmp_path), strict=True).collect()
    index = spark.createDataFrame([("a/b.py", 3), ("c.py", 2)], "file string, session_count int")
    sinks.write_file_extracts(index, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("name=*")] == ["name=a_b_py"]
    src = "#!/bin/x\nimport os\n@dec\ndef f():\n    pass\n"
    once = sinks.annotate(src, "head", "foot", {"f": "about f"})
    assert once == "#!/bin/x\n# @ctx head\nimport os\n# @ctx about f\n@dec\ndef f():\n    pass\n# @ctx foot\n" and sinks.annotate(once, "head", "foot", {"f": "about f"}) == once
    frame = spark.createDataFrame([("a.js", "x", "h", None, None)], "file string, source string, header string, footer string, inline map<string,string>")
    assert sinks.annotated(frame).first().annotated == "// @ctx h\nx\n"


def events(n, file):
    return [json.dumps({"session_id": "s", "tool_name": "Edit", "tool_input": {"file_path": file, "old_string": "a", "new_string": "abc"}, "ts": "2025-01-01T00:00:00Z"}) for _ in range(n)]


def test_tracker_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(events(5, "a.py") + events(1, "b.md")))
    seen: list = []
    stream = operations.track(operations.operations(operations.events(spark, str(src))))
    run = lambda: operations.run_once(stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")))
    run()
    assert [(r.ops, r.edits, r.distinct_files, r.churn, r.extensions) for r in seen] == [(6, 6, 2, [], {"py": 1, "md": 1})]
    (src / "2.json").write_text("\n".join(events(2, "a.py")))
    run()  # goes on from the checkpoint: a.py passes five
    assert (seen[-1].ops, seen[-1].churn) == (8, ["a.py"])
    batch = operations.track_batch(operations.operations(spark.read.schema(operations.EVENT).json(str(src)))).first()
    assert (batch.ops, batch.distinct_files, batch.churn) == (8, 2, ["a.py"])


def test_windows_stream(spark, tmp_path):
    spark.createDataFrame([(datetime.datetime(2025, 1, 1, 0, m), "x", 1.0) for m in (0, 10, 59)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    operations.run_once(operations.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete"))
    assert [(r.n, r.total) for r in spark.sql("select * from windows").collect()] == [(3, 3.0)]
