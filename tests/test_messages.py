"""Message operators on hand-made rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from talus.functions import text as T
from talus.operators import behavior, llm_passes, tags, threads
from talus.operators import messages as M
from talus.plans import queries, sessions  # noqa: F401  sessions registers its queries

SCHEMA = "session_id string, idx int, role string, content string"


@pytest.fixture(scope="module")
def one(spark):
    def run(expr, text):
        return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first().v

    return run


@pytest.mark.parametrize(("content", "kind"), [("", "empty_wrapper"), (" \n\t ", "empty_wrapper"), (None, "empty_wrapper"), ("<system-reminder>x\ny</system-reminder>", "system_reminder"), ("<command-name>/x</command-name>", "command_name"), ("This session is being continued from a previous conversation that ran out", "clear_continuation"), ("Base directory for this skill: /a/.claude/skills/b", "skill_injection"), ("Hello memory agent", "subagent_relay"), ("a normal message", None), ("about <b>tags</b>", None)])
def test_protocol(one, content, kind):
    assert one(M.protocol_type, content) == kind


@pytest.mark.parametrize(("length", "score", "pasted", "tier"), [(49, 0, False, 1), (50, 0, False, 1), (99, 0, False, 1), (100, 0, False, 3), (49, 1, False, 2), (99, 1, False, 2), (99, 3, False, 3), (99, 6, False, 4), (499, 0, False, 3), (500, 0, False, 4), (10, 0, True, 4), (199, 4, False, 3), (200, 5, False, 4)])
def test_tier_ladder(spark, length, score, pasted, tier):
    total, level = M.tier(F.lit(length), F.lit(score), F.lit(pasted))
    assert spark.range(1).select(level.alias("v")).first().v == tier


def test_signals_count_the_leftmost_keyword(one):
    counts = lambda k: lambda t: T.signal_counts(t)[k]
    assert one(counts("failure"), "An ERROR and a failure, it doesn't work") == 3
    assert one(counts("frustration"), "I hated that chateau") == 2
    assert one(counts("code"), "app.tsx") == 1 and one(counts("code"), "") == 0


def test_char_per_line(one):
    pair = lambda t: F.struct(*T.collapse_char_per_line(t))
    assert tuple(one(pair, "A\nL\nW\nA\nY\nS\n!")) == ("ALWAYS!", True)
    assert tuple(one(pair, "A\nB\nC")) == ("A\nB\nC", False)
    assert tuple(one(pair, "a normal line")) == ("a normal line", False) and tuple(one(pair, "")) == ("", False)


def test_scalars(one):
    assert one(T.caps_ratio, "123 !!") == 0 and one(T.caps_ratio, "aB") == 0.5
    assert one(T.repeated_word, "no no no never mind") == "NO" and one(T.repeated_word, "no no never mind") is None
    assert one(T.repeated_sentence, "Fix it now! Fix it now! Fix it now!") == "fix it now" and one(T.repeated_sentence, "Fix it now! Fix it now!") is None
    assert one(T.content_hash, "abc") == "ba7816bf8f01cfea" and one(T.token_estimate, "x" * 20) == 20
    assert one(T.stems, "six_thread_extractor.py") == ["six_thread", "thread_extractor", "six_thread_extractor"] and one(T.stems, "plain.py") == []
    assert one(T.normalize_confidence, "0.95") == "proven" and one(T.normalize_confidence, "HIGH") == "proven" and one(T.normalize_confidence, "?") == "unknown"
    assert one(lambda t: T.parse_signals(F.split(t, " ")), "failure:3 odd pivot:x plan:1") == {"failure": 3, "plan": 1}
    assert one(T.format_size, "2048") == "2.0KB" and one(T.safe_filename, "a/b.py") == "a_b_py"
    assert one(T.clean_for_agents, "first\n\n\n\nsecond\n==========\n") == "first\n\nsecond"
    assert one(lambda t: T.cost(t, F.lit(1_000_000), F.lit(0)), "claude-OPUS-x") == 15


@pytest.fixture(scope="module")
def session(spark):
    rows = [
        ("s", 0, "user", "I want a parser for the config loader module. Create a new file loader.py please!"),
        ("s", 1, "assistant", "I created the file loader.py and updated loader.py and edited main.py. All done."),
        ("s", 2, "user", "NO! THAT'S WRONG!! you broke the loader.py again!! it fails with KeyError on localhost:8080"),
        ("s", 3, "assistant", "I apologize, that was wrong. I fixed it: ```python\nx = 1\n``` and all tests pass, see output: OK"),
        ("s", 4, "user", "<system-reminder>noise</system-reminder>"),
        ("s", 5, "user", "what if we use my goals: zero mistakes, carefully ordered configuration sections everywhere"),
        ("s", 6, "assistant", "While i was at it I rewrote other things. " + "Something unrelated follows here. " * 8),
        ("s", 7, "user", "wait wait wait"),
    ]
    return M.enrich(spark.createDataFrame(rows, SCHEMA)).cache()


def test_enrich(session):
    r = {x.idx: x for x in session.collect()}
    assert r[0].files == ["loader.py"] and r[0].files_create == ["loader.py"] and r[2].error_types == ["KeyError"] and r[2].ports == [8080]
    assert r[2].emergency and r[2].emergency_reason == "code_broken,5!" and r[7].emergency_reason == "REPEAT:WAIT"
    assert r[4].is_protocol and r[4].filter_tier == 1 and r[4].filter_tier_name == "skip" and r[4].filter_score == 0
    assert r[3].code_block and r[3].code_langs == ["python"]


def test_session_statistics(session):
    s = M.session_stats(session).first()
    assert (s.total_messages, s.user_messages, s.assistant_messages, s.protocol_messages, s.human_messages) == (8, 5, 3, 1, 4)
    assert [x.idx for x in s.frustration_peaks] == [2] and [x.idx for x in s.emergency_interventions] == [2, 7]
    assert s.tier_1 + s.tier_2 + s.tier_3 + s.tier_4 == 8


def test_behavior(session):
    r = {x.idx: x for x in behavior.flags(session).collect()}
    assert r[1].premature_completion and r[1].batch_without_verify and not r[0].premature_completion
    assert r[3].apologizes and r[3].acknowledges_mistake and not r[3].unverified_claim and r[6].unsolicited_addition and not r[6].scope_creep
    assert r[6].ignores_context and r[6].upset_score == 27
    assert behavior.by_session(behavior.flags(session, None)).first().analyzed == 3
    assert {a.level for a in behavior.alerts(behavior.flags(session)).collect()} <= {"WATCH", "CAUTION", "WARNING", "CRITICAL"}


def test_contradiction_looks_back(spark):
    rows = [("s", 0, "assistant", "the parser works now"), ("s", 1, "user", "ok"), ("s", 2, "assistant", "the parser doesn't work"), ("t", 0, "assistant", "the parser doesn't work")]
    got = {(r.session_id, r.idx): r.contradicts_self for r in behavior.flags(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[("s", 2)] and not got[("s", 0)] and not got[("t", 0)]


def test_tags(session):
    r = {x.idx: x for x in tags.tag(behavior.flags(session)).collect()}
    assert 4 not in r and r[2].emotional_tenor == "frustrated" and r[2].friction_log.startswith("User frustration: NO!")
    assert r[3].intent_marker == "bugfix" and r[1].friction_log.startswith("Assistant exhibited:")
    n = {(x.dimension, x.value): x.n for x in tags.distributions(tags.tag(behavior.flags(session))).collect()}
    assert sum(v for (d, _), v in n.items() if d == "action_vector") == 7


@pytest.mark.parametrize("name", ["message_tags", "tag_distributions", "emotion_summaries"])
def test_tags_are_those_of_the_sql(spark, tmp_path, name):
    """Words beside letters that aren't ASCII, long ones, short texts, sentences said three times, other blanks."""
    texts = [
        "die zußen en en die", "menteciónie ciónñque que que.", "no no no", "NO No no", "Fix it now! Fix it now! Fix it now!", "yes yes\tyes", "yes\vyes yes yes", "a-be be\n\nbeta", "de de", "de de code", "wait wait waiting",
        f"{'x' * 25} {'x' * 20} {'x' * 20}", f"{'y' * 25} {'y' * 25} {'y' * 25}", f"{'z' * 20} {'z' * 20} {'z' * 21}", "a a a a a", "damné", "éass of it", "what ass", "éError was seen", "Errorñ was seen", "an Error was seen", "ñyou forgot it!!", "you forgot it!!",
        "todo está: éall done", "été all done", "schön schön schön", "Kelp Kelp kelp",
    ]
    table = pa.table({"conv_id": [k // 6 for k in range(2 * len(texts))], "turn": [k % 6 for k in range(2 * len(texts))], "role": [r for _ in texts for r in ("user", "assistant")], "text": [t for t in texts for _ in range(2)]})
    pq.write_table(table, tmp_path / "conversations.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize(("text", "said"), [("We chose a over b because it is fast.", "chose a over b because it is fast"), ("switched from x to y.", "chose y over x because migration/upgrade"), ("nothing here", None)])
def test_decisions(spark, text, said):
    assert spark.createDataFrame([(text,)], "content string").select(tags.decision().alias("v")).first().v == said


def test_threads(session):
    t = threads.extract(behavior.flags(session))
    r = {x.idx: x for x in t.collect()}
    assert r[0].ideas.evolution == "expressing_goal" and r[0].ideas.idea.startswith("a parser for the config") and r[3].response.action == "apologized_and_corrected"
    assert r[5].markers.is_ignored_gem and r[2].markers.frustration_level >= 2 and r[3].reactions.to == "user frustration or previous error"
    e = threads.entries(t).collect()
    assert {x.category for x in e} >= {"ideas", "software", "reactions", "code"} and all(x.content for x in e)
    assert threads.summary(t).first().messages == 7


def test_batches_never_mix_sessions(spark):
    m = spark.createDataFrame([(s, i, "user", "x" * 60) for s in "ab" for i in range(7)], SCHEMA)
    assert {(r.session_id, r.batch): r["count"] for r in M.batches(m, 3).groupBy("session_id", "batch").count().collect()} == {(s, b): n for s in "ab" for b, n in ((0, 3), (1, 3), (2, 1))}
    got = M.token_batches(m, 70, 40).groupBy("session_id", "batch").count().collect()
    assert {r["count"] for r in got} == {2, 1} and len(got) == 8


def test_subagents(spark):
    rows = [("x_agent-1", 0, "user", "hi"), ("m", 0, "user", "H\ne\nl\nl\no\n \nm\ne\nm\no\nr\ny\n \na\ng\ne\nn\nt"), ("p", 0, "user", "hi"), ("late", 9, "user", "hello memory agent")]
    got = {r.session_id: (r.is_subagent, r.agent_type) for r in M.subagents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"x_agent-1": (True, None), "m": (True, "memory_agent"), "p": (False, None), "late": (False, None)}


def test_passes(session, spark):
    asked = llm_passes.prompts(session, "content", "Label.", 2)
    assert asked.agg(F.sum("n")).first()[0] == llm_passes.rows_for(session, "content").count()
    found = llm_passes.results(llm_passes.run(asked, lambda p: '```json\n[{"msg_index": 2, "label": "angry", "reason": "caps"}]\n```'))
    assert {(r.msg_index, r.flagged) for r in found.collect()} == {(2, True)}
    assert [r.idx for r in llm_passes.rows_for(session, "review", {"content": found}).collect()] == [2]
    merged = {r.idx: r.content_pass for r in llm_passes.merge(session.withColumnRenamed("content", "text"), {"content_pass": found}).collect()}
    assert merged[2].label == "angry" and merged[0] is None
    failing = llm_passes.run(asked, lambda p: 1 / 0).first()
    assert failing.answer is None and "zero" in failing.error
    assert llm_passes.dry_run(asked, "sonnet").first().calls == asked.count()
