"""Threads: what each message says about software, code, plans, ideas, responses and reactions, and its markers.

The input is an enriched table with behaviour flags. Ladders take the first rule that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values: frustration phrases (points), ladders of actions, ideas, reactions and triggers
FRUSTRATION = [(["are you serious"], 2), (["rushing", "ignored"], 1), (["i really hate"], 1), (["what's your problem"], 2)]
CODE_ACTIONS = [("reverted", ["reverted", "restored", "undo"]), ("fixed", ["fixed", "fix ", "bugfix", "patched"]), ("created", ["created", "wrote", "implemented", "added"]), ("modified", ["modified", "updated", "changed", "refactored"]), ("analyzed", ["analyzed", "found", "discovered", "detected"]), ("removed", ["removed", "deleted", "stripped"])]
RESPONSES = [("apologized_and_corrected", ["i apologize", "i'm sorry", "you're right"]), ("implemented", ["created", "wrote", "implemented"]), ("fixed", ["fixed", "patched", "resolved"]), ("analyzed", ["analyzed", "found", "discovered"]), ("executing_pipeline", ["the pipeline", "running", "executing"]), ("reported_error", ["api error"])]
PITCHES = [("offering_options", ["would you like", "shall i"]), ("proposing_solution", ["i propose", "i suggest", "my recommendation"])]
IDEAS = [("expressing_goal", ["i want", "i need"]), ("exploring_new_direction", ["what if", "how about"]), ("correcting_claude", ["instead", "actually", "no,", "not what", "excuse me"]), ("frustration_feedback", ["rushing", "ignored", "are you serious"]), ("context_recovery", ["continue", "session is being continued"]), ("architectural_thinking", ["puzzle", "architecture", "system design", "tiered"]), ("prevention_system_thinking", ["prevent", "canary", "zero mistakes"])]
REACTIONS = [("frustrated", ["rushing", "ignored", "didn't listen", "not what i"]), ("positive", ["great", "perfect", "excellent", "love it", "this is what i want"]), ("correcting", ["instead", "no,", "actually", "not that"])]
TRIGGERS = [("rushing through work", ["rushing"]), ("truncating content", ["truncat"]), ("deleting code/imports", ["delete", "removed"]), ("summarizing instead of translating", ["summari"]), ("using fallback models", ["fallback"])]
PIVOTS = ["instead", "new approach", "different strategy", "pivot", "actually, let", "change of plan", "scrap that"]
FAILURES = ["devastating", "broken", "crashed", "failed", "api error"]
BREAKTHROUGHS = ["it works!", "working!", "eureka", "the fix is", "smoking gun", "root cause", "there it is"]
GEMS = ["what if", "my goals", "zero mistakes", "puzzle pieces", "top down", "bottom up", "sophisticated", "magical", "decision framework", "full situational awareness", "multi-tier", "multi-resolution"]
CLASS_SUFFIXES = "Extractor|Builder|Analyzer|Pipeline|Generator|Tracker|Reader|Router|Chunker"


def ladder(steps: list[tuple[str, list[str]]], low: Column, rest: str | None) -> Column:
    out = None
    for name, words in steps:
        out = (F if out is None else out).when(T.any_of(words, low), name)
    return out.otherwise(F.lit(rest).cast("string"))


def frustration_level(phrases: list = FRUSTRATION) -> Column:
    """0 to 5 from capitals, profanity, exclamation marks, interventions, repeats and phrases."""
    low, caps, marks = F.lower("content"), F.col("caps_ratio"), F.col("exclamations")
    points = F.when(caps > 0.8, 3).when(caps > 0.4, 2).when(caps > 0.2, 1).otherwise(0) + F.when(F.col("profanity"), 2).otherwise(0) + F.when(marks > 5, 2).when(marks > 2, 1).otherwise(0)
    repeats = T.repeats(F.col("content"))
    points = points + F.col("emergency").cast("int") + F.when(repeats > 3, 2).when(repeats > 1, 1).otherwise(0)
    for words, n in phrases:
        points = points + F.when(T.any_of(words, low), n).otherwise(0)
    return F.least(points, F.lit(5))


def deception() -> Column:
    """An assistant message with two signs of unfounded completeness, or many failures and a claim of completion."""
    low = F.lower("content")
    signs = F.when(low.contains("comprehensive") & low.contains("all") & low.contains("complete"), 1).otherwise(0) + T.found(r"100%|everything.*fixed|all.*resolved", low).cast("int") + (F.col("overconfident") & (F.col("upset_score") > 1)).cast("int")
    return (F.col("role") == "assistant") & (((F.col("n_failure") > 5) & T.any_of(["complete", "done", "all fixed"], low)) | (signs >= 2))


def markers(level: Column, deceives: Column) -> Column:
    low, user = F.lower("content"), F.col("role") == "user"
    failure = (F.col("n_failure") >= 5) | (T.any_of(FAILURES, low) & (F.col("role") == "assistant"))
    gem = user & ~low.contains("session is being continued") & T.any_of(GEMS, low)
    return F.struct(((F.col("n_pivot") >= 3) | T.any_of(PIVOTS, low)).alias("is_pivot"), failure.alias("is_failure"), ((F.col("n_breakthrough") >= 2) | T.any_of(BREAKTHROUGHS, low)).alias("is_breakthrough"), gem.alias("is_ignored_gem"), deceives.alias("deception_detected"), level.alias("frustration_level"))


def software() -> Column:
    low = F.lower("content")
    deleted = F.filter("files", lambda f: low.contains(F.concat(F.lit("removed "), f)) | low.contains(F.concat(F.lit("deleted "), f)) | low.contains(F.concat(F.lit("delete "), f)))
    modified = F.slice(F.array_union("files_edit", F.array_except(F.array_except("files", "files_create"), deleted)), 1, 10)
    return F.struct(F.col("files_create").alias("created"), modified.alias("modified"), deleted.alias("deleted"))


def code_blocks() -> Column:
    named = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(r"`(\w+(?:\.\w+)*\(\))`"), F.lit(1)), F.regexp_extract_all("content", F.lit(rf"`(\w+(?:{CLASS_SUFFIXES}))`"), F.lit(1))))
    return F.struct(ladder(CODE_ACTIONS, F.lower("content"), "referenced").alias("action"), F.slice(named, 1, 8).alias("blocks"), T.count(r"(?s)```(?:\w+)?\n.*?```", F.col("content")).alias("n"))


def plans() -> Column:
    item = lambda marks: F.transform(F.slice(F.regexp_extract_all("content", F.lit(rf"[{marks}]\s*([^\n]+)"), F.lit(1)), 1, 5), lambda x: F.substring(F.trim(x), 1, 80))
    refs = lambda p: F.array_join(F.slice(F.regexp_extract_all("content", F.lit(p), F.lit(1)), 1, 5), ", ")
    task, phase = F.nullif(refs(r"[Tt]ask\s*#?(\d+)"), F.lit("")), F.nullif(refs(r"[Pp]hase\s*(\d+)"), F.lit(""))
    said = F.nullif(F.concat_ws("; ", F.concat(F.lit("Tasks "), task, F.lit(" referenced")), F.concat(F.lit("Phases "), phase)), F.lit(""))
    return F.struct((F.col("n_plan") > 0).alias("detected"), said.alias("content"), item("✅✓").alias("completed"), item("❌⬜☐").alias("pending"))


def ideas() -> Column:
    """The idea of a user message and how it evolves; of an assistant message, its reading of the user's goal."""
    content, low = F.col("content"), F.lower("content")
    evolution = ladder(IDEAS, low, None)
    goal = F.trim(F.regexp_extract(content, r"[Ii]\s*(?:want|need)\s+(.+?)(?:\.|!|\n|$)", 1))
    idea = F.when((evolution == "expressing_goal") & (goal != ""), goal).when(evolution == "context_recovery", "Session continuation").otherwise(F.nullif(content, F.lit("")))
    read = F.substring(F.trim(F.regexp_extract(content, r"[Yy]our\s+(?:goal|vision|intent|actual goal)[:\s]+(.+?)(?:\.|!|\n)", 1)), 1, 150)
    user, reads = F.col("role") == "user", (F.col("role") != "user") & (read != "")
    return F.struct(F.when(user, idea).when(reads, F.concat(F.lit("Interprets user goal: "), read)).alias("idea"), F.when(user, evolution).when(reads, "interpreted").alias("evolution"))


def response() -> Column:
    low = F.lower("content")
    poor = (F.col("overconfident") & (F.col("n_failure") > 3)) | F.col("rushes") | F.col("ignores_context") | ((F.col("n_failure") > 5) & low.contains("complete"))
    quality = F.when(poor, "poor").when((F.col("n_frustration") > 2) | (F.col("n_failure") > 2), "adequate").otherwise("good")
    assistant = F.col("role") == "assistant"
    return F.struct(F.when(assistant, ladder(RESPONSES, low, "responded")).alias("action"), F.when(assistant, quality).alias("quality"), F.when(assistant, ladder(PITCHES, low, None)).alias("pitch"))


def reactions() -> Column:
    low, caps = F.lower("content"), F.col("caps_ratio")
    kind = F.when((caps > 0.8) | (F.col("profanity") & (caps > 0.3)), "rage").when(F.col("profanity"), "angry").when(caps > 0.3, "emphatic")
    for name, words in REACTIONS:
        kind = kind.when(T.any_of(words, low), name)
    kind = kind.when(low.contains("continue") & low.contains("session"), "session_continuation").when(low.contains("?"), "questioning").otherwise("neutral")
    conceding = F.when(low.contains("you're right") | low.contains("you're absolutely right"), "conceding").when(low.contains("i apologize"), "apologizing")
    to = F.when(conceding == "conceding", "user correction").when(conceding == "apologizing", "user frustration or previous error")
    user = F.col("role") == "user"
    return F.struct(F.when(user, kind).otherwise(conceding).alias("type"), F.when(user, ladder(TRIGGERS, low, None)).otherwise(to).alias("to"))


def extract(flagged: DataFrame) -> DataFrame:
    """session_id, idx, role, content and a struct for each thread and for the markers; protocol rows are left out.

    A gem counts as ignored unless the next message is the assistant's and has half of the user's first five long words.
    """
    rows = flagged.where("not is_protocol")
    out = rows.select("session_id", "idx", "role", "content", software().alias("software"), code_blocks().alias("code"), plans().alias("plans"), ideas().alias("ideas"), response().alias("response"), reactions().alias("reactions"), markers(frustration_level(), deception()).alias("markers"))
    following = W.partitionBy("session_id").orderBy("idx")
    terms = F.slice(F.filter(F.split(F.lower("content"), r"\s+"), lambda w: F.length(w) > 5), 1, 5)
    answer = F.lower(F.lead("content").over(following))
    met = F.size(F.filter(terms, lambda t: answer.contains(t)))
    addressed = (F.lead("role").over(following) == "assistant") & (F.size(terms) > 0) & (met >= F.size(terms) * 0.5)
    return out.withColumn("markers", F.col("markers").withField("is_ignored_gem", F.col("markers.is_ignored_gem") & ~F.coalesce(addressed, F.lit(False))))


def entries(threads: DataFrame) -> DataFrame:
    """session_id, category, msg_index, content, significance, evolution: one row for each category that a message adds to."""
    m = F.col("markers")
    high = lambda cond: F.when(cond, "high").otherwise("medium")
    joined = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    reaction, code, plan, reply = F.col("reactions"), F.col("code"), F.col("plans"), F.col("response")
    tags = F.array_join(F.array_compact(F.array(F.when(m["is_pivot"], "PIVOT"), F.when(m["is_failure"], "FAILURE"), F.when(m["is_breakthrough"], "BREAKTHROUGH"))), ", ")
    poor = F.coalesce((F.col("role") == "assistant") & (reply["quality"] == "poor"), F.lit(False))
    behavior = F.when(poor, F.concat(reply["action"], F.lit(" (quality: "), reply["quality"], F.lit(")"), F.when(m["deception_detected"], " [DECEPTION]").otherwise(""))).when(tags != "", F.concat(F.lit("["), tags, F.lit("] "), F.coalesce(reply["action"], F.col("role"))))
    some = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f" | {label}: "), F.array_join(F.slice(c, 1, 3), ", "))).otherwise("")
    none = F.lit(None).cast("string")
    found = {
        "ideas": (F.substring(F.nullif(F.col("ideas.idea"), F.lit("")), 1, 500), high(m["is_ignored_gem"]), F.col("ideas.evolution")),
        "reactions": (F.when(reaction["type"] != "neutral", F.concat_ws(": ", reaction["type"], reaction["to"])), high(reaction["type"].isin("rage", "angry")), none),
        "software": (F.nullif(F.concat_ws("; ", joined("Created", F.col("software.created")), joined("Modified", F.slice("software.modified", 1, 5)), joined("Deleted", F.col("software.deleted"))), F.lit("")), high(F.size("software.created") > 0), none),
        "code": (F.when((F.size(code["blocks"]) > 0) | (code["n"] > 0), F.concat(F.concat_ws(": ", code["action"], F.nullif(F.array_join(code["blocks"], ", "), F.lit(""))), F.when(code["n"] > 0, F.format_string(" (%d code blocks)", code["n"])).otherwise(""))), high(code["action"].isin("created", "fixed")), none),
        "plans": (F.when(plan["detected"], F.concat(F.coalesce(plan["content"], F.lit("Plan detected")), some(plan["completed"], "Done"), some(plan["pending"], "Pending"))), F.lit("high"), none),
        "behavior": (behavior, F.lit("high"), none),
    }
    each = F.array(*(F.struct(F.lit(k).alias("category"), c.alias("content"), s.alias("significance"), e.alias("evolution")) for k, (c, s, e) in found.items()))
    return threads.select("session_id", F.col("idx").alias("msg_index"), F.explode(F.filter(each, lambda x: x["content"].isNotNull())).alias("x")).select("session_id", "x.category", "msg_index", "x.content", "x.significance", "x.evolution")


def summary(threads: DataFrame) -> DataFrame:
    """One row a session: markers, the frustration histogram, response quality and reactions."""
    m = F.col("markers")
    return threads.groupBy("session_id").agg(
        F.count("*").alias("messages"), *(F.count_if(m[k]).alias(k) for k in ("is_pivot", "is_failure", "is_breakthrough", "is_ignored_gem", "deception_detected")), *(F.count_if(m["frustration_level"] == k).alias(f"frustration_{k}") for k in range(6)),
        *(F.count_if(F.col("response.quality") == q).alias(f"quality_{q}") for q in ("good", "adequate", "poor")), F.count_if(F.coalesce(F.col("reactions.type"), F.lit("neutral")) != "neutral").alias("reactions"), F.count_if("plans.detected").alias("plans"),
    )


def evidence_labels(content: Column, role: Column) -> Column:
    """What a message shows in a debugging sequence."""
    low = F.lower(content)
    return F.when(low.rlike(r"error|exception|traceback|failed"), "ERROR").when(low.rlike(r"\bfix(?:ed|ing)?\b|resolved"), "FIX").when(low.rlike(r"\bedit(?:ed)?\b|modified|updated"), "EDIT").when(low.rlike(r"\bworks?\b|passed|success"), "OK").when(content.contains("```"), "CODE").when(low.rlike(r"architect|design|structure"), "ARCH").otherwise("MSG")


def file_events(content: Column) -> Column:
    low = F.lower(content)
    return F.when(low.rlike(r"\bcreat(?:e|ed|ing)\b|new file"), "CREATE").when(low.rlike(r"\bdelet(?:e|ed|ing)\b|removed"), "DELETE").when(low.rlike(r"\brenam(?:e|ed|ing)\b"), "RENAME").when(low.rlike(r"\b(?:edit|modif|updat|chang)"), "MODIFY").otherwise("MENTION")


