"""Behaviour of assistant messages: pattern flags, flags that look at earlier messages, upset scores, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

#: Messages of any role that a flag looks back at; None means all of the session.
CONTEXT = 5


def _before(context: int | None, session: str = "session_id", order: str = "idx"):
    return W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding if context is None else -context, -1)


def long_words(text: Column) -> Column:
    """Distinct words of over 5 letters and nothing else, lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 5) & w.rlike(r"^\p{L}+$")), lambda w: F.lower(w)))


def ignores_context(content: Column, last_user: Column, spoke: Column) -> Column:
    """Under a tenth (and under 3) of the long words of the last user message stand in a message of over 200 characters."""
    asked, said = long_words(last_user), long_words(content)
    few = F.size(F.array_intersect(asked, said)) < F.least(F.lit(3.0), F.size(asked) * 0.1)
    return F.coalesce(spoke & (F.length(content) > 200) & (F.size(asked) > 0) & few, F.lit(False))


def hollow(content: Column) -> Column:
    """Over half, and three at least, of four or more paragraphs of over 50 characters open with the same three words."""
    paragraphs = F.filter(F.transform(F.split(content, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 50)
    openings = F.transform(paragraphs, lambda p: F.array_join(F.slice(F.split(p, r"\s+"), 1, 3), " "))
    most = T.let(openings, lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda o: F.size(F.filter(all_, lambda x: x == o)))))
    return F.coalesce((F.length(content) > 500) & (F.size(paragraphs) >= 4) & (most >= 3) & (most / F.size(paragraphs) > 0.5), F.lit(False))


def flags(messages: DataFrame, context: int | None = CONTEXT) -> DataFrame:
    """messages with a boolean for each flag (false for other roles than assistant) and upset_score."""
    if "thinking" not in messages.columns:
        messages = messages.withColumn("thinking", F.lit(None).cast("string"))
    assistant, content = F.col("role") == "assistant", F.coalesce("content", F.lit(""))
    full = F.concat(F.coalesce("thinking", F.lit("")), F.lit(" "), content)
    low = F.lower(content)
    operations = T.count(L.FILE_OPERATION, content)
    earlier = _before(context)
    fails = T.found(r"(?i)error|failed|doesn't work", content)
    if context is None:
        # no window gathers the texts of a whole session: the last five of the role by lag, failed files by their first failure
        messages = _repeats_failed(messages, content, fails)
        repeats, said = F.col("__repeats"), _last_of_role(low)
    else:
        failed = F.array_distinct(F.flatten(F.collect_list(F.when(fails, T.matches(L.PATTERNS["any_file"], content))).over(earlier)))
        repeats = F.size(F.array_intersect(F.coalesce(failed, F.array().cast("array<string>")), T.matches(L.FILE_OPERATION, content))) > 0
        said = F.slice(F.reverse(F.collect_list(F.when(assistant, low)).over(earlier)), 1, 5)
    own = {name: T.found(f"(?i){pattern}", full if thinks else content) for name, (thinks, _, pattern) in L.BEHAVIOR.items()}
    own["unverified_claim"] = own["unverified_claim"] & ~T.found(L.EVIDENCE, content)
    spoke = F.coalesce(F.max(assistant.cast("int")).over(earlier), F.lit(0)) > 0
    last_user = F.last(F.when(F.col("role") == "user", content), ignorenulls=True).over(earlier)
    own |= {
        "rushes": (F.length("thinking") > 0) & (F.length("thinking") < 100) & (F.length(content) > 500), "asks_questions": content.contains("?") & T.any_of(L.QUESTION_PHRASES, low), "batch_without_verify": (operations >= 3) & ~T.found(L.VERIFY, content), "hollow_fulfillment": hollow(content),
        "contradicts_self": spoke & (T.found(L.SELF_CORRECTION, low) | _contradicts(low, said)), "repeats_failed": repeats, "ignores_context": ignores_context(content, last_user, spoke),
    }
    out = messages.withColumns({k: F.coalesce(assistant & v, F.lit(False)) for k, v in own.items()}).drop("__repeats")
    weights = {k: w for k, (_, w, _) in L.BEHAVIOR.items()} | L.OTHER_UPSET
    return out.withColumn("upset_score", F.greatest(F.lit(0), sum((F.col(k).cast("int") * w for k, w in weights.items() if w), F.lit(0))))


def _last_of_role(low: Column, n: int = 5) -> Column:
    """The last n texts of the same role in the session, nearest first."""
    own = W.partitionBy("session_id", "role").orderBy("idx")
    return F.array_compact(F.array(*(F.lag(low, k).over(own) for k in range(1, n + 1))))


def _repeats_failed(messages: DataFrame, content: Column, fails: Column) -> DataFrame:
    """messages with __repeats: whether a message works on a file that an earlier one of its session names beside a failure."""
    first = messages.where(fails).select("session_id", "idx", F.explode(T.matches(L.PATTERNS["any_file"], content)).alias("__file"))
    first = first.groupBy("session_id", "__file").agg(F.min("idx").alias("__first"))
    done = messages.where("role = 'assistant'").select("session_id", "idx", F.explode(T.matches(L.FILE_OPERATION, content)).alias("__file"))
    again = done.join(first, ["session_id", "__file"]).where("__first < idx").select("session_id", "idx", F.lit(True).alias("__repeats")).distinct()
    return messages.join(again, ["session_id", "idx"], "left")


def _contradicts(low: Column, said: Column) -> Column:
    """Something that worked (was complete) in the last five assistant messages does not now."""
    items = lambda p: F.flatten(F.transform(said, lambda t: F.regexp_extract_all(t, F.lit(p), F.lit(1))))
    quoted = lambda x, rest: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"), F.lit(rest))
    broken = F.exists(items(r"(\w+(?:\.\w+)?)\s+(?:works?|is working|is functional)"), lambda x: F.regexp_like(low, quoted(x, r"\s+(?:doesn'?t|does not|isn'?t|is not)\s+work")))
    undone = F.exists(items(r"(\w+(?:\.\w+)?)\s+(?:is )?(?:complete|done|finished)"), lambda x: F.regexp_like(low, quoted(x, r"\s+(?:(?:is )?(?:not |in)complete|(?:still )?needs?)")))
    return broken | undone


def by_session(flagged: DataFrame, damage: int = 5) -> DataFrame:
    """One row a session: how often each flag stands, mean upset score, indices of harmful messages."""
    names = [*L.BEHAVIOR, *L.OTHER_UPSET]
    spoken = flagged.where("role = 'assistant'")
    return spoken.groupBy("session_id").agg(F.count("*").alias("analyzed"), *(F.count_if(k).alias(k) for k in names), F.avg("upset_score").alias("average_upset"), F.sort_array(F.collect_list(F.when(F.col("upset_score") >= damage, F.col("idx")))).alias("harmful"))


def before_events(events: DataFrame, anchors: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    """anchor, rank and row of the last n rows of events before each row of anchors with the same key.

    Events and anchors are put in one sequence by key, so each row is read once, whatever lies between.
    """
    cols = [c for c in events.columns if c not in (key,)]
    row = events.select(key, F.col(order).alias("__at"), F.struct(*cols).alias("row"), F.lit(None).cast(dict(anchors.dtypes)[order]).alias("anchor"))
    mark = anchors.select(key, F.col(order).alias("__at"), F.lit(None).cast(row.schema["row"].dataType).alias("row"), F.col(order).alias("anchor"))
    both = row.unionByName(mark)
    order = W.partitionBy(key).orderBy(F.col("__at"), F.col("anchor").isNull())  # an anchor comes before the rows of its own time
    seq = both.withColumn("__seen", F.count("row").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = seq.where("row is not null").select(key, F.col("__seen").alias("__no"), "row")
    marks = seq.where("anchor is not null").select(key, "anchor", F.explode(F.sequence(F.greatest(F.col("__seen") - n + 1, F.lit(1)), F.greatest(F.col("__seen"), F.lit(1)))).alias("__no"), "__seen").where("__seen > 0")
    return marks.join(rows, [key, "__no"]).select(key, "anchor", (F.col("__seen") - F.col("__no") + 1).cast("int").alias("rank"), "row")


# --- fixed values: tactics against each flag
TACTICS = {"ignores_context": "Restate the request", "unverified_claim": "Ask for evidence", "premature_completion": "Ask for a test run", "scope_creep": "Limit the scope", "silent_decision": "Ask for options", "batch_without_verify": "Verify each step", "overconfident": "Ask for evidence", "assumptions": "Ask for assumptions", "repeats_failed": "Ask for another approach"}


def alerts(flagged: DataFrame, tactics: dict = TACTICS, levels: tuple = ((8, "CRITICAL"), (5, "WARNING"), (3, "CAUTION"), (1, "WATCH"))) -> DataFrame:
    """session_id, idx, risk, level, tactics of assistant messages with any risk (a point for each flag, two for the gravest)."""
    risk = sum((F.col(k).cast("int") * (2 if k in ("ignores_context", "repeats_failed") else 1) for k in tactics), F.lit(0))
    level = F.lit(None).cast("string")
    for least, name in reversed(levels):
        level = F.when(F.col("risk") >= least, name).otherwise(level)
    out = flagged.where("role = 'assistant'").withColumn("risk", risk).where("risk > 0")
    return out.select("session_id", "idx", "risk", level.alias("level"), F.array_distinct(F.array_compact(F.array(*(F.when(F.col(k), t) for k, t in tactics.items())))).alias("tactics"))
