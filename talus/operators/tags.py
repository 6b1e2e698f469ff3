"""Message tags: action, confidence, emotion, intent, friction and decision, each an ordered ladder of rules.

The input is an enriched table (messages.enrich, then behavior.flags for the flags of assistant messages).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def _ladder(steps: list[tuple[Column, str]], rest: Column) -> Column:
    out = None
    for cond, name in steps:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(rest)


def _low(low: Column | None) -> Column:
    return F.lower("content") if low is None else low


def _n(name: str) -> Column:
    return F.col(f"n_{name}")


def action(lex: dict = L.ACTION, low: Column | None = None) -> Column:
    low, user = _low(low), F.col("role") == "user"
    says = {k: T.any_of(v, low) for k, v in lex.items()}
    creating = F.size("files_create") > 0
    steps = [
        (says["reverted"], "reverted"), (says["abandoned"] | (_n("pivot") >= 3), "abandoned"), (says["decided"] | ((_n("pivot") >= 1) & (_n("plan") >= 1)), "decided"), (says["discovered"], "discovered"),
        (F.col("error") | F.col("traceback") | (_n("failure") >= 2) | says["debugged"], "debugged"), (says["refactored"], "refactored"),
        ((F.col("code_block") & creating) | (says["created"] & (F.col("code_block") | (_n("code") >= 10))), "created"), ((F.size("files_edit") > 0) | says["modified"], "modified"),
        ((_n("architecture") >= 4) & (_n("code") >= 10), "created"), (_n("code") >= 5, "modified"), (user & (F.col("questions") >= 2), "discovered"), (user, "decided"), ((_n("architecture") >= 2) | (_n("plan") >= 2), "discovered"),
    ]
    return _ladder(steps, F.lit("modified"))


def confidence(lex: dict = L.CONFIDENCE, low: Column | None = None) -> Column:
    low = _low(low)
    steps = [(T.any_of(words, low), name) for name, words in lex.items()]
    steps += [(F.col("overconfident"), "working"), (F.col("confusion") | F.col("assumptions"), "tentative"), (F.col("error") | (_n("failure") >= 2), "fragile"), (_n("code") >= 15, "working")]
    return _ladder(steps, F.lit("tentative"))


def emotion(lex: dict = L.EMOTION, low: Column | None = None) -> Column:
    low, user, caps, bad = _low(low), F.col("role") == "user", F.col("caps_ratio"), F.col("profanity")
    says = {k: T.any_of(v, low) for k, v in lex.items()}
    steps = [
        (bad | F.col("emergency") | (caps > 0.5) | (_n("frustration") >= 3), "frustrated"), (((F.col("exclamations") >= 2) & says["excited"]) | (low.contains("love") & user), "excited"), (says["relieved"] & ~bad, "relieved"),
        (says["confident"] | F.col("overconfident"), "confident"), (says["cautious"], "cautious"), (((F.col("questions") >= 3) & user) | says["uncertain"] | F.col("confusion"), "uncertain"),
        (says["curious"] | ((_n("architecture") >= 3) & ~bad), "curious"), (user & (caps > 0.15), "frustrated"), (user & (F.col("questions") >= 1), "curious"),
    ]
    return _ladder(steps, F.lit("confident"))


def intent(lex: dict = L.INTENT, low: Column | None = None) -> Column:
    low = _low(low)
    says = {k: T.any_of(v, low) for k, v in lex.items()}
    steps = [
        (F.col("error") | F.col("traceback") | (_n("failure") >= 3) | (says["bugfix"] & ~says["not_bugfix"]), "bugfix"), (says["cleanup"], "cleanup"), (says["exploration"] | (_n("architecture") >= 4), "exploration"), (says["correctness"], "correctness"),
        (says["maintainability"], "maintainability"), (says["performance"], "performance"), (says["feature"] | (_n("plan") >= 3) | (_n("code") >= 10), "feature"),
    ]
    return _ladder(steps, F.lit("exploration"))


# --- fixed values: flags that a friction names, in order, and what it calls them
FRICTION_FLAGS = {
    "confusion": "confusion", "forgetting": "forgetting", "assumptions": "assumptions", "contradicts_self": "contradicts", "apologizes": "apologizes", "rushes": "rushing", "overconfident": "overconfident",
    "ignores_context": "ignores_context", "repeats_failed": "repeats_failed", "unsolicited_addition": "unsolicited_addition", "premature_completion": "premature_completion", "batch_without_verify": "batch_without_verify",
    "silent_decision": "silent_decision", "hollow_fulfillment": "hollow_fulfillment", "unverified_claim": "unverified_claim", "scope_creep": "scope_creep", "acknowledges_mistake": "acknowledges_mistake",
}


def friction() -> Column:
    """A sentence about what went wrong, or null."""
    readable = F.trim(F.replace(F.trim(F.col("content")), F.lit("\n"), F.lit(" ")))
    flagged = F.array_join(F.array_compact(F.array(*(F.when(F.col(k), name) for k, name in FRICTION_FLAGS.items()))), ", ")
    upset = (F.col("role") == "user") & ((F.col("caps_ratio") > 0.3) | F.col("profanity") | F.col("emergency")) & (readable != "")
    out = F.when(upset, F.concat(F.lit("User frustration: "), readable))
    out = out.when(F.col("error") | F.col("traceback"), F.when(F.size("error_types") > 0, F.concat(F.lit("Encountered "), F.array_join("error_types", ", "), F.lit(" during execution"))).otherwise("Code error encountered during execution"))
    out = out.when(flagged != "", F.concat(F.lit("Assistant exhibited: "), flagged)).when(_n("pivot") >= 2, "Direction changed mid-task, prior work potentially wasted")
    return out.when(_n("failure") >= 3, "Multiple failure signals detected in this message").when(_n("frustration") >= 2, "Frustration signals present in interaction")


# --- fixed values: how decisions are said (group of what was chosen, of what not, of the reason or the reason itself)
DECISIONS = [
    (r"chose\s+(.+?)\s+over\s+(.+?)\s+because\s+(.+?)(?:\.|$)", 1, 2, 3),
    (r"(?:instead of|rather than)\s+(.+?),?\s+(?:use|we|i|go with|chose|pick)\s+(.+?)(?:\.|$)", 2, 1, "stated preference"),
    (r"switch(?:ed)?\s+from\s+(.+?)\s+to\s+(.+?)(?:\.|$)", 2, 1, "migration/upgrade"),
    (r"evolved?\s+from\s+(.+?)\s+to\s+(.+?)(?:\.|$)", 2, 1, "evolution"),
    (r"(?:not|don't|do not)\s+(.+?)\s*[,;]\s*(?:use|do|prefer|want)\s+(.+?)(?:\.|$)", 2, 1, "user preference"),
]


# words that all have to stand, lists of which one each has to stand, and the decision
KNOWN_DECISIONS = [
    (["four_thread", "six_thread"], [], "chose six_thread_extractor over four_thread_extractor because expanded analysis threads"),
    (["v1", "v5"], [["enhance", "incorporate"]], "chose enhancing V1 with V5 capabilities over replacing V1 because V1 actually worked"),
    (["unified_orchestrator"], [["pipeline", "orchestrat"]], "chose unified orchestrator over separate pipelines because need single entry point"),
    (["opus"], [["sonnet", "haiku"], ["only", "not"]], "chose Opus only over tiered models because user mandate for quality"),
]


def decision(rules: list = DECISIONS, known: list = KNOWN_DECISIONS, low: Column | None = None) -> Column:
    """chose X over Y because Z, by the first rule that matches, else a known decision by its words, or null."""
    low, out = _low(low), F.lit(None).cast("string")
    for words, choices, text in reversed(known):
        said = [low.contains(w) for w in words] + [T.any_of(some, low) for some in choices]
        out = F.when(reduce(lambda a, b: a & b, said), text).otherwise(out)
    for pattern, chosen, over, why in reversed(rules):
        part = lambda g, p=pattern: F.trim(F.regexp_extract(low, p, g))
        reason = part(why) if isinstance(why, int) else F.lit(why)
        out = F.when(low.rlike(pattern), F.concat(F.lit("chose "), part(chosen), F.lit(" over "), part(over), F.lit(" because "), reason)).otherwise(out)
    return out


def tag(enriched: DataFrame) -> DataFrame:
    """session_id, idx, role and the tags of each message that isn't protocol."""
    flags = {k: F.lit(False) for k in [*L.BEHAVIOR, *FRICTION_FLAGS] if k not in enriched.columns}
    # a column of its own, so that it is computed once for all rules
    enriched, low = enriched.withColumns(flags).withColumn("low", F.lower("content")), F.col("low")
    return enriched.where("not is_protocol").select("session_id", "idx", "role", action(low=low).alias("action_vector"), confidence(low=low).alias("confidence_signal"), emotion(low=low).alias("emotional_tenor"), intent(low=low).alias("intent_marker"), friction().alias("friction_log"), decision(low=low).alias("decision_trace"))


def distributions(tags: DataFrame) -> DataFrame:
    """dimension, value, n: histograms of four tags, and how many rows have friction and decisions."""
    dims = ["action_vector", "confidence_signal", "emotional_tenor", "intent_marker"]
    pairs = [x for d in dims for x in (F.lit(d), F.col(d))] + [F.lit("friction_log"), F.when(F.col("friction_log").isNotNull(), "present"), F.lit("decision_trace"), F.when(F.col("decision_trace").isNotNull(), "present")]
    return tags.select(F.stack(F.lit(len(dims) + 2), *pairs).alias("dimension", "value")).where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
