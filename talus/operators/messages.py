"""Messages: protocol detection, features, filter tiers, the enriched table and its session statistics.

A messages table has session_id, idx, role, content; ts, thinking and model are used where they exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

TIERS = {1: "SKIP", 2: "BASIC", 3: "STANDARD", 4: "PRIORITY"}


def with_index(lines: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """idx: the ordinal of a retained message in its session, from 0."""
    return lines.withColumn("idx", F.row_number().over(W.partitionBy(session).orderBy(*order)) - 1)


def protocol_type(content: Column) -> Column:
    """The kind of system-made message, or null: empty, tagged, continued, skill text, relayed, in this order."""
    out = F.when(F.coalesce(F.trim(F.regexp_replace(content, r"\s+", " ")), F.lit("")) == "", "empty_wrapper")
    for tag in L.PROTOCOL_TAGS:
        out = out.when(content.rlike(rf"(?s)<{tag}>.*?</{tag}>"), tag.replace("-", "_"))
    out = out.when(T.any_of(L.CONTINUATION, content), "clear_continuation")
    out = out.when(content.contains(L.SKILL[0]) & content.contains(L.SKILL[1]), "skill_injection")
    return out.when(T.any_of(L.RELAY, content), "subagent_relay")


def score(counts: dict[str, Column], families: dict = L.SIGNALS) -> Column:
    return sum((counts[k] * w for k, (w, _) in families.items()), F.lit(0))


def tier(length: Column, signal_score: Column, pasted: Column | None = None) -> tuple[Column, Column]:
    """(score with bonuses, tier 1 to 4). The bonuses for length and pasted content count in every test."""
    pasted = F.lit(False) if pasted is None else F.coalesce(pasted, F.lit(False))
    total = signal_score + F.when(pasted, 5).otherwise(0) + F.when(length >= 500, 3).when(length >= 200, 1).otherwise(0)
    level = F.when((length < 50) & (total == 0) & ~pasted, 1).when((length >= 500) | (total >= 6) | (pasted & (total >= 3)), 4)
    return total, level.when((length >= 100) | (total >= 3) | pasted, 3).when(total >= 1, 2).otherwise(1)


def content_referential(content: Column, role: Column, counts: dict[str, Column]) -> Column:
    """Whether the signals are about the content rather than the session."""
    low, size = F.lower(content), F.length(content)
    assistant, failure, frustration = role == "assistant", counts["failure"], counts["frustration"]
    some = sum(counts.values(), F.lit(0)) > 0
    rules = (
        (assistant & (T.how_many_of(L.ANALYSIS_WORDS, low) >= 2) & (size > 500))
        | (((failure > 20) | (frustration > 10)) & (size > 1000))
        | ((failure >= 3) & (counts["architecture"] >= 3) & (size > 500))
        | (assistant & ((failure >= 1) | (frustration >= 1)) & (T.how_many_of(L.POSITIVE_WORDS, low) >= 2) & (size > 300))
    )
    return F.coalesce(some & rules, F.lit(False))


def emergency(content: Column, caps: Column, exclamations: Column, repeated: Column | None = None) -> tuple[Column, Column]:
    """(is an emergency intervention, reason): an intervention with urgency, or a phrase repeated three times."""
    repeated = T.repeated(content) if repeated is None else repeated
    said = F.lower(F.regexp_extract(content, T.ascii_edges(L.EMERGENCY), 0))
    urgent = (said != "") & ((caps > 0.4) | (exclamations >= 2))
    reasons = [F.when(T.any_of(words, said), name) for name, words in L.EMERGENCY_REASONS]
    reasons += [F.when(caps > 0.4, "CAPS"), F.when(exclamations >= 2, F.concat(exclamations.cast("string"), F.lit("!")))]
    reason = F.array_join(F.array_compact(F.array(*reasons)), ",")
    return F.coalesce(repeated.isNotNull() | urgent, F.lit(False)), F.when(repeated.isNotNull(), F.concat(F.lit("REPEAT:"), repeated)).when(urgent, F.when(reason == "", "intervention").otherwise(reason))


def enrich(messages: DataFrame, repeated: Callable[[Column], Column] = T.repeated) -> DataFrame:
    """messages with all features, flags and tiers; protocol rows get tier 1, score 0 and no emotions. repeated: the phrase of a text that stands three times in a row."""
    have = messages.columns
    for c, kind in (("ts", "timestamp"), ("thinking", "string"), ("model", "string"), ("pasted", "boolean")):
        if c not in have:
            messages = messages.withColumn(c, F.lit(None).cast(kind))
    text, encoded = T.collapse_char_per_line(F.coalesce("content", F.lit("")))
    df = messages.withColumns({"content_length_raw": F.length("content"), "was_char_encoded": encoded, "content": text})
    content = F.col("content")
    p, m = L.PATTERNS, T.matches
    df = df.withColumns({
        "content_length": F.length(content), "content_hash": T.content_hash(content), "protocol_type": protocol_type(content), "hour": F.hour("ts"), "day_name": T.estimate_day_name(F.col("ts")),
        **{f"n_{k}": v for k, v in T.signal_counts(content).items()},
        "caps_ratio": T.caps_ratio(content), "exclamations": T.occurrences("!", content), "questions": T.occurrences("?", content), "profanity": T.found(p["profanity"], content),
        "images": T.count(p["image"], content), "code_block": content.contains("```"), "code_langs": F.filter(F.regexp_extract_all(content, F.lit(p["code_block"]), F.lit(1)), lambda x: x != ""),
        "files": m(p["any_file"], content), "paths": m(p["file_path"], content), "error": T.found(p["error"], content), "error_types": m(p["error_type"], content), "traceback": T.found(p["traceback"], content),
        "browser_open": T.found(p["browser"], content), "server_command": T.found(p["server"], content), "server_issue": T.found(p["server_issue"], content),
        "ports": F.array_sort(F.array_distinct(F.transform(F.concat(m(p["port_host"], content), m(p["port_equal"], content)), lambda x: x.cast("int")))),
        "terminal_paste": T.found(p["terminal_paste"], content), "terminal_sessions": m(p["terminal_session"], content), "scripts_run": m(p["script"], content), "terminal_mentions": T.count(p["terminal_mention"], content),
        "files_create": F.array_union(m(p["create_1"], content), m(p["create_2"], content)), "files_open": m(p["open"], content), "files_edit": F.array_union(m(p["edit"], content), m(p["edit_in"], content)), "tools": m(p["tool"], content),
        "has_thinking": F.coalesce(F.col("thinking") != "", F.lit(False)), "thinking_length": F.coalesce(F.length("thinking"), F.lit(0)),
    })
    counts = {k: F.col(f"n_{k}") for k in L.SIGNALS}
    is_emergency, reason = emergency(content, F.col("caps_ratio"), F.col("exclamations"), repeated(content))
    total, level = tier(F.col("content_length"), score(counts), F.col("pasted"))
    referential = content_referential(content, F.col("role"), counts)
    df = df.withColumns({"is_protocol": F.col("protocol_type").isNotNull(), "emergency": is_emergency, "emergency_reason": reason, "filter_score": total, "filter_tier": level, "content_referential": referential})
    protocol = F.col("is_protocol")
    demoted = F.col("error") & (F.col("content_referential") | ((F.col("content_length") > 500) & (F.coalesce("model", F.lit("")) != "<synthetic>")))
    return df.withColumns({
        "filter_tier": F.when(protocol, 1).otherwise(F.col("filter_tier")), "filter_score": F.when(protocol, 0).otherwise(F.col("filter_score")),
        "error_context": F.when(protocol, "protocol_recap").when(demoted, "mentioned_not_encountered"), "error": F.col("error") & ~protocol & ~demoted,
        "profanity": F.col("profanity") & ~protocol, "caps_ratio": F.when(protocol, 0.0).otherwise(F.col("caps_ratio")), "emergency": F.col("emergency") & ~protocol,
        "signals": T.format_signals(counts), "repeated": repeated(content),
    }).withColumn("filter_tier_name", F.when(protocol, "skip").otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("filter_tier"))))


def session_stats(enriched: DataFrame) -> DataFrame:
    """One row a session: counts by role and tier, human and protocol rows, errors, peaks and interventions, ordered."""
    human = ~F.col("is_protocol") & (F.col("role") == "user")
    peak = human & ((F.col("caps_ratio") > 0.3) | F.col("profanity") | (F.col("exclamations") >= 5))
    listed = lambda cond, *cols: F.sort_array(F.collect_list(F.when(cond, F.struct(*cols))))
    return enriched.groupBy("session_id").agg(
        F.count("*").alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.count_if("is_protocol").alias("protocol_messages"), F.count_if(human).alias("human_messages"),
        *(F.count_if(F.col("filter_tier") == k).alias(f"tier_{k}") for k in TIERS), F.count_if("error").alias("errors"), F.count_if("was_char_encoded").alias("char_encoded"), F.sum(F.when(~F.col("is_protocol"), F.col("content_length"))).alias("characters"),
        listed(peak, "idx", "caps_ratio").alias("frustration_peaks"), listed(F.col("emergency") & human, "idx", "emergency_reason").alias("emergency_interventions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


# --- fixed values: names that stand for any file
GENERIC_FILES = [
    "file.py", "mentioned.py", "other_file.py", "filename.py", "example.py", "test.py", "main.py", "script.py", "module.py", "utils.py", "helper.py", "config.py", "setup.py", "run.py", "app.py", "index.js", "index.html", "style.css",
    "styles.css", "file.txt", "data.json", "output.json",
]


def file_mentions(enriched: DataFrame, generic: list[str] = GENERIC_FILES, short: int = 12) -> DataFrame:
    """session_id, file, n: messages that name a file, without generic names and short ones that are part of another name of the session."""
    named = enriched.where("not is_protocol").select("session_id", F.explode("files").alias("file")).groupBy("session_id", "file").agg(F.count("*").alias("n"))
    other = named.select("session_id", F.col("file").alias("longer"))
    named = named.where(~F.lower("file").isin(generic))
    base = F.length(F.regexp_replace("file", r"\.[^.]*$", ""))
    return named.join(other, (named.session_id == other.session_id) & (base <= short) & F.col("longer").contains(F.col("file")) & (F.col("longer") != F.col("file")), "left_anti")


def top_files(mentions: DataFrame, k: int = 30) -> DataFrame:
    """The k files of each session that most messages name, with rank."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("n").desc(), "file"))
    return mentions.withColumn("rank", rank).where(F.col("rank") <= k)


def tier_examples(enriched: DataFrame, k: int = 3, characters: int = 100) -> DataFrame:
    """session_id, filter_tier, examples: the beginnings of the first k messages of each tier."""
    rank = F.row_number().over(W.partitionBy("session_id", "filter_tier").orderBy("idx"))
    first = enriched.select("session_id", "filter_tier", "idx", F.substring("content", 1, characters).alias("preview")).withColumn("r", rank).where(F.col("r") <= k)
    return first.groupBy("session_id", "filter_tier").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "preview"))), lambda x: x["preview"]).alias("examples"))


def subsets(enriched: DataFrame) -> dict[str, DataFrame]:
    """The selections that later stages read, all off one table."""
    tier_, user = F.col("filter_tier"), F.col("role") == "user"
    return {"tier_2_up": enriched.where(tier_ >= 2), "tier_4": enriched.where(tier_ == 4), "user_tier_2_up": enriched.where(user & (tier_ >= 2)), "unprotected": unique_content(enriched.where("not is_protocol"))}


def unique_content(messages: DataFrame, key: str = "content_hash", order: tuple[str, ...] = ("session_id", "idx"), within: tuple[str, ...] = ("session_id",), longer_than: int = 10) -> DataFrame:
    """messages without later copies; contents of longer_than characters or fewer stay."""
    rank = F.row_number().over(W.partitionBy(*within, key).orderBy(*order))
    return messages.withColumn("__rank", rank).where((F.col("__rank") == 1) | (F.length("content") <= longer_than)).drop("__rank")


def batches(messages: DataFrame, size: int = 30, session: str = "session_id", order: str = "idx") -> DataFrame:
    """batch, from 0, of size rows each in order of a session."""
    return messages.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(session).orderBy(order)) - 1) / size).cast("int"))


def token_batches(messages: DataFrame, budget: int, most: int = 40) -> DataFrame:
    """session_id, idx, batch: a batch ends before the message that would exceed the budget of tokens, or at most messages.

    A fold over a session in order; a session is the bounded group here (its messages' sizes, not their texts, are
    what the task holds).
    """
    import pandas as pd

    sizes = messages.select("session_id", "idx", T.token_estimate(F.col("content")).alias("tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        out, batch, used, n = [], 0, 0, 0
        for t in pdf.tokens:
            if n and (used + t > budget or n >= most):
                batch, used, n = batch + 1, 0, 0
            out.append(batch)
            used, n = used + t, n + 1
        return pdf.assign(batch=out)[["session_id", "idx", "batch"]]

    return sizes.groupBy("session_id").applyInPandas(run, f"session_id {dict(messages.dtypes)['session_id']}, idx {dict(messages.dtypes)['idx']}, batch int")


def subagents(messages: DataFrame) -> DataFrame:
    """session_id, is_subagent, agent_id, agent_type: by the id, the source file's name, then the first five messages."""
    low = F.lower(T.collapse_char_per_line(F.coalesce("content", F.lit("")))[0])
    first = F.col("idx") < 5
    kind = F.when(low.contains("hello memory agent"), "memory_agent").when(low.contains("<observed_from_primary"), "observer_agent").when(low.contains("progress summary checkpoint") & (F.col("role") == "user"), "memory_agent")
    file = F.max("source_file") if "source_file" in messages.columns else F.max(F.lit(None).cast("string"))
    seen = messages.groupBy("session_id").agg(F.min_by(kind, F.when(first & kind.isNotNull(), F.col("idx"))).alias("said"), file.alias("file"))
    own = lambda c: F.when(c.contains("_agent-"), F.split_part(c, F.lit("_agent-"), F.lit(2))).when(c.startswith("agent-"), F.replace(c, F.lit("agent-"), F.lit("")))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    by_id, by_file = own(F.col("session_id").cast("string")), own(stem)
    return seen.select("session_id", (by_id.isNotNull() | by_file.isNotNull() | F.col("said").isNotNull()).alias("is_subagent"), F.coalesce(by_id, by_file).alias("agent_id"), F.when(by_id.isNull(), F.when(by_file.isNotNull(), "task_agent").otherwise(F.col("said"))).alias("agent_type"))
