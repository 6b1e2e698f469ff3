"""Aggregates over sessions: dossiers of a file, the cross-session index, coverage, profiles, comparison of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import relational as R


def ordered_union(rows: DataFrame, by: list[str], values: str, order: list[str]) -> DataFrame:
    """by and an array of the distinct values of an array column, in order of first appearance."""
    each = rows.select(*by, *order, F.posexplode(values).alias("__k", "value"))
    first = each.groupBy(*by, "value").agg(F.min(F.struct(*order, "__k")).alias("__at"))
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "value"))), lambda x: x["value"]).alias(values))


def file_index(dossiers: DataFrame) -> DataFrame:
    """One row a file from dossiers (session_id, file, mentions, warnings, decisions, significance)."""
    base = dossiers.groupBy("file").agg(F.countDistinct("session_id").alias("session_count"), F.sum("mentions").alias("mentions"), F.sort_array(F.collect_set("session_id")).alias("sessions"), *(F.count_if(F.col("significance") == s).alias(f"significance_{s}") for s in ("high", "medium", "low")))
    for c in ("warnings", "decisions"):
        base = base.join(ordered_union(dossiers, ["file"], c, ["session_id"]), "file", "left")
    return base


def index_statistics(index: DataFrame) -> DataFrame:
    n = F.col("session_count")
    return index.agg(F.count("*").alias("files"), F.count_if(n == 1).alias("in_1"), F.count_if(n == 2).alias("in_2"), F.count_if(n >= 3).alias("in_3_up"))


def enrich_index(index: DataFrame, sides: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """index with values of side tables (table, file column, values), by full path, else by base name."""
    for side, column, values in sides.values():
        keys = [(F.col("file"), F.col(column)), (R.basename(F.col("file")), R.basename(F.col(column)))]
        index = R.coalesce_join(index, side, keys, values)
    return index


def map_sums(rows: DataFrame, by: list[str], counts: str) -> DataFrame:
    """by and the sum of maps of counts."""
    each = rows.select(*by, F.explode(counts).alias("__k", "__v")).groupBy(*by, "__k").agg(F.sum("__v").alias("__v"))
    return each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__v")))).alias(counts))


def touch_counts(events: DataFrame) -> DataFrame:
    """created, modified and all touches of each file, most touched first."""
    return events.groupBy("file").agg(F.count_if(F.col("action") == "CREATE").alias("created"), F.count_if(F.col("action") == "MODIFY").alias("modified"), F.count("*").alias("touches"))


def frustration_files(peaks: DataFrame, named: DataFrame, width: int = 5) -> DataFrame:
    """file, peaks, sessions: frustration peaks within width messages of a mention of the file."""
    near = R.band_join(peaks.select("session_id", F.col("idx").alias("peak")), named.select("session_id", "idx", "file"), ["session_id"], "peak", "idx", width, width)
    return near.select("session_id", "peak", "file").distinct().groupBy("file").agg(F.count("*").alias("peaks"), F.countDistinct("session_id").alias("sessions"))


def importance(rows: DataFrame, label: str = "importance") -> DataFrame:
    value = F.when(F.lower(label).isin("critical", "significant", "context", "noise"), F.lower(label)).otherwise("unclassified")
    return rows.groupBy(value.alias("importance")).agg(F.count("*").alias("n"))


def effective_tier(messages: DataFrame, labels: DataFrame, keys: list[str], label: str = "importance") -> DataFrame:
    """messages with their label and keep: by the label where there is one, else by a tier of 3 or more."""
    out = messages.join(labels.select(*keys, label), keys, "left")
    return out.withColumn("keep", F.when(F.col(label).isNull(), F.col("filter_tier") >= 3).otherwise(F.lower(label).isin("critical", "significant", "context")))


def compare_passes(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """both, agree, only_a, only_b and agreement (share, 2 places) of two passes."""
    j = a.select(*keys, F.col(value).alias("va"), F.lit(1).alias("a")).join(b.select(*keys, F.col(value).alias("vb"), F.lit(1).alias("b")), keys, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    agree = F.count_if(both & (F.col("va") == F.col("vb")))
    return j.agg(F.count_if(both).alias("both"), agree.alias("agree"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.when(F.count_if(both) > 0, F.round(agree / F.count_if(both), 2)).otherwise(0.0).alias("agreement"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (new, lost, kept) and rows of two selections."""
    return a.subtract(b).withColumn("side", F.lit("new")).unionByName(b.subtract(a).withColumn("side", F.lit("lost"))).unionByName(a.intersect(b).withColumn("side", F.lit("kept")))


def coverage(status: DataFrame, phases: list[str]) -> DataFrame:
    """session_id, a column for each phase (complete, partial, missing) and fully_complete, from (session_id, phase, found, expected)."""
    state = F.when(F.col("found") >= F.col("expected"), "complete").when(F.col("found") > 0, "partial").otherwise("missing")
    wide = status.withColumn("state", state).groupBy("session_id").pivot("phase", phases).agg(F.first("state")).na.fill("missing", phases)
    return wide.withColumn("fully_complete", F.forall(F.array(*phases), lambda x: x == "complete"))


def project_rollup(sessions: DataFrame) -> DataFrame:
    """project (null: all), sessions, messages, bytes."""
    return sessions.rollup("project").agg(F.countDistinct("session_id").alias("sessions"), F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


def profile(messages: DataFrame) -> DataFrame:
    """One row a session: span, roles, characters, hours and days, busiest hour (the least of equal ones)."""
    hours = messages.groupBy("session_id", F.hour("ts").alias("h")).agg(F.count("*").alias("n")).groupBy("session_id").agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("busiest_hour"))
    own = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.length("content")).alias("characters"), F.countDistinct(F.to_date("ts")).alias("days"))
    return own.join(hours, "session_id", "left")


def tokens_by_model(messages: DataFrame) -> DataFrame:
    """model, responses, input_tokens, output_tokens and the average output of a response, rounded down."""
    return messages.where("role = 'assistant'").groupBy("model").agg(F.count("*").alias("responses"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.floor(F.sum("output_tokens") / F.count("*")).alias("average_output"))


def credibility(results: DataFrame, by: list[str]) -> DataFrame:
    """verified, failed and verified / (verified + failed) (0 without any) of check results (status)."""
    v, f = F.count_if(F.col("status") == "verified"), F.count_if(F.col("status") == "failed")
    return results.groupBy(*by).agg(v.alias("verified"), f.alias("failed"), F.when(v + f > 0, v / (v + f)).otherwise(0.0).alias("credibility"))


def layers(rows: DataFrame) -> DataFrame:
    """file, layers, first and last of an append-only table (file, layer_type, at), and how many of each type."""
    kinds = rows.groupBy("file", "layer_type").agg(F.count("*").alias("n")).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer_type", "n")))).alias("types"))
    return rows.groupBy("file").agg(F.count("*").alias("layers"), F.min("at").alias("first"), F.max("at").alias("last")).join(kinds, "file")


def app_level(facts: Column | None = None) -> Column:
    """0 to 6 by gates that all hold up to it, over the columns sessions, files, dossiers, families, index_files, verified, realtime."""
    gates = [F.col(c) > 0 for c in ("sessions", "files", "dossiers", "families", "index_files", "verified")] if facts is None else [F.element_at(facts, c) > 0 for c in ("sessions", "files", "dossiers", "families", "index_files", "verified")]
    level, held = F.lit(0), F.lit(True)
    for k, g in enumerate(gates):
        held = held & F.coalesce(g, F.lit(False))
        level = F.when(held, k + 1).otherwise(level)
    return level


def busiest(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by and the commonest value (the least of equal ones)."""
    n = rows.groupBy(*by, value.alias("__v")).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("__n"), "__v"))
    return n.withColumn("__r", rank).where("__r = 1").select(*by, F.col("__v").alias(name))


def merge_totals(merged: DataFrame, passes: list[str], usage: DataFrame) -> DataFrame:
    """One row a session: messages with and without a pass's result, the passes that have any, and what they cost (usage: session_id, cost)."""
    found = F.coalesce(*(F.when(F.col(p).isNotNull(), 1) for p in passes))
    seen = [F.when(F.count_if(F.col(p).isNotNull()) > 0, p) for p in passes]
    own = merged.groupBy("session_id").agg(F.count("*").alias("total_messages"), F.count(found).alias("with_result"), F.array_compact(F.array(*seen)).alias("passes"))
    cost = usage.groupBy("session_id").agg(F.sum("cost").alias("cost"))
    out = own.join(cost, "session_id", "left").withColumn("without_result", F.col("total_messages") - F.col("with_result"))
    return out.na.fill(0.0, ["cost"])


def session_totals(sessions: DataFrame) -> DataFrame:
    """section (total, day or size), name, n, bytes over sessions (date, size_class, size_bytes, total_messages, user_messages, assistant_messages, is_agent)."""
    by = lambda section, name: sessions.where(name.isNotNull()).groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).select(F.lit(section).alias("section"), "name", "n", "bytes")
    counts = {"sessions": F.count("*"), "agent_sessions": F.count_if("is_agent"), "human_sessions": F.count_if(~F.col("is_agent"))}
    counts |= {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("total_messages", "user_messages", "assistant_messages")}
    one = sessions.agg(*(v.alias(k) for k, v in counts.items()), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    total = one.select(F.lit("total").alias("section"), F.stack(F.lit(len(counts)), *(x for k in counts for x in (F.lit(k), F.col(k)))).alias("name", "n"), "bytes")
    return total.unionByName(by("day", F.col("date"))).unionByName(by("size", F.col("size_class")))


def behavior_patterns(rows: DataFrame) -> DataFrame:
    """file, pattern, seen (array<struct<session_id, value>>) from rows (session_id, file, behavior: map of texts); empty values don't count."""
    each = rows.select("file", "session_id", F.explode("behavior").alias("pattern", "value")).where("value is not null and value <> ''")
    return each.groupBy("file", "pattern").agg(F.sort_array(F.collect_list(F.struct("session_id", "value"))).alias("seen"))


def related_files(rows: DataFrame) -> DataFrame:
    """file and the sorted union of its related files over all sessions."""
    return rows.select("file", F.explode("related").alias("r")).groupBy("file").agg(F.array_sort(F.collect_set("r")).alias("related"))
