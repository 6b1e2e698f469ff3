"""Which sessions and messages a later stage takes, and how it sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def condensed(enriched: DataFrame) -> DataFrame:
    """The short names under which agents read a message: all of it, nothing cut."""
    names = {
        "session_id": "session_id",
        "i": "idx",
        "r": "role",
        "c": "content",
        "cl": "content_length",
        "t": "filter_tier",
        "ts": "ts",
        "signals": "signals",
        "is_protocol": "is_protocol",
        "protocol_type": "protocol_type",
        "was_char_encoded": "was_char_encoded",
        "content_ref": "content_referential",
    }
    meta = F.struct("files", "error", F.col("caps_ratio").alias("caps"), "profanity", "emergency")
    return enriched.select(*(F.col(old).alias(new) for new, old in names.items()), meta.alias("meta"))


def _first_two(values: Column) -> Column:
    return F.array_join(F.transform(F.slice(values, 1, 2), lambda x: x.cast("string")), ",")


def _listed(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}:"), _first_two(values)))


def context_line() -> Column:
    """One line that says what to expect of an enriched message; parts that don't apply are left out."""
    col, percent = F.col, F.format_string("CAPS:%.0f%%", F.col("caps_ratio") * 100)
    frustration = F.concat_ws(
        " ",
        F.when(col("caps_ratio") > 0.3, percent),
        F.when(col("exclamations") >= 2, F.concat(col("exclamations").cast("string"), F.lit("!"))),
        F.when(col("profanity"), F.lit("PROFANITY")),
    )
    emergency = F.when(col("emergency"), F.concat(F.lit("EMERGENCY:"), col("emergency_reason")))
    langs, errors = _first_two(col("code_langs")), _first_two(col("error_types"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), col("idx").cast("string"), F.lit("]")),
        F.date_format("ts", "HH:mm"),
        F.date_format("ts", "E"),
        F.when(col("images") > 0, F.concat(F.lit("IMG:"), col("images").cast("string"))),
        F.when(col("code_block"), F.concat(F.lit("CODE:"), F.coalesce(F.nullif(langs, F.lit("")), F.lit("block")))),
        _listed("FILES", col("files")),
        F.when(col("error"), F.concat(F.lit("ERR:"), F.coalesce(F.nullif(errors, F.lit("")), F.lit("error")))),
        F.when(col("traceback"), F.lit("TRACEBACK")),
        F.when(col("terminal_paste"), F.lit("TERM_PASTE")),
        _listed("RUN", col("scripts_run")),
        F.when(col("server_issue"), F.lit("SERVER_ISSUE")),
        _listed("PORT", col("ports")),
        _listed("CREATE", col("files_create")),
        _listed("EDIT", col("files_edit")),
        F.nullif(frustration, F.lit("")),
        F.coalesce(emergency, F.when(col("repeated").isNotNull(), F.concat(F.lit("SPAM:"), T.repeats(col("content")).cast("string"), F.lit("x")))),
    )


def eligible(stats: DataFrame, present: DataFrame, required: list[str], least: int = 20, done: DataFrame | None = None) -> DataFrame:
    """stats of sessions with least messages that have every required file (present: session_id, file) and aren't done."""
    have = present.where(F.col("file").isin(required)).groupBy("session_id").agg(F.countDistinct("file").alias("__n"))
    out = stats.where(F.col("total_messages") >= least)
    out = out.join(have.where(F.col("__n") == len(set(required))).select("session_id"), "session_id", "left_semi")
    return out if done is None else out.join(done.select("session_id"), "session_id", "left_anti")


def duplicates(files: DataFrame, name: str = "name") -> DataFrame:
    """short: the eight-character ids of sessions that only repeat another one, as prefix_uuid beside uuid.

    Files are named uuid.jsonl or prefix_uuid.jsonl (agent files keep their whole name). Where two or more files have one
    uuid, those with a prefix that isn't the beginning of it are copies.
    """
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.jsonl$", "")
    prefixed = stem.contains("_") & ~stem.startswith("agent-")
    uuid = F.when(prefixed, F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)).otherwise(stem)
    parts = files.select(uuid.alias("uuid"), prefixed.alias("prefixed"), F.substring(stem, 1, 8).alias("short"))
    many = parts.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1").select("uuid")
    copies = parts.join(many, "uuid", "left_semi").where("prefixed and short <> substring(uuid, 1, 8)")
    return copies.select("short").distinct()


def without_duplicates(sessions: DataFrame, files: DataFrame, session: str = "session_id", name: str = "name") -> DataFrame:
    """sessions whose short id is no copy's."""
    skip = duplicates(files, name)
    return sessions.join(skip, F.substring(sessions[session].cast("string"), 1, 8) == skip["short"], "left_anti")


def not_yet(rows: DataFrame, taken: DataFrame, keys: tuple[str, ...] = ("session_id", "idx")) -> DataFrame:
    """Rows whose keys aren't among those taken."""
    return rows.join(taken.select(*keys), list(keys), "left_anti")


def selected(enriched: DataFrame, base: int = 4, user: int = 2, marks: int = 5, caps: float = 0.3) -> DataFrame:
    """Messages to tag, and why: of tier base, users' of tier user and up, and intense ones of users that tiers missed."""
    own = (F.col("role") == "user") & ~F.col("is_protocol")
    intense = own & ((F.col("exclamations") >= marks) | (F.col("caps_ratio") > caps))
    why = F.when(F.col("filter_tier") >= base, "tier").when((F.col("role") == "user") & (F.col("filter_tier") >= user), "user")
    return enriched.withColumn("why", why.when(intense, "intense")).where("why is not null")


def with_previews(rows: DataFrame, previews: DataFrame, least: int = 2) -> DataFrame:
    """rows of tier least and up, with the content of the preview (session_id, idx, preview) where there is one."""
    found = previews.where("preview is not null and preview <> ''").groupBy("session_id", "idx").agg(F.max("preview").alias("preview"))
    out = rows.where(F.col("filter_tier") >= least).join(found, ["session_id", "idx"], "left")
    return out.withColumn("content", F.coalesce("preview", "content")).drop("preview")


def recent(sessions: DataFrame, n: int, at: str = "modified", key: str = "session_id") -> DataFrame:
    """The n sessions that changed last, the latest first."""
    return sessions.orderBy(F.col(at).desc(), F.col(key)).limit(n)


def chronological(messages: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("ts", "session_id", "idx")) -> DataFrame:
    """Messages of all sessions in order of time (without a time first), the first limit of them."""
    out = messages.orderBy(*order)
    return out if limit is None else out.limit(limit)


def between(rows: DataFrame, start: Column | int, end: Column | int, at: str = "idx") -> DataFrame:
    """Rows from start to end, both included."""
    return rows.where(F.col(at).between(start, end))


def archived(runs: DataFrame, files: DataFrame, key: str = "run_id") -> DataFrame:
    """The manifest of each run: run_id, files, bytes and the listing (name, bytes, sha256) in order of name."""
    listing = F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256")))
    each = files.groupBy(key).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), listing.alias("listing"))
    return runs.join(each, key, "left").na.fill(0, ["files", "bytes"])


# --- fixed values: states of a file in the processing ledger, in the order they follow
STATES = ("pending", "in_progress", "processed")


def ledger(files: DataFrame, marks: DataFrame, key: str = "file") -> DataFrame:
    """file, state: of each file the state it was last put into (marks: file, state, at), pending where there is none."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("state"))
    last = marks.groupBy(key).agg(F.max_by("state", F.struct("at", rank)).alias("state"))
    return files.select(key).distinct().join(last, key, "left").na.fill(STATES[0], ["state"])


def marked(marks: DataFrame, files: DataFrame, state: str, at: Column, key: str = "file") -> DataFrame:
    """The ledger's marks with a new one for each of files; marks are only added, so that a repeated run changes nothing."""
    if state not in STATES:
        raise ValueError(f"no state: {state}")
    return marks.unionByName(files.select(key, F.lit(state).alias("state"), at.alias("at"))).distinct()


def numbered(rows: DataFrame, by: list[str], order: list, letter: str, width: int) -> DataFrame:
    """id: the letter and each row's number in its group, with zeros in front."""
    number = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("id", F.format_string(f"{letter}%0{width}d", number))
