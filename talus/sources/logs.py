"""Readers of session logs (JSON lines), display archives, source files and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import normalize as N

BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,input:string>>"
SKIPPED = ("queue-operation", "system", "progress", "file-history-snapshot", "summary")


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """path, session_id (file stem), line_no (order in the file), value; blank lines are left out.

    Numbering needs a file in one piece; sessions are files of megabytes, and files are spread over tasks.
    """
    options = {"recursiveFileLookup": str(recursive).lower(), "pathGlobFilter": glob, "wholetext": "true"}
    whole = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")
    each = whole.select("path", "size", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("trim(value) <> ''")
    return each.withColumn("session_id", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))


def timestamp(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds (over 1e12) or ISO 8601; null where it is none of them."""
    number = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.cast("double"))
    return F.coalesce(F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)), F.try_to_timestamp(F.when(number.isNull(), raw)))


def _content(raw: Column, separator: str) -> tuple[Column, Column]:
    """(text of a string or of text blocks, blocks)."""
    blocks = F.from_json(F.when(N.kind(raw) == "array", raw), BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(blocks.isNotNull(), F.array_join(texts, separator)).otherwise(raw), blocks


def messages(raw: DataFrame, separator: str = "\n", thinking: str = "last", drop_empty: bool = False) -> DataFrame:
    """Messages of raw lines: malformed lines, other types and (drop_empty) empty contents are left out.

    A record without a message gives its own content. separator and thinking (first or last block) are where the two
    ways to read logs differ. Times that can't be read are null.
    """
    v = F.col("value")
    get = lambda *paths: F.coalesce(*(F.get_json_object(v, f"$.{p}") for p in paths))
    ok = raw.where(F.from_json(v, "map<string,string>").isNotNull()).where(F.coalesce(~get("type").isin(*SKIPPED), F.lit(True)))
    text, blocks = _content(get("message.content", "content"), separator)
    role = F.when(get("type").isin("user", "assistant"), get("type")).otherwise(get("role", "message.role"))
    thoughts = F.filter(blocks, lambda b: (b["type"] == "thinking") & b["thinking"].isNotNull())
    usage = lambda k: F.coalesce(get(f"message.usage.{k}").cast("int"), F.lit(0))
    out = ok.select(
        F.coalesce(get("sessionId"), F.col("session_id")).alias("session_id"), "path", "line_no", role.alias("role"), F.coalesce(text, F.lit("")).alias("content"), timestamp(get("timestamp")).alias("ts"), get("uuid").alias("uuid"), get("message.model").alias("model"), get("message.stop_reason").alias("stop_reason"), get("cwd").alias("cwd"), get("gitBranch").alias("git_branch"),
        F.get(thoughts, F.size(thoughts) - 1 if thinking == "last" else F.lit(0))["thinking"].alias("thinking"),
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("input"))).alias("tool_calls"),
        F.struct(usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cache_creation_input_tokens").alias("cache_creation"), usage("cache_read_input_tokens").alias("cache_read"), get("message.usage.service_tier").alias("service_tier")).alias("usage"),
    ).where(F.col("role").isin("user", "assistant"))
    out = out.where("trim(content) <> ''") if drop_empty else out
    return out.withColumn("idx", F.row_number().over(W.partitionBy("session_id").orderBy("path", "line_no")) - 1)


def read_sessions(spark: SparkSession, path: str, **options) -> DataFrame:
    return messages(lines(spark, path), **options)


def limit_files(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n files in order of path."""
    first = df.select("path").distinct().orderBy("path").limit(n)
    return df.join(first, "path", "left_semi")


def read_display(spark: SparkSession, path: str, paste: int = 500) -> DataFrame:
    """User messages of display archives: the display, then paste characters of each pasted content in order of key."""
    raw = lines(spark, path)
    schema = "display string, timestamp bigint, project string, pastedContents map<string,struct<content:string>>"
    d = raw.select("path", "session_id", "line_no", F.from_json("value", schema).alias("d")).where("d.display is not null and trim(d.display) <> ''")
    pasted = F.transform(F.array_sort(F.map_entries("d.pastedContents")), lambda e: F.substring(e["value"]["content"], 1, paste))
    text = F.concat_ws("\n", F.col("d.display"), F.nullif(F.array_join(F.coalesce(pasted, F.array().cast("array<string>")), "\n"), F.lit("")))
    return d.select("path", "session_id", "line_no", F.lit("user").alias("role"), text.alias("content"), F.timestamp_millis("d.timestamp").alias("ts"), F.col("d.project").alias("project"), (F.size("d.pastedContents") > 0).alias("pasted"))


def archive_statistics(archive: DataFrame) -> DataFrame:
    return archive.agg(F.countDistinct("path").alias("files"), F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("project").alias("projects"))


SIZES = [(10 << 10, "tiny"), (100 << 10, "small"), (1 << 20, "medium"), (10 << 20, "large")]


def profile(raw: DataFrame) -> DataFrame:
    """One row a file of raw lines: span, roles, lines, whether it has thinking, its size class, whether an agent's."""
    v = F.col("value")
    own = raw.groupBy("path", "session_id").agg(F.max("size").alias("size"), F.count("*").alias("lines"), F.count_if(v.contains('"type":"user"') | v.contains('"type": "user"')).alias("user_lines"), F.count_if(v.contains('"type":"assistant"') | v.contains('"type": "assistant"')).alias("assistant_lines"), F.max(v.contains('"thinking"')).alias("has_thinking"), F.min(timestamp(F.get_json_object(v, "$.timestamp"))).alias("first_ts"), F.max(timestamp(F.get_json_object(v, "$.timestamp"))).alias("last_ts"))
    return own.withColumns({"size_class": T.size_bucket(F.col("size"), SIZES, "huge"), "is_agent": F.col("session_id").contains("agent-"), "minutes": T.duration_hours(F.col("first_ts"), F.col("last_ts")) * 60})


def find_session(sessions: DataFrame, wanted: str) -> DataFrame:
    """The session of this id, else the first that begins with it, else the first that has it after an underscore."""
    s = F.col("session_id")
    priority = F.when(s == wanted, 0).when(s.startswith(wanted), 1).when(s.contains(f"_{wanted}"), 2)
    return sessions.withColumn("__p", priority).where("__p is not null").orderBy("__p", "session_id").limit(1).drop("__p")


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that a ledger (path, status) doesn't have as processed."""
    return files.join(ledger.where("status = 'processed'").select("path"), "path", "left_anti")


def source_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """file (name), path, source, modified."""
    whole = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob, wholetext="true").text(path)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"), F.col("_metadata.file_modification_time").alias("modified"))


def documents(spark: SparkSession, path: str, glob: str = "*.json", strict: bool = False) -> DataFrame:
    """session_id (folder), name, doc of whole JSON files; those that don't parse are left out, or fail the read (strict)."""
    whole = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob, wholetext="true").text(path)
    out = whole.select(F.regexp_extract("_metadata.file_path", r"([^/]*)/[^/]*$", 1).alias("session_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("doc"))
    bad = F.from_json("doc", "map<string,string>").isNull() & F.from_json("doc", "array<string>").isNull()
    return out.withColumn("doc", F.when(bad, F.raise_error(F.concat(F.lit("not JSON: "), "name")).cast("string")).otherwise(F.col("doc"))) if strict else out.where(~bad)


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are newer than in the cache (path, modified), or not there."""
    return files.join(cache.select("path", F.col("modified").alias("__m")), "path", "left").where("__m is null or modified > __m").drop("__m")
