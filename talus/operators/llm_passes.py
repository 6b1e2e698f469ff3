"""The boundary to a language model: what goes into each pass, prompts, batches, answers. The model itself is a function
that is passed in; offline() answers without a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import messages as M
from . import normalize as N
from . import relational as R

#: name: (role or None, least tier, pass whose flagged rows are read or None, context)
PASSES = {"content": ("user", 2, None, 0), "behavior": ("assistant", 2, None, 2), "review": (None, 2, "content", 2), "importance": (None, 1, None, 0)}
ANSWER = "struct<msg_index:int,label:string,reason:string>"


def rows_for(enriched: DataFrame, name: str, results: dict[str, DataFrame] | None = None, passes: dict = PASSES) -> DataFrame:
    """The messages that a pass reads; a pass on flagged rows reads those that the earlier pass flagged."""
    role, least, after, _ = passes[name]
    out = enriched.where((~F.col("is_protocol")) & (F.col("filter_tier") >= least))
    out = out.where(F.col("role") == role) if role else out
    if after:
        flagged = (results or {})[after].where("flagged").select("session_id", F.col("msg_index").alias("idx")).distinct()
        out = out.join(flagged, ["session_id", "idx"], "left_semi")
    return out


def prompts(enriched: DataFrame, name: str, head: str, size: int = 30, passes: dict = PASSES, results: dict | None = None) -> DataFrame:
    """session_id, batch, prompt, n, tokens: a session's rows in batches, never mixed with another session's."""
    role, least, after, context = passes[name]
    rows = rows_for(enriched, name, results, passes)
    if context:
        seen = R.lookback(enriched.select("session_id", "idx", "role", "content"), "session_id", "idx", F.lit(True), F.col("role") == "user", 9, context)
        rows = rows.join(seen.select("session_id", "idx", F.array_join(F.transform("previous", lambda p: p["content"]), "\n").alias("before")), ["session_id", "idx"], "left")
    else:
        rows = rows.withColumn("before", F.lit(""))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("content"), F.when(F.col("before") != "", F.concat(F.lit("\n  after: "), F.col("before"))).otherwise(""))
    batched = M.batches(rows.withColumn("line", line), size)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    out = batched.groupBy("session_id", "batch").agg(F.concat(F.lit(head + "\n"), body).alias("prompt"), F.count("*").alias("n"))
    return out.withColumn("tokens", T.token_estimate(F.col("prompt")))


def dry_run(asked: DataFrame, model: str, tokens_out: int = 1000) -> DataFrame:
    """calls, tokens and the estimated cost."""
    return asked.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(T.cost(F.lit(model), F.col("tokens"), F.lit(tokens_out))), F.lit(0.0)).alias("cost"))


def offline(prompt: str) -> str:
    return "[]"


def run(asked: DataFrame, client: Callable[[str], str] = offline, retries: int = 3) -> DataFrame:
    """session_id, batch, answer, error: one call a prompt, tried again up to retries times."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b.prompt:
                answer, error = None, None
                for _ in range(retries):
                    try:
                        answer, error = client(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  a client may fail in any way; the row says how
                        error = str(e)
                out.append((answer, error))
            yield b[["session_id", "batch"]].assign(answer=[a for a, _ in out], error=[e for _, e in out])

    kind = dict(asked.dtypes)
    return asked.select("session_id", "batch", "prompt").mapInPandas(call, f"session_id {kind['session_id']}, batch {kind['batch']}, answer string, error string")


def recorded(spark: SparkSession, record: str) -> DataFrame | None:
    """prompt_hash, answer of the prompts that were answered, or None where nothing is recorded yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(record)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(record).where("error is null").groupBy("prompt_hash").agg(F.min("answer").alias("answer"))


def run_recorded(asked: DataFrame, record: str, client: Callable[[str], str] = offline, retries: int = 3, parts: int = 10) -> DataFrame:
    """run(), but what a table at record has an answer for isn't asked again. Answers are added to it part by part, so that what
    stops in between repeats one part at most; equal prompts are asked once."""
    spark = asked.sparkSession
    asked = asked.withColumn("prompt_hash", F.sha2("prompt", 256))
    known = recorded(spark, record)
    todo = asked.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    todo = todo if known is None else todo.join(known, "prompt_hash", "left_anti")
    todo = cut(todo)
    for k in range(parts):
        part = todo.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)) == k).select(F.col("prompt_hash").alias("session_id"), F.lit(0).alias("batch"), "prompt")
        run(part, client, retries).select(F.col("session_id").alias("prompt_hash"), "answer", "error").write.mode("append").parquet(record)
    answers = spark.read.parquet(record).groupBy("prompt_hash").agg(F.min("answer").alias("answer"), F.max("error").alias("__error"))
    out = asked.select("session_id", "batch", "prompt_hash").join(answers, "prompt_hash", "left")
    return out.select("session_id", "batch", "answer", F.when(F.col("answer").isNull(), F.col("__error")).alias("error"))


def results(answers: DataFrame) -> DataFrame:
    """session_id, batch, msg_index, label, reason of all answers; flagged where the label isn't none."""
    rows = answers.select("session_id", "batch", F.explode(N.parse_response(F.col("answer"), ANSWER)).alias("r")).select("session_id", "batch", "r.*")
    return rows.where("msg_index is not null").withColumn("flagged", F.coalesce(~F.lower("label").isin("none", ""), F.lit(False)))


def merge(enriched: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """enriched with each pass's result; of repeated results of a message the last batch's stands."""
    renamed = {k: v.withColumnRenamed("msg_index", "idx").select("session_id", "idx", "label", "reason", F.col("batch").alias("seq")) for k, v in found.items()}
    return R.merge_passes(enriched, renamed, ["session_id", "idx"])


def classification_rows(enriched: DataFrame, cap: int, near: int = 3) -> DataFrame:
    """Rows to classify: short user rows, tier 1 rows, rows within near of a frustration peak; cap of them a session, by score."""
    rows = enriched.where("not is_protocol")
    peaks = rows.where((F.col("role") == "user") & ((F.col("caps_ratio") > 0.3) | F.col("profanity") | (F.col("exclamations") >= 5))).select("session_id", F.col("idx").alias("peak"))
    close = R.band_join(rows.select("session_id", "idx"), peaks, ["session_id"], "idx", "peak", near, near, "left_semi")
    short = rows.where(((F.col("role") == "user") & (F.col("content_length") < 100)) | (F.col("filter_tier") == 1)).select("session_id", "idx")
    picked = rows.join(close.unionByName(short).distinct(), ["session_id", "idx"], "left_semi")
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("filter_score"), "idx"))
    return picked.withColumn("rank", rank).where(F.col("rank") <= cap)


def merge_chunks(parts: DataFrame) -> DataFrame:
    """Entries of several chunks of a session as one list, in order, without repeats: (session_id, category, msg_index, content, chunk)."""
    return R.last_wins(parts, ["session_id", "category", "msg_index", "content"], "chunk").drop("chunk").orderBy("session_id", "category", "msg_index", "content")
