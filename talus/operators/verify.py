"""Verification: checks of source code, of claims against tables, gaps, coverage checks; audits of listings and data flow."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import relational as R


def lines(files: DataFrame, name: str = "file", source: str = "source") -> DataFrame:
    """file, line_no (from 1), line."""
    return files.select(F.col(name).alias("file"), F.posexplode(F.split(source, "\n", -1)).alias("__k", "line")).select("file", (F.col("__k") + 1).alias("line_no"), "line")


def excepts(files: DataFrame, name: str = "file", source: str = "source") -> DataFrame:
    """file, parsed, bare (bare excepts) and broad (handlers of Exception or BaseException), with line numbers."""

    @F.pandas_udf("parsed boolean, bare array<int>, broad array<int>")
    def find(s: pd.Series) -> pd.DataFrame:
        out = []
        for text in s:
            try:
                handlers = [n for n in ast.walk(ast.parse(text or "")) if isinstance(n, ast.ExceptHandler)]
            except (SyntaxError, ValueError):
                out.append((False, [], []))
                continue
            out.append((True, sorted(h.lineno for h in handlers if h.type is None), sorted(h.lineno for h in handlers if isinstance(h.type, ast.Name) and h.type.id in ("Exception", "BaseException"))))
        return pd.DataFrame(out, columns=["parsed", "bare", "broad"])

    return files.select(F.col(name).alias("file"), find(F.col(source)).alias("r")).select("file", "r.*")


def truncations(source: DataFrame, least: int = 10) -> DataFrame:
    """Lines that cut to [:N] with N at least least, unless they print or log, or they or the four before are about samples or disabled code."""
    before = F.array_join(F.collect_list("line").over(W.partitionBy("file").orderBy("line_no").rowsBetween(-4, 0)), "\n")
    n = F.regexp_extract("line", r"\[\s*:\s*(\d+)\s*\]", 1)
    out = source.withColumns({"n": F.when(n != "", n.cast("int")), "context": before})
    return out.where((F.col("n") >= least) & ~F.lower("line").rlike(r"print\(|log(?:ger)?\.|^\s*#") & ~F.lower("context").rlike(r"sample|preview|disabled|display")).select("file", "line_no", "n")


def unsafe_access(source: DataFrame, access: str = r"\.content\[0\]|\.choices\[0\]", guard: str = r"\bif\b|\btry\b|\blen\(") -> DataFrame:
    """Lines with an access that no guard stands on or in the three lines above."""
    near = F.max(F.col("line").rlike(guard).cast("int")).over(W.partitionBy("file").orderBy("line_no").rowsBetween(-3, 0))
    return source.withColumn("guarded", near == 1).where(F.col("line").rlike(access) & ~F.col("guarded")).select("file", "line_no")


def model_strings(source: DataFrame, pattern: str = r"\b(?:opus|sonnet|haiku|gpt)[\w.-]*") -> DataFrame:
    """Lines outside docstrings and comments that name a model."""
    quotes = F.regexp_count("line", F.lit("\"\"\"|'''"))
    inside = F.coalesce(F.sum(quotes).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    found = F.regexp_extract(F.lower("line"), pattern, 0)
    return source.withColumns({"model": found, "doc": inside | (quotes > 0)}).where((F.col("model") != "") & ~F.col("doc") & ~F.trim("line").startswith("#")).select("file", "line_no", "model")


def function_exists(claims: DataFrame, prints: DataFrame) -> DataFrame:
    """claims (file, name) with status verified or failed, by the file's callables."""
    names = prints.select("file", F.explode("callables").alias("name")).distinct().withColumn("ok", F.lit(True))
    return claims.join(names, ["file", "name"], "left").withColumn("status", F.when(F.col("ok"), "verified").otherwise("failed")).drop("ok")


def indices_valid(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """claims (session_id, msg_index) checked against each session's messages."""
    ok = F.col("msg_index").between(0, F.col("messages") - 1)
    return claims.join(sessions.select("session_id", "messages"), "session_id", "left").withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "verified").otherwise("failed"))


def confidence_consistent(claims: DataFrame, tags: DataFrame) -> DataFrame:
    """claims (session_id, msg_index, confidence) against the tag of that message; without a tag nothing can be said."""
    j = claims.join(tags.select("session_id", F.col("idx").alias("msg_index"), "confidence_signal"), ["session_id", "msg_index"], "left")
    return j.withColumn("status", F.when(F.col("confidence_signal").isNull(), "unverifiable").when(F.col("confidence_signal") == F.col("confidence"), "verified").otherwise("failed"))


def graph_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("graph", "id")
    return edges.join(known.withColumnRenamed("id", "src"), ["graph", "src"], "left_anti").unionByName(edges.join(known.withColumnRenamed("id", "dst"), ["graph", "dst"], "left_anti")).distinct()


def claims_about(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (id, claim) with each file that they name."""
    return claims.join(files.select("file"), R.mentions_file(F.col("claim"), F.col("file")))


def gaps(results: DataFrame, warnings: DataFrame) -> DataFrame:
    """file, category, detail: failed claims (contradicted), unverifiable ones, warnings no failed claim covers, and files without any result."""
    failed = results.where("status = 'failed'")
    a = failed.select("file", F.lit("contradicted").alias("category"), F.col("claim").alias("detail"))
    b = results.where("status = 'unverifiable'").select("file", F.lit("unverifiable").alias("category"), F.col("claim").alias("detail"))
    said = failed.select(F.col("file").alias("__f"), F.lower("claim").alias("__c"))
    open_ = warnings.join(said, (F.col("file") == F.col("__f")) & (F.col("__c").contains(F.lower("warning")) | F.lower("warning").contains(F.col("__c"))), "left_anti")
    c = open_.select("file", F.lit("unresolved_warning").alias("category"), F.col("warning").alias("detail"))
    d = warnings.select("file").distinct().join(results.select("file").distinct(), "file", "left_anti").select("file", F.lit("unchecked").alias("category"), F.lit(None).cast("string").alias("detail"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def enum_coverage(rows: DataFrame, column: str, possible: list[str]) -> DataFrame:
    """observed, missing (sorted), coverage, gap_type (structural up to a quarter missing, one at least) and confidence."""
    allowed = F.array(*(F.lit(x) for x in possible))
    out = rows.agg(F.array_sort(F.array_intersect(F.collect_set(column), allowed)).alias("observed"))
    missing = F.array_sort(F.array_except(allowed, F.col("observed")))
    share = F.size("observed") / len(possible)
    kind = F.when(F.size(missing) == 0, "none").when(F.size(missing) <= max(1, len(possible) // 4), "structural").otherwise("extraction")
    return out.select("observed", missing.alias("missing"), F.round(share, 4).alias("coverage"), kind.alias("gap_type"), F.round(F.least(share * 1.1, F.lit(1.0)), 4).alias("confidence"))


def count_threshold(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("n"), (n < least).alias("is_gap"), F.round(F.least(n / least, F.lit(1.0)), 4).alias("confidence"))


def populated_ratio(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, populated, ratio, is_gap (under a tenth), confidence (1.2 times the ratio, 1 at most), without a pass for each field."""
    filled = [F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in columns]
    wide = rows.agg(F.count("*").alias("__n"), *filled)
    long = wide.select("__n", F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c)))).alias("field", "populated"))
    ratio = F.when(F.col("__n") > 0, F.col("populated") / F.col("__n")).otherwise(0.0)
    return long.select("field", "populated", F.round(ratio, 4).alias("ratio"), (ratio < 0.1).alias("is_gap"), F.round(F.least(ratio * 1.2, F.lit(1.0)), 4).alias("confidence"))


def coverage_histogram(rows: DataFrame, coverage: str) -> DataFrame:
    """bucket 0 to 9 (tenths) and n."""
    return rows.groupBy(F.least(F.floor(F.col(coverage) * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def completeness(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, missing, zero, populated fields of each row."""
    s = F.array(*(F.when(F.col(c).isNull(), "MISSING").when(F.col(c).cast("string").isin("", "0", "0.0", "false"), "ZERO").otherwise("POPULATED") for c in columns))
    n = lambda k: F.size(F.filter(s, lambda x: x == k))
    return rows.select(key, n("MISSING").alias("missing"), n("ZERO").alias("zero"), n("POPULATED").alias("populated"))


def invariants(stats: DataFrame) -> DataFrame:
    """session_id, broken: which of the volume rules a session's statistics break."""
    tiers = F.col("tier_1") + F.col("tier_2") + F.col("tier_3") + F.col("tier_4")
    rules = {"tiers_sum": tiers == F.col("total_messages"), "roles_fit": F.col("user_messages") + F.col("assistant_messages") <= F.col("total_messages"), "human_fit": F.col("human_messages") <= F.col("user_messages"), "some_messages": F.col("total_messages") > 0}
    return stats.select("session_id", F.array_compact(F.array(*(F.when(~ok, k) for k, ok in rules.items()))).alias("broken"))


def same_rows(a: DataFrame, b: DataFrame, volatile: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """side, rows that only one of two runs has, with multiplicity; none where they are the same."""
    a, b = a.drop(*volatile), b.drop(*volatile)
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_second")))


def lifecycle(listing: DataFrame, known: DataFrame, large: int = 10 << 20) -> DataFrame:
    """issue, files, bytes of a listing (path, name, size): backups, orphans, large, empty files and locks."""
    backup, lock = F.col("name").rlike(r"\.bak|_backup|~$"), F.col("name").endswith(".lock")
    issues = {"backup": backup, "lock": lock, "large": F.col("size") > large, "empty": F.col("size") == 0}
    each = listing.select("size", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in issues.items())))).alias("issue"))
    orphans = listing.where(~backup & ~lock).join(known.select("name"), "name", "left_anti").select("size", F.lit("orphan").alias("issue"))
    return each.unionByName(orphans).groupBy("issue").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the row that comes last in order."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in others))


def data_flow(source: DataFrame) -> DataFrame:
    """file, artifact, direction (reads or writes) of JSON file names in lines that read or write."""
    name = F.regexp_extract("line", r"[\"']([\w-]+\.jsonl?)[\"']", 1)
    way = F.when(F.col("line").rlike(r"dump|write|\bopen\([^)]*[\"']w"), "writes").when(F.col("line").rlike(r"load|read|open\("), "reads")
    return source.select("file", name.alias("artifact"), way.alias("direction")).where("artifact <> '' and direction is not null").distinct()


def dead_ends(flow: DataFrame) -> DataFrame:
    """Artifacts that are written and never read."""
    return flow.where("direction = 'writes'").select("artifact").distinct().join(flow.where("direction = 'reads'").select("artifact"), "artifact", "left_anti")


def earliest_phase(flow: DataFrame, phases: DataFrame) -> DataFrame:
    """file, phase, earliest (one after the last phase that writes what it reads, 0 without), misplaced."""
    made = flow.where("direction = 'writes'").join(phases, "file").groupBy("artifact").agg(F.max("phase").alias("made"))
    need = flow.where("direction = 'reads'").join(made, "artifact").groupBy("file").agg((F.max("made") + 1).alias("earliest"))
    out = phases.join(need, "file", "left").na.fill(0, ["earliest"])
    return out.withColumn("misplaced", F.col("phase") < F.col("earliest"))


def source_metrics(files: DataFrame, name: str = "file", source: str = "source") -> DataFrame:
    s = F.col(source)
    return files.select(F.col(name).alias("file"), F.size(F.split(s, "\n", -1)).alias("lines"), F.regexp_count(s, F.lit(r"(?m)^\s*(?:async\s+)?def\s+\w+")).alias("functions"), F.regexp_count(s, F.lit(r"(?m)^\s*class\s+\w+")).alias("classes"), F.regexp_count(s, F.lit(r"(?m)^(?:import|from)\s+\w+")).alias("imports"), s.rlike(r"\bopen\(|read_text|write_text").alias("does_io"))


def log_report(rows: DataFrame, level: Column | None = None) -> DataFrame:
    """session_id, phase, status, n of log rows (filtered by level where given)."""
    rows = rows if level is None else rows.where(level)
    return rows.groupBy("session_id", "phase", "status").agg(F.count("*").alias("n"))


def strip_markers(text: Column, sentinel: str) -> Column:
    """text up to the line that begins with the sentinel."""
    return F.regexp_replace(text, r"(?ms)^\Q" + sentinel + r"\E.*\z", "")


def wrap(text: Column, width: int = 76, prefix: str = "# ") -> Column:
    """text in lines of at most width characters (longer words stand alone), each with a prefix."""
    import textwrap

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join(prefix + x for x in textwrap.wrap(t, width, break_long_words=False)))

    return run(text)
