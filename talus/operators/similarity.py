"""Similarity of source files: fingerprints, pair signals, patterns, file statistics, and candidates without all pairs."""

from __future__ import annotations

import ast
import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of names with their weight in the signal score.
SIGNALS = {"func": ("functions", 3), "callable": ("callables", 2), "class": ("classes", 2), "import": ("imports", 1), "constant": ("constants", 1), "name": ("stem_words", 1)}
COMMON_NAMES = ("__init__", "__str__", "__repr__", "main", "to_dict")
FALLBACK = {"functions": r"(?m)^def\s+(\w+)", "callables": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "classes": r"(?m)^class\s+(\w+)", "imports": r"(?m)^(?:import|from)\s+(\w+)"}
_NAMES = ("functions", "callables", "classes", "methods", "imports", "from_imports", "constants", "strings")
FINGERPRINT = ", ".join(f"{k} array<string>" for k in _NAMES) + ", parsed boolean"


def strip_annotations(source: str) -> str:
    """Without comments that annotate (`# @ctx` to the end of the line)."""
    return re.sub(r"(?m)[ \t]*# @ctx.*$", "", source)


def fingerprint(source: str | None) -> dict:
    """Names in a Python source, by its syntax tree, or by patterns where it has no tree."""
    clean = strip_annotations(source or "")
    found: dict[str, set[str]] = {k: set() for k in _NAMES}
    try:
        tree = ast.parse(clean)
    except (SyntaxError, ValueError, RecursionError):
        found |= {k: set(re.findall(p, clean)) for k, p in FALLBACK.items()}
        return {k: sorted(v) for k, v in found.items()} | {"parsed": False}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found["callables"].add(node.name)
        elif isinstance(node, ast.ClassDef):
            found["classes"].add(node.name)
            found["methods"] |= {x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)}
        elif isinstance(node, ast.Import):
            found["imports"] |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found["imports"].add(node.module.split(".")[0])
            found["from_imports"] |= {a.name for a in node.names}
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value) > 10:
            found["strings"].add(node.value)
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found["functions"].add(node.name)
        elif isinstance(node, ast.Assign):
            found["constants"] |= {t.id for t in node.targets if isinstance(t, ast.Name) and t.id.isupper() and len(t.id) > 2}
    return {k: sorted(v) for k, v in found.items()} | {"parsed": True}


def fingerprints(files: DataFrame, name: str = "file", source: str = "source") -> DataFrame:
    """file, clean_source, the name sets and stem_words of each file."""

    @F.pandas_udf(FINGERPRINT)
    def names(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint(x) for x in s])

    out = files.select(F.col(name).alias("file"), F.regexp_replace(source, r"(?m)[ \t]*# @ctx.*$", "").alias("clean_source"), names(F.col(source)).alias("n"))
    words = F.filter(F.split(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", ""), "_"), lambda w: w != "")
    return out.select("file", "clean_source", "n.*", F.array_distinct(words).alias("stem_words"))


def overlap(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def candidates(prints: DataFrame, columns: tuple[str, ...] = ("callables", "classes", "imports", "constants", "stem_words")) -> DataFrame:
    """file_a < file_b that share any name: only such pairs can have a signal score over 0."""
    names = prints.select("file", F.explode(F.array_distinct(F.flatten(F.array(*(F.transform(c, lambda x, c=c: F.concat(F.lit(f"{c}:"), x)) for c in columns))))).alias("name"))
    a, b = names.withColumnRenamed("file", "file_a"), names.withColumnRenamed("file", "file_b")
    return a.join(b, "name").where("file_a < file_b").select("file_a", "file_b").distinct()


def pair_signals(prints: DataFrame, pairs: DataFrame | None = None, text_threshold: float = 0.1) -> DataFrame:
    """The overlaps, containments, shared names, signal score and text similarity of pairs; the text is compared only
    where the score is text_threshold or more or the names overlap by over 0.3."""
    pairs = candidates(prints) if pairs is None else pairs
    cols = [c for c in prints.columns if c != "file"]
    side = lambda s: prints.select(F.col("file").alias(f"file_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    df = pairs.join(side("a"), "file_a").join(side("b"), "file_b")
    both = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    df = df.withColumns({f"{k}_overlap": overlap(*both(c)) for k, (c, _) in SIGNALS.items()})
    have = (F.size("functions_a") > 0) & (F.size("functions_b") > 0)
    df = df.withColumns({
        "containment_a_in_b": F.when(have, containment(*both("functions"))).otherwise(0.0), "containment_b_in_a": F.when(have, containment(F.col("functions_b"), F.col("functions_a"))).otherwise(0.0),
        "shared_functions": F.array_sort(F.array_except(F.array_intersect(*both("callables")), F.array(*(F.lit(x) for x in COMMON_NAMES)))), "signal_score": sum((F.col(f"{k}_overlap") * w for k, (_, w) in SIGNALS.items()), F.lit(0.0)),
    })
    keep = ["file_a", "file_b", *(f"{k}_overlap" for k in SIGNALS), "containment_a_in_b", "containment_b_in_a", "shared_functions", "signal_score"]
    gate = (F.col("signal_score") >= text_threshold) | (F.col("name_overlap") > 0.3)
    close = df.where(gate).select(*keep, text_similarity(F.col("clean_source_a"), F.col("clean_source_b")).alias("text_similarity"))
    return close.unionByName(df.where(~gate).select(*keep, F.lit(0.0).alias("text_similarity")))


def text_similarity(a: Column, b: Column) -> Column:
    """The ratio of matching blocks (2 M / T) of the first text, taken as the first, and the second."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "", autojunk=True).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def patterns() -> Column:
    """The kinds of similarity of a pair with signals; the last two only where there is no other."""
    text, func, call, imports, name = (F.col(c) for c in ("text_similarity", "func_overlap", "callable_overlap", "import_overlap", "name_overlap"))
    contained = (F.col("containment_a_in_b") > 0.8) | (F.col("containment_b_in_a") > 0.8)
    rules = [
        ("dead_copy", text > 0.9), ("evolution_pair", (text > 0.6) & (text <= 0.9)), ("function_clone", (func > 0.5) & (text < 0.9)), ("partial_extraction", contained & (text < 0.6)), ("template_variant", (call > 0.4) & (text < 0.3)),
        ("import_twin", (imports > 0.7) & (func < 0.3)), ("name_only", (name > 0.3) & (text < 0.05) & (func < 0.05)), ("interface_mismatch", (F.size("shared_functions") >= 3) & (text < 0.3)),
    ]
    found = F.array_compact(F.array(*(F.when(cond, k) for k, cond in rules)))
    rest = F.when((call > 0.15) & (imports > 0.3) & (text < 0.4), F.array(F.lit("structural_sibling"))).when((imports > 0.4) & (call > 0.1), F.array(F.lit("shared_ecosystem"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(rest)


def matches(signals: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs with a pattern, or a score over least."""
    return signals.withColumn("patterns", patterns()).where((F.size("patterns") > 0) | (F.col("signal_score") > least))


def file_statistics(found: DataFrame, prints: DataFrame) -> DataFrame:
    """matches, strongest match and isolation of each file."""
    sides = found.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "signal_score").unionByName(found.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), "signal_score"))
    agg = sides.groupBy("file").agg(F.count("*").alias("matches"), F.max(F.struct("signal_score", "other")).alias("best"))
    out = prints.select("file").join(agg, "file", "left")
    n = F.coalesce("matches", F.lit(0))
    return out.select("file", n.alias("matches"), F.col("best.other").alias("strongest_match"), F.col("best.signal_score").alias("strongest_score"), (1 - F.least(F.lit(1.0), n / 10)).alias("isolation"))


def pattern_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def incremental(changed: DataFrame, cached: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of changed files (fingerprints) with cached ones of other names, at or over least: alerts, strongest first."""
    new = changed.select("file").distinct()
    all_ = changed.unionByName(cached.join(new, "file", "left_anti"))
    pairs = candidates(all_)
    touched = pairs.join(new.select(F.col("file").alias("file_a"), F.lit(1).alias("x")), "file_a", "left").join(new.select(F.col("file").alias("file_b"), F.lit(1).alias("y")), "file_b", "left").where("x is not null or y is not null").select("file_a", "file_b")
    return matches(pair_signals(all_, touched)).where(F.col("signal_score") >= least).orderBy(F.desc("signal_score"), "file_a", "file_b")


def regex_fingerprint(source: Column) -> Column:
    """The pattern fallback alone, in the JVM."""
    return F.struct(*(T.matches(p, source).alias(k) for k, p in FALLBACK.items()))
