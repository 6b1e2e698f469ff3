"""Writers: JSON documents, partitioned extracts, versioned runs, annotated sources. Spark's committer makes them atomic."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def write_subsets(subsets: dict[str, DataFrame], path: str) -> None:
    """Each selection to a folder of its own."""
    for name, df in subsets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_batches(batched: DataFrame, path: str) -> None:
    """A folder for each batch of batched (session_id, batch)."""
    batched.repartition("session_id", "batch").write.mode("overwrite").partitionBy("session_id", "batch").json(path)


def write_file_extracts(index: DataFrame, path: str, least: int = 3) -> None:
    """A folder for each file that stands in least sessions or more."""
    index.where(F.col("session_count") >= least).withColumn("name", F.regexp_replace("file", "[/.]", "_")).write.mode("overwrite").partitionBy("name").json(path)


def archive_run(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """A copy of each table under the run's name, which must be new."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{run}/{name}")


# --- fixed values: comment styles by extension
COMMENTS = {"py": ("# ", ""), "sh": ("# ", ""), "yaml": ("# ", ""), "yml": ("# ", ""), "toml": ("# ", ""), "js": ("// ", ""), "ts": ("// ", ""), "jsx": ("// ", ""), "tsx": ("// ", ""), "css": ("/* ", " */"), "html": ("<!-- ", " -->"), "md": ("<!-- ", " -->")}


def annotate(source: str, header: str, footer: str, inline: dict[str, str], extension: str = "py") -> str:
    """source with a header, a footer and, in Python, a comment before each function or class of inline; again gives the same."""
    begin, end = COMMENTS.get(extension, ("# ", ""))
    mark = "@ctx "
    comment = lambda text, pad="": "\n".join(f"{pad}{begin}{mark}{x}{end}" for x in text.split("\n"))
    rows = [x for x in source.split("\n") if not x.strip().startswith(f"{begin}{mark}".strip())]
    if extension == "py" and inline:
        try:
            found = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.name, n.col_offset) for n in ast.walk(ast.parse("\n".join(rows))) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and n.name in inline]
        except SyntaxError:
            found = []
        for line, name, pad in sorted(found, reverse=True):
            rows.insert(line - 1, comment(inline[name], " " * pad))
    top = 1 if rows and rows[0].startswith("#!") else 0
    body = "\n".join([*rows[:top], *([comment(header)] if header else []), *rows[top:]])
    return body.rstrip("\n") + "\n" + (comment(footer) + "\n" if footer else "")


def annotated(files: DataFrame) -> DataFrame:
    """files (file, source, header, footer, inline map) with annotated sources."""

    @F.pandas_udf("string")
    def run(file: pd.Series, source: pd.Series, header: pd.Series, footer: pd.Series, inline: pd.Series) -> pd.Series:
        rows = zip(file, source, header, footer, inline, strict=True)
        return pd.Series([annotate(s or "", h or "", t or "", dict(i or {}), f.rpartition(".")[2]) for f, s, h, t, i in rows])

    return files.withColumn("annotated", run("file", "source", "header", "footer", "inline"))


def changed_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows to append to an append-only table: those it doesn't have."""
    return new.join(old, [c for c in new.columns if c in old.columns], "left_anti")
