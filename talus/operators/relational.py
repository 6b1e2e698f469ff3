"""Joins and selections that messages need and SQL has no word for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, below: int, above: int, how: str = "inner") -> DataFrame:
    """Rows of equal keys with right_at within left_at - below .. left_at + above; how: inner, left_semi or left_anti.

    An equi-join: both sides get buckets of below + above + 1 positions, the left row looks into the two (three) that
    its band touches, so no range is compared across a whole key.
    """
    width = below + above + 1
    bucket = lambda c: F.floor(c / width)
    r = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.col(right_at).alias("__r_at"), F.struct(*right.columns).alias("__row")).withColumn("__b", bucket(F.col("__r_at")))
    l_at = F.col(left_at)
    cond = [F.col(k) == F.col(f"__r_{k}") for k in keys] + [F.col("__r_at").between(F.col("__l_at") - below, F.col("__l_at") + above)]
    if how == "inner":
        lhs = left.withColumn("__l_at", l_at).withColumn("__lb", F.explode(F.sequence(bucket(l_at - below), bucket(l_at + above))))
        joined = lhs.join(r, reduce(lambda a, b: a & b, [*cond, F.col("__lb") == F.col("__b")]))
        new = [c for c in right.columns if c not in left.columns]
        return joined.select(*left.columns, *(F.col(f"__row.{c}").alias(c) for c in new), F.col("__r_at").alias(f"matched_{right_at}"))
    # semi and anti: the right side's bands are laid over the left row's bucket, so each left row stays one row
    near = r.drop("__row").withColumn("__nb", F.explode(F.sequence(bucket(F.col("__r_at") - above), bucket(F.col("__r_at") + below)))).distinct()
    lhs = left.withColumn("__l_at", l_at).withColumn("__lb", bucket(l_at))
    return lhs.join(near, reduce(lambda a, b: a & b, [*cond, F.col("__lb") == F.col("__nb")]), how).drop("__l_at", "__lb")


def coalesce_join(df: DataFrame, side: DataFrame, keys: list[tuple[Column, Column]], values: list[str]) -> DataFrame:
    """df with values of side by the first pair of keys that matches: a left equi-join for each pair, then coalesce."""
    out, found = df, {v: [] for v in values}
    for k, (mine, other) in enumerate(keys):
        key = f"__k{k}"
        part = side.select(other.alias(key), *(F.col(v).alias(f"__{v}_{k}") for v in values))
        part = part.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(f"__{v}_{k}").alias(f"__{v}_{k}") for v in values))
        out = out.join(part, mine == F.col(key), "left").drop(key)
        for v in values:
            found[v].append(f"__{v}_{k}")
    drop = [c for cols in found.values() for c in cols]
    return out.withColumns({v: F.coalesce(*cols) for v, cols in found.items()}).drop(*drop)


#: Names that contains_join() gives to every task; more of them meet the texts by a shuffle.
FEW_NAMES = 1000


def contains_join(texts: DataFrame, names: DataFrame, text: str, name: str, gram: int = 6, how: str = "inner", few: int = FEW_NAMES) -> DataFrame:
    """Pairs of rows where the text contains the name, letter case included; a null or empty name stands nowhere.

    Up to few names (counted first) go to the tasks. Beyond that the pairs meet in an equi-join: a text that contains a name
    contains the name's first gram characters (all of a shorter one), so rows are dealt by those and compared then.
    """
    named, hit = names.where(F.length(name) > 0), F.col(text).contains(F.col(name))
    if named.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(named), hit, how)
    size = F.length(F.col(text))
    cut = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n))), lambda x: F.length(x) == n)
    lengths = sorted(r.n for r in named.select(F.least(F.length(name), F.lit(gram)).alias("n")).distinct().collect())  # at most gram rows
    left = texts.withColumn("__key", F.explode(F.array_distinct(F.concat(*(cut(n) for n in lengths)))))
    found = left.join(named.withColumn("__key", F.substring(F.col(name), 1, gram)), "__key").where(hit)
    return found.select(*texts.columns).distinct() if how == "left_semi" else found.drop("__key")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def first_match(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Each key's row from the first of the sources that has it."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("__p", F.lit(k)) for k, s in enumerate(sources)])
    others = [c for c in both.columns if c not in (*keys, "__p")]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*others), "__p").alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def merge_passes(messages: DataFrame, passes: dict[str, DataFrame], keys: list[str], order: str = "seq") -> DataFrame:
    """messages with a struct of each pass's result (null where it has none); the last of repeated results wins."""
    out = messages
    for name, rows in passes.items():
        one = last_wins(rows, keys, order)
        out = out.join(one.select(*keys, F.struct(*(c for c in one.columns if c not in (*keys, order))).alias(name)), keys, "left")
    return out


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group, with rank; order has to be total."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mentions_file(text: Column, name: Column) -> Column:
    """Whether text has a file's name, its stem, or the stem with spaces for underscores, letter case aside."""
    low, stem = F.lower(text), F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    return low.contains(F.lower(name)) | low.contains(stem) | low.contains(F.replace(stem, F.lit("_"), F.lit(" ")))


def window_indices(mentions: DataFrame, keys: list[str], at: str, width: int = 10) -> DataFrame:
    """Distinct positions within width of a mention, from 0."""
    spread = F.explode(F.sequence(F.greatest(F.col(at) - width, F.lit(0)), F.col(at) + width))
    return mentions.select(*keys, spread.alias(at)).distinct()


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str = "lo", hi: str = "hi", width: int = 64) -> DataFrame:
    """points with the intervals (closed) that hold them: intervals are laid over buckets of width positions."""
    laid = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(laid, [*keys, "__b"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__b")


def compare_stores(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (both, only_left, only_right, mismatch) of a full outer join."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    out = a.join(b, key, "full_outer")
    status = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(F.col("left_value") != F.col("right_value"), "mismatch").otherwise("both")
    return out.withColumn("status", status)


def lookback(rows: DataFrame, key: str, order: str, target: Column, source: Column, within: int, k: int) -> DataFrame:
    """Each target row with the k nearest source rows among the within rows before it (nearest first), as an array."""
    earlier = W.partitionBy(key).orderBy(order).rowsBetween(-within, -1)
    seen = F.collect_list(F.when(source, F.struct(*rows.columns))).over(earlier)
    return rows.withColumn("previous", F.slice(F.reverse(seen), 1, k)).where(target)
