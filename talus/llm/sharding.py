"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest metadata dimension.

Only DataFrame functions touch rows. A point is a group of rows with equal texts (so copies share a shard), its
weight their bytes; a group heavier than SPLIT_SHARE of a shard is dealt into that many points by a hash of doc_id,
so that no text, however often copied, outweighs the law. The tree's dimensions are the size of the text, the
metadata columns that exist, and doc_id (the least of a group). A node that still holds m shards splits along the
dimension of largest extent, relative to the whole table's, where floor(m / 2) / m of its bytes lie below. The cut
is found by histograms of 4,096 buckets that are refined inside the bucket that holds it: one row for each node
and bucket reaches the driver, whatever the size of the table. Positions break ties by a hash of the point, so equal
coordinates can be split too.

The number of shards is given, or follows from the bytes that a leaf is to hold. What the driver decides for each node (at most
as many nodes as shards) goes back as a small literal table that is joined.

Law: `bytes`. Strings are ordered by their first six bytes only; what shares them is equal there and told apart by the hash.
Defined cases: null text weighs 1 and has crc32 0, as an empty one; null metadata sort first, numbers that
aren't finite count as 0; null doc_ids count as 0 for the tree; repeated rows are copies and get slots of their own; an empty table gives no row;
with fewer points than shards some shards stay empty; extra columns are ignored, other columns can be chosen as
dimensions. shard and slot depend on the rows alone, not on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
#: A group of equal texts heavier than this share of a shard is dealt into points of its own.
SPLIT_SHARE = 0.05
#: A cut is refined until its bucket is lighter than this share of a shard.
CUT_SHARE = 0.001
COORDINATE, TIE, DIGIT = 24, 36, 12
#: Rows that one task numbers.
SLOT_ROWS = 20_000


def _position(column):
    """Strings by their first six bytes, in order; numbers as they are."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(column.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def _finite(column):
    return F.when(F.abs(column) < float("inf"), column).otherwise(0.0)  # nothing is less than NaN but it isn't less than infinity


def _points(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    numeric = dict(docs.dtypes)
    at = [(_finite(docs[c].cast("double")) if numeric[c] in ("int", "bigint", "double", "float", "smallint") else _position(docs[c])).alias(f"d{k + 2}") for k, c in enumerate(dimensions)]
    size = F.octet_length(text).cast("long") + 1
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), F.log(size.cast("double")).alias("d0"), F.coalesce(docs["doc_id"].cast("double"), F.lit(0.0)).alias("d1"), *at)


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A literal table of whole numbers, one row a node, for a broadcast join."""
    items = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names.split(), r, strict=True))) for r in rows))
    return F.broadcast(spark.range(1).select(F.inline(items)))


def _key(points: DataFrame):
    """The key of the row's dimension d."""
    n = sum(c[:1] == "k" and c[1:].isdigit() for c in points.columns)
    return F.element_at(F.array(*(f"k{k}" for k in range(n))), F.col("d").cast("int") + 1)


def _medians(points: DataFrame, dims: dict[int, int], goal: dict[int, float], near: float) -> dict[int, int]:
    """Of each node: the key below which goal bytes lie, from histograms of ever narrower ranges of its dimension."""
    bits = COORDINATE + TIE
    low, below, done = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0), {}
    while len(done) < len(dims):
        bits -= DIGIT
        at = _table(points.sparkSession, "node d range", [(n, d, low[n] >> (bits + DIGIT)) for n, d in dims.items() if n not in done])
        inside = points.join(at, "node").withColumn("key", _key(points)).where(F.shiftright("key", bits + DIGIT) == F.col("range"))
        found: dict[int, list] = {}
        for r in inside.groupBy("node", F.shiftright("key", bits).alias("bucket")).agg(F.sum("w").alias("w")).collect():
            found.setdefault(r.node, []).append((r.bucket, r.w))
        for n in [n for n in dims if n not in done]:
            total = below[n]
            for at, w in sorted(found[n]):
                if total + w >= goal[n]:
                    break
                total += w
            low[n], below[n] = at << bits, total
            if w <= near or not bits:
                done[n] = (at + (total + w - goal[n] < goal[n] - total)) << bits
    return done


def keyed(rows: DataFrame, leaf: float, edge, n_dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows with sub, points: same, size, sub, w (bytes), node 1 and a key for each dimension)."""
    group = rows.groupBy("same", "size").agg(F.sum("size").alias("w"))
    # at most shards / SPLIT_SHARE groups are that heavy
    heavy = F.broadcast(group.where(F.col("w") > SPLIT_SHARE * leaf).select("same", "size", F.ceil(F.col("w") / (SPLIT_SHARE * leaf)).alias("many")))
    rows = rows.join(heavy, ["same", "size"], "left").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.coalesce("many", F.lit(1))))
    tie = F.shiftrightunsigned(F.xxhash64("same", "size", "sub"), 64 - TIE)
    keys = []
    for k in range(n_dims):
        lo, extent = edge[f"lo{k}"] or 0.0, (edge[f"hi{k}"] or 0.0) - (edge[f"lo{k}"] or 0.0)
        share = (F.col(f"d{k}") - lo) / extent if extent > 0 else F.lit(0.0)
        keys.append((F.shiftleft(F.least(F.floor(share * (1 << COORDINATE)), F.lit((1 << COORDINATE) - 1)).cast("long"), TIE) + tie).alias(f"k{k}"))
    units = rows.groupBy("same", "size", "sub").agg(F.sum("size").alias("w"), *(F.min(f"d{k}").alias(f"d{k}") for k in range(n_dims)))
    return rows, C.cut(units.select("same", "size", "sub", "w", F.lit(1).cast("long").alias("node"), *keys))


def grow(points: DataFrame, shards: int, leaf: float, n_dims: int) -> DataFrame:
    """points with the shard of each, by splitting every node that holds several shards."""
    leaves, open_ = {1: shards}, [1]
    while open_ := [n for n in open_ if leaves[n] > 1]:
        mine = points.where(F.col("node") >= min(open_)).groupBy("node")
        extents = [r for r in mine.agg(F.sum("w").alias("w"), *(F.max(f"k{k}") - F.min(f"k{k}") for k in range(n_dims))).collect() if leaves[r.node] > 1]
        if not extents:
            break
        dims = {r.node: max(range(n_dims), key=lambda k, r=r: (r[k + 2], -k)) for r in extents}
        cuts = _medians(points, dims, {r.node: r.w * (leaves[r.node] // 2) / leaves[r.node] for r in extents}, CUT_SHARE * leaf)
        cut = _table(points.sparkSession, "node d cut", [(n, d, cuts[n]) for n, d in dims.items()])
        child = F.when(F.col("d").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_key(points) >= F.col("cut")).cast("long"))
        points = C.cut(points.join(cut, "node", "left").withColumn("node", child).drop("d", "cut"))
        for n in dims:
            leaves[2 * n], leaves[2 * n + 1] = leaves[n] // 2, leaves[n] - leaves[n] // 2
        open_ = [c for n in dims for c in (2 * n, 2 * n + 1)]
    order = sorted((n for n in leaves if 2 * n not in leaves), key=lambda n: n << (62 - n.bit_length()))
    number = _table(points.sparkSession, "node shard", [(n, shard) for shard, n in enumerate(order)])
    return points.join(number, "node").select("same", "size", "sub", F.col("shard").cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source"), target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row. With target_bytes there are as many shards as hold that much each."""
    names = [c for c in dimensions if c in docs.columns]
    rows = C.cut(_points(docs, names))
    n_dims = len(names) + 2
    edge = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *(f(f"d{k}").alias(f"{name}{k}") for k in range(n_dims) for f, name in ((F.min, "lo"), (F.max, "hi")))).first()
    shards = max(1, -(-edge.total // target_bytes)) if target_bytes else shards
    leaf = max(1.0, edge.total / shards)
    rows, points = keyed(rows, leaf, edge, n_dims)
    placed = rows.select("doc_id", "size", "text_crc32", "same", "sub").join(grow(points, shards, leaf, n_dims), ["same", "size", "sub"])
    return _slots(C.cut(placed.select("doc_id", "size", "text_crc32", "shard")), math.ceil(edge.n / shards / SLOT_ROWS))


def _slots(placed: DataFrame, buckets: int) -> DataFrame:
    """Gapless slots: rows are numbered inside hashed buckets of a shard, after the rows of its earlier buckets."""
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, buckets))).cast("int"))
    count = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = count.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("rank", rank).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(C.read(spark, sf_dir, "documents"))
