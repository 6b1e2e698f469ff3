"""Exact top-k search over binary codes: incremental multi-index hashing.

A code is cut into segments of SEGMENT bits, and each block of the index keeps, for every segment, its codes sorted by
the segment's value. A query looks up all values within radius 0 of its segments, then 1, 2, ...; after radius r in
the first j segments and r - 1 in the rest, every code within distance m r + j - 1 (m segments, r from 0) has been
seen and verified. The search of a query ends when its kth verified distance is no larger than that, which proves
the result, ties included. Segments in which all codes of a block agree are not searched: what a query differs there is a part of
every distance, and is added to the bound.

The index is dealt into blocks. The rows of a block and, after them, all queries come to one task, which builds the tables once and
answers the queries as they stream by; the k best of each block are merged. Candidates are verified BATCH at a time, however many
codes share a segment's value.

Equal codes of a block share one entry, of which the k + 1 least ids are kept: no more of them can be among the k
nearest (ties by id), so a hot code costs no more than any other.

Defined cases: rows with a null id, a null vector or a null element are neither index nor query; vectors shorter than the longest
count as 0 there, empty ones are 0 all over; a query never finds the row with its own id; rows that repeat an id count once, the
least code wins; fewer than k other rows give fewer results; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

K, SEGMENT, QUERY_STEP = 10, 16, 20
#: Codes in a block of the index, at most; smaller blocks of LEAST_ROWS at least where that gives work to up to TASKS tasks.
INDEX_ROWS, LEAST_ROWS, TASKS = 500_000, 50_000, 32
#: Candidates that are verified at once.
BATCH = 1 << 20


def codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code array<long>: bit b is whether component b is over 0, in 64-bit words."""
    clean = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    size = clean.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    words = [F.lit(0).cast("long") for _ in range(max(1, -(-size // 64)))]
    for w in range(len(words)):
        bits = F.slice(vector, 64 * w + 1, 64)
        words[w] = F.aggregate(F.transform(bits, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return clean.select(F.col(id_col).cast("long").alias("id"), F.array(*words).alias("code")).groupBy("id").agg(F.min("code").alias("code"))


class MultiIndex:
    """The tables of one block. codes: (rows, 64-bit words)."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, k: int):
        order = np.lexsort((ids, *code.T))
        ids, code = ids[order], code[order]
        new = np.ones(len(ids), bool)
        new[1:] = (code[1:] != code[:-1]).any(1)
        start = np.flatnonzero(new)
        self.code, self.k = code[start], k
        size = np.minimum(np.diff(np.r_[start, len(ids)]), k + 1)
        self.first = np.r_[0, np.cumsum(size)]
        self.ids = ids[np.repeat(start, size) + np.arange(self.first[-1]) - np.repeat(self.first[:-1], size)]
        self.parts = self.code.view(np.uint16).reshape(len(self.code), -1) if len(code) else np.zeros((0, 4), np.uint16)
        same = (self.parts == self.parts[:1]).all(0)
        if same.all():
            same[0] = False
        self.same, self.common = same, self.parts[0, same] if len(code) else np.zeros(0, np.uint16)
        self.parts = np.ascontiguousarray(self.parts[:, ~same])
        self.order = [np.argsort(p, kind="stable").astype(np.int32) for p in self.parts.T]
        self.at = [np.r_[0, np.cumsum(np.bincount(p, minlength=1 << SEGMENT))].astype(np.int64) for p in self.parts.T]

    @staticmethod
    def masks(radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(SEGMENT), radius)], np.uint16)

    def search(self, ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of the k nearest other ids of each query, by distance and id."""
        m = self.parts.shape[1]
        parts = code.view(np.uint16).reshape(len(code), -1)
        always = np.bitwise_count(parts[:, self.same] ^ self.common).sum(1, dtype=np.int64)  # of every distance
        parts = parts[:, ~self.same]
        best = [np.zeros(0, np.int64) for _ in range(3)]
        active = np.arange(len(code)) if len(self.code) else np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            masks = self.masks(radius)
            for j in range(m):
                found = [best]
                for lo in range(0, len(active), max(1, (1 << 18) // len(masks))):
                    rows = active[lo : lo + max(1, (1 << 18) // len(masks))]
                    found += self._probe(rows, parts[rows, j][:, None] ^ masks[None, :], j, ids, code)
                best = self._best([np.concatenate(x) for x in zip(*found, strict=True)])
                count = np.bincount(best[0], minlength=len(code))
                last = np.zeros(len(code), np.int64)
                np.maximum.at(last, best[0], best[2])
                done = (count >= self.k) & (last <= always + m * radius + j)
                active = active[~done[active]]
                if not len(active):
                    return tuple(best)
        return tuple(best)

    def _probe(self, rows, values, j, ids, code):
        start = self.at[j][values].ravel()
        many = self.at[j][values.ravel().astype(np.int64) + 1] - start
        some = np.flatnonzero(many)
        start, ends, owners = start[some], np.cumsum(many[some]), np.repeat(rows, values.shape[1])[some]
        for lo in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
            at = np.arange(lo, min(lo + BATCH, int(ends[-1])))
            cell = np.searchsorted(ends, at, "right")
            own = owners[cell]
            entry = self.order[j][start[cell] + at - (ends[cell] - many[some][cell])]
            far = np.bitwise_count(self.code[entry] ^ code[own]).sum(1, dtype=np.int64)
            size = self.first[entry + 1] - self.first[entry]
            o, f = np.repeat(own, size), np.repeat(far, size)
            i = self.ids[np.repeat(self.first[entry] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(o))]
            other = i != ids[o]
            yield self._best([o[other], i[other], f[other]])

    def _best(self, found):
        """Without repeats, the k first of each query."""
        q, i, f = found
        order = np.lexsort((i, f, q))
        q, i, f = q[order], i[order], f[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, f = q[new], i[new], f[new]
        start = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - start < self.k
        return [q[keep], i[keep], f[keep]]


def _arrays(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = table.num_rows
    code = table.column("code").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)
    return table.column("id").to_numpy(), np.ascontiguousarray(code)


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, neighbor_id, distance, rank of the k nearest index rows of each query; both are (id, code)."""
    index, queries = C.cut(index), C.cut(queries)
    n = index.count()
    blocks = max(1, -(-n // INDEX_ROWS), min(TASKS, n // LEAST_ROWS))
    # a block's rows first, then every query
    left = index.select(F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).alias("x"), F.lit(False).alias("asks"), "id", "code")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("x"), F.lit(True).alias("asks"), "id", "code")
    dealt = left.unionByName(right).repartition(blocks, "x").sortWithinPartitions("x", "asks")
    schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int32())])

    def run(batches):
        block, held, tables = None, [], None
        for b in batches:
            x, asks = b.column("x").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (asks[1:] != asks[:-1])]) if len(x) else []
            for lo, hi in zip(edge, [*edge[1:], len(x)], strict=True):
                ids, code = _arrays(b.slice(lo, hi - lo))
                if x[lo] != block:
                    block, held, tables = x[lo], [], None
                if not asks[lo]:
                    held.append((ids, code))
                    continue
                if held:
                    tables, held = MultiIndex(*(np.concatenate(v) for v in zip(*held, strict=True)), k), []
                if tables is not None:
                    q, i, f = tables.search(ids, code)
                    yield C.batch(schema, ids[q], i, f.astype(np.int32))

    near = dealt.mapInArrow(run, "query_id long, neighbor_id long, distance int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by QUERY_STEP, against all rows."""
    index = C.cut(codes(C.read(spark, sf_dir, "embeddings")))
    return search(index, index.where(F.col("id") % QUERY_STEP == 0))


#: The same by comparing every query with every row.
ORACLE_SQL = """
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
d AS (
  SELECT q.id AS query_id, r.id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.id <> r.id WHERE q.id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM k WHERE rank <= 10
"""
