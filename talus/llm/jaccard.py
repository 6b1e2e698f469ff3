"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and exact verification on full n-gram sets.

1. Each document gets a fingerprint of its set of word n-grams (two 64-bit sums over the distinct n-grams) and a
   MinHash signature; bands() picks the number of bands of ROWS rows for the target recall at the threshold.
2. Documents with equal sets are one class with one representative, so copies are never compared. A representative
   is a row, told by its doc_id and a hash of its text, as a doc_id may stand in rows of different texts.
3. Representatives that share a band hash are a bucket; buckets of the same members are one. Buckets of more than BLOCK
   representatives or BLOCK_BYTES of text are dealt into blocks, so that a bucket of any size becomes tasks of two blocks each.
4. In each bucket the full n-gram sets are intersected (a matrix product over the n-grams that two documents of the
   blocks share) and each pair at or above the threshold is a link, counted in the bucket of the first band that the
   pair shares and nowhere else. A task returns sums of links and a spanning forest, never the pairs.
5. The components of the forests, so of verified links alone, are the classes.

Defined cases: a text of 1 to n - 1 words has its whole word sequence as its only n-gram; a null or empty text or
one of white space has no n-gram, no link, and is a class of its own; rows with a null doc_id keep a null class
and no link; rows that repeat a doc_id and text are copies of each other and count as links; rows that repeat a doc_id with
another text are compared like any other rows; white space between words doesn't matter, letter case does; extra columns
are ignored by join() and kept by deduplicate().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Representatives and bytes of text in a block; rows and bytes that one task verifies at least (small buckets share a task).
BLOCK, BLOCK_BYTES, TASK_ROWS, TASK_BYTES = 1024, 16 << 20, 2048, 4 << 20
_SHINGLE = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of that many rows with which a pair at the threshold shares one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams, row by row, and the first of each row (rows + 1)."""
    s, e, first = C.words(data, at)
    h = C.span_hashes(data, s, e)
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, count > 0)
    out_first = np.r_[0, np.cumsum(many)]
    row = np.repeat(np.arange(len(count)), many)
    start = first[row] + np.arange(len(row)) - out_first[row]
    g = np.zeros(len(start), C.U64)
    left = first[row + 1] - start
    for k in range(n):
        inside = left > k
        g += np.where(inside, h[np.minimum(start + k, len(h) - 1)] * C.U64(_SHINGLE[k]), C.U64(0)) if not inside.all() else h[start + k] * C.U64(_SHINGLE[k])
    return C.mix(g), out_first


def distinct(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted within the row, and their first places."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=n))]


def _keys(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each row's distinct hashes."""
    out = []
    for v in (g, C.mix(g ^ C.U64(0xA5A5A5A5A5A5A5A5))):
        total = np.zeros(len(v) + 1, C.U64)
        np.cumsum(v, out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def signatures(docs: DataFrame, n: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), size (its bytes), k1, k2 (fingerprint of the n-gram set), band array<long> of each row with an n-gram and a doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("size", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("band", pa.list_(pa.int64()))])
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, n_bands * rows, dtype=np.uint64) * C.U64(2) + C.U64(1)

    def run(batches):
        for batch, data, at in C.parts(batches):
            g, first = distinct(*shingles(data, at, n))
            has = np.flatnonzero(np.diff(first))
            k1, k2 = _keys(g, first)
            start = first[has]
            band = np.zeros((len(has), n_bands), C.U64)
            if len(has):
                for k in range(n_bands):
                    h = np.full(len(has), k, C.U64)
                    for r in range(rows):
                        h = C.mix(h ^ np.minimum.reduceat(g * a[k * rows + r], start))
                    band[:, k] = h
            flat = pa.array(C.i64(band.ravel()))
            take = pa.array(has)
            yield C.batch(schema, batch.column("doc_id").take(take), batch.column("th").take(take), np.diff(at)[has], C.i64(k1[has]), C.i64(k2[has]), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * n_bands), flat))

    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return known.mapInArrow(run, "doc_id long, th long, size long, k1 long, k2 long, band array<long>")


def _overlaps(g: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows left with those of rows right."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, code, count = np.unique(g, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], code[shared]
    used, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(used), 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        x = np.zeros((len(first) - 1, min(4096, len(used) - lo)), np.float32)
        x[row[a:b], code[a:b] - lo] = 1
        out += x[left] @ x[right].T
    return out


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least member of each node's component, from a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _elsewhere(band: np.ndarray, i: np.ndarray, j: np.ndarray, no: int) -> np.ndarray:
    """Whether rows i and j of band share a hash in a band before no."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i) if no else 0, 1 << 15):
        k = slice(lo, lo + (1 << 15))
        out[k] = (band[i[k], :no] == band[j[k], :no]).any(1)
    return out


def verify(rows: pa.Table, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a task: is it a text of its class, documents that it links to here, and the row of the least representative it is joined with."""
    size = rows.num_rows
    col = {k: rows.column(k).to_numpy() for k in ("no", "hash", "x", "y", "block", "k1", "k2", "n", "doc_id", "th")}
    band = rows.column("band").combine_chunks()
    band = band.flatten().to_numpy(zero_copy_only=False).reshape(size, -1) if size else np.zeros((0, 1), np.int64)
    g, first = [], [np.zeros(1, np.int64)]
    data, at = C.buffer(rows.column("text"))
    for lo, hi in C.slices(at):
        h, f = distinct(*shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n))
        g.append(h)
        first.append(f[1:] + first[-1][-1])
    g, first = np.concatenate(g), np.concatenate(first)
    k1, k2 = _keys(g, first)
    order = np.lexsort((col["th"], col["doc_id"], col["y"], col["x"], col["hash"], col["no"]))
    own = (C.i64(k1) == col["k1"]) & (C.i64(k2) == col["k2"])
    order = order[own[order]]
    group = np.stack([col[k][order] for k in ("no", "hash", "x", "y", "doc_id", "th")])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[:, 1:] != group[:, :-1]).any(0)
    order, group = order[fresh], group[:4, fresh]
    starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)]) if len(order) else np.zeros(0, int)
    links, root, valid = np.zeros(size, np.int64), np.arange(size), np.zeros(size, bool)
    valid[order] = True
    for lo, hi in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        at_ = order[lo:hi]
        sizes = np.diff(first)[at_]
        own_g = np.concatenate([g[first[i] : first[i + 1]] for i in at_])
        own_first = np.r_[0, np.cumsum(sizes)]
        x, y = col["x"][at_[0]], col["y"][at_[0]]
        left = np.flatnonzero(col["block"][at_] == x)
        right = np.flatnonzero(col["block"][at_] == y)
        both = _overlaps(own_g, own_first, left, right)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        link = both >= threshold * union - 1e-6
        if x == y:
            np.fill_diagonal(link, False)
        i, j = np.nonzero(link)
        away = _elsewhere(band, at_[left[i]], at_[right[j]], int(col["no"][at_[0]]))
        link[i[away], j[away]] = False
        weight = col["n"][at_]
        links[at_[left]] += link @ weight[right]
        full = np.zeros((len(at_), len(at_)), bool)
        full[np.ix_(left, right)] = link
        if x != y:
            links[at_[right]] += link.T @ weight[left]
            full |= full.T
        root[at_] = at_[_labels(full)]
    return valid, links, root


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, k1, k2 of each document with an n-gram; k1, k2, root (doc_id and th of the class's least row), n_links of each class of equal sets)."""
    n_bands = bands(threshold, recall, rows)
    sig = C.cut(signatures(docs, n, n_bands, rows))
    reps = C.cut(sig.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("node"), F.count("*").alias("n"), F.max("size").alias("size"), F.min("band").alias("band")))
    bucket = reps.select("node", "size", F.posexplode("band").alias("no", "hash"))
    marks = F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("f2")
    crowd = bucket.groupBy("no", "hash").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), *marks).where("m > 1")
    sets = crowd.groupBy("m", "f1", "f2").agg(F.min(F.struct("no", "hash")).alias("b"), F.max("bytes").alias("bytes"))
    sets = C.cut(sets.select("b.*", "m", "bytes", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("nb")))
    member = bucket.join(sets.select("no", "hash", "nb"), ["no", "hash"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    member = C.cut(member.groupBy("node").agg(F.collect_list(F.struct("no", "hash", "nb", "block")).alias("buckets")))
    members = C.cut(member.join(reps.drop("size"), "node").select("node.*", "k1", "k2", "n", "band", "buckets"))
    total, size = sets.agg(F.coalesce(F.sum(F.col("m") * F.col("nb")), F.lit(0)), F.coalesce(F.sum(F.col("bytes") * F.col("nb")), F.lit(0))).first()
    tasks = max(1, total // TASK_ROWS, size // TASK_BYTES)
    # the members grow with the input, so they are never broadcast, not even where they would be small enough
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").hint("merge")
    dealt = members.join(text, ["doc_id", "th"]).withColumn("b", F.explode("buckets")).select("doc_id", "th", "k1", "k2", "n", "band", "text", "b.*")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other").cast("int")).withColumn("y", F.greatest("block", "other").cast("int"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("no", "hash", "x", "y"), F.lit(tasks)))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("links", pa.int64()), ("root_id", pa.int64()), ("root_th", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        valid, links, root = verify(table, n, threshold)
        keep = np.flatnonzero(valid & (links > 0))
        doc, th = table.column("doc_id").to_numpy(), table.column("th").to_numpy()
        return pa.Table.from_batches([C.batch(schema, doc[keep], th[keep], links[keep], doc[root[keep]], th[root[keep]])])

    found = dealt.select("task", "doc_id", "th", "k1", "k2", "n", "no", "hash", "block", "x", "y", "band", "text").groupBy("task").applyInArrow(run, "doc_id long, th long, links long, root_id long, root_th long")
    found = C.cut(found)
    node, root = F.struct("doc_id", "th"), F.struct(F.col("root_id").alias("doc_id"), F.col("root_th").alias("th"))
    joined = connected(found.select(node.alias("a"), root.alias("b")).distinct())
    links = found.groupBy(node.alias("node")).agg(F.sum("links").alias("links"))
    out = reps.drop("band", "size").join(joined, "node", "left").join(links, "node", "left")
    out = out.select("k1", "k2", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return sig.select("doc_id", "th", "k1", "k2"), C.cut(out)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (documents at or above the threshold) of each row."""
    of, found = classes(docs, n, threshold, recall)
    linked = of.join(found, ["k1", "k2"]).select("doc_id", F.col("root.doc_id").alias("class_id"), "n_links")
    none = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~_has_words(docs, "text") | F.col("doc_id").isNull())
    return linked.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _has_words(docs: DataFrame, column: str):
    return F.coalesce(docs[column].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs, all columns, with one row of each class: one with the class's least doc_id. Rows without a class stay."""
    of, found = classes(docs, n, threshold, recall)
    kind = of.join(found, ["k1", "k2"]).groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.first("root").alias("root"))
    kind = C.cut(kind.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "rows", ((F.col("root.doc_id") != F.col("doc_id")) | (F.col("root.th") != F.col("th"))).alias("gone")))
    on = lambda rows, x: (rows["doc_id"].cast("long") == x["__id"]) & (F.xxhash64(rows["text"]) == x["__th"])
    gone = kind.where("gone").select("__id", "__th")
    kept = docs.join(gone, on(docs, gone), "left_anti")
    twice = kind.where("rows > 1 and not gone").select("__id", "__th")
    if twice.isEmpty():
        return kept
    again, once = kept.join(twice, on(kept, twice), "left_semi"), kept.join(twice, on(kept, twice), "left_anti")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(C.read(spark, sf_dir, "documents"))
