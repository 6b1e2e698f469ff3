"""Removal of repeated byte strings: external induced sorting of the windows of a corpus, in shards.

A byte goes when a string of LENGTH bytes that covers it starts anywhere else too. Windows are sharded so that equal ones
meet: every window of LENGTH bytes has an anchor, the KMER bytes inside it with the least hash, and successive windows
with one anchor form a run, whose bytes hold all of them.

1. Runs are made from all texts; an anchor that stands once in the corpus can't repeat, so its run is dropped.
2. Runs of equal bytes are aggregated to one with a count before their bytes are shuffled.
3. All runs that are left are sorted by induction (suffixes.py), those that stand more than once too: every repeated
   window comes out of a sort. A shard holds about SHARD_BYTES of runs, several times what a sort keeps in memory.
4. An anchor with more than HOT different runs would make one shard of them all, so its runs are cut into bands of BAND
   levels, which are dealt by the bytes that all windows of a band have in common; they are sorted like all others.
5. Each text gets the repeated windows of its runs, and what they cover is removed.

Anchors are told apart by 64 bits, runs of one anchor by 64 bits more. A Bloom filter of fixed size keeps texts that can't be
concerned out of the joins.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows that repeat a doc_id and text are copies
like any other, so they lose all from LENGTH bytes on; rows with a null doc_id are treated alike; texts are cut at any byte,
so what is kept needn't be valid UTF-8; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import suffixes

LENGTH, KMER = 200, 64
#: Bytes of runs in a shard, different runs of an anchor that aren't cut into bands, and levels of a band.
SHARD_BYTES, HOT, BAND = 16 << 20, 2048, 17
#: Bits of the Bloom filter (8 MB).
BLOOM_BITS = 26
_BYTE = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) * C.U64(2) + C.U64(1)
_STEP = [pow(0x9FB21C651E98DF25, 1 << k, 1 << 64) for k in range(8)]
_AT = C.U64((1 << 28) - 1)


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, kmer: int = KMER):
    """Of each run: anchor, run hash, row, first window in the row, windows, bytes from the first window to the anchor. kmer is a power of 2."""
    n, width = len(data), length - kmer + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (C.U64, C.U64, np.int64, np.int64, np.int64, np.int64))
    h, size = _BYTE[data], 1
    for k in range(kmer.bit_length() - 1):
        h = h[:-size] * C.U64(_STEP[k]) + h[size:]
        size *= 2
    h = C.mix(h)
    least, size = (h & ~_AT) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    place = (least & _AT).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(valid, at[long], 1)
    np.add.at(valid, at[long + 1] - length + 1, -1)
    valid = np.cumsum(valid[: len(place)]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    new[at[long]] = True
    start = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(at, start, "right") - 1
    return h[place[start]], C.span_hashes(data, start, end + length - 1), row, start - at[row], end - start, place[start] - start


#: A text: doc_id (0 for null) and a hash of doc_id and text.
_TEXT = ["doc", "rid"]


def _source(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), "text", F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64("doc_id", "text").alias("rid"))


def all_runs(source: DataFrame, length: int, kmer: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("left", pa.int32())])

    def run(batches):
        for rows, data, at in C.parts(batches):
            a, c, row, start, n, left = runs(data, at, length, kmer)
            take = pa.array(row)
            yield C.batch(schema, C.i64(a), C.i64(c), rows.column("doc").take(take), rows.column("rid").take(take), start, n, left)

    return source.where(F.octet_length("text") >= length).select(*_TEXT, "text").mapInArrow(run, "a long, c long, doc long, rid long, start int, n int, left int")


def _bloom(rids: DataFrame) -> np.ndarray:
    """Bits of the ids' places: BLOOM_BITS bits, however many ids."""
    place = F.shiftrightunsigned("rid", 64 - BLOOM_BITS)
    word = rids.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    got = C.fetch(word)
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bits[got["word"]] = got["bits"].astype(np.int64).view(np.uint64)
    return bits


def _maybe(bits: np.ndarray, rid: np.ndarray) -> np.ndarray:
    place = rid.view(np.uint64) >> C.U64(64 - BLOOM_BITS)
    return (bits[(place >> C.U64(6)).astype(np.int64)] >> (place & C.U64(63))) & C.U64(1) > 0


def _near(source: DataFrame, bits) -> DataFrame:
    """Key and text of the rows that may be among the ids of a Bloom filter."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_maybe(bits.value, b.column("rid").to_numpy())))

    return source.select(*_TEXT, "text").mapInArrow(run, "doc long, rid long, text string")


def _contents(source: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """kinds (a, c, many, crowd, left, n and, in one, where it stands) with the bytes of each run as content."""
    spark = source.sparkSession
    bits = spark.sparkContext.broadcast(_bloom(kinds.select("one.rid")))
    wants = kinds.groupBy("one.doc", "one.rid").agg(F.collect_list(F.struct("a", "c", "many", "crowd", "left", "n", F.col("one.start").alias("start"))).alias("runs"))
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("many", pa.bool_()), ("crowd", pa.bool_()), ("left", pa.int32()), ("n", pa.int32()), ("content", pa.binary())])

    def cut_out(batches):
        for b in batches:
            data, at = C.buffer(b.column("text"))
            want = b.column("runs")
            first = want.offsets.to_numpy()
            col = {k: want.values.field(k).to_numpy(zero_copy_only=False)[first[0] : first[-1]] for k in ("a", "c", "many", "crowd", "left", "n", "start")}
            begin = np.repeat(at[:-1], np.diff(first)) + col["start"]
            for lo in range(0, len(begin), 1 << 14):
                k = slice(lo, lo + (1 << 14))
                size = col["n"][k].astype(np.int64) + length - 1
                to = np.r_[0, np.cumsum(size)]
                raw = data[np.arange(to[-1]) + np.repeat(begin[k] - to[:-1], size)]
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)])
                yield C.batch(schema, *(col[x][k] for x in ("a", "c", "many", "crowd", "left", "n")), content)

    # a text that stands in several rows is asked once
    texts = wants.hint("merge").join(_near(source, bits), _TEXT).dropDuplicates(_TEXT)
    return texts.select("text", "runs").mapInArrow(cut_out, "a long, c long, many boolean, crowd boolean, left int, n int, content binary")


def _dealt(contents: DataFrame, length: int, kmer: int) -> DataFrame:
    """The sorter's runs: a, c of the run, window of its level 0 (base), group, many, core, first, left, content; runs of crowded anchors in bands."""
    first = F.col("left") - F.col("n") + 1
    cool = contents.where("not crowd").select("a", "c", F.col("left").alias("base"), F.col("a").alias("group"), "many", F.lit(kmer).alias("core"), first.alias("first"), "left", "content")
    levels = length - kmer + 1
    band = contents.where("crowd").withColumn("d0", F.explode(F.sequence(F.lit(0), F.lit(levels - 1), F.lit(BAND)))).withColumn("d1", F.least(F.col("d0") + BAND, F.lit(levels)))
    band = band.withColumn("first", first).where("first < d1 and left >= d0").withColumn("lo", F.greatest("first", "d0")).withColumn("hi", F.least("left", F.col("d1") - 1))
    core = F.lit(length + 1) - F.col("d1") + F.col("d0")
    common = F.substring("content", F.col("left") - F.col("d0") + 1, core)
    part = F.substring("content", F.col("left") - F.col("hi") + 1, F.col("hi") - F.col("lo") + length)
    hot = band.select("a", "c", (F.col("left") - F.col("d0")).alias("base"), F.xxhash64("d0", common).alias("group"), "many", core.alias("core"), (F.col("lo") - F.col("d0")).alias("first"), (F.col("hi") - F.col("d0")).alias("left"), part.alias("content"))
    return cool.unionByName(hot)


def sort_shard(batches, length: int, memory: int | None = None):
    """Record batches of a, c, lo, hi (repeated windows of a run) from those of a shard of _dealt()."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    sorter = suffixes.Sorter(length, memory)
    names = suffixes.Spool(sorter.scratch, [("a", "i8"), ("c", "i8"), ("base", "i4")])
    for b in batches:
        if not b.num_rows:
            continue
        data, at = C.buffer(b.column("content"))
        col = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("a", "c", "base", "group", "many", "core", "first", "left")}
        sorter.add(C.U64(0) + col["group"].view(C.U64), col["many"], col["core"], col["first"], col["left"], data, at)
        name = np.empty(b.num_rows, names.dtype)
        for k in names.dtype.names:
            name[k] = col[k]
        names.add(name)
    name = names.array()
    for run, lo, hi in sorter.repeats():
        if len(run):
            of = name[run]
            yield C.batch(schema, of["a"], of["c"], (of["base"] - hi).astype(np.int32), (of["base"] - lo + 1).astype(np.int32))


def repeated(source: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc, rid, spans array<struct<lo, hi>>: the byte ranges of each text that repeated windows cover."""
    # what goes into a join is a table, so that adaptive execution can split the join's hot keys
    every = C.cut(all_runs(source, length, kmer))
    twice = C.cut(every.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"))
    found = C.cut(every.hint("merge").join(twice, "a"))
    kinds = C.cut(found.groupBy("a", "c", "left", "n").agg((F.count("*") > 1).alias("many"), F.min(F.struct("doc", "rid", "start")).alias("one")))
    size = kinds.agg(F.coalesce(F.sum(F.col("n") + length - 1), F.lit(0))).first()[0]
    crowded = C.cut(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("a", F.lit(True).alias("crowd")))
    kinds = kinds.join(crowded, "a", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = _dealt(_contents(source, kinds, length), length, kmer).repartition(shards, "group")
    marks = dealt.mapInArrow(lambda batches: sort_shard(batches, length), "a long, c long, lo int, hi int")
    marked = C.cut(marks.groupBy("a", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")))
    ranges = found.hint("merge").join(marked, ["a", "c"]).select(*_TEXT, F.explode(F.transform("marks", lambda m: F.struct((F.col("start") + m["lo"]).alias("lo"), (F.col("start") + m["hi"] + length - 1).alias("hi")))).alias("r"))
    return ranges.groupBy(*_TEXT).agg(F.collect_set("r").alias("spans"))


def _covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.r_[True, lo[1:] > hi[:-1]] if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return lo[first], hi[np.r_[first[1:], len(lo)] - 1] if len(first) else hi


def _kept(batch: pa.RecordBatch):
    """Of each row: bytes, bytes removed, removed ranges, bytes kept."""
    data, at = C.buffer(batch.column("text"))
    spans = batch.column("spans")
    first = spans.offsets.to_numpy()
    lo, hi = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
    raw = data.tobytes()
    for r in range(batch.num_rows):
        text = raw[at[r] : at[r + 1]]
        a, b = _covered(lo[first[r] : first[r + 1]], hi[first[r] : first[r + 1]])
        kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
        yield len(text), len(text) - len(kept), len(a), kept


def _with_spans(source: DataFrame, length: int, kmer: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their spans, rows without any)."""
    found = C.cut(repeated(source, length, kmer))
    bits = source.sparkSession.sparkContext.broadcast(_bloom(found))
    schema = source.schema

    def some(batches, want=True):
        for b in batches:
            hit = _maybe(bits.value, b.column("rid").to_numpy())
            yield b.filter(pa.array(hit if want else ~hit))

    joined = source.mapInArrow(some, schema).hint("merge").join(found, _TEXT, "left")
    return joined, source.mapInArrow(lambda x: some(x, False), schema)


def spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    source = _source(docs).withColumn("text", F.coalesce("text", F.lit("")))
    some, rest = _with_spans(source, length, kmer)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            n, removed, many, kept = zip(*_kept(b), strict=True) if b.num_rows else ((), (), (), ())
            yield C.batch(schema, b.column("doc_id"), list(n), list(removed), list(many), [hashlib.sha256(x).hexdigest() for x in kept])

    some = some.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    some = some.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return some.unionByName(rest)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return spans(C.read(spark, sf_dir, "documents"))
