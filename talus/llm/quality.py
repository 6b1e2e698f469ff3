"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from distributed moment sums over all labelled rows (none sampled). Each
covariance is shrunk towards the pooled one and a multiple of the identity, factored by Cholesky once, and the
factors are used for every document: the score is the logistic of the difference of the two log densities.

Defined cases: null and empty texts have the statistics of an empty text and get a score; rows with a null
doc_id are scored, and labels with a null doc_id or quality are ignored; repeated rows count and are returned as
often as they stand; with no label of one class every score is the smoothed share of class 1, and keep() keeps all rows; extra columns of
the input are left out of the result of score() and kept by keep().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from . import common as C

FEATURES = ("bytes", "words", "word_len", "word_len_sd", "upper", "digit", "symbol", "mark", "not_ascii", "stop", "comma", "odd_end", "no_letter", "repeat", "distinct", "focus", "pairs", "shout", "lines", "same_lines", "short", "long")
D = len(FEATURES)
THRESHOLD, SHRINK, RIDGE = 0.3, 0.15, 0.02

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*@^~|\\<>{}[]=_+`/"]] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[[ord(c) for c in "!?;:\"'()-"]] = 1
_END = np.zeros(256, np.uint8)
_END[[ord(c) for c in "#$%&*@^~|!\\<>{}[]=_+`/"]] = 1


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, D) float32: logs of sizes, and log odds of shares with half a count added to each side."""
    n = len(at) - 1
    odds = lambda k, total: np.log((k + 0.5) / (np.maximum(total - k, 0) + 0.5))
    bytes_ = np.diff(at).astype(float)
    s, e, first = C.words(data, at)
    n_words = np.diff(first).astype(float)
    size = (e - s).astype(float)
    per = lambda v: C.sums(v, first)
    mean = per(size) / np.maximum(n_words, 1)
    sd = np.sqrt(np.maximum(per(size * size) / np.maximum(n_words, 1) - mean**2, 0))
    h = C.span_hashes(data, s, e)
    row = np.repeat(np.arange(n), np.diff(first))
    upper, letter = _UPPER[data], C.LETTER[data]
    by_word = lambda table: np.add.reduceat(table, s, dtype=np.int32) if len(s) else np.zeros(0, np.int32)  # noqa: E731  what stands between words is white space: 0
    word_letters = by_word((letter | (data >= 128)).astype(np.uint8))
    word_upper = by_word(upper)
    same = np.zeros(len(h), np.uint8)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = h ^ C.mix(row.astype(C.U64))
    distinct, focus = _counts(key, row, n)
    pair = (key[:-1] * C.U64(3) + h[1:] * C.U64(0x9E3779B97F4A7C15))[row[1:] == row[:-1]] if len(h) > 1 else key[:0]
    pairs, _ = _counts(pair, row[1:][row[1:] == row[:-1]] if len(h) > 1 else row[:0], n)
    ls, le, lfirst = C.spans(data != 10, at)
    lrow, lines = np.repeat(np.arange(n), np.diff(lfirst)), np.diff(lfirst).astype(float)
    dlines, _ = _counts(C.span_hashes(data, ls, le) ^ C.mix(lrow.astype(C.U64)), lrow, n)
    byte = lambda v: C.sums(v, at)
    letters = byte(letter)
    out = np.stack([
        np.log1p(bytes_), np.log1p(n_words), np.log1p(mean), np.log1p(sd), odds(byte(upper), letters), odds(byte(_DIGIT[data]), bytes_), odds(byte(_SYMBOL[data]), bytes_), odds(byte(_MARK[data]), bytes_),
        odds(byte(data >= 128), bytes_), odds(byte(data == 46), n_words), odds(byte(data == 44), n_words), odds(per(_END[data[e - 1]] if len(e) else e), n_words), odds(per(word_letters == 0), n_words),
        odds(per(same), n_words), np.log((n_words + 1) / (distinct + 1)), np.log((focus + 1) / (n_words + 1)), np.log((n_words + 1) / (pairs + 1)), odds(per((word_upper == word_letters) & (word_letters > 1)), n_words),
        np.log((n_words + 1) / (lines + 1)), np.log((lines + 1) / (dlines + 1)), odds(per(size <= 2), n_words), odds(per(size >= 12), n_words),
    ], 1)
    return out.astype(np.float32)


def _counts(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: distinct keys, and the count of its commonest key. Equal keys are of one row."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(key)
    k, r = key[order], row[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    many = np.diff(np.r_[start, len(k)])
    most = np.zeros(n)
    np.maximum.at(most, r[start], many)
    return np.bincount(r[start], minlength=n).astype(float), most


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f array<float>, one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float32()))])

    def run(batches):
        for rows, data, at in C.parts(batches):
            f = statistics(data, at)
            yield C.batch(schema, rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * D), pa.array(f.ravel())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<float>")


def fit(feats: DataFrame, labels: DataFrame) -> dict:
    """The model from features and (doc_id, quality) rows, from moment sums: D (D + 1) + 1 numbers a class reach the driver."""
    schema = pa.schema([("y", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def moments(batches):
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            y = b.column("quality").to_numpy(zero_copy_only=False)
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, D).astype(float)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.r_[len(z), z.sum(0), (z.T @ z).ravel()]
        for k in (0, 1):
            yield C.batch(schema, np.full(total.shape[1], k), np.arange(total.shape[1]), total[k])

    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    got = C.fetch(feats.join(known, "doc_id").select("quality", "f").mapInArrow(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")))
    total = np.zeros((2, 1 + D + D * D))
    total[got["y"], got["i"]] = got["v"]
    n = total[:, 0]
    model = {"prior": float((n[1] + 1) / (n.sum() + 2)), "classes": None}
    if n.min() < 1:
        return model
    mean = total[:, 1 : D + 1] / n[:, None]
    scatter = [total[k, D + 1 :].reshape(D, D) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = sum(scatter) / n.sum()
    scale = np.diag(pooled).clip(1e-6)
    model["classes"] = []
    for k in (0, 1):
        cov = (1 - SHRINK) * scatter[k] / n[k] + SHRINK * pooled + RIDGE * np.diag(scale)
        low = np.linalg.cholesky(cov)
        model["classes"].append((mean[k], np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), float(np.log((n[k] + 1) / (n.sum() + 2)))))
    return model


def posterior(model: dict, x: np.ndarray) -> np.ndarray:
    if model["classes"] is None:
        return np.full(len(x), model["prior"])
    density = [prior - 0.5 * (logdet + (((x - mean) @ inv.T) ** 2).sum(1)) for mean, inv, logdet, prior in model["classes"]]
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; labels of held-out documents are not learned from."""
    feats = C.cut(features(docs))
    model = fit(feats, labels.where(~C.held_out("doc_id", mod, rest)))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, D).astype(float)
            yield C.batch(schema, b.column("doc_id"), posterior(model, x))

    scored = feats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(C.held_out("doc_id", mod, rest), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose text scores under threshold; all rows where the labels have one class only."""

    def measured(batches):
        for rows, data, at in C.parts(batches):
            f = statistics(data, at)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * D), pa.array(f.ravel()))
            yield rows.append_column("__statistics", column)

    known = C.cut(docs.mapInArrow(measured, StructType([*docs.schema.fields, StructField("__statistics", ArrayType(FloatType()))])))
    model = fit(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__statistics").alias("f")), labels.where(~C.held_out("doc_id", mod, rest)))
    if model["classes"] is None:
        return known.drop("__statistics")

    def run(batches):
        for b in batches:
            x = b.column("__statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, D).astype(float)
            yield b.drop_columns(["__statistics"]).filter(pa.array(posterior(model, x) >= threshold))

    return known.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
