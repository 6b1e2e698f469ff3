"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts byte trigrams inside words (with word edges) for each language over all training documents, and
the letters of each script. A word's score in a language is the mean-centred sum of its trigrams' log
probabilities; languages that hardly use the word's script are no candidates. Viterbi with a penalty for each
switch labels every word, so a text may hold spans of several languages; the document's language is the one with
most letters in its spans.

Defined cases: null text and text without a letter give `und` with score 0; rows with a null doc_id are labelled
but not learned from; repeated rows count and are returned as often as they stand; with nothing learned every
text is `und`; ties go to the language that sorts first; extra columns are ignored. There may be any number of languages.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bins of the trigram table: BINS * languages counts are all that reaches the driver.
BINS = 1 << 15
#: Nats that a change of language between two words costs, and the share of its letters that makes a language a candidate for a script.
SWITCH, SCRIPT_SHARE = 12.0, 0.005
#: Score that leaves a language out, and numbers that word scores take at a time (more languages mean fewer bytes and words at once).
IMPOSSIBLE, WORK = -1e9, 1 << 24

# First code points of script ranges (letters up to the next entry are of that script).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x31350, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_AT = np.array([at for at, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int8)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def letter_marks(data: np.ndarray) -> np.ndarray:
    """Of each byte: script number where a letter starts, else -1."""
    out = np.full(len(data), -1, np.int8)
    out[C.LETTER[data]] = SCRIPT_NAMES.index("latin")
    for at, size in ((np.flatnonzero((data >= 0xC0) & (data < 0xE0)), 2), (np.flatnonzero((data >= 0xE0) & (data < 0xF0)), 3), (np.flatnonzero(data >= 0xF0), 4)):
        at = at[at + size <= len(data)]
        if len(at):
            point = data[at].astype(np.int64) & (0xFF >> (size + 1))
            for k in range(1, size):
                point = (point << 6) | (data[at + k] & 0x3F)
            point = np.minimum(point, 0x10FFFF)
            is_letter = _letters()[point]
            out[at[is_letter]] = _SCRIPT_OF[np.searchsorted(_SCRIPT_AT, point[is_letter], "right") - 1]
    return out


def trigrams(data: np.ndarray) -> np.ndarray:
    """Of each byte: the bin of the three bytes around it, in lower case, white space and marks as one symbol."""
    x = np.where(C.WORDY[data], C.LOWER[data], np.uint8(32)).astype(np.uint32)
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = x[:-1], x[1:]
    return ((((before << 16) | (x << 8) | after) * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)


def learn(docs: DataFrame) -> dict:
    """The model from (text, lang): trigram counts and script shares of each language."""
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for rows, data, at in C.parts(batches):
            langs = np.array(rows.column("lang").to_pylist(), object)
            bins, script = trigrams(data), letter_marks(data)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            names, code = np.unique(langs.astype(str), return_inverse=True)
            own, word = code[row], C.WORDY[data]
            grams = np.bincount((own * BINS + bins)[word], minlength=len(names) * BINS).reshape(-1, BINS)
            marks = np.bincount((own * len(SCRIPT_NAMES) + script)[script >= 0], minlength=len(names) * len(SCRIPT_NAMES)).reshape(len(names), -1)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + np.r_[grams[k], marks[k]]
        for name, n in total.items():
            i = np.flatnonzero(n)
            yield C.batch(schema, pa.array([name] * len(i)), i, n[i])

    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    got = C.fetch(known.mapInArrow(count, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")))
    langs = sorted(set(got["lang"]))
    if not langs:
        return {"langs": []}
    n = np.zeros((len(langs), BINS + len(SCRIPT_NAMES)))
    n[[langs.index(x) for x in got["lang"]], got["i"]] = got["n"]
    grams, marks = n[:, :BINS], n[:, BINS:]
    logp = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BINS))
    share = marks / np.maximum(marks.sum(1, keepdims=True), 1)
    able = share >= SCRIPT_SHARE
    able[:, ~able.any(0)] = True
    return {"langs": langs, "logp": np.ascontiguousarray((logp - logp.max(0)).T, np.float32), "able": able.T}


def word_scores(model: dict, data: np.ndarray, at: np.ndarray):
    """Words that have a letter: scores (words, languages), letters, and the first such word of each row (n + 1)."""
    s, e, first = C.words(data, at)
    script = letter_marks(data)
    if not len(s):
        return np.zeros((0, len(model["langs"])), np.float32), np.zeros(0, np.int64), first
    letters = np.add.reduceat((script >= 0).astype(np.uint8), s, dtype=np.int64)
    bins, wordy = trigrams(data), C.WORDY[data]
    score = np.empty((len(s), len(model["langs"])), np.float32)
    step, a = max(1, WORK // len(model["langs"])), 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(s, s[a] + step)))
        lo, hi = s[a], s[b] if b < len(s) else len(data)
        # what stands between words adds nothing
        score[a:b] = np.add.reduceat(np.where(wordy[lo:hi, None], model["logp"][bins[lo:hi]], np.float32(0)), s[a:b] - lo, axis=0)
        a = b
    main = np.maximum.reduceat(script, s)
    score += np.where(model["able"][main], np.float32(0), np.float32(IMPOSSIBLE))
    has = letters > 0
    return score[has], letters[has], np.r_[0, np.cumsum(has)][first]


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word on its row's best path; all rows advance together, a word at a time."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, size = first[:-1][order], n[order]
    label = np.zeros(len(score), np.int32)
    if not len(score):
        return label
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # rows with more than t words
    switched = np.zeros((len(score), -(-score.shape[1] // 8)), np.uint8)  # bit l: the best way to l came from another language
    came = np.zeros(len(score), np.int32)  # from which
    best = score[start[: active[0]]].astype(np.float32)
    for t in range(1, size[0]):
        k = active[t]
        at = start[:k] + t
        best = best[:k]
        lead = best.argmax(1)
        top = np.take_along_axis(best, lead[:, None], 1) - np.float32(switch)
        moved = top > best
        best = np.where(moved, top, best) + score[at]
        switched[at] = np.packbits(moved, axis=1)
        came[at] = lead
        if t % 64 == 0:
            best -= best.max(1, keepdims=True)
    # back from each row's last word; a row's best scores are those when it ended, so they are computed as rows end
    final = _final(score, start, size, active, switch)
    now = final.astype(np.int64)
    for t in range(size[0] - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        label[at] = now[:k]
        turn = (switched[at, now[:k] >> 3] >> (7 - (now[:k] & 7)).astype(np.uint8)) & 1 > 0
        now[:k] = np.where(turn, came[at], now[:k])
    return label


def _final(score, start, size, active, switch):
    """The best last label of each row."""
    out = np.zeros(len(size), np.int32)
    best = score[start[: active[0]]].astype(np.float32)
    for t in range(1, size[0] + 1):
        k = active[t] if t < size[0] else 0
        if k < len(best):
            out[k : len(best)] = best[k:].argmax(1)
            best = best[:k]
        if t < size[0]:
            top = best.max(1, keepdims=True)
            best = np.maximum(best, top - np.float32(switch)) + score[start[:k] + t]
            if t % 64 == 0:
                best -= best.max(1, keepdims=True)
    return out


def label_spans(model: dict, batch, column: str = "text"):
    """Of a record batch: word labels, letters of each word, first word of each row."""
    score, letters, firsts = [], [], [np.zeros(1, np.int64)]
    for _, data, at in C.parts([batch], column):
        s, n, first = word_scores(model, data, at)
        firsts.append(first[1:] + firsts[-1][-1])
        score.append(s)
        letters.append(n)
    first = np.concatenate(firsts)
    if not score:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), first
    return viterbi(np.concatenate(score), first), np.concatenate(letters), first


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, n_spans (maximal runs of one language) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())])
    names = np.array([*model["langs"], "und"], object)

    def run(batches):
        k = len(model["langs"])
        for b, _, _ in C.parts(batches, limit=max(C.SLICE_BYTES, 8 * WORK // max(1, k))):
            n = b.num_rows
            pred, share, turns = np.full(n, k), np.zeros(n), np.zeros(n, np.int64)
            if k:
                label, letters, first = label_spans(model, b)
                row = np.repeat(np.arange(n), np.diff(first))
                mass = np.bincount(row * k + label, letters, minlength=n * k).reshape(n, k)
                known = mass.sum(1) > 0
                pred[known] = mass[known].argmax(1)
                share[known] = mass[known].max(1) / mass[known].sum(1)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                turns = np.bincount(row[new], minlength=n)
            yield C.batch(schema, b.column("doc_id"), pa.array(names[pred], pa.string()), share, turns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def identify(docs: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans; learns from the rows that aren't held out."""
    model = learn(docs.where(~C.held_out("doc_id", mod, rest)))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(C.held_out("doc_id", mod, rest), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(C.read(spark, sf_dir, "documents"))
